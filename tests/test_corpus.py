import pytest
from helpers import catalogue, nested, values
from pyspark.sql import functions as F

from crateline.config import Dials
from crateline.operators import corpus as C
from crateline.plans import steps
from crateline.plans.staging import Stage
from crateline.sources import tables as S

SEEDED = ["Dub Techno"]


def dials(**changes):
    return Dials(**{"min_seed_ratio": None, "bridge_min_ratio": None, **changes})


def tally(spark, *releases, **changes):
    d = dials(**changes)
    cat = catalogue(spark, *releases)
    seeds = C.seed_releases(cat, d.seed)
    return dict(values(C.seed_artist_tally(C.seed_appearances(cat, seeds), d), "artist_id", "seed_releases"))


def test_seed_by_tags_and_by_any_predicate(spark):
    releases = [
        {"id": 1, "styles": ["Dub Techno", "Techno"]},
        {"id": 2, "styles": ["House"]},
        {"id": 3, "styles": ["Ambient", "Techno"], "genres": ["Electronic"]},
        {"id": 4, "styles": ["Ambient", "Soundtrack", "Dub Techno"]},
    ]
    assert values(C.seed_releases(catalogue(spark, *releases)), "id") == [1, 3]
    chosen = lambda styles, genres: F.array_contains(styles, "House")
    assert values(C.seed_releases(catalogue(spark, *releases, is_seed=chosen)), "id") == [2]


def test_tally_counts_appearances_without_packaging_or_placeholders(spark):
    got = tally(
        spark,
        {"id": 1, "styles": SEEDED, "artists": [10, (194, "Various"), (12, "Traditional")], "credits": [(10, "Engineer"), (20, "Engineer"), (0, "Producer")]},
        {"id": 2, "styles": SEEDED, "artists": [10], "credits": [(21, "Photography By"), (22, "Artwork, Design")]},
        {"id": 3, "styles": ["House"], "artists": [30]},
    )
    assert got == {10: 3, 20: 1}


def test_seed_ratio_drops_those_who_mostly_work_elsewhere(spark):
    releases = [{"id": 1, "styles": SEEDED, "artists": [10, 11]}]
    releases += [{"id": i, "styles": ["House"], "artists": [10]} for i in range(2, 11)]
    cat = catalogue(spark, *releases)
    people = C.appearances(cat)
    d = dials(min_seed_ratio=0.2)
    counted = C.seed_artist_tally(C.seed_appearances(cat, C.seed_releases(cat)), d)
    totals = C.artist_totals(people, counted)
    assert values(C.seed_artists(counted, totals, 0.2), "artist_id", "seed_releases", "total_releases") == [(11, 1, 1)]
    assert values(C.seed_artists(counted, totals, None), "artist_id", "total_releases") == [(10, None), (11, None)]


def seed_labels(spark, *releases, floor=2, ratio=0.05):
    d = dials(label_min_artists=floor, label_min_ratio=ratio)
    return values(
        steps.select_seed(catalogue(spark, *releases), d, Stage(spark)).labels,
        "label_id", "seed_artist_count", "total_artist_count",
    )


def test_label_floor_ratio_and_distinct_roster(spark):
    seeded = {"id": 1, "styles": SEEDED, "artists": [1, 2], "labels": [500]}
    filler = lambda id, artists: {"id": id, "styles": ["House"], "artists": artists, "labels": [500]}
    assert seed_labels(spark, seeded, filler(2, [3])) == [(500, 2, 3)]
    assert seed_labels(spark, {**seeded, "artists": [1]}, filler(2, [3])) == []
    assert seed_labels(spark, seeded, filler(2, list(range(3, 101)))) == []
    assert seed_labels(spark, seeded, filler(2, [1, 3])) == [(500, 2, 3)]
    assert seed_labels(spark, seeded, filler(2, list(range(3, 23))), ratio=0.5) == []


def test_labels_without_id_and_placeholders_are_counted_and_keep_their_slot(spark):
    cat = catalogue(
        spark,
        {"id": 1, "artists": [1], "labels": [(None, "x"), (1818, "Not on Label"), (1818, "not On label (b)"), (500, "L"), (None, "y")]},
    )
    assert values(C.label_artist_pairs(cat, dials()), "label_id", "artist_id") == [(500, 1)]
    assert C.label_ref_stats(cat.label_refs, dials()).head().asDict() == {
        "labels_without_id": 2, "placeholder_labels": 2, "usable_labels": 1,
    }
    assert values(S.corpus_tables(cat, dials())["release_labels"], "position", "label_id") == [(3, 500)]


# --- one hop --------------------------------------------------------------------------------


def expand(spark, releases, seeds=(), labels=(), totals=None, **changes):
    d = dials(**{"max_people_to_admit": 8, **changes})
    cat = catalogue(spark, *releases)
    artists = spark.createDataFrame(
        [(i, n) for i, n in (seeds.items() if isinstance(seeds, dict) else [(i, 1) for i in seeds])],
        "artist_id bigint, seed_releases bigint",
    )
    none = spark.createDataFrame([], "artist_id bigint, total bigint")
    chosen = spark.createDataFrame([(i,) for i in labels], "label_id bigint")
    seeded = C.seed_releases(cat)
    counted = C.artist_totals(C.appearances(cat), artists) if d.bridge_min_ratio else none
    seed = steps.Seed(None, seeded, artists, counted, artists, chosen)
    made = steps.expand(cat, seed, d, Stage(spark))
    kept = {r.id: (r.is_seed, r.channel_a, r.channel_b) for r in made["releases"].collect()}
    people = {r.artist_id: (r.is_seed, r.channel_a, r.channel_b) for r in made["corpus_artists"].collect()}
    return kept, people, made


A, B, AB = (False, True, False), (False, False, True), (False, True, True)


def test_channels(spark):
    releases = [
        {"id": 1, "artists": [10]},
        {"id": 2, "artists": [50], "credits": [(10, "Artwork")]},
        {"id": 3, "artists": [99], "labels": [500]},
        {"id": 4, "artists": [10], "labels": [500]},
        {"id": 5, "artists": [51], "labels": [501]},
        {"id": 6, "artists": [194], "labels": [(500, "Not On Label")]},
    ]
    kept, people, made = expand(spark, releases, [10], [500])
    assert kept == {1: A, 2: A, 3: B, 4: AB}
    assert values(made["release_artists"], "release_id") == [1, 2, 3, 4]
    assert people[10] == (True, True, True) and people[99] == B and people[50] == A


def test_one_hop_only(spark):
    kept, people, _ = expand(spark, [{"id": 1, "artists": [10, 11]}, {"id": 2, "artists": [11, 12]}], [10])
    assert kept == {1: A} and people == {10: (True, True, False), 11: A}


def test_tie_dial(spark):
    releases = [{"id": 1, "artists": [10, 11, 12]}, {"id": 2, "artists": [10, 12]}]
    _, people, _ = expand(spark, releases, [10], min_ties=2)
    assert set(people) == {10, 12}


def test_seed_releases_stay_with_their_flag(spark):
    releases = [
        {"id": 1, "artists": [10], "styles": SEEDED},
        {"id": 2, "artists": [11], "styles": SEEDED},
    ]
    kept, _, _ = expand(spark, releases, [10])
    assert kept == {1: (True, True, False), 2: (True, False, False)}


def test_bridge_ratio_keeps_the_unmeasured(spark):
    releases = [{"id": i, "artists": [10]} for i in (1, 2, 3)] + [{"id": 4, "artists": [11]}]
    kept, people, _ = expand(spark, releases, [10, 11, 77], bridge_min_ratio=0.5)
    assert set(kept) == {4} and set(people) == {10, 11, 77}


def test_crowds_admit_nobody_new_but_are_kept(spark):
    kept, people, _ = expand(spark, [{"id": 1, "artists": list(range(10, 20))}], [10], max_people_to_admit=8)
    assert kept == {1: A} and people == {10: (True, False, False)}
    kept, people, _ = expand(spark, [{"id": 1, "artists": list(range(10, 20)), "labels": [500]}], [10], [500])
    assert people[19] == B


def test_authorship_alone_admits_nobody(spark):
    credits = [(20, "Composed By"), (21, "Written-By"), (22, "Engineer"), (23, "Producer, Written-By"), (24, "Written-By"), (24, "Producer")]
    _, people, _ = expand(spark, [{"id": 1, "artists": [10], "credits": credits}], [10])
    assert set(people) == {10, 22, 24}


def test_whole_selection_is_repeatable_and_reports_what_it_did(spark):
    releases = [
        {"id": 1, "styles": SEEDED, "artists": [1, 2], "credits": [(3, "Mixed By"), (4, "Design")], "labels": [500]},
        {"id": 2, "styles": ["House"], "artists": [5], "labels": [500]},
        {"id": 3, "styles": ["House"], "artists": [6], "credits": [(1, "Remix")], "labels": [(None, "x")]},
        {"id": 4, "styles": ["House"], "artists": [7]},
    ]
    d = dials(label_min_artists=2, label_min_ratio=0.5, min_seed_ratio=0.02)
    cat = catalogue(spark, *releases)
    runs = [steps.select_corpus(cat, d, Stage(spark)) for _ in range(2)]
    for table in ("releases", "corpus_artists", "release_labels", "seed_labels"):
        columns = runs[0][table].columns
        assert values(runs[0][table], *columns) == values(runs[1][table], *columns)
    assert values(runs[0]["releases"], "id") == [1, 2, 3]
    assert dict(values(runs[0]["roles_seen"], "role", "occurrences")) == {"Design": 1, "Mixed By": 1, "Remix": 1}
    seed = steps.select_seed(cat, d, Stage(spark))
    stats = C.pass1_stats(
        cat, seed.releases, C.seed_appearances(cat, seed.releases), seed.tally, seed.artists, seed.pairs, seed.labels, d
    ).head().asDict()
    assert stats == {
        "scanned": 4, "seed_releases": 1, "seed_artists": 3, "candidate_labels": 1, "seed_labels": 1, "distinct_roles": 2,
        "packaging_credits": 1, "labels_without_id": 1, "placeholder_labels": 0, "seed_candidates": 3, "dropped_by_ratio": 0,
    }


def test_records_and_flat_tables_select_the_same(spark):
    releases = [
        {"id": i, "styles": SEEDED if i % 3 == 0 else ["House"], "artists": [i % 7 + 1, i % 5 + 20], "credits": [(i % 4 + 40, "Mixed By")], "labels": [i % 3 + 500]}
        for i in range(1, 40)
    ]
    d = Dials(label_min_artists=2, label_min_ratio=0.5, min_seed_ratio=0.3, bridge_min_ratio=0.35)
    records = nested(spark, *releases)
    cat = C.from_records(records)
    flat = C.Catalogue(cat.releases.drop("is_seed"), cat.line, cat.credits, cat.label_refs, cat.styles, cat.genres)
    one, two = (steps.select_corpus(c, d, Stage(spark)) for c in (cat, flat))
    tables = ("releases", "corpus_artists", "release_artists", "release_labels", "release_styles", "seed_labels", "label_artist_pairs")
    for table in tables:
        columns = one[table].columns
        assert values(one[table], *columns) == values(two[table], *columns)
    assert one["releases"].count() >= 13


def test_flatten_keeps_positions_and_tag_sets(spark):
    cat = catalogue(spark, {"id": 1, "artists": [3, 1], "styles": ["a", "b", "a"], "genres": ["g"]})
    assert values(cat.line, "position", "artist_id") == [(0, 3), (1, 1)]
    assert values(cat.styles, "style") == ["a", "b"]
    assert nested(spark, {"id": 1}).count() == 1


@pytest.mark.parametrize("seq, want", [("asc", "first"), ("desc", "last")])
def test_write_conflicts(spark, seq, want):
    from crateline.operators import relational as R

    df = spark.createDataFrame([(1, 1, "first"), (1, 2, "last"), (2, 1, "only")], "k int, s int, v string")
    got = R.ignore_by_key(df, ["k"], ["s"]) if seq == "asc" else R.replace_by_key(df, ["k"], "s")
    assert values(got, "k", "v") == [(1, want), (2, "only")]
    assert R.ignore_by_key(df, ["k"]).count() == 2
