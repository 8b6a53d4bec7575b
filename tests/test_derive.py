import itertools
import random
from collections import defaultdict

import pytest
from helpers import corpus, values
from pyspark.sql import functions as F

from crateline.config import TRADITIONS, Dials, Tradition
from crateline.operators import derive as D
from crateline.plans import steps
from crateline.plans.staging import Stage


def derive(spark, *releases, dials=Dials(), seeds=(), totals=(), extra_artists=()):
    tables = corpus(spark, *releases)
    if seeds:
        tables["seed_artists"] = spark.createDataFrame(list(seeds), tables["seed_artists"].schema)
    if totals:
        tables["seed_artist_totals"] = spark.createDataFrame(list(totals), tables["seed_artist_totals"].schema)
    if extra_artists:
        more = spark.createDataFrame([(i, True, False, False) for i in extra_artists], tables["corpus_artists"].schema)
        tables["corpus_artists"] = tables["corpus_artists"].union(more)
    return steps.derive(tables, tables["labels"], dials, Stage(spark))


def pairs_of(made, artist):
    rows = made["artist_collaborators"].filter(F.col("artist_id") == artist)
    return values(rows, "collaborator_id", "shared_releases", "roles")


def test_pairs_roles_and_no_self_pairs(spark):
    made = derive(
        spark,
        {"id": 1, "artists": [10, 11]}, {"id": 2, "artists": [10, 11]},
        {"id": 3, "artists": [10, 11], "credits": [(20, "Engineer [Recording]"), (10, "Producer")]},
        {"id": 4, "artists": [10, 12], "credits": [(20, "Mixed By"), (20, "Mixed By")]},
    )
    assert pairs_of(made, 10) == [(11, 3, None), (12, 1, None), (20, 2, ["Engineer [Recording]", "Mixed By"])]
    assert pairs_of(made, 11) == [(10, 3, ["Producer"]), (20, 1, ["Engineer [Recording]"])]
    assert made["artist_collaborators"].filter("artist_id = collaborator_id").count() == 0


def test_crowds_are_not_paired(spark):
    made = derive(spark, {"id": 1, "artists": list(range(100, 125))}, {"id": 2, "artists": [100, 101]})
    assert pairs_of(made, 100) == [(101, 1, None)]
    pairable = D.pairable(made["people_once"], 20)
    tables = corpus(spark, {"id": 1}, {"id": 2})
    assert values(D.releases_skipped(tables["releases"], pairable), "releases_skipped") == [1]


def test_pairs_match_brute_force_beside_a_hot_release(spark):
    """One release holds a third of all rows."""
    draw = random.Random(7)
    rows = [(r, draw.randrange(12), draw.choice([None, "A", "B"])) for r in range(40) for _ in range(draw.randrange(1, 6))]
    rows += [(999, i, "crowd") for i in range(len(rows) // 2)]
    people = spark.createDataFrame(rows, "release_id bigint, artist_id bigint, role string")
    cap = 4
    on = defaultdict(set)
    for release, artist, _ in rows:
        on[release].add(artist)
    shared, roles = defaultdict(int), defaultdict(set)
    for release, members in on.items():
        if len(members) <= cap:
            for a, b in itertools.permutations(members, 2):
                shared[a, b] += 1
                roles[a, b] |= {r for rel, p, r in rows if rel == release and p == b and r}
    want = {(a, b): (n, sorted(roles[a, b]) or None) for (a, b), n in shared.items()}
    got = D.artist_collaborators(people, cap).collect()
    assert {(r.artist_id, r.collaborator_id): (r.shared_releases, r.roles) for r in got} == want
    assert {(r.aid, r.bid): r.n for r in D.pair_counts(people, cap).collect()} == dict(shared)
    assert {(r.aid, r.bid): set(r.roles) for r in D.pair_roles(people, cap).collect()} == {
        pair: held for pair, held in roles.items() if held
    }


def test_label_spans_and_roster(spark):
    made = derive(
        spark,
        {"id": 1, "year": 1994, "artists": [10], "labels": [500, 500]}, {"id": 2, "year": 1998, "artists": [10, 11], "labels": [500]},
        {"id": 3, "year": 2003, "artists": [10], "labels": [501]}, {"id": 4, "artists": [12], "labels": [502]},
    )
    rows = values(made["artist_labels"].filter("artist_id = 10"), "label_id", "release_count", "first_year", "last_year")
    assert rows == [(500, 2, 1994, 1998), (501, 1, 2003, 2003)]
    assert values(made["label_roster"].filter("label_id = 500"), "artist_id", "release_count") == [(10, 2), (11, 1)]
    assert values(made["artist_labels"].filter("artist_id = 12"), "first_year") == [None]


def test_absence_is_told_from_solo_work(spark):
    made = derive(
        spark, {"id": 1, "artists": [10]}, {"id": 2, "artists": [11], "credits": [(11, "Producer")]}, extra_artists=[77]
    )
    rows = values(made["artist_coverage"], "artist_id", "release_count", "credited_releases", "collaborator_count")
    assert rows == [(10, 1, 0, 0), (11, 1, 1, 0), (77, 0, 0, 0)]


def test_displayed_counts_are_distinct_and_shares_reach_the_rejected(spark):
    releases = [
        {"id": 1, "artists": [10], "credits": [(10, "Engineer")]}, {"id": 2, "artists": [10, 20]}, {"id": 3, "artists": [10], "seed": False},
    ]
    made = derive(spark, *releases, seeds=[(10, 3, 4)], totals=[(20, 400)])
    rows = {r.artist_id: r for r in made["artist_coverage"].collect()}
    assert rows[10].seed_releases == 2 and rows[10].seed_share == 0.5
    assert rows[20].seed_releases == 1 and rows[20].seed_share == 1 / 400 and rows[20].relevance == "none"


def graded(spark, seeds):
    releases = [{"id": i, "artists": [s[0]]} for i, s in enumerate(seeds)]
    made = derive(spark, *releases, seeds=seeds)
    return dict(values(made["artist_coverage"], "artist_id", "scene_relevance"))


def test_grades_read_the_seed_tally(spark):
    seeds = [(1, 61, 77), (2, 8, 10), (3, 114, 1079), (4, 1, 1), (5, 25, 5000), (6, 61, None)]
    assert graded(spark, seeds) == {1: "high", 2: "high", 3: "medium", 4: "low", 5: "medium", 6: "medium"}


def reggae(artist, n, first=1, styles=("Dub",), genres=("Reggae",), labels=()):
    return [
        {"id": first + i, "artists": [artist], "styles": list(styles), "genres": list(genres), "labels": list(labels)} for i in range(n)
    ]


def lineage_of(made):
    return {r.artist_id: (r.lineage, r.scene_relevance, r.relevance) for r in made["artist_coverage"].collect()}


def test_lineage_rules_floors_precedence_and_dials(spark):
    releases = (
        reggae(1, 5)  # style and genre: lifted to medium
        + reggae(2, 5, 100, styles=["House"])  # genre alone: low
        + reggae(3, 4, 200)  # too few
        + reggae(4, 5, 300) + reggae(4, 21, 310, styles=["House"], genres=["Rock"])  # share under a fifth
        + reggae(5, 3, 400, styles=[], genres=[], labels=[415])  # by label
        + reggae(6, 5, 500, labels=[415])  # both kinds: tags come first
        + reggae(7, 3, 600, styles=["Dubstep"], genres=[]) + reggae(7, 2, 650, styles=["UK Garage"], genres=[])
        + reggae(8, 5, 700)  # high already: tagged, not promoted
        + reggae(9, 5, 800, genres=["Electronic"])  # the style without its genre
    )
    made = lineage_of(derive(spark, *releases, seeds=[(8, 9, 10)]))
    assert made == {
        1: ("roots dub", "none", "medium"), 2: ("reggae", "none", "low"), 3: (None, "none", "none"), 4: (None, "none", "none"),
        5: ("detroit techno", "none", "medium"), 6: ("roots dub", "none", "medium"),
        7: ("dubstep and uk garage", "none", "medium"), 8: ("roots dub", "high", "high"), 9: (None, "none", "none"),
    }


def test_unknown_floor_is_an_error(spark):
    df = spark.createDataFrame([("none", None)], "relevance string, lineage string")
    with pytest.raises(ValueError):
        D.lineage_floor(df, [Tradition("x", "high", 1, 0.1, styles=("a",))])
    assert D.lineage_floor(df, TRADITIONS).head().relevance == "none"


def test_label_grades_from_pairs_not_rosters(spark):
    releases = [{"id": i, "artists": [i], "labels": [500]} for i in (1, 2)] + [{"id": 3, "artists": [9], "credits": [(1, "Engineer")], "labels": [501]}]
    made = derive(spark, *releases, seeds=[(1, 5, 5), (2, 5, 5)])
    rows = {r.label_id: (r.line_artist_count, r.seed_artist_count, r.seed_ratio, r.relevance) for r in made["label_coverage"].collect()}
    assert rows == {500: (2, 2, 1.0, "high"), 501: (1, 0, 0.0, "none")}
    assert made["label_roster"].filter("label_id = 501").count() == 2
    assert [tuple(r) for r in D.label_grade_histogram(made["label_coverage"]).collect()] == [("high", 1), ("none", 1)]


def test_grading_against_no_pairs_is_refused(spark):
    tables = corpus(spark, {"id": 1, "artists": [1], "labels": [500]})
    tables["label_artist_pairs"] = tables["label_artist_pairs"].limit(0)
    with pytest.raises(ValueError):
        steps.derive(tables, tables["labels"], Dials(), Stage(spark))
    D.pairs_guard(tables["release_labels"].limit(0), tables["label_artist_pairs"])


def test_roles_of_a_hot_release_are_cut_with_its_people(spark):
    """One release of thousands beside small ones: no join, the small ones' roles are whole."""
    hot = spark.range(4000).select(F.lit(1).cast("bigint").alias("release_id"), F.col("id").alias("artist_id"), F.concat(F.lit("r"), F.col("id") % 9).alias("role"))
    small = spark.range(60).select(
        (F.col("id") % 10 + 2).alias("release_id"), (F.col("id") % 3).alias("artist_id"),
        F.when(F.col("id") % 4 > 0, F.concat(F.lit("s"), F.col("id") % 7)).alias("role"),
    )
    people = hot.unionByName(small)
    made = D.artist_collaborators(people, 4)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("WindowGroupLimit") == 2
    held, want = {}, {}
    for r in small.collect():
        held.setdefault(r.release_id, {}).setdefault(r.artist_id, set()).update({r.role} - {None})
    for members in held.values():
        for a in members:
            for b in members:
                if a != b:
                    n, roles = want.get((a, b), (0, set()))
                    want[a, b] = n + 1, roles | members[b]
    got = {(r.artist_id, r.collaborator_id): (r.shared_releases, r.roles) for r in made.collect()}
    assert got == {k: (n, sorted(roles) or None) for k, (n, roles) in want.items()}


def test_pair_roles_from_people_packed_before(spark):
    """Roles packed per person are not packed again, and releases without a role send none."""
    rows = [(1, 10, None), (1, 11, None), (1, 20, "Mixed By"), (2, 10, None), (2, 20, None), (3, 20, "Producer"), (3, 10, None)]
    people = spark.createDataFrame(rows, "release_id bigint, artist_id bigint, role string")
    once = D.people_once(people)
    made = D.pair_roles(people, 4, once.localCheckpoint())
    assert values(made, "aid", "bid", "roles") == [(10, 20, ["Mixed By", "Producer"]), (11, 20, ["Mixed By"])]
    assert values(made, "aid", "bid", "roles") == values(D.pair_roles(people, 4), "aid", "bid", "roles")
    assert "collect_set(role#" not in made._jdf.queryExecution().toString()
    both = D.artist_collaborators(people, 4, once)
    assert values(both.filter("artist_id = 10"), "collaborator_id", "shared_releases", "roles") == [
        (11, 1, None), (20, 3, ["Mixed By", "Producer"])
    ]
    gathered = both._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set(CASE WHEN" in gathered
