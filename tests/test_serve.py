import random

import pytest
from helpers import corpus, values
from pyspark.sql import functions as F

from crateline.config import Dials, SceneLists
from crateline.operators import entities as E
from crateline.functions import text as T
from crateline.operators import measure as M
from crateline.operators import relational as R
from crateline.operators import serve as V
from crateline.plans import steps
from crateline.plans.staging import Stage

SCENE = SceneLists(core_artists=(1,), named_artists=(2,), scene_labels=(500,), alias_floor=2, excluded_ids=(9,), excluded_names=("Artist 8",))


@pytest.fixture(scope="module")
def tables(spark):
    held = corpus(
        spark,
        {"id": 1, "year": 1994, "artists": [1, 3], "credits": [(4, "Producer"), (4, "Mixed By")], "labels": [500]},
        {"id": 2, "year": 2001, "artists": [1, 3], "labels": [501, 501]},
        {"id": 3, "artists": [3, 5], "labels": [502]},
        {"id": 4, "year": 2001, "artists": [2, 6, 8, 9], "labels": [501, 500]},
        {"id": 5, "year": 1990, "artists": [7], "labels": [503]},
    )
    held["artists"] = held["corpus_artists"].select(
        F.col("artist_id").alias("id"), F.concat(F.lit("Artist "), "artist_id").alias("name"),
        F.lit(None).cast("string").alias("real_name"), F.lit(None).cast("string").alias("profile"),
        F.lit(None).cast("array<string>").alias("urls"),
    )
    held["labels"] = held["labels"].select("*", F.lit(None).cast("string").alias("profile"), F.lit(None).cast("array<string>").alias("urls"))
    held["artist_relations"] = spark.createDataFrame(
        [(1, 3, "alias", "Three"), (5, 1, "alias", "One"), (1, 6, "member", "Six"), (2, 99, "alias", "Gone"), (2, 98, "group", "")],
        "artist_id bigint, related_id bigint, kind string, related_name string",
    )
    held["artist_search"] = E.search_index(held["artists"])
    held["label_search"] = E.search_index(held["labels"])
    return {**held, **steps.derive(held, held["labels"], Dials(), Stage(spark))}


def test_ranked_lists_one_id_and_all(tables):
    best = V.top_collaborators(tables, 1, 2)
    assert values(best, "place", "collaborator_id", "shared_releases") == [(1, 3, 2), (2, 4, 1)]
    everyone = V.top_collaborators(tables, limit=1).filter("artist_id = 3")
    assert values(everyone, "collaborator_id") == [1]
    assert values(V.top_roster(tables, 501), "place", "artist_id") == [(1, 1), (2, 2), (3, 3), (4, 6), (5, 8), (6, 9)]
    assert [r.label_id for r in V.ranked_artist_labels(tables, 1).collect()] == [500, 501]
    assert values(V.artist_profile(tables, 1), "release_count", "collaborator_count", "is_seed", "relevance") == [(2, 2, True, "none")]


def test_releases_newest_first_undated_last(tables):
    mine = V.artist_releases(tables, 3)
    assert values(mine, "place", "release_id", "label") == [(1, 2, "Label 501"), (2, 1, "Label 500"), (3, 3, "Label 502")]
    assert values(V.artist_releases(tables, 4), "roles") == ["Mixed By,Producer"]
    of_label = V.label_releases(tables, 501)
    assert values(of_label, "place", "release_id", "by_line") == [(1, 2, "Artist 1 Artist 3"), (2, 4, "Artist 2 Artist 6 Artist 8 Artist 9")]


def test_label_profile_and_imprints(tables):
    rows = {r.id: r for r in V.label_profile(tables).collect()}
    assert (rows[501].artist_count, rows[501].release_count, rows[501].first_year, rows[501].last_year) == (6, 2, 2001, 2001)
    assert not rows[501].is_imprint and not rows[503].is_imprint


def test_relations_both_ways_and_inverted(tables):
    rows = values(V.relations(tables, 1), "other_id", "kind", "name", "in_corpus")
    assert rows == [(3, "alias", "Artist 3", True), (5, "alias", "Artist 5", True), (6, "member", "Artist 6", True)]
    assert values(V.relations(tables, 6), "other_id", "kind") == [(1, "group")]
    assert values(V.relations(tables, 2), "other_id", "name", "in_corpus") == [(99, "Gone", False)]


def test_search_merges_kinds_and_reports_the_limit(tables):
    assert values(V.search(tables, "artist 3"), "kind", "id") == [("artist", 3)]
    found = V.search(tables, "l", 2)
    assert {(r.kind, r.truncated) for r in found.collect()} == {("label", True)} and found.count() == 2
    assert V.search(tables, " ?! ").count() == 0


def test_curated_lists(tables):
    assert values(V.alias_expansion(tables["artist_relations"], [1]), "id") == [3, 5]
    who = V.anchors(tables["artist_relations"], SCENE)
    assert values(who, "artist_id", "listed", "alias_of") == [(1, 0, None), (2, 1, None), (3, None, 0), (5, None, 0), (99, None, 1)]
    assert values(V.scene_releases(tables, SCENE, who), "release_id") == [1, 2, 3, 4]
    listed = V.top_artists(tables, SCENE)
    got = [(r.id, r.standing, r.scene_releases, r.line_releases) for r in listed.collect()]
    assert got == [(3, "core", 3, 3), (1, "core", 2, 2), (2, "named", 1, 1), (5, "found", 1, 1), (6, "found", 1, 1)]
    labels = [(r.id, r.standing, r.core_artists, r.named_artists, r.scene_releases) for r in V.top_labels(tables, listed, SCENE).collect()]
    assert labels == [(500, "core", 2, 1, 2), (501, "found", 2, 1, 2), (502, "found", 1, 0, 1)]
    kept = steps.top_lists(tables, SCENE, Stage(tables["artists"].sparkSession))
    assert [r.id for r in kept["top_artists"].orderBy(F.col("weight").desc()).limit(1).collect()] == [3]


def test_pages(tables):
    ranked, left = V.page(tables["artists"], "9", [F.col("id").desc()], 50)
    assert (ranked.head().id, left) == (9, 10)
    by_name, _ = V.page(tables["artists"], None, [F.col("id").desc()], 9, sort="name")
    assert by_name.head().id == 1
    assert V.corpus_stats(tables).head().asDict() == {"artists": 9, "labels": 4, "releases": 5}


PROFILE = "[b]Ran[/b] [l500] with [a1] and [A77],\r\nnot [a=Some Name] or [url=javascript:x]bad[/url]; see [url=http://s.example/][/url][/x]"


def test_profiles_are_read_out(spark, tables):
    who = spark.createDataFrame([(1, PROFILE), (2, "plain"), (3, None)], "id bigint, profile string")
    refs = V.profile_references(who, tables["artists"], tables["labels"])
    assert values(refs, "entity_id", "kind", "ref_id", "name") == [(1, "a", 1, "Artist 1"), (1, "a", 77, None), (1, "l", 500, "Label 500")]
    rows = {r.entity_id: r for r in V.render_profile(who, tables["artists"], tables["labels"]).collect()}
    assert rows[1].text == "Ran Label 500 with Artist 1 and artist 77,\nnot Some Name or bad; see http://s.example/[/x]"
    assert [(l.href, l.outbound) for l in rows[1].links] == [
        ("/label/500", False), ("/artist/1", False), ("/artist/77", False), ("http://s.example/", True),
    ]
    assert rows[2].text == "plain" and rows[2].links == []


# --- measuring --------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "state, action",
    [
        ((5, "a", "a", 0, False), "reuse"), ((5, "a", "b", 0, False), "rescan"), ((5, "a", "a", 2, False), "rescan"), ((5, None, "a", 0, False), "rescan"),
        ((0, "a", "a", 0, False), "rescan"), ((0, None, None, 0, False), "rescan"), ((5, "a", "a", 0, True), "rescan"), ((5, None, None, 3, False), "reuse"),
    ],
)
def test_cache_verdicts(spark, state, action):
    df = spark.createDataFrame([state], "cached bigint, built_from string, dump_on_disk string, uncovered bigint, forced boolean")
    row = M.totals_cache_verdict(df).head()
    assert row.action == action and (row.why in ("current", "unchecked")) == (action == "reuse")
    assert (row.why == "unchecked") == (action == "reuse" and state[2] is None)
    assert (row.built_from, row.dump_on_disk, row.uncovered) == state[1:4]


def test_measures(spark):
    seeds = spark.createDataFrame([(1, 1), (2, 3), (3, 60)], "artist_id bigint, seed_releases bigint")
    totals = spark.createDataFrame([(1, 100), (2, 100), (3, 100)], "artist_id bigint, total bigint")
    pairs = spark.createDataFrame([(500, 2), (500, 3), (501, 3), (501, 9)], "label_id bigint, artist_id bigint")
    assert values(M.share_bands(seeds, totals), "band", "n") == [("a) under 2%", 1), ("b) 2-5%", 1), ("f) 50%+", 1)]
    assert [tuple(r) for r in M.floor_sweep(seeds, totals, pairs, (0.02, 0.05)).collect()] == [(0.02, 2, 1), (0.05, 1, 0)]
    artists = spark.createDataFrame([(1, "A"), (2, None), (3, "C")], "id bigint, name string")
    assert values(M.largest_catalogues(seeds, totals, artists), "name") == ["A", "C"]
    assert M.random_sample(artists, 2, 1).collect() == M.random_sample(artists.repartition(3), 2, 1).collect()


def test_expectations(tables):
    facts = M.named_facts(tables["artists"], tables["corpus_artists"], tables["artist_coverage"], tables["labels"], tables["label_coverage"])
    spark = facts.sparkSession
    asked = spark.createDataFrame(
        [("artist", "Artist 1", "in corpus", None, True), ("artist", "Nobody", "in corpus", None, True), ("artist", "Artist 1", "is high", None, False), ("label", "Label 500", "is seed label", None, True)],
        "kind string, name string, predicate string, argument string, want boolean",
    )
    checked = M.check_corpus(asked, facts)
    assert values(checked, "name", "predicate", "ok") == [
        ("Artist 1", "in corpus", "ok"), ("Artist 1", "is high", "ok"), ("Label 500", "is seed label", "ok"), ("Nobody", "in corpus", "FAIL"),
    ]
    assert M.failures(checked).head().failures == 1


def test_default_expectations_fail_on_a_corpus_without_the_scene(tables):
    from crateline import expectations

    asked = expectations.table(tables["artists"].sparkSession)
    facts = M.named_facts(
        tables["artists"], tables["corpus_artists"], tables["artist_coverage"], tables["labels"], tables["label_coverage"], asked
    )
    checked = M.check_corpus(asked, facts)
    wanted = sum(want for *_, want in expectations.rows())
    assert facts.count() == 0 and checked.count() == len(expectations.rows())
    assert M.failures(checked).head().failures == wanted


# --- tables that lookups read ---------------------------------------------------------------


def test_stored_lookups_answer_like_the_joins(spark, tables):
    served = {**tables, **steps.serving_tables(tables, Stage(spark))}
    for id in (None, 1, 3, 4):
        one, two = V.artist_releases(tables, id), V.artist_releases(served, id)
        assert values(one, *one.columns) == values(two, *one.columns) and one.count() > 0
    for id in (None, 500, 501):
        one, two = V.label_releases(tables, id), V.label_releases(served, id)
        assert values(one, *one.columns) == values(two, *one.columns) and one.count() > 0
    for text in ("artist 3", "l", " ?! ", "rtist", "ARTIST", "3", "label 50", ""):
        one, two = V.search(tables, text), V.search(served, text)
        assert values(one, *one.columns) == values(two, *one.columns), text
    plan = V.artist_releases(served, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "EqualTo(artist_id,3)" in plan and "Join" not in plan
    plan = V.label_releases(served, 501)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "EqualTo(label_id,501)" in plan and "Join" not in plan


def test_postings_hold_every_phrase(spark):
    rng = random.Random(3)
    words = ["red", "wine", "bar", "é", "redd", "a", "x" * 70, "日本"]
    names = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 6))) for _ in range(300)] + ["red wine " * 40, "", None]
    index = E.search_index(spark.createDataFrame(list(enumerate(names)), "id bigint, name string"))
    postings = E.search_postings(index)
    for query in ("re", "red wi", "wine bar a", "e", "bar", "x" * 69, "x" * 70 + " red", "red wine " * 20, "日", "!", "ed wine"):
        phrase = T.normalise_query(F.lit(query))
        want = index.filter(T.matches_phrase(F.col("norm_name"), phrase)).select("id")
        assert values(E.phrase_ids(postings, index, query), "id") == values(want, "id"), query


def test_a_search_skips_row_groups(spark, tmp_path):
    import pyarrow.parquet as pq

    index = E.search_index(spark.range(20_000).select("id", F.concat(F.md5(F.col("id").cast("string").cast("binary")), F.lit(" band")).alias("name")))
    laid = R.clustered(E.search_postings(index), "text")
    laid.write.option("parquet.block.size", 16_384).option("parquet.page.size", 4_096).parquet(str(tmp_path / "p"))
    found = E.phrase_ids(spark.read.parquet(str(tmp_path / "p")), index, "c4ca4238")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(text,c4ca4238)" in plan
    assert values(found, "id") == [1]
    groups = [
        f.metadata.row_group(g).column(0).statistics
        for f in (pq.ParquetFile(p) for p in (tmp_path / "p").glob("*.parquet"))
        for g in range(f.metadata.num_row_groups)
    ]
    read = [s for s in groups if s.min <= "c4ca4238g" and s.max >= "c4ca4238"]
    assert len(groups) > 20 and len(read) <= 2


def test_a_by_line_is_cut_on_the_map_side(spark, tables):
    crowd = spark.range(3000).select(
        F.when(F.col("id") >= 0, 1).otherwise(2).cast("bigint").alias("release_id"), F.col("id").alias("position"), F.col("id").alias("artist_id"),
        F.concat(F.lit("N"), "id").alias("name"), F.lit(None).cast("string").alias("join_phrase"),
    )
    rows = V.label_release_list({**tables, "release_artists": crowd}, by_line=3)
    assert values(rows.filter("release_id = 1"), "by_line") == ["N0 N1 N2"]
    assert rows._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2
