"""Stored steps: what is read again, what is rebuilt, what is counted while writing."""

import json
import random

import pytest
from pyspark.sql import functions as F

from crateline.config import Dials
from crateline.plans import steps
from crateline.plans.staging import Stage
from crateline.plans.store import Incomplete
from crateline.sources import files, tables
from helpers import catalogue

DIALS = Dials(min_seed_ratio=0.1, label_min_ratio=0.3, min_ties=2, bridge_min_ratio=0.2, max_people_to_admit=5)
WIDER = Dials(min_seed_ratio=0.1, label_min_ratio=0.3, min_ties=1, bridge_min_ratio=0.1, max_people_to_admit=9)
RECORD = "id bigint, name string, real_name string, profile string, urls array<string>, relations array<struct<kind:string,id:bigint,name:string>>"


def some_releases(n=120):
    rng = random.Random(5)
    roles = ["Producer", "Written-By", "Photography By", "Engineer [Mix]"]
    return [
        dict(
            id=i,
            artists=rng.sample(range(1, 40), rng.randrange(1, 4)),
            credits=[(rng.randrange(1, 60), rng.choice(roles)) for _ in range(rng.randrange(0, 7))],
            labels=[rng.choice([1, 2, 3, 4, 5, (None, "Self"), (9, "Not On Label")]) for _ in range(rng.randrange(1, 3))],
            styles=["Dub Techno"] if i % 4 == 0 else ["House"],
            genres=["Electronic"],
        )
        for i in range(1, n)
    ]


def jobs(spark):
    return spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()


def rows(held):
    return {name: sorted(map(str, df.select(sorted(df.columns)).collect())) for name, df in held.items()}


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/store"


def opened(spark, folder, dials=DIALS, catalogue="one"):
    return steps.open_store(spark, folder, dials, catalogue=catalogue, artists="a", labels="l")


def test_a_stored_seed_is_read_in_another_session_without_a_job(spark, folder):
    cat = catalogue(spark, *some_releases())
    steps.select_seed(cat, DIALS, opened(spark, folder))
    session = spark.newSession()
    store = opened(session, folder, WIDER)
    before = jobs(spark)
    seed = steps.load_seed(store)
    assert jobs(spark) == before
    assert set(store.reused) == set(steps.SEED_TABLES) and not store.built
    wide = steps.expand(catalogue(session, *some_releases()), seed, WIDER, store)
    assert not set(store.built) & set(steps.SEED_TABLES)
    again = opened(spark, folder)
    narrow = steps.expand(cat, steps.load_seed(again), DIALS, again)
    for made, dials in ((wide, WIDER), (narrow, DIALS)):
        whole = steps.select_corpus(cat, dials, Stage(spark))
        assert rows(made) == rows({name: whole[name] for name in made})
    assert rows(wide)["channel_flags"] != rows(narrow)["channel_flags"]
    assert steps.expansion_stats(again) == steps.expansion_stats(_counted(spark, cat, DIALS))


def _counted(spark, cat, dials):
    stage = Stage(spark)
    steps.select_corpus(cat, dials, stage)
    return stage


def test_labels_are_chosen_again_from_stored_pairs(spark, folder):
    cat = catalogue(spark, *some_releases())
    first = steps.select_seed(cat, DIALS, opened(spark, folder))
    other = Dials(**{**vars(DIALS), "label_min_ratio": 0.87, "label_min_artists": 1})
    store = opened(spark, folder, other)
    seed = steps.retune_labels(store)
    assert store.built == ["seed_labels"]
    assert rows({"l": seed.labels}) == rows({"l": steps.select_seed(cat, other, Stage(spark)).labels})
    assert rows({"l": seed.labels}) != rows({"l": first.labels})
    assert rows({"l": steps.load_seed(opened(spark, folder)).labels}) == rows({"l": first.labels})


def test_other_sources_and_lost_runs_are_built_again(spark, folder):
    cat = catalogue(spark, *some_releases(40))
    store = opened(spark, folder)
    steps.select_seed(cat, DIALS, store)
    with pytest.raises(Incomplete):
        steps.load_seed(opened(spark, folder, catalogue="two"))
    # A run that ends before its marker leaves data that no one reads.
    store.clear("seed_artists")
    lost = opened(spark, folder)
    with pytest.raises(Incomplete, match="seed_artists"):
        steps.load_seed(lost)
    steps.select_seed(cat, DIALS, lost)
    assert lost.built == ["seed_artists"]
    steps.select_seed(cat, DIALS, opened(spark, folder, catalogue="two"))
    held = opened(spark, folder)
    gone = held.prune()
    assert len([g for g in gone if g.startswith("seed_artists/")]) == 2
    steps.load_seed(held)
    with pytest.raises(Incomplete):
        steps.load_seed(opened(spark, folder, catalogue="two"))


def test_a_whole_build_is_read_again_without_building(spark, folder):
    cat = catalogue(spark, *some_releases(60))
    artists = spark.createDataFrame([(i, f"A{i}", None, None, [], []) for i in range(1, 50)], RECORD)
    labels = artists.select("id", "name", "profile", "urls")
    first, second = opened(spark, folder), opened(spark, folder)
    one = steps.build(cat, artists, labels, DIALS, first)
    two = steps.build(cat, artists, labels, DIALS, second)
    assert not second.built and set(first.built) == set(second.reused) == set(steps.RECIPES)
    assert rows(one) == rows(two)


def test_a_log_row_starts_no_job(spark, folder):
    cat = catalogue(spark, *some_releases(60))
    artists = spark.createDataFrame([(i, f"A{i}", None, None, [], []) for i in range(1, 50)], RECORD)
    labels = artists.select("id", "name", "profile", "urls")
    stage = Stage(spark)
    steps.build(cat, artists, labels, DIALS, stage, run_log=f"{folder}-runs")
    before = jobs(spark)
    for stats in (steps.seed_stats, steps.expansion_stats, steps.entity_stats, steps.derivation_stats):
        tables.append_run(spark, tables.run_record(stats(stage), "again", None, {}, "now"), f"{folder}-others")
    assert jobs(spark) == before
    logged = {r.step: json.loads(r.stats_json) for r in tables.read_runs(spark, f"{folder}-runs").collect()}
    assert set(logged) == {"pass1", "pass2", "entities", "derive"}
    assert logged["pass1"]["scanned"] == 59 and logged["entities"]["artists_scanned"] == 49


def test_counts_that_the_optimizer_drops_are_taken_again(spark):
    stage = Stage(spark)
    nothing = spark.createDataFrame([], "id bigint")
    build = lambda: stage.watch("t", spark.range(7), seen=F.count("*")).join(nothing, "id", "left_semi")
    assert stage.table("t", build).count() == 0
    assert stage.counts["t"] == {"rows": 0, "seen": 7}


def test_small_files_are_replaced_whole(spark, folder):
    path = f"{folder}-small"
    assert files.read_text(spark, path) is None
    for text in ("first", "second ünïcode"):
        files.replace_text(spark, path, text)
        assert files.read_text(spark, path) == text
    digest = files.listing_digest(spark, path)
    assert digest == files.listing_digest(spark, path)
    files.replace_text(spark, path, "third, longer")
    assert digest != files.listing_digest(spark, path)


def test_stored_tables_of_many_rows_are_not_broadcast_by_their_small_files(spark, tmp_path):
    """Read again from the store, the optimizer knows their rows too."""
    from test_plans import plan_of, settings

    rows = spark.range(300_000).select((F.col("id") * 2).alias("artist_id"), F.lit("one text").alias("text"))
    opened = lambda: steps.open_store(spark, str(tmp_path / "kept"), DIALS, catalogue="a", artists="b", labels="c")
    made = opened().table("appearance_counts", lambda: rows)
    again = opened().need("appearance_counts")["appearance_counts"]
    assert sum(f.stat().st_size for f in (tmp_path / "kept").rglob("*.parquet")) < 2 << 20
    with settings(spark, **{"spark.sql.autoBroadcastJoinThreshold": "2m", "spark.sql.adaptive.enabled": "false"}):
        for held in (made, again):
            assert held.count() == 300_000 and held.dtypes == rows.dtypes
            assert "BroadcastHashJoin" not in plan_of(rows.join(held, "artist_id"))
