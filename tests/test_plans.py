"""What the plans must look like at scale, and every registered query beside its SQL."""

import os
from contextlib import contextmanager

import pytest
from helpers import catalogue, values
from pyspark.sql import functions as F

import __spark_entry__ as driver
import check
from crateline.config import Dials
from crateline.operators import corpus as C
from crateline.operators import derive as D
from crateline.operators import relational as R
from crateline.plans.staging import Stage, stored_bytes, tune

SMALL = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver tables are not here")


@contextmanager
def settings(spark, **changes):
    held = {name: spark.conf.get(name, None) for name in changes}
    for name, value in changes.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in held.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# Every join shuffled and any partition that stands out taken as hot.
HOT = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


def test_a_hot_key_is_split_and_answers_the_same(spark):
    """One artist and one label on most rows: the joins split them, the flags do not change."""
    rows = spark.range(0, 40_000, 1, 8)
    hot = lambda n: F.when(F.col("id") % 3 != 0, F.lit(5)).otherwise(F.col("id") % n + 10)
    people = rows.select(
        F.col("id").alias("release_id"), hot(900).alias("artist_id"), F.lit("x").alias("name"), F.lit(None).cast("string").alias("role")
    )
    refs = rows.select(F.col("id").alias("release_id"), hot(700).alias("label_id"), F.lit("x").alias("name"))
    bridging = spark.range(0, 400).withColumnRenamed("id", "artist_id")
    labels = spark.range(0, 300).withColumnRenamed("id", "label_id")
    flags = lambda: C.channel_flags(people, refs, bridging, labels, Dials())
    plain = values(flags().groupBy("channel_a", "channel_b").count(), "channel_a", "channel_b", "count")
    with settings(spark, **HOT):
        df = flags()
        split = values(df.groupBy("channel_a", "channel_b").count(), "channel_a", "channel_b", "count")
        df.collect()
        assert "skew=true" in plan_of(df).lower()
    assert split == plain


def test_a_hot_release_never_reaches_one_task(spark):
    """A map task sends at most one member more than the dial; no broadcast is hinted."""
    people = spark.range(0, 3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") / 3).cast("bigint").alias("release_id"),
        F.col("id").alias("artist_id"),
    )
    groups = R.members_within(people, "release_id", "artist_id", 4)
    plan = plan_of(groups)
    assert plan.count("WindowGroupLimit") == 2 and "Join" not in plan
    assert groups.filter("release_id = 1").count() == 0 and groups.count() > 900


def test_per_group_limits_are_taken_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    plan = plan_of(R.top_k_per_group(df, ["g"], [F.col("id").desc()], 5))
    assert plan.count("WindowGroupLimit") == 2
    assert plan_of(R.replace_by_key(df, ["g"], "id")).count("WindowGroupLimit") == 2
    # Also for long lists, past the runtime's default of 1000.
    many = spark.range(20_000).select((F.col("id") % 3).alias("g"), "id")
    assert plan_of(R.top_k_per_group(many, ["g"], [F.col("id").desc()], 5000)).count("WindowGroupLimit") == 2


def test_numbers_follow_the_order_over_partitions(spark, tmp_path):
    df = spark.range(2000).select((F.col("id") * 7919 % 2003).alias("v")).repartition(7).orderBy("v")
    R.placed(df).write.parquet(str(tmp_path / "placed"))
    rows = R.numbered(spark.read.parquet(str(tmp_path / "placed")), "place").collect()
    assert [r.v for r in sorted(rows, key=lambda r: r.place)] == sorted(r.v for r in rows)
    assert sorted(r.place for r in rows) == list(range(1, 2001))


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    from crateline.operators import serve as V

    roster = spark.createDataFrame([(1, 2, 3, 1990, 1991, "unread")], "label_id bigint, artist_id bigint, release_count bigint, first_year int, last_year int, junk string")
    roster.write.parquet(str(tmp_path / "roster"))
    artists = spark.createDataFrame([(2, "a", "p")], "id bigint, name string, profile string")
    df = V.top_roster({"label_roster": spark.read.parquet(str(tmp_path / "roster")), "artists": artists}, 1)
    plan = plan_of(df)
    assert "EqualTo(label_id,1)" in plan and "junk" not in plan


def test_labels_meet_artists_within_nested_records(spark):
    cat = catalogue(spark, {"id": 1, "artists": [1, 2], "labels": [5, 6]})
    plan = plan_of(C.label_artist_pairs(cat, Dials()))
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_seed_rule_reads_only_listed_tags(spark):
    cat = catalogue(spark, {"id": 1, "styles": ["Dub Techno"]})
    assert "CollectSet" not in plan_of(C.seed_releases(cat)) and "collect_" not in plan_of(C.seed_releases(cat))


@pytest.fixture(scope="module")
def base():
    import duckdb

    held = duckdb.connect()
    for table in check.TABLES:
        held.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return held


@needs_tables
@pytest.mark.parametrize("name", list(driver.QUERIES))
def test_registered_query(spark, base, name):
    """No product of rows, no Python in the plan, and the same rows as its SQL."""
    df = driver.queries()[name](spark, SMALL)
    plan = plan_of(df)
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "InArrow", "ExistingRDD"):
        assert node not in plan
    ours = check.rows_of(df.columns, df.collect())
    if name in driver.oracle_sql():
        told = base.sql(driver.oracle_sql()[name])
        assert sorted(df.columns) == sorted(told.columns)
        assert ours == check.rows_of(told.columns, told.fetchall())
    else:
        assert ours


@needs_tables
def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns == ["artist_id", "place", "collaborator_id", "name", "shared_releases", "roles"]
    assert df.count() > 0


@needs_tables
def test_catalogue_tables_meet_by_release_without_a_shuffle(spark):
    """Rows are dealt by release as they are written, so joins and groups by it shuffle none of them again."""
    from driver_binding.catalogue import bind

    bound = bind(spark, SMALL)
    cat, people = bound.cat, C.appearances(bound.cat)
    with settings(spark, **{"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        kept = C.kept_releases(cat.releases, bound.seed.releases, bound.corpus["channel_flags"])
        within = cat.within(kept)
        once = bound.derived["people_once"]
        meeting = {
            "kept": kept,
            "line": within.line,
            "credits": within.credits,
            "label_refs": within.label_refs,
            "styles": within.styles,
            "genres": within.genres,
            "seed releases": C.seed_releases(cat, bound.dials.seed),
            "seed people": C.seed_appearances(cat, bound.seed.releases),
            "crowded": C.crowded(people, 4),
            "once": D.people_once(bound.derived["release_people"]),
            "groups": D.groups_of_people(once, 4),
            "pairable": D.pairable(once, 4),
            "facts": D.release_facts(bound.corpus["releases"], bound.corpus["release_credits"]),
        }
        assert [name for name, df in meeting.items() if "Exchange" in plan_of(df)] == []
        # What groups by another key shuffles its own groups, once.
        pairs = plan_of(C.label_artist_pairs(cat, bound.dials))
        labels = plan_of(D.artist_labels(once, bound.corpus["release_labels"], bound.corpus["releases"]))
        assert pairs.count("Exchange") == labels.count("Exchange") == 1


def test_dealt_tables_count_what_they_write(spark):
    """Buckets hold the same rows as files do, and are counted by the job that writes them."""
    rows = spark.range(1000).select((F.col("id") % 97).alias("release_id"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("n"))
    stage = Stage(spark, keys={"dealt": "release_id"}, buckets=5)
    held = stage.table("dealt", lambda: stage.watch("dealt", stage.deal(rows, "release_id"), some=F.count("n")))
    assert stage.counts["dealt"] == {"rows": 1000, "some": 666}
    assert values(held, "release_id", "n") == values(rows, "release_id", "n")
    assert "Exchange" not in plan_of(held.groupBy("release_id").count())
    plain = Stage(spark)
    assert plain.deal(rows, "release_id") is rows


def test_dealt_tables_are_stored_in_order(spark, tmp_path):
    """Joins and groups by release sort no rows again, and every table is written with the stage's codec."""
    rows = spark.range(3000).select((F.col("id") * 7 % 991).alias("release_id"), "id")
    stage = Stage(spark, str(tmp_path / "stage"), keys={"left": "release_id", "right": "release_id"}, buckets=3)
    left, right, plain = (stage.table(n, lambda: stage.deal(rows, "release_id")) for n in ("left", "right", "plain"))
    with settings(spark, **{"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        met = left.join(right, "release_id")
        assert "SortMergeJoin" in plan_of(met) and "Sort [" not in plan_of(met) and "Exchange" not in plan_of(met)
        assert values(met.groupBy("release_id").count(), "release_id", "count") == values(
            rows.join(rows, "release_id").groupBy("release_id").count(), "release_id", "count"
        )
    assert values(plain, "release_id", "id") == values(rows, "release_id", "id")
    written = list((tmp_path / "stage").rglob("part-*.parquet"))
    assert written and all(".zstd." in f.name for f in written)


def test_tables_of_many_rows_are_not_broadcast_by_their_small_files(spark, tmp_path):
    """Files hold a tenth of what rows take on the driver, so rows are what the optimizer goes by."""
    many = spark.range(300_000).select(
        (F.col("id") * 2).alias("release_id"), F.when(F.col("id") % 5 > 0, F.lit(True)).alias("on"), F.lit("one text").alias("text")
    )
    few = spark.range(50).withColumnRenamed("id", "release_id")
    stage = Stage(spark, str(tmp_path / "stage"), keys={"dealt": "release_id"}, buckets=3)
    left = many.withColumn("release_id", F.col("release_id") * 2)
    dealt = stage.table("dealt", lambda: stage.deal(many, "release_id"))
    plain, small = stage.table("plain", lambda: many), stage.table("small", lambda: few)
    files = [sum(f.stat().st_size for f in (tmp_path / "stage" / n).rglob("*.parquet")) for n in ("dealt", "plain")]
    with settings(spark, **{"spark.sql.autoBroadcastJoinThreshold": "2m", "spark.sql.adaptive.enabled": "false"}):
        assert max(files) < 2 << 20
        for held in (dealt, plain):
            assert held.dtypes == many.dtypes
            assert values(held.groupBy("on", "text").count(), "on", "text", "count") == values(
                many.groupBy("on", "text").count(), "on", "text", "count"
            )
            assert "BroadcastHashJoin" not in plan_of(left.join(held, "release_id"))
            # What is small is met on the spot as before.
            assert "BroadcastHashJoin" in plan_of(held.join(small, "release_id"))


def test_files_that_were_not_counted_are_taken_for_their_rows(spark, tmp_path):
    """A table file of a quarter of the limit may hold far more than the limit."""
    path = str(tmp_path / "part.parquet")
    names = F.concat(F.lit("name "), F.col("id") % 50)
    spark.range(0, 200_000, 1, 1).select("id", names.alias("name"), names.alias("kind")).write.parquet(path)
    other = spark.range(1_000_000).filter("id % 3 = 0")
    changes = {"spark.sql.autoBroadcastJoinThreshold": "2m", "spark.sql.adaptive.enabled": "false"}
    with settings(spark, **changes, **{"spark.sql.sources.fileCompressionFactor": "1.0"}):
        # As the session was: its files are smaller than the limit.
        assert "BroadcastHashJoin" in plan_of(other.join(spark.read.parquet(path), "id"))
        tune(spark, stored_bytes(spark, path))
        assert "BroadcastHashJoin" not in plan_of(other.join(spark.read.parquet(path), "id"))
        spark.range(9).write.parquet(str(tmp_path / "few"))
        assert "BroadcastHashJoin" in plan_of(other.join(spark.read.parquet(str(tmp_path / "few")), "id"))
