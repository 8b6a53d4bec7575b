"""The join, aggregate, set, order and write-conflict forms the other operators use.

No side is ever hinted for broadcast unless its size is bounded by a parameter or by a
proof given at the call: the engine's own runtime size check picks broadcast joins, and its
skew-join split spreads hot keys.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# --- parameters as tables -------------------------------------------------------


def literal_rows(spark: SparkSession, columns: Sequence[tuple[str, str]], rows: Sequence) -> DataFrame:
    """A parameter list as a one-partition table, without a Python worker."""
    schema = ",".join(f"{name}:{kind}" for name, kind in columns)
    cells = json.dumps([dict(zip((name for name, _ in columns), row)) for row in rows])
    table = F.from_json(F.lit(cells), f"array<struct<{schema}>>")
    return spark.range(0, 1, 1, 1).select(F.inline(table))


# --- joins ----------------------------------------------------------------------


def inner_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return left.join(right, list(keys), "inner")


def left_join_all(left: DataFrame, rights: Sequence[DataFrame], key: str) -> DataFrame:
    """Each right side holds one row per key, so no row of the left is repeated."""
    for right in rights:
        left = left.join(right, key, "left")
    return left


def members_within(pairs: DataFrame, group: str, member: str, cap: int) -> DataFrame:
    """(group, members) of every group holding at most ``cap`` members.

    ``pairs`` holds each (group, member) once. Each map task sends at most ``cap + 1`` members of
    a group, which tells small groups from large ones whole, so no task ever meets a large group
    and no join with sizes is needed.
    """
    few = top_k_per_group(pairs.select(group, member), [group], [F.col(member)], cap + 1)
    return few.groupBy(group).agg(F.collect_list(member).alias("members")).filter(F.size("members") <= cap)


def people_who_share(people: DataFrame, release_id: str, person_id: str, cap: int) -> DataFrame:
    """(a, b, release): ordered pairs of different people on one release of at most ``cap``."""
    once = people.select(release_id, person_id).distinct()
    groups = members_within(once, release_id, person_id, cap)
    return (
        groups.filter(F.size("members") > 1)
        .select(F.col(release_id), F.explode("members").alias("a"), "members")
        .select("a", F.explode("members").alias("b"), F.col(release_id))
        .filter(F.col("a") != F.col("b"))
    )


def semi_join(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def with_match(df: DataFrame, matches: DataFrame, key: str) -> DataFrame:
    """EXISTS on a key, as a semi join."""
    return df.join(matches.select(key), key, "left_semi")


def anti_join(df: DataFrame, covered: DataFrame, key: str) -> DataFrame:
    return df.join(covered.select(key), key, "left_anti")


def in_id_list(df: DataFrame, ids: Sequence[int], key: str) -> DataFrame:
    """``key IN (...)``: a pushed-down filter, the list being a bounded parameter."""
    return df.filter(F.col(key).isin(list(ids)))


def with_scalar_aggregates(outer: DataFrame, inner: DataFrame, key: str, **aggs: Column) -> DataFrame:
    """Correlated scalar subqueries as one pre-aggregation and one left join."""
    facts = inner.groupBy(key).agg(*[value.alias(name) for name, value in aggs.items()])
    return outer.join(facts, key, "left")


def both_directions(relations: DataFrame, kinds: Sequence[str] | None = None) -> DataFrame:
    """(id, other_id, kind) read from either side, each once."""
    kept = relations if kinds is None else relations.filter(F.col("kind").isin(list(kinds)))
    forward = kept.select(
        F.col("artist_id").alias("id"), F.col("related_id").alias("other_id"), "kind"
    )
    backward = kept.select(
        F.col("related_id").alias("id"), F.col("artist_id").alias("other_id"), "kind"
    )
    return forward.unionByName(backward).distinct()


def per_threshold(
    facts: DataFrame, thresholds: Sequence[float], measure: Callable[[float], Column], name: str
) -> DataFrame:
    """(threshold, measure) for every threshold from one pass, without a product of rows."""
    columns = [measure(t).alias(f"_m{i}") for i, t in enumerate(thresholds)]
    rows = [
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_m{i}").alias(name))
        for i, t in enumerate(thresholds)
    ]
    return facts.agg(*columns).select(F.inline(F.array(*rows)))


def _doubles(values: Sequence[float]) -> Column:
    """A literal array, folded once by the planner whatever its length."""
    return F.from_json(F.lit(json.dumps([float(v) for v in values])), "array<double>")


def reached(value: Column, thresholds: Sequence[float]) -> Column:
    """How many of the rising thresholds the value reaches, by halving: 14 steps for 10,000; 0 for null."""
    steps = [1 << k for k in reversed(range(len(thresholds).bit_length()))]
    listed = _doubles(thresholds)
    further = lambda at, step: F.coalesce(F.get(listed, at + step - 1) <= value, F.lit(False))
    return F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(further(at, step), at + step).otherwise(at))


def at_least(facts: DataFrame, place: str, thresholds: Sequence[float], name: str) -> DataFrame:
    """(threshold, n): rows whose ``place`` (as ``reached`` gives it) is at or past each threshold.

    Rows are counted per place, then added up from the highest down over as many rows as there are
    thresholds: one pass however many those are.
    """
    counts = facts.groupBy(F.col(place).alias("place")).agg(F.count("*").alias("n"))
    # A row per threshold, so that one nobody stands at is there too; bounded by the parameter.
    none = facts.sparkSession.range(1, len(thresholds) + 1).select(F.col("id").cast("int").alias("place"), F.lit(0).cast("bigint").alias("n"))
    whole = counts.filter("place > 0").unionByName(none).groupBy("place").agg(F.sum("n").alias("n"))
    upwards = Window.orderBy(F.col("place").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    threshold = F.get(_doubles(thresholds), F.col("place") - 1)
    return whole.select(threshold.alias("threshold"), F.sum("n").over(upwards).alias(name))


# --- write conflicts --------------------------------------------------------------


def replace_by_key(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Last write per key wins. Each map task keeps one row per key before the shuffle."""
    latest = Window.partitionBy(*keys).orderBy(F.col(seq).desc())
    return df.withColumn("_rn", F.row_number().over(latest)).filter("_rn = 1").drop("_rn")


def ignore_by_key(
    df: DataFrame, keys: Sequence[str], precedence: Sequence[str] | None = None
) -> DataFrame:
    """First write per key wins; with no precedence the rows are a set over the keys."""
    if precedence is None:
        return df.dropDuplicates(list(keys))
    first = Window.partitionBy(*keys).orderBy(*precedence)
    return df.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")


def merge_flags(seed: DataFrame, kept: DataFrame, key: str, flags: Sequence[str]) -> DataFrame:
    """Seed rows and kept rows by key, each flag the greater of the two; is_seed is the seed's."""
    off = [F.lit(False).alias(f) for f in flags]
    rows = seed.select(key, F.lit(True).alias("is_seed"), *off).unionByName(
        kept.select(key, F.lit(False).alias("is_seed"), *flags)
    )
    return rows.groupBy(key).agg(*[F.max(f).alias(f) for f in ("is_seed", *flags)])


def count_by_key(df: DataFrame, key: str, name: str = "occurrences") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias(name))


# --- aggregates -------------------------------------------------------------------


def count_rows(df: DataFrame, keys: Sequence[str], value: str | None = None) -> DataFrame:
    """``count(*)``, or ``count(value)`` which skips nulls."""
    return df.groupBy(*keys).agg(F.count(F.lit(1) if value is None else F.col(value)).alias("n"))


def count_distinct(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.countDistinct(value).alias("n"))


def count_distinct_if(df: DataFrame, keys: Sequence[str], value: str, test: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.countDistinct(F.when(test, F.col(value))).alias("n"))


def count_if(df: DataFrame, keys: Sequence[str], test: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count_if(test).alias("n"))


def span(df: DataFrame, keys: Sequence[str], year: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(year).alias("first_year"), F.max(year).alias("last_year"))


def joined_text(df: DataFrame, keys: Sequence[str], text: str, separator: str) -> DataFrame:
    """Distinct non-null values per key, sorted and joined. Duplicates go before the shuffle."""
    return (
        df.filter(F.col(text).isNotNull())
        .select(*keys, text)
        .distinct()
        .groupBy(*keys)
        .agg(F.array_join(F.array_sort(F.collect_list(text)), separator).alias(text))
    )


def arg_min(df: DataFrame, keys: Sequence[str], value: str, by: Sequence[str]) -> DataFrame:
    order = F.struct(*[F.col(c) for c in (*by, value)])
    return df.groupBy(*keys).agg(F.min_by(F.col(value), order).alias(value))


def having(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column], test: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*aggs).filter(test)


def one_row(*frames: DataFrame) -> DataFrame:
    """One-row frames of counts side by side in one row, without a cross join."""
    parts, names = None, []
    for frame in frames:
        cells = [
            F.struct(F.lit(c).alias("name"), F.col(c).cast("bigint").alias("n"))
            for c in frame.columns
        ]
        names += frame.columns
        part = frame.select(F.inline(F.array(*cells)))
        parts = part if parts is None else parts.unionByName(part)
    return parts.agg(
        *[F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in names]
    )


def beside_whole(df: DataFrame, **wholes: Column) -> DataFrame:
    """Each row of a table bounded by a limit or a fixed grouping, beside aggregates over all of it."""
    gathered = df.agg(
        F.collect_list(F.struct("*")).alias("_rows"), *[v.alias(n) for n, v in wholes.items()]
    )
    return gathered.select(F.explode("_rows").alias("_row"), *wholes).select("_row.*", *wholes)


def clustered(df: DataFrame, key: str) -> DataFrame:
    """Rows laid out by a key over range partitions, so a lookup reads few row groups. Whole
    numbers break ties, so one hot key still spreads over ranges."""
    rest = [c for c, kind in df.dtypes if c != key and kind in ("bigint", "int")]
    return df.repartitionByRange(key, *rest).sortWithinPartitions(key)


def row_count(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count("*").alias(name))


# --- sets and order ---------------------------------------------------------------


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def distinct(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns).distinct()


def placed(df: DataFrame) -> DataFrame:
    """An ordered table with the partition and place of each row, to be stored before it is numbered."""
    return df.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())


def numbered(stored: DataFrame, name: str) -> DataFrame:
    """Rows stored by ``placed`` numbered from 1 in their order, without gathering them: a row's
    place in its partition, after the rows of the partitions before."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = stored.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    parts = parts.select("_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_at") - F.col("_first") + 1
    return stored.join(parts, "_part").withColumn(name, place).drop("_part", "_at", "_first", "_before")


def newest_first(df: DataFrame, year: str, *then: str) -> DataFrame:
    return df.orderBy(F.col(year).desc_nulls_last(), *then)


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_k_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None
) -> DataFrame:
    """Best ``k`` rows per group. Each map task keeps ``k`` rows per group before the shuffle."""
    name = rank or "_rn"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    kept = ranked.filter(F.col(name) <= k)
    return kept if rank else kept.drop(name)


def banded_order(df: DataFrame, band: Column, weight: str, name: str, key: str) -> DataFrame:
    return df.orderBy(band, F.col(weight).desc(), F.col(name), F.col(key))


def span_of(df: DataFrame, key: str, first: str, last: str) -> DataFrame:
    """Span of spans: earliest first and latest last per key."""
    return df.groupBy(key).agg(F.min(first).alias(first), F.max(last).alias(last))
