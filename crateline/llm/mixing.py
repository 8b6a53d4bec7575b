"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Of all document rates up to ``cap`` that give each source its target of words, those nearest to
one copy each in relative entropy are exp(lambda * size), held at the cap: one multiplier per
source. The multipliers solve a convex dual; Newton steps find them for all sources at once,
each step one sum over the counts of sizes per source. Rates are rounded to whole copies by
sequential Poisson sampling: whole parts stay, and of the remaining parts those with the
smallest hash over part are taken until the source's target is met.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crateline.llm.common import WORD, staged

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
# A source's words are within this share of its target before rounding.
CLOSE = 1e-5
# Newton steps before the bracket is halved instead, until it settles.
STEPS = 40
# Bits of a document's place in its source's order, settled so many at a time.
BITS, AT_ONCE = 30, 10


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def numbered(sources: DataFrame) -> DataFrame:
    """Sources numbered from 0 by code point, null last: places within sorted partitions, plus
    the rows of the partitions before."""
    placed = staged(
        sources.orderBy(F.col("source").asc_nulls_last()).select(
            "*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")
        ),
        "placed",
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("part").agg(F.count("*").alias("rows"), F.min("place").alias("first"))
    parts = parts.select("part", "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    return placed.join(parts, "part").select(
        "source", "source_size", "docs", (F.col("offset") + F.col("place") - F.col("first")).alias("number")
    )


def with_targets(sources: DataFrame, weights: tuple[float, ...], cap: int) -> DataFrame:
    """Adds weight and target: all words shared by weight, targets above ``cap`` times the
    source's words stopped there and the excess shared again until none is above."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int"))
    sources = staged(sources.withColumn("weight", weight), "sources")
    most = cap * F.col("source_size")
    total = sources.agg(F.sum("source_size")).head()[0] or 0
    level, stopped = 0.0, -1
    while total:
        above = most <= level * F.col("weight") if stopped >= 0 else F.lit(False)
        held = sources.agg(
            F.count_if(above), F.sum(F.when(above, most).otherwise(0)), F.sum(F.when(~above, F.col("weight")))
        ).head()
        if held[0] == stopped or not held[2]:
            break
        stopped, level = held[0], (total - held[1]) / held[2]
    return sources.withColumn("target", F.least(most.cast("double"), level * F.col("weight")))


def rate(multiplier: Column, cap: int) -> Column:
    """exp(lambda * size / mean size), held at the cap; the exponent is held first, so it cannot overflow."""
    reach = multiplier * F.col("size") / F.col("mean")
    return F.when(F.col("full") | (reach >= math.log(cap)), F.lit(float(cap))).otherwise(F.exp(reach))


def multipliers(rows: DataFrame, sources: DataFrame, cap: int) -> DataFrame:
    """``sources`` with lambda, mean, and whether all rates are at the cap.

    Words taken grow with lambda and pass every target that is not full, so a source that Newton
    steps leave open settles by halving: at its target or where no number is between the bounds.
    """
    live = sources.where("source_size > 0").select(
        "number",
        "target",
        (F.col("source_size") / F.col("docs")).alias("mean"),
        (F.col("target") >= cap * F.col("source_size")).alias("full"),
    )
    counts = staged(rows.where("size > 0").groupBy("number", "size").agg(F.count("*").alias("n")), "counts")
    state = staged(
        live.select(
            "*",
            F.lit(0.0).alias("lambda"),
            F.lit(float("-inf")).alias("low"),
            F.lit(float("inf")).alias("high"),
            F.lit(False).alias("done"),
        ),
        "state",
    )
    words = F.col("n") * F.col("size")
    for step in itertools.count():
        r = rate(F.col("lambda"), cap)
        sums = (
            counts.join(state.where("NOT done AND NOT full").select("number", "lambda", "mean", "full"), "number")
            .groupBy("number")
            .agg(
                F.sum(words * r).alias("taken"),
                F.sum(F.when(r < cap, words * r * F.col("size") / F.col("mean")).otherwise(0.0)).alias("slope"),
            )
        )
        gap = F.col("target") - F.col("taken")
        low = F.when(gap > 0, F.col("lambda")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("high")).otherwise(F.col("lambda"))
        newton = F.col("lambda") + gap / F.col("slope")
        # Outside the bracket, or where it is open and the step is long, halve or double instead.
        longest = 2 * F.abs(F.col("lambda")) + 2
        newton = F.greatest(F.least(newton, F.col("lambda") + longest), F.col("lambda") - longest)
        inner = F.when((F.col("slope") > 0) & (newton > low) & (newton < high) & F.lit(step < STEPS), newton)
        wide = F.when(high == float("inf"), F.col("lambda") + longest).when(
            low == float("-inf"), F.col("lambda") - longest
        )
        close = F.abs(gap) <= CLOSE * F.col("target")
        middle = (low + high) / 2
        settled = F.col("taken").isNull() | close | (wide.isNull() & ((middle <= low) | (middle >= high)))
        state = staged(
            state.join(sums, "number", "left").select(
                "number",
                "target",
                "mean",
                "full",
                F.when(settled, F.col("lambda"))
                .otherwise(F.coalesce(inner, wide, middle))
                .alias("lambda"),
                low.alias("low"),
                high.alias("high"),
                settled.alias("done"),
            ),
            "state",
        )
        if state.where("NOT done").isEmpty():
            break
    return state.select("number", "target", "mean", "full", "lambda")


def thresholds(rows: DataFrame, state: DataFrame) -> DataFrame:
    """(number, threshold): documents placed below it get one more copy.

    The place where a source's added words reach what is missing is found a few bits at a time,
    from sums per source and bin. The first bits are added up before sources are told apart, so a
    hot source's rows never meet. The documents at that very place go where the sum is nearer.
    """
    missing = rows.groupBy("number").agg(F.sum(F.col("whole") * F.col("size")).alias("base"))
    need = missing.join(state, "number").select("number", (F.col("target") - F.col("base")).alias("need"), F.lit(0).alias("prefix"))
    extra = rows.where("size > 0 AND place IS NOT NULL").select("number", "place", "size")
    for shift in range(BITS - AT_ONCE, -1, -AT_ONCE):
        within = extra
        if shift + AT_ONCE < BITS:
            within = extra.join(need, "number").where(F.shiftright("place", shift + AT_ONCE) == F.col("prefix"))
        bins = within.groupBy("number", F.shiftright("place", shift).alias("bin")).agg(F.sum("size").alias("words"))
        bins = bins.join(need.select("number", "need"), "number")
        upto = F.sum("words").over(Window.partitionBy("number").orderBy("bin"))
        crossed = bins.withColumn("upto", upto).where(F.col("upto") > F.col("need"))
        need = crossed.groupBy("number").agg(
            F.min(F.struct("bin", (F.col("need") - F.col("upto") + F.col("words")).alias("need"), "words")).alias("at")
        )
        need = staged(need.select("number", F.col("at.bin").alias("prefix"), "at.need", "at.words"), "need")
    return need.select("number", (F.col("prefix") + (2 * F.col("need") >= F.col("words")).cast("int")).alias("threshold"))


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """doc_id, source, size, a hash of id and text, and the whole row beside them."""
    text, doc_id = F.col(text_col), F.col(id_col).cast("bigint")
    return docs.select(
        doc_id.alias("doc_id"),
        F.col(source_col).alias("source"),
        count_words(text).alias("size"),
        F.xxhash64(doc_id, text).alias("hash"),
        F.struct(*docs.columns).alias("row"),
    )


def rated(rows: DataFrame, sources: DataFrame, cap: int) -> DataFrame:
    """Adds each row's rate, its whole part, and the row's place in its source for one more copy."""
    part = F.col("rate") - F.col("whole")
    odds = (F.pmod("hash", F.lit(1 << 40)) + 0.5) / float(1 << 40) / part
    return (
        rows.join(sources.withColumnRenamed("source", "named"), F.col("source").eqNullSafe(F.col("named")))
        .withColumn("rate", F.when(F.col("size") > 0, rate(F.col("lambda"), cap)).otherwise(0.0))
        .withColumn("whole", F.floor("rate"))
        .withColumn("place", F.when(part > 0, F.floor(odds / (1 + odds) * (1 << BITS)).cast("int")))
    )


def fit(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Per source: source_size, target, multiplier and threshold, from all (source, size, hash)."""
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    sources = staged(with_targets(numbered(sources), weights, cap), "targets")
    named = sources.select(F.col("source").alias("named"), "number")
    state = multipliers(rows.join(named, F.col("source").eqNullSafe(F.col("named"))), sources, cap)
    fitted = staged(
        sources.select("source", "number", "source_size", "target").join(state.drop("target"), "number", "left"), "fitted"
    )
    at = thresholds(rated(rows, fitted, cap), state)
    return staged(
        fitted.join(at, "number", "left").withColumn("threshold", F.coalesce("threshold", F.lit(1 << BITS))), "fitted"
    )


def decide(rows: DataFrame, fitted: DataFrame, cap: int = CAP) -> DataFrame:
    more = F.coalesce(F.col("place") < F.col("threshold"), F.lit(False)).cast("bigint")
    copies = rated(rows, fitted, cap).withColumn("copies", F.col("whole") + more)
    return copies.withColumn("taken", F.col("copies") * F.col("size"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    cap: int = CAP,
) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target, rate, copies, taken.

    Sources by code point, null last, weigh ``weights`` in turn. Size is the number of words, 0
    for a null or empty text; such rows take nothing. Rows that repeat an id and text are
    decided alike, and a source misses its target by half of the words at one place at most.
    Null ids are kept. The same input gives the same copies. Other columns are not read.
    """
    rows = staged(sized(docs, id_col, text_col, source_col).drop("row"), "sized")
    columns = ("doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken")
    return decide(rows, fit(rows, weights, cap), cap).select(*columns)


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    cap: int = CAP,
) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it: up to ``cap`` times, or not at all."""
    rows = sized(docs, id_col, text_col, source_col)
    fitted = fit(staged(rows.drop("row"), "sized"), weights, cap)
    times = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return decide(rows, fitted, cap).where("copies > 0").select("row", times).select("row.*")
