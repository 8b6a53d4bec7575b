"""Measuring the dials and checking a corpus against named expectations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crateline.config import FLOOR_SWEEP
from crateline.functions import predicates as P
from crateline.operators import corpus as C
from crateline.operators import relational as R


def totals_cache_verdict(state: DataFrame) -> DataFrame:
    """Rescan or reuse, and a code for why, from (cached, built_from, dump_on_disk, uncovered, forced).

    The two dumps and the number of uncovered artists stand beside the code.
    """
    c = F.col
    other = ~c("built_from").eqNullSafe(c("dump_on_disk"))
    why = (
        F.when(c("forced"), "forced")
        .when(c("cached") == 0, "empty")
        .when(c("dump_on_disk").isNull(), "unchecked")
        .when(c("built_from").isNull(), "unrecorded")
        .when(other, "other dump")
        .when(c("uncovered") > 0, "uncovered")
        .otherwise("current")
    )
    action = F.when(why.isin("current", "unchecked"), "reuse").otherwise("rescan")
    return state.select(
        action.alias("action"), why.alias("why"), "built_from", "dump_on_disk", "uncovered"
    )


def totals_cache_state(
    totals: DataFrame,
    seeds: DataFrame,
    built_from: str | None,
    dump_on_disk: str | None,
    forced: bool = False,
) -> DataFrame:
    counts = R.one_row(
        R.row_count(totals, "cached"),
        R.row_count(R.anti_join(seeds, totals, "artist_id"), "uncovered"),
    )
    return counts.select(
        "cached",
        F.lit(built_from).cast("string").alias("built_from"),
        F.lit(dump_on_disk).cast("string").alias("dump_on_disk"),
        "uncovered",
        F.lit(forced).alias("forced"),
    )


def _shares(seeds: DataFrame, totals: DataFrame) -> DataFrame:
    return seeds.select("artist_id", "seed_releases").join(
        totals.select("artist_id", "total"), "artist_id"
    ).withColumn("share", F.col("seed_releases") / F.col("total"))


# The names of the bands.
def share_band(share: Column) -> Column:
    return (
        F.when(share < 0.02, "a) under 2%")
        .when(share < 0.05, "b) 2-5%")
        .when(share < 0.10, "c) 5-10%")
        .when(share < 0.25, "d) 10-25%")
        .when(share < 0.50, "e) 25-50%")
        .otherwise("f) 50%+")
    )


def share_bands(seeds: DataFrame, totals: DataFrame) -> DataFrame:
    """(band, n, pct): six rows at most, so the share of the whole is taken over those."""
    bands = (
        _shares(seeds, totals)
        .groupBy(share_band(F.col("share")).alias("band"))
        .agg(F.count("*").alias("n"))
    )
    return (
        R.beside_whole(bands, whole=F.sum("n"))
        .select("band", "n", (100.0 * F.col("n") / F.col("whole")).alias("pct"))
        .orderBy("band")
    )


def largest_catalogues(
    seeds: DataFrame, totals: DataFrame, artists: DataFrame, n: int = 12
) -> DataFrame:
    named = _shares(seeds, totals).join(
        artists.filter(F.col("name").isNotNull()).select(F.col("id").alias("artist_id"), "name"),
        "artist_id",
    )
    return R.top_k(
        named.select("artist_id", "name", "seed_releases", "total", "share"),
        [F.col("total").desc(), F.col("artist_id")],
        n,
    )


def floor_sweep(
    seeds: DataFrame,
    totals: DataFrame,
    pairs: DataFrame,
    floors: Sequence[float] = FLOOR_SWEEP,
    min_artists: int = 2,
    min_ratio: float = 0.5,
) -> DataFrame:
    """(floor, artists, labels): what each ratio floor would keep, all floors in one pass.

    An artist passes every floor up to its share. A label's strong artists only get fewer as floors
    rise, so it passes up to the highest floor that leaves it enough; its artists are counted per
    floor they reach, which combines on the map side, and added up from the highest down.
    """
    rising = sorted(set(map(float, floors)))
    shares = _shares(seeds, totals).select("artist_id", R.reached(F.col("share"), rising).alias("place"))
    artists = R.at_least(shares, "place", rising, "artists")
    held = (
        pairs.join(shares, "artist_id", "left")
        .groupBy("label_id", F.coalesce("place", F.lit(0)).alias("place"))
        .agg(F.count("*").alias("n"))
    )
    label = Window.partitionBy("label_id")
    strong = F.sum("n").over(label.orderBy(F.col("place").desc()))
    enough = (F.col("strong") >= min_artists) & (F.col("strong") / F.col("roster") >= min_ratio)
    best = (
        held.select("label_id", "place", strong.alias("strong"), F.sum("n").over(label).alias("roster"))
        .filter(enough)
        .groupBy("label_id")
        .agg(F.max("place").alias("place"))
    )
    labels = R.at_least(best, "place", rising, "labels")
    return (
        artists.join(labels, "threshold")
        .withColumnRenamed("threshold", "floor")
        .orderBy("floor")
    )


def top_seed_labels(seed_labels: DataFrame, label_refs: DataFrame, n: int = 15) -> DataFrame:
    """Largest first; a label's name is the least spelling its references carry."""
    best = R.top_k(
        seed_labels,
        [F.col("seed_artist_count").desc(), F.col("seed_ratio").desc(), F.col("label_id")],
        n,
    )
    names = (
        R.semi_join(label_refs.select("label_id", "name"), best, "label_id")
        .groupBy("label_id")
        .agg(F.min("name").alias("name"))
    )
    return best.join(names, "label_id", "left").orderBy(
        F.col("seed_artist_count").desc(), F.col("seed_ratio").desc(), "label_id"
    )


def retune_seed_labels(
    pairs: DataFrame, seeds: DataFrame, min_artists: int, min_ratio: float
) -> DataFrame:
    """The seed labels again from stored pairs, with other dials."""
    return C.seed_labels(pairs, seeds, min_artists, min_ratio)


def named_facts(
    artists: DataFrame,
    corpus: DataFrame,
    coverage: DataFrame,
    labels: DataFrame,
    seed_labels: DataFrame,
    names: DataFrame | None = None,
) -> DataFrame:
    """(name, predicate, argument): every fact an expectation can name, true ones only.

    With ``names`` given, only facts about those names are looked up.
    """
    if names is not None:
        asked = names.select("name").distinct()
        artists = artists.join(asked, "name", "left_semi")
        labels = labels.join(asked, "name", "left_semi")
    ids = lambda df, key: df.withColumnRenamed(key, "id")
    fact = lambda df, predicate, argument=None: df.select(
        "name",
        F.lit(predicate).alias("predicate"),
        (F.lit("") if argument is None else F.col(argument)).alias("argument"),
    )
    people = artists.select("id", "name").join(ids(corpus, "artist_id"), "id")
    graded = artists.select("id", "name").join(ids(coverage, "artist_id"), "id")
    tagged = graded.filter(F.col("lineage").isNotNull())
    parts = [
        fact(labels.select("id", "name").join(ids(seed_labels, "label_id"), "id"), "is seed label"),
        fact(people, "in corpus"),
        fact(people.filter("is_seed"), "is core"),
        fact(graded.filter("relevance = 'high'"), "is high"),
        fact(tagged, "has lineage", "lineage"),
        fact(tagged, "any lineage"),
        fact(graded.filter("relevance in ('high', 'medium')"), "at least medium"),
        fact(graded.filter("relevance = 'low'"), "is low"),
    ]
    facts = parts[0]
    for part in parts[1:]:
        facts = facts.unionByName(part)
    return facts.distinct()


def check_corpus(expectations: DataFrame, facts: DataFrame) -> DataFrame:
    """Each expectation (kind, name, predicate, argument, want) with what was found."""
    asked = expectations.withColumn("argument", F.coalesce("argument", F.lit("")))
    found = facts.withColumn("got", F.lit(True))
    got = F.coalesce("got", F.lit(False))
    return asked.join(found, ["name", "predicate", "argument"], "left").select(
        "kind",
        "name",
        "predicate",
        "argument",
        "want",
        got.alias("got"),
        F.when(got == F.col("want"), "ok").otherwise("FAIL").alias("ok"),
    )


def failures(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count_if(F.col("ok") == "FAIL").alias("failures"))


def high_equals_seed(label_coverage: DataFrame, seed_labels: DataFrame) -> DataFrame:
    counts = R.one_row(
        label_coverage.agg(F.count_if(F.col("relevance") == "high").alias("high")),
        R.row_count(seed_labels, "seed"),
    )
    return counts.withColumn("ok", F.col("high") == F.col("seed"))


def absence_report(coverage: DataFrame) -> DataFrame:
    """(status, artists): nobody entered credits, and credits naming no one else."""
    counts = coverage.agg(
        F.count_if((F.col("release_count") > 0) & (F.col("credited_releases") == 0)).alias("a"),
        F.count_if((F.col("credited_releases") > 0) & (F.col("collaborator_count") == 0)).alias("b"),
    )
    rows = F.array(
        F.struct(F.lit("no credits recorded").alias("status"), F.col("a").alias("artists")),
        F.struct(F.lit("worked alone").alias("status"), F.col("b").alias("artists")),
    )
    return counts.select(F.inline(rows))


def absence_histogram(coverage: DataFrame) -> DataFrame:
    status = P.absence_status(
        F.col("release_count"), F.col("credited_releases"), F.col("collaborator_count")
    )
    return coverage.groupBy(status.alias("status")).agg(F.count("*").alias("artists"))


def random_sample(artists: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` names drawn with a seed: the least by a seeded hash of the id."""
    drawn = artists.select("id", "name", F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary")).alias("_draw"))
    return drawn.orderBy("_draw", "id").limit(n).select("name")
