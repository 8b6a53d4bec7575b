"""What each of several filters removes, in every order they can be applied in.

Two of the filters are read from a sparse document-term matrix. Documents are cut into shards of
a bounded amount of text; each shard numbers its own words and keeps its rows as CSR arrays. Only
the distinct words of a shard are ranked among those of the whole corpus, so a word that fills a
document crosses the network once per shard. With the corpus-wide ids put in, a row's sum is the
document's words and its number of entries the distinct ones.

What a document fails is one of 32 patterns; all orders follow from the counts per pattern.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crateline.llm.common import TEXT_BYTES, settings, slices, staged

FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT = 50
MOST_CAPITALS = 2
MARKS = "[#$%&*|]"
# Bytes of text in a shard. A larger one repeats fewer words, and takes a worker more memory.
SHARD_BYTES = 24 << 20
# Bytes of text in a row of a shard, which a batch or a record of a join holds whole, however large the shard.
PART_BYTES = 6 << 20
# Hash buckets that words are ranked in: the most tasks that can share the work.
BUCKETS = 1 << 12
# The texts with most copies, which are met without a shuffle.
COMMON_TEXTS = 1_000


class Shard:
    """Rows of documents over the shard's own words, in the order they were first seen."""

    def __init__(self):
        self.local: dict[bytes, int] = {}
        self.bytes = 0
        self._next_part()

    def _next_part(self) -> None:
        self.edges, self.indices, self.data = [0], array("i"), array("i")
        self.docs: list[pa.RecordBatch] = []
        self.part = 0

    def add(self, batch: pa.RecordBatch, kept: list[str]) -> None:
        local = self.local
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            # Bytes are split at exactly the six blanks that end a word.
            held = Counter((text or b"").split())
            self.indices.extend([local.setdefault(word, len(local)) for word in held])
            self.data.extend(held.values())
            self.edges.append(len(self.indices))
        # Copied, as columns of a batch that came to a worker hold on to all of it, its texts included.
        self.docs.append(batch.select(kept).take(pa.array(range(batch.num_rows))))
        size = pc.sum(pc.binary_length(batch.column("text"))).as_py() or 0
        self.bytes, self.part = self.bytes + size, self.part + size

    def row(self, number: int, last: bool) -> pa.RecordBatch:
        """The documents since the row before; the last row of a shard has its words."""
        docs = pa.Table.from_batches(self.docs).combine_chunks().to_batches()[0].to_struct_array()
        whole = lambda values: pa.array([np.asarray(values, np.int32)], pa.list_(pa.int32()))
        words = pa.array(list(self.local) if last else [], pa.binary()).cast(pa.string())
        made = pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words),
                whole(self.edges),
                whole(self.indices),
                whole(self.data),
                pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs),
            ],
            names=["shard", "words", "indptr", "indices", "data", "docs"],
        )
        self._next_part()
        return made


def csr_shards(rows: DataFrame, limit: int = SHARD_BYTES, part: int = PART_BYTES) -> DataFrame:
    """(shard, words, indptr, indices, data, docs): each shard's own words, its rows as CSR over
    them, and the other columns of its documents. A shard ends with the text that fills it, and
    comes in rows of about ``part`` bytes of text; only its last has words."""
    kept = [f for f in rows.schema.fieldNames() if f != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Files are cut and read alike in every attempt of a task, so a shard keeps its number.
        number, shard = TaskContext.get().partitionId() << 32, Shard()
        for batch in slices(batches, limit=min(limit, part, TEXT_BYTES)):
            if shard.part >= part:
                yield shard.row(number, last=False)
            shard.add(batch, kept)
            if shard.bytes >= limit:
                yield shard.row(number, last=True)
                number, shard = number + 1, Shard()
        if shard.docs:
            yield shard.row(number, last=True)

    docs = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    return rows.mapInArrow(
        run,
        "shard bigint, words array<string>, indptr array<int>, indices array<int>, data array<int>, "
        f"docs array<struct<{docs}>>",
    )


def dictionary(shards: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(shard, place, word, id): where each shard has each of its words, and the word's number in
    the whole corpus. Words are ranked within ``buckets`` hash buckets, so ids are as small as
    the fullest bucket allows and no word is in more than one place of a shard."""
    local = shards.select("shard", F.posexplode("words").alias("place", "word"))
    bucket = F.pmod(F.xxhash64("word"), F.lit(buckets))
    rank = F.dense_rank().over(Window.partitionBy("bucket").orderBy("word")) - 1
    return local.withColumn("bucket", bucket).select(
        "shard", "place", "word", (rank.cast("bigint") * buckets + F.col("bucket")).alias("id")
    )


def located(shards: DataFrame) -> DataFrame:
    """Rows of shards beside the places of the shard's words and the words' numbers in the corpus, in step."""
    # Both lists take up the same rows in the same order.
    listed = dictionary(shards).groupBy("shard").agg(F.collect_list("place").alias("places"), F.collect_list("id").alias("ids"))
    # A shard without any word meets no id, and has no entry that needs one.
    return shards.drop("words").join(listed, "shard", "left")


def _numbers(batch: pa.RecordBatch, column: str, row: int) -> np.ndarray:
    held = batch.column(column)[row].values
    return np.zeros(0, np.int64) if held is None else held.to_numpy(zero_copy_only=False)


def _columns(batch: pa.RecordBatch, row: int) -> np.ndarray:
    """The corpus-wide number of each entry's word."""
    places, ids = _numbers(batch, "places", row), _numbers(batch, "ids", row)
    numbers = np.full(len(places), -1, np.int64)
    numbers[places] = ids
    return numbers[_numbers(batch, "indices", row)]


def term_matrix(shards: DataFrame) -> DataFrame:
    """(shard, indptr, indices, data, docs): the CSR arrays over the ids of the whole dictionary."""
    met = located(shards)
    kinds = {f.name: f.dataType.simpleString() for f in met.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            indices = pa.array([_columns(batch, k) for k in range(batch.num_rows)], pa.list_(pa.int64()))
            columns = {"shard": batch.column("shard"), "indptr": batch.column("indptr"), "indices": indices}
            columns |= {c: batch.column(c) for c in ("data", "docs")}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return met.mapInArrow(
        run, f"shard bigint, indptr array<int>, indices array<bigint>, data array<int>, docs {kinds['docs']}"
    )


def row_counts(shards: DataFrame) -> DataFrame:
    """The documents' own columns, with n_words (the sum of the matrix's row) and n_distinct (the
    columns it has entries in)."""
    met = located(shards)
    fields = met.schema["docs"].dataType.elementType.fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                edges, columns = _numbers(batch, "indptr", k), _columns(batch, k)
                sums = np.concatenate([[0], np.cumsum(_numbers(batch, "data", k), dtype=np.int64)])
                entries = np.concatenate([[0], np.cumsum(columns >= 0)])
                docs = batch.column("docs")[k].values
                counts = [pa.array(np.diff(held[edges]), pa.int64()) for held in (sums, entries)]
                yield pa.RecordBatch.from_arrays(
                    [*docs.flatten(), *counts], names=[*(f.name for f in fields), "n_words", "n_distinct"]
                )

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    return met.mapInArrow(run, f"{kept}, n_words bigint, n_distinct bigint")


# Workers get a shard per batch, as a shard is as long as a batch of texts may be, and tasks as few shards as may be:
# a task that merges several shuffle partitions would hold the lists of all of their shards.
ONE_SHARD_AT_A_TIME = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
}


def with_earlier(rows: DataFrame, most: int = COMMON_TEXTS) -> DataFrame:
    """Adds ``earlier``: whether a smaller doc_id has the same text.

    The ``most`` texts with most rows are met by a broadcast of that many rows; of any other text
    there are fewer than one row in ``most``, so no task of the join gets many.
    """
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = staged(firsts, "firsts")
    common = staged(firsts.orderBy(F.desc("n"), "digest").limit(most), "common").drop("n")
    rest = firsts.drop("n").join(F.broadcast(common.select("digest")), "digest", "left_anti")
    met = rows.join(F.broadcast(common), "digest").unionByName(
        rows.join(F.broadcast(common.select("digest")), "digest", "left_anti").join(rest, "digest", "left")
    )
    return met.withColumn("earlier", F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))).drop("first")


def failed_filters(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """(doc_id, part, pattern) per row of ``docs``; bit k of the pattern says that FILTERS[k] fails it.

    A: fewer than 200 words. B: under half of the words are distinct. C: over 2% of the code
    points are A to Z. D: holds one of #$%&*|. E: a smaller id has the same text. A null text
    counts as empty, a null source as the empty part; a null id is never the smaller one and has
    none before it. Repeated rows stay. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("part"),
        (100 * F.regexp_count(text, F.lit("[A-Z]")) > MOST_CAPITALS * F.length(text)).alias("capitals"),
        text.rlike(MARKS).alias("marks"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        text.alias("text"),
    )
    shards = staged(csr_shards(kept), "shards", compression="zstd", rows_per_file=1)
    with settings(docs.sparkSession, ONE_SHARD_AT_A_TIME):
        counted = staged(row_counts(shards), "counted")
    rows = with_earlier(counted)
    fails = (
        F.col("n_words") < LEAST_WORDS,
        100 * F.col("n_distinct") < LEAST_DISTINCT * F.col("n_words"),
        F.col("capitals"),
        F.col("marks"),
        F.col("earlier"),
    )
    pattern = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))
    return rows.select("doc_id", "part", pattern.alias("pattern"))


def interactions(patterns: DataFrame, filters: str = FILTERS) -> DataFrame:
    """All orders of the filters, from (part, pattern, n, good, toxic): a row per part, order and step."""
    held = patterns.groupBy("part").agg(F.collect_list(F.struct("pattern", "n", "good", "toxic")).alias("held"))
    orders = ["".join(order) for order in permutations(filters)]
    bit = lambda letter: F.call_function("shiftleft", F.lit(1), F.instr(F.lit(filters), letter) - 1)
    letters = F.split("filter_order", "")
    rows = (
        held.select("part", "held", F.explode(F.lit(orders)).alias("filter_order"))
        .select("*", F.posexplode(F.transform(letters, bit)).alias("at", "own"), F.transform(letters, bit).alias("bits"))
        .withColumn("before", F.aggregate(F.slice("bits", F.lit(1), F.col("at")), F.lit(0), lambda total, b: total + b))
        .withColumn("step", F.col("at") + 1)
    )
    zero = F.lit(0).cast("bigint")

    def total(when, value: str = "n", times=lambda p: F.lit(1)) -> Column:
        chosen = F.filter("held", lambda e: when(e["pattern"]))
        return F.aggregate(chosen, zero, lambda t, e: t + e[value] * times(e["pattern"]))

    own = lambda p: p.bitwiseAND(F.col("own")) > 0
    earlier = lambda p: p.bitwiseAND(F.col("before")) > 0
    here = lambda p: own(p) & ~earlier(p)
    # Of the filters that a document fails, each comes first in as many orders as any other.
    first_in = lambda p: (F.lit(len(orders)) / F.bit_count(p)).cast("bigint")
    return rows.select(
        "part",
        "filter_order",
        "step",
        total(lambda p: ~own(p) & ~earlier(p)).alias("kept"),
        total(here).alias("removed"),
        total(lambda p: own(p) & earlier(p)).alias("redundant"),
        total(lambda p: p == F.col("own")).alias("unique_fails"),
        total(here, "good").alias("good_lost"),
        total(here, "toxic").alias("toxic_lost"),
        total(own, times=first_in).alias("shapley"),
    )


def audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """Per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley.

    A document counts as good or toxic if any label row of its id says so; label columns other
    than doc_id, quality and toxic are not read. See ``failed_filters`` for nulls and repeats.
    No documents, no rows.
    """
    marked = labels.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    rows = failed_filters(docs, id_col, text_col, source_col).join(marked.where("doc_id IS NOT NULL"), "doc_id", "left")
    patterns = rows.groupBy("part", "pattern").agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum("good"), F.lit(0)).alias("good"),
        F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"),
    )
    return interactions(patterns)
