"""Similarity join of documents on word shingles: size-banded tiles, bitmaps, exact overlap.

Documents with the same set are one class, met by a digest of the set and numbered. Classes that
could be linked meet by a shared key: the smallest hashes of a set, which are a random sample of it
agreed on by every document. Keys are dealt into tiles by size band, for linked sets differ in
size by a third at most. Inside a tile bit counts of hashed bitmaps bound the overlap from
above; pairs that pass are decided by the exact overlap of their sorted arrays.

A class is first tried with one class per key group, its head; then every class of a tile with
the nearest class that the bit counts allow in another component. Only classes that were allowed
a partner by then can have links at all. What is still apart among them is compared in full, so
a group of thousands of near copies costs a few exact comparisons per copy. Tiles larger than
``BLOCK`` are compared block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crateline.llm.common import settings, slices, staged, to_batch
from crateline.llm.components import components
from crateline.llm.shingles import shingle_sets

# Links: PARTS * overlap >= SHARE * (sum of both sizes) is 100 * overlap >= 75 * union.
PARTS, SHARE = 7, 3

# Keys of a set. Sets that link agree on each of the KEYS smallest hashes of their union with
# probability 3/4 at least, so they share no key with probability 4**-32 = 2**-64 at most: as
# rare as two shingles with one 64-bit hash. Sets under 128 shingles have the whole prefix that
# linked sets must share an element of, and miss nothing at all. With None every set gives its
# whole prefix, a quarter of its shingles, and no pair is left to chance.
KEYS = 32

# Classes of one block of a tile.
BLOCK = 2048

# Joins filter the scan of their large side by a Bloom filter whatever its size.
FILTER_SCAN = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1g",
}

SIGNED = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("version", pa.int64()),
        ("n", pa.int64()),
        ("digest", pa.binary()),
        ("bitmap", pa.binary()),
        ("keys", pa.list_(pa.int64())),
    ]
)
SIGNED_DDL = "doc_id bigint, version bigint, n bigint, digest binary, bitmap binary, keys array<bigint>"


def encoded(column: pa.ChunkedArray) -> list[bytes]:
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def bitmap(hashes: np.ndarray) -> bytes:
    """One bit per slot: whether an odd number of hashes fall in it. At least twice as many slots as hashes."""
    width = max(64, 2 << max(len(hashes) - 1, 0).bit_length())
    odd = np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(maps: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, all folded to the narrowest: slots modulo its width."""
    width = min(map(len, maps))
    rows = [np.bitwise_xor.reduce(np.frombuffer(m, np.uint8).reshape(-1, width), axis=0) for m in maps]
    return np.stack(rows).view(np.uint64)


def prefix(hashes: np.ndarray, keys: int | None) -> np.ndarray:
    """The smallest hashes of a set: as many as a linked set must share one of, ``keys`` at most."""
    whole = len(hashes) - -(-3 * len(hashes) // 4) + 1 if len(hashes) else 0
    return hashes[: whole if keys is None else min(keys, whole)].view(np.int64)


def sign(keys: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(encoded(batch.column("text")))
            yield to_batch(
                SIGNED,
                batch.column("doc_id"),
                batch.column("version"),
                [len(s) for s in sets],
                [blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                [bitmap(s) for s in sets],
                [prefix(s, keys) for s in sets],
            )

    return run


def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("rep", pa.int64()), ("hashes", pa.list_(pa.int64()))])
    for batch in slices(batches):
        sets = shingle_sets(encoded(batch.column("text")))
        yield to_batch(schema, batch.column("rep"), [s.view(np.int64) for s in sets])


def enough(overlap, sizes):
    return PARTS * overlap >= SHARE * sizes


def allowed(n_left, n_right, differ):
    """Whether sets whose bitmaps differ in so many bits could link: each such bit is an element apart."""
    return enough((n_left + n_right - differ) // 2, n_left + n_right)


def tile_pairs(rows: list[tuple], every: bool, key: int = 0) -> set[tuple[int, int]]:
    """Pairs across components of a tile, or of two blocks of it, that the bit counts allow.

    All of them whose smallest common key is the tile's, so that each pair comes from one tile;
    or of each class only the one with the fewest bits apart. A row is (id, size, component,
    upper band, block, bitmap, keys). Pairs of the upper band with itself belong to the tile
    above; in a pair of blocks a pair within one belongs elsewhere.
    """
    rows.sort(key=lambda r: (r[1], r[0]))
    ids, n, component, upper, block = (np.array([r[k] for r in rows]) for k in range(5))
    bits = folded([r[5] for r in rows])
    apart = block.min() != block.max()
    nearest, partner = np.full(len(rows), np.iinfo(np.int64).max), np.full(len(rows), -1)
    pairs = set()
    keys = [set(r[6]) for r in rows] if every else None
    for i in range(len(rows) - 1):
        j = np.arange(i + 1, np.searchsorted(n, 4 * n[i] // 3, side="right"))
        j = j[(component[j] != component[i]) & ~(upper[j] & upper[i])]
        if apart:
            j = j[block[j] != block[i]]
        if not len(j):
            continue
        differ = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64)
        ok = allowed(n[j], n[i], differ)
        j, differ = j[ok], differ[ok]
        if every:
            for k in j.tolist():
                if min(keys[i] & keys[k]) == key:
                    pairs.add((min(ids[i], ids[k]), max(ids[i], ids[k])))
        elif len(j):
            at = differ.argmin()
            if differ[at] < nearest[i]:
                nearest[i], partner[i] = differ[at], j[at]
            closer = differ < nearest[j]
            nearest[j[closer]], partner[j[closer]] = differ[closer], i
    for i in np.flatnonzero(partner >= 0):
        a, b = ids[i], ids[partner[i]]
        pairs.add((min(a, b), max(a, b)))
    return pairs


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])
PAIRS_DDL = "a bigint, b bigint"


def compare_tiles(every: bool):
    """Rows come sorted by tile; a tile has two blocks at most."""

    def pack(found: set) -> pa.RecordBatch:
        pairs = sorted(found)
        found.clear()
        return to_batch(PAIRS, [int(a) for a, _ in pairs], [int(b) for _, b in pairs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held, found = None, [], set()
        for batch in batches:
            for key, band, x, y, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, band, x, y) != tile:
                    if len(held) > 1:
                        found |= tile_pairs(held, every, tile[0])
                    tile, held = (key, band, x, y), []
                    if len(found) > 100_000:
                        yield pack(found)
                held.append(tuple(row))
        if len(held) > 1:
            found |= tile_pairs(held, every, tile[0])
        yield pack(found)

    return run


def allowed_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for n, m, *maps in zip(*(batch.column(c).to_pylist() for c in ("n", "m", "left", "right"))):
            left, right = folded(maps)
            keep.append(bool(allowed(n, m, int(np.bitwise_count(left ^ right).sum()))))
        mask = pa.array(keep, pa.bool_())
        yield to_batch(PAIRS, batch.column("a").filter(mask), batch.column("b").filter(mask))


def overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with their sorted arrays those that link."""
    for batch in batches:
        left, right = batch.column("left"), batch.column("right")
        keep = []
        for i in range(batch.num_rows):
            s, t = (x[i].values.to_numpy(zero_copy_only=False) for x in (left, right))
            at = np.minimum(np.searchsorted(t.view(np.uint64), s.view(np.uint64)), len(t) - 1)
            keep.append(enough(int((t[at] == s).sum()), len(s) + len(t)))
        mask = pa.array(keep, pa.bool_())
        yield to_batch(PAIRS, batch.column("a").filter(mask), batch.column("b").filter(mask))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    side = lambda name, as_: sets.select(F.col("rep").alias(name), F.col("hashes").alias(as_))
    return (
        pairs.join(side("a", "left"), "a")
        .join(side("b", "right"), "b")
        .select("a", "b", "left", "right")
        .mapInArrow(overlaps, PAIRS_DDL)
    )


def candidates(met: DataFrame, classes: DataFrame, label: DataFrame, every: bool) -> DataFrame:
    """(a, b) across components that the bit counts allow, from the tiles of ``met`` (key, rep, n).

    ``label`` (id, component) holds the components so far; a class outside it is its own.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(4 / 3))).cast("int")
    met = met.join(label.withColumnRenamed("id", "rep"), "rep", "left").select(
        "key", "rep", "n", F.coalesce("component", "rep").alias("component")
    )
    mixed = met.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y")
    tiles = met.join(mixed.select("key"), "key", "left_semi").withColumn("band", band)
    tiles = tiles.select("*", F.explode(F.array("band", F.col("band") - 1)).alias("tile"))
    size = (
        tiles.groupBy("key", "tile")
        .agg(
            F.min("component").alias("x"),
            F.max("component").alias("y"),
            F.min(F.col("band") - F.col("tile")).alias("above"),
            F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"),
        )
        .where("x < y AND above = 0")
        .select("key", "tile", "blocks")
    )
    others = F.expr("transform(sequence(0, blocks - 1), k -> struct(least(k, block) AS x, greatest(k, block) AS y))")
    dealt = (
        tiles.join(size, ["key", "tile"])
        .withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        .withColumn("with", F.explode(others))
        .join(classes.select("rep", "bitmap", *(["keys"] if every else [])), "rep")
        .select(
            "key", "tile", F.col("with.x").alias("x"), F.col("with.y").alias("y"), "rep", "n", "component",
            (F.col("band") > F.col("tile")).alias("upper"), "block", "bitmap", *(["keys"] if every else []),
        )
        .repartition("key", "tile", "x", "y")
        .sortWithinPartitions("key", "tile", "x", "y")
    )
    return dealt.mapInArrow(compare_tiles(every), PAIRS_DDL).distinct()


def versions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, version and text: a row is known by its id and a 64-bit hash of its text, so an id
    may have several texts."""
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text")
    )


def texts_of(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """(rep, text) of each class's first row.

    The filter says no more than what holds for every class, but under ``FILTER_SCAN`` it lets Spark pass the
    ids to the scan of the texts as a Bloom filter, so that few other texts are shuffled.
    """
    met = docs.join(firsts.where("rep >= 0"), ["doc_id", "version"])
    return met.dropDuplicates(["doc_id", "version"]).select("rep", "text")


def placed(docs: DataFrame, keys: int | None) -> DataFrame:
    """Per row of ``docs`` (doc_id, version, text): doc_id, version, n, digest, and the first row
    (doc_id, version) of its component; null for a row without shingles or without an id."""
    signed = staged(docs.mapInArrow(sign(keys), SIGNED_DDL), "signed")

    # Classes are numbered, for rows of one id may stand in several; the numbers are as written.
    classes = staged(
        signed.where("digest IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("digest")
        .agg(
            F.min(F.struct("doc_id", "version")).alias("first"),
            *(F.any_value(c).alias(c) for c in ("n", "bitmap", "keys")),
        )
        .withColumn("rep", F.monotonically_increasing_id()),
        "classes",
    )
    # Dealt by key once, for the heads and for the join with them.
    met = classes.select("rep", "n", F.explode("keys").alias("key")).repartition("key")
    heads = met.groupBy("key").agg(F.min("rep").alias("head"), F.max("rep").alias("last")).where("head < last")
    met = staged(met.join(heads.drop("last"), "key"), "met")

    # Each class with the head it shares most keys with.
    shared = met.where("rep <> head").groupBy("rep", "head").agg(F.count("*").alias("shared"))
    nearest = shared.groupBy(F.col("rep").alias("b")).agg(
        F.max_by("head", F.struct(F.col("shared"), -F.col("head"))).alias("a")
    )
    held = lambda name, n, bits: classes.select(F.col("rep").alias(name), F.col("n").alias(n), F.col("bitmap").alias(bits))
    starred = staged(
        nearest.join(held("a", "n", "left"), "a").join(held("b", "m", "right"), "b").mapInArrow(allowed_pairs, PAIRS_DDL),
        "pairs",
    )
    under = starred.select(F.col("b").alias("id"), F.col("a").alias("component"))
    tried = starred.union(staged(candidates(met, classes, under, every=False), "pairs"))

    # The sets of classes that were allowed a partner, worked out again from their first row's text.
    partnered = staged(tried.select(F.col("a").alias("rep")).union(tried.select("b")).distinct(), "partnered")
    firsts = staged(classes.select("rep", "first.*").join(partnered, "rep", "left_semi"), "firsts")
    with settings(docs.sparkSession, FILTER_SCAN):
        sets = staged(texts_of(docs, firsts).mapInArrow(sets_of, "rep bigint, hashes array<bigint>"), "sets")
    links = staged(verified(tried, sets), "links")
    met = staged(met.join(partnered, "rep", "left_semi"), "met")
    for every in (False, True):
        pairs = staged(candidates(met, classes, components(links), every), "pairs")
        links = links.union(staged(verified(pairs, sets), "links"))

    # A component's first row is the smallest of its classes' first rows.
    linked = staged(
        components(links).withColumnRenamed("id", "rep").join(classes.select("rep", "digest", "first"), "rep"), "linked"
    )
    least = staged(linked.groupBy("component").agg(F.min("first").alias("least")), "least")
    moved = linked.join(least, "component").select("digest", "least")
    found = classes.select("digest", "first").join(moved, "digest", "left")
    found = found.select("digest", F.coalesce("least", "first").alias("first"))
    return (
        signed.select("doc_id", "version", "n", "digest")
        .join(found, "digest", "left")
        .withColumn("first", F.when(F.col("doc_id").isNotNull(), F.col("first")))
    )


def jaccard_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys: int | None = KEYS
) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs``; other columns are not read.

    Documents link when 100 * overlap >= 75 * union of their five-word shingles; component_id
    is the smallest id reachable by links. A null, empty or wordless text has no shingles and is
    linked with nothing. Rows that repeat an id and text are one document and are all returned.
    Rows of one id with different texts are documents of their own, each linked by its own text.
    Rows with a null id are linked with nothing and returned with a null component. No rows, no
    rows. ``keys`` of None meets sets by their whole prefixes: exact for sets of any size, at the
    cost of a row per four shingles of each class.
    """
    return placed(versions(docs, id_col, text_col), keys).select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("first.doc_id", "doc_id").alias("component_id"),
    )


def one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keys: int | None = KEYS
) -> DataFrame:
    """``docs`` with one row of each group of linked documents.

    The row of the smallest id stays; where that id has several texts in the group, the one with
    the smallest hash. Of rows that repeat an id and text one stays, by the smallest hash of its
    columns (maps aside); that holds for texts without words, too. Any other row stays: those
    without an id, and those that share an id with a row that they are not linked with.
    """
    gone = (
        placed(versions(docs, id_col, text_col), keys)
        .where((F.col("first.doc_id") != F.col("doc_id")) | (F.col("first.version") != F.col("version")))
        .select("doc_id", "version")
        .distinct()
    )
    hashed = [f.name for f in docs.schema if "map<" not in f.dataType.simpleString()]
    row = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.xxhash64(text_col).alias("version"),
        F.xxhash64(*hashed).alias("place"),
        F.struct(*docs.columns).alias("row"),
    )
    kept = row.where("doc_id IS NOT NULL").join(gone, ["doc_id", "version"], "left_anti")
    kept = kept.groupBy("doc_id", "version").agg(F.min_by("row", "place").alias("row"))
    return kept.select("row.*").union(row.where("doc_id IS NULL").select("row.*"))
