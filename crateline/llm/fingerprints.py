"""Document fingerprints from prefix polynomial hashes.

Arrays of prefix hashes modulo two primes give the hash of any span in constant time: equal spans
have equal hashes wherever they stand, and the longest common extension of two positions is found
by binary search. A fingerprint keeps, of a whole text, its length, its hash, the hashes of
prefixes whose lengths grow by an eighth, and a sketch of its spans of SPAN code points: per slot
of the hash range the smallest hash that falls there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crateline.llm.common import TEXT_BYTES, mix, to_batch

PRIMES = (2147483647, 2147483629)
BASES = (1103515249, 1664525021)
SPAN = 12
SLOTS = 64
# Hex digits of a kept prefix hash and of a sketch slot.
PREFIX_HEX, SLOT_HEX = 6, 5
EMPTY = (1 << 4 * SLOT_HEX) - 1

_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _power_table(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of each base and of its inverse modulo its prime, by doubling."""
    if not _powers or len(_powers[0][0]) < n:
        size = 1 << max(n - 1, 1).bit_length()
        _powers.clear()
        for p, base in zip(PRIMES, BASES):
            both = []
            for b in (base, pow(base, -1, p)):
                out = np.ones(1, np.uint64)
                while len(out) < size:
                    out = np.concatenate([out, out * np.uint64(pow(b, len(out), p)) % np.uint64(p)])
                both.append(out)
            _powers.append(tuple(both))
    return _powers


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)


class PrefixHashes:
    """Prefix hashes of a sequence of code points; spans are [start, end)."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.tables = _power_table(self.n + 1)
        self.prefix = []
        for p, (power, _) in zip(PRIMES, self.tables):
            held = np.zeros(self.n + 1, np.uint64)
            # Up to 2**33 terms below 2**31 add up without overflow.
            np.cumsum((values + np.uint64(1)) * power[: self.n] % np.uint64(p), out=held[1:])
            self.prefix.append(held % np.uint64(p))

    def half(self, k: int, start, end) -> np.ndarray:
        """Hashes of many spans modulo one prime; ``start`` and ``end`` are indices or slices."""
        p, held = np.uint64(PRIMES[k]), self.prefix[k]
        return (held[end] + p - held[start]) % p * self.tables[k][1][start] % p

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of many spans at once, both moduli in one value."""
        return self.half(0, start, end) << np.uint64(31) | self.half(1, start, end)

    def span(self, start: int, end: int) -> int:
        return int(self.spans(np.array([start]), np.array([end]))[0])

    def equal(self, start: int, other: int, length: int) -> bool:
        return self.span(start, start + length) == self.span(other, other + length)


def common_extension(left: PrefixHashes, i: int, right: PrefixHashes, j: int) -> int:
    """Length of the longest common span that starts at i in one text and at j in the other."""
    low, high = 0, min(left.n - i, right.n - j)
    while low < high:
        middle = (low + high + 1) // 2
        if left.span(i, i + middle) == right.span(j, j + middle):
            low = middle
        else:
            high = middle - 1
    return low


def ladder(n: int) -> list[int]:
    """Lengths of the kept prefixes: 1 to 8, then growing by an eighth, up to n."""
    out, at = [], 1
    while at <= n:
        out.append(at)
        at += max(1, at // 8)
    return out


def fingerprint(values: np.ndarray) -> str:
    """``length:hash:prefixes:sketch`` in hex; equal texts have equal fingerprints."""
    n = len(values)
    held = PrefixHashes(values)
    rungs = np.array(ladder(n), np.int64)
    steps = mix(held.spans(np.zeros(len(rungs), np.int64), rungs)) >> np.uint64(64 - 4 * PREFIX_HEX)
    width = min(SPAN, n)
    # One modulus is enough for a sketch.
    hashed = np.sort(mix(held.half(0, slice(0, n - width + 1), slice(width, n + 1)))) if n else np.zeros(0, np.uint64)
    first = np.searchsorted(hashed, np.arange(SLOTS, dtype=np.uint64) << np.uint64(58))
    sketch = np.full(SLOTS, EMPTY, np.uint64)
    there = first < len(hashed)
    kept = hashed[np.minimum(first, len(hashed) - 1)] if n else sketch
    there &= (kept >> np.uint64(58)) == np.arange(SLOTS)
    low = kept & np.uint64(EMPTY)
    sketch[there] = np.minimum(low[there], np.uint64(EMPTY - 1))
    whole = int(mix(np.array([held.span(0, n)], np.uint64))[0]) if n else 0
    parts = "".join(f"{x:0{PREFIX_HEX}x}" for x in steps.tolist())
    slots = "".join(f"{x:0{SLOT_HEX}x}" for x in sketch.tolist())
    return f"{n:x}:{whole:016x}:{parts}:{slots}"


def likeness(one: str, other: str) -> float:
    """0 to 1, from two fingerprints alone: 1 for equal ones, else the larger of the sketches'
    Dice coefficient and the common beginning as a share of the longer text."""
    if one == other:
        return 1.0
    (n, _, steps, slots), (m, _, others, more) = one.split(":"), other.split(":")
    n, m = int(n, 16), int(m, 16)
    if not n or not m:
        return 0.0
    rungs = ladder(min(n, m))
    low, high = 0, len(rungs)
    while low < high:  # a prefix that agrees makes all shorter ones agree
        middle = (low + high + 1) // 2
        at = slice((middle - 1) * PREFIX_HEX, middle * PREFIX_HEX)
        low, high = (middle, high) if steps[at] == others[at] else (low, middle - 1)
    begun = rungs[low - 1] / max(n, m) if low else 0.0
    same = filled = 0
    empty = f"{EMPTY:0{SLOT_HEX}x}"
    for k in range(0, SLOTS * SLOT_HEX, SLOT_HEX):
        a, b = slots[k : k + SLOT_HEX], more[k : k + SLOT_HEX]
        filled += a != empty or b != empty
        same += a == b != empty
    jaccard = same / filled if filled else 0.0
    return min(1.0, max(begun, 2 * jaccard / (1 + jaccard)))


EDITED = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited", pa.string()), ("fingerprint", pa.string())]
    + [("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)
EDITED_DDL = (
    "doc_id bigint, n_chars bigint, edited string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def edited_text(text: str, following: str) -> str:
    """The last third of the code points replaced by as many first ones of the following text, or all."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, bucket, borrowed) by bucket and descending id; one row is held at a time.

    A borrowed row ends its bucket: it is only the follower of the row before.
    """
    held, out, size = None, [], 0
    for batch in batches:
        for doc_id, text, bucket, borrowed in zip(*(c.to_pylist() for c in batch.columns)):
            text = text or ""
            print_ = fingerprint(points(text))
            if held is not None and held[2] == bucket:
                own_id, own, _, own_print = held
                edited = edited_text(own, text)
                changed = fingerprint(points(edited)) if edited != own else own_print
                near = likeness(own_print, changed), likeness(own_print, print_)
                out.append((own_id, len(own), edited, own_print, changed, *near))
                size += len(edited)
            held = None if borrowed else (doc_id, text, bucket, print_)
            if size > TEXT_BYTES:
                yield to_batch(EDITED, *zip(*out))
                out, size = [], 0
    if out:
        yield to_batch(EDITED, *zip(*out))


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text takes its end from the next document by descending id, the first after the
    last; a lone document follows itself. Null text is empty; an empty text likens to an empty
    one only. Null ids come last. Rows that repeat an id follow each other by text. No rows, no
    rows. Other columns are not read.

    Ids alone are read first, for bounds that split them evenly; texts are shuffled once, by the
    bucket of their id, and the first row of each bucket is also lent to the bucket before. An id
    with very many rows fills one bucket, which is read row by row.
    """
    spark = docs.sparkSession
    # Null ids sort below all others; the text settles the order of repeated ids.
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    key = F.coalesce("doc_id", F.lit(-(2**63)))
    # Several buckets to a partition even out how they are dealt.
    n = 4 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ids = rows.select(key.alias("key"))
    cuts = ids.agg(F.percentile_approx("key", [k / n for k in range(1, n)] or [0.5], 10000)).head()[0]
    cuts = sorted(set(cuts or []), reverse=True)
    bounds = F.array(*(F.lit(c) for c in cuts)) if cuts else F.array().cast("array<bigint>")
    # Bucket: how many bounds lie above the id, by binary search.
    halve = lambda s, bounds, key: F.when(
        s["low"] < s["high"],
        F.when(
            F.element_at(bounds, F.shiftright(s["low"] + s["high"], 1) + 1) > key,
            F.struct((F.shiftright(s["low"] + s["high"], 1) + 1).alias("low"), s["high"].alias("high")),
        ).otherwise(F.struct(s["low"].alias("low"), F.shiftright(s["low"] + s["high"], 1).alias("high"))),
    ).otherwise(s)
    steps = F.sequence(F.lit(1), F.lit(max(1, len(cuts).bit_length() + 1)))
    start = F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high"))
    bucket = lambda key: F.aggregate(steps, start, lambda s, _: halve(s, bounds, key))["low"]

    placed = ids.select("key", bucket(F.col("key")).alias("bucket"))
    tops = {r["bucket"]: r["key"] for r in placed.groupBy("bucket").agg(F.max("key").alias("key")).collect()}
    filled = sorted(tops)
    # Each bucket's top row is lent to the filled bucket before, the first one's to the last.
    lend = dict(zip(filled, [filled[-1], *filled[:-1]])) if filled else {}
    text = F.coalesce("text", F.lit(""))
    keyed = rows.withColumn("key", key).withColumn("bucket", bucket(F.col("key")))
    first = keyed.where(F.col("key").isin(list(tops.values()))).groupBy("bucket", "key", "doc_id").agg(F.min(text).alias("text"))
    to = F.create_map(*(F.lit(x) for pair in lend.items() for x in pair)) if lend else F.create_map()
    if lend:
        lent = first.select("doc_id", "text", "key", to[F.col("bucket")].alias("bucket"), F.lit(True).alias("borrowed"))
        keyed = keyed.withColumn("borrowed", F.lit(False)).unionByName(lent)
    else:
        keyed = keyed.withColumn("borrowed", F.lit(False))
    dealt = (
        keyed.repartition("bucket")
        .sortWithinPartitions("bucket", "borrowed", F.desc("key"), text)
        .select("doc_id", "text", "bucket", "borrowed")
    )
    return dealt.mapInArrow(follow, EDITED_DDL)
