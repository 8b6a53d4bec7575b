"""Language by bit-sliced Bloom filters of character n-grams.

One table of slots serves all languages: a slot holds one bit per language. The slots of an
n-gram, combined by AND, give the mask of all languages whose filter holds it. Bits are counted
per language over the n-grams of a text and corrected for the hits a filter gives by chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crateline.llm.common import mix, slices, staged, to_batch

# A language's n-grams: these sizes, those that make up LEAST_SHARE of its training text or
# more, hence 1 / LEAST_SHARE of them at most. The rule is one for languages of any size.
SIZES = (2, 3, 4)
LEAST_SHARE = 2e-5
# Documents of a language that are learned from, as the expected size of a sample by hash.
TRAINED = 4000
SLOT_BITS = 20
PROBES = 2
UNKNOWN = "und"

POINTS = 0x20000
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether a code point is a letter; those past the table count as the last."""
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(POINTS)]))
    return _letters[0]


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of all texts as code points, anything else 0; and the texts' starts.

    A text begins and ends with a 0.
    """
    lowered = ["", *(t.lower() for t in texts), ""]
    found = np.frombuffer("\0".join(lowered).encode("utf-32-le", "replace"), np.uint32)
    starts = np.cumsum([0, *(len(t) + 1 for t in lowered[1:-1])])
    return np.where(letters()[np.minimum(found, POINTS - 1)], found, 0), starts


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per size: 64-bit hashes of the n-grams of words and their edges, and each text's bounds."""
    found, starts = points(texts)
    solid = found > 0
    wide = found.astype(np.uint64)
    for size in SIZES:
        n = len(found) - size + 1
        keep = np.ones(n, bool) if n > 0 else np.zeros(0, bool)
        for k in range(1, size - 1):
            keep &= solid[k : k + n]
        keep &= (solid[:n] | solid[size - 1 : size - 1 + n]) if size == 2 else True
        at = np.flatnonzero(keep)
        hashed = np.full(len(at), size, np.uint64)
        for k in range(size):
            hashed = mix(hashed * np.uint64(0x9E3779B97F4A7C15) + wide[at + k])
        yield hashed, np.searchsorted(at, starts)


def slot_columns(gram: Column) -> list[Column]:
    """``slots`` as columns."""
    return [F.shiftrightunsigned(gram, k * SLOT_BITS).bitwiseAND(F.lit((1 << SLOT_BITS) - 1)).cast("int") for k in range(PROBES)]


def slots(hashed: np.ndarray) -> list[np.ndarray]:
    return [((hashed >> np.uint64(k * SLOT_BITS)) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64) for k in range(PROBES)]


@dataclass(frozen=True)
class Filters:
    """Languages and, per word of 64 of them, the masks of all slots. Of fixed size per language."""

    languages: tuple[str, ...]
    masks: tuple[np.ndarray, ...]

    @staticmethod
    def build(languages: list[str], word: np.ndarray, slot: np.ndarray, bits: np.ndarray) -> Filters:
        """From the filled slots: which word of languages, which slot, and its bits."""
        masks = [np.zeros(1 << SLOT_BITS, np.uint64) for _ in range(-(-len(languages) // 64))]
        for k, mask in enumerate(masks):
            mask[slot[word == k]] = bits[word == k].view(np.uint64)
        return Filters(tuple(languages), tuple(masks))

    def chance(self) -> np.ndarray:
        """Per language how often an n-gram outside its filter hits."""
        filled = [
            ((self.masks[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(len(self.languages))
        ]
        return np.array(filled) ** PROBES

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per text and language the hits beyond chance, and the number of n-grams per text."""
        hits, total, chance = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts)), self.chance()
        for hashed, bounds in grams(texts):
            where = slots(hashed)
            sizes = np.diff(bounds)
            for k in range(len(self.languages)):
                if k % 64 == 0:
                    mask = np.bitwise_and.reduce([self.masks[k // 64][at] for at in where])
                bit = ((mask >> np.uint64(k % 64)) & np.uint64(1)).astype(np.int64)
                run = np.concatenate([[0], np.cumsum(bit)])[bounds]
                hits[:, k] += (np.diff(run) - sizes * chance[k]) / (1 - chance[k])
            total += sizes
        return hits, total


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("seen", pa.int64())])
    for batch in slices(batches):
        by: dict[str, list[str]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            held, seen = np.unique(np.concatenate([h for h, _ in grams(texts)]), return_counts=True)
            yield to_batch(schema, [lang] * len(held), held.view(np.int64), seen)


def learn(docs: DataFrame, trained: int = TRAINED) -> Filters:
    """Filters from rows (doc_id, text, lang) that have a text and a language.

    Each language is learned from a sample by hash of about ``trained`` documents, or all if it
    has fewer. The shares, one row per language, are stored: where the table is small by its
    files' size, the planner sends it to where texts are read. Slots are filled in Spark; the
    driver gets the languages' names and a word per slot and 64 languages at most, as much as
    the filters hold. No rows, no languages.
    """
    docs = docs.where("text IS NOT NULL AND lang IS NOT NULL")
    share = docs.groupBy("lang").agg((F.lit(float(trained)) / F.count("*")).alias("share")).withColumnRenamed("lang", "l")
    drawn = docs.join(staged(share, "shares"), F.col("l") == F.col("lang")).where(
        F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("share") * (1 << 20)
    )
    seen = (
        drawn.select("lang", "text")
        .mapInArrow(counted, "lang string, gram bigint, seen bigint")
        .groupBy("lang", "gram")
        .agg(F.sum("seen").alias("seen"))
    )
    seen = staged(seen, "seen")
    total = staged(seen.groupBy(F.col("lang").alias("l")).agg(F.sum("seen").alias("total")), "totals")
    kept = (
        seen.join(total, F.col("l") == F.col("lang"))
        .where(F.col("seen") >= F.col("total") * LEAST_SHARE)
        .select("lang", "gram")
    )
    languages = sorted(r["lang"] for r in kept.select("lang").distinct().collect())
    if not languages:
        return Filters((), ())
    numbers = staged(
        docs.sparkSession.createDataFrame(list(enumerate(languages)), "number int, l string"), "languages"
    )
    filled = (
        kept.join(numbers, F.col("l") == F.col("lang"))
        .select(
            F.shiftright("number", 6).alias("word"),
            F.explode(F.array(*slot_columns(F.col("gram")))).alias("slot"),
            F.expr("shiftleft(1L, number % 64)").alias("bit"),
        )
        .groupBy("word", "slot")
        .agg(F.bit_or("bit").alias("bits"))
        .toPandas()
    )
    return Filters.build(languages, *(filled[c].to_numpy() for c in ("word", "slot", "bits")))


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """(doc_id, lang_pred, score) per row of (doc_id, text).

    The language with the most hits beyond chance, ties to the first by code point; the score
    is its lead over the next as a share of its hits, and 0 to 1. ``und`` and 0 for a null text,
    one without letters, or when no language was learned.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            lettered = [any(map(str.isalpha, t)) for t in texts]
            hits, _ = filters.counts(texts)
            names, scores = [], []
            for ok, row in zip(lettered, hits):
                if not ok or not len(row):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                best = int(row.argmax())
                top = max(row[best], 0.0)
                rest = max(np.delete(row, best).max(initial=0.0), 0.0)
                names.append(filters.languages[best])
                scores.append(float((top - rest) / top) if top > 0 else 0.0)
            yield to_batch(schema, batch.column("doc_id"), names, scores)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(
        run, "doc_id bigint, lang_pred string, score double"
    )
