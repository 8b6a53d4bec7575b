"""Document quality by a regularised quadratic discriminant over transformed text statistics.

Each class has its own mean and covariance, the covariance shrunk towards its diagonal and the
diagonal towards the pooled one. A document's log odds are the difference of both log densities,
read from Mahalanobis distances through Cholesky factors that are worked out once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crateline.llm.common import slices, to_batch

NAMES = (
    "words", "word_length", "long_word", "upper", "symbols", "digits", "distinct", "echo",
    "lines", "line_copies", "short_words", "stops", "end_marks", "bars", "top_word",
)
# Shares of the class's own diagonal and of the pooled diagonal in its covariance.
OWN_DIAGONAL = 0.1
POOLED_DIAGONAL = 0.5
FLOOR = 1e-4
LIMIT = 30.0


def share(part: float, whole: float) -> float:
    """Log odds of a share, smoothed, so that shares near 0 and 1 are spread."""
    return math.log((part + 0.5) / (whole - part + 0.5)) if whole > 0 else 0.0


def statistics(text: str) -> list[float]:
    """Transformed statistics of a whole text; those of an empty text are all defined."""
    words = text.split()
    n, length = len(words), len(text)
    letters = sum(map(len, words))
    kinds = set(words)
    upper = sum(map(str.isupper, words))
    plain = sum(map(str.isalpha, words))
    tails = [w[-1] for w in words]
    symbols = sum(not c.isalnum() and c not in ".,;:!?'\"" for c in tails)
    lines = text.split("\n")
    echo = sum(map(str.__eq__, words, words[1:]))
    short = sum(len(w) <= 3 for w in words)
    return [
        math.log1p(n),
        math.log1p(letters / n) if n else 0.0,
        math.log1p(max(map(len, words), default=0)),
        share(upper, n),
        share(symbols, n),
        share(n - plain, n),
        share(len(kinds), n),
        share(echo, max(n - 1, 0)),
        math.log1p(len(lines)),
        share(len(lines) - len(set(lines)), len(lines)),
        share(short, n),
        share(sum(c in ".?" for c in tails), n),
        share(sum(c == "!" for c in tails), n),
        share(text.count("|"), max(length, 1)),
        share(n - len(kinds), n) if n < 2 else math.log((n - len(kinds) + 1) / math.sqrt(n)),
    ]


def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])
    for batch in slices(batches):
        yield to_batch(schema, batch.column("doc_id"), [statistics(t or "") for t in batch.column("text").to_pylist()])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x) per row of ``docs``: the statistics of its whole text, of the empty one for null.

    Null ids and repeated rows stay; other columns are not read. No rows, no rows.
    """
    kept = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return kept.mapInArrow(measure, "doc_id bigint, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Log prior odds, and per class its mean, the inverse Cholesky factor and log determinant."""

    prior: float
    means: tuple[np.ndarray, ...]
    factors: tuple[np.ndarray, ...]
    determinants: tuple[float, ...]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 per row; one half where nothing was learned."""
        if not self.means:
            return np.full(len(x), 0.5)
        zero, one = (
            (((x - m) @ f.T) ** 2).sum(axis=1) + d for m, f, d in zip(self.means, self.factors, self.determinants)
        )
        return 1 / (1 + np.exp(-np.clip(self.prior + (zero - one) / 2, -LIMIT, LIMIT)))


def learn(rows: DataFrame) -> Discriminant:
    """From rows (x, label 0 or 1): counts, sums and products are added up by Spark.

    With one class only, the prior decides for it; with no rows every score is one half.
    """
    k = len(NAMES)
    at = lambda i: F.col("x")[i]
    sums = [F.sum(at(i)).alias(f"s{i}") for i in range(k)]
    products = [F.sum(at(i) * at(j)).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)]
    told = {r["label"]: r for r in rows.groupBy("label").agg(F.count("*").alias("n"), *sums, *products).collect()}
    if not {0, 1} <= told.keys():
        if not told:
            return Discriminant(0.0, (), (), ())
        flat, eye = np.zeros(k), np.zeros((k, k))
        return Discriminant(LIMIT if 1 in told else -LIMIT, (flat, flat), (eye, eye), (0.0, 0.0))
    means, spread = [], []
    for label in (0, 1):
        r = told[label]
        mean = np.array([r[f"s{i}"] for i in range(k)]) / r["n"]
        second = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                second[i, j] = second[j, i] = r[f"p{i}_{j}"] / r["n"]
        means.append(mean)
        spread.append(second - np.outer(mean, mean))
    n0, n1 = told[0]["n"], told[1]["n"]
    pooled = np.diag((n0 * np.diag(spread[0]) + n1 * np.diag(spread[1])) / (n0 + n1))
    factors, determinants = [], []
    for s in spread:
        own = (1 - OWN_DIAGONAL) * s + OWN_DIAGONAL * np.diag(np.diag(s))
        low = np.linalg.cholesky((1 - POOLED_DIAGONAL) * own + POOLED_DIAGONAL * pooled + FLOOR * np.eye(k))
        factors.append(np.linalg.inv(low))
        determinants.append(2 * float(np.log(np.diag(low)).sum()))
    return Discriminant(math.log(n1 / n0), tuple(means), tuple(factors), tuple(determinants))


def score(rows: DataFrame, model: Discriminant) -> DataFrame:
    """(doc_id, score) per row of (doc_id, x); null ids and repeated rows stay."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            yield to_batch(schema, batch.column("doc_id"), model.scores(x))

    return rows.select("doc_id", "x").mapInArrow(run, "doc_id bigint, score double")
