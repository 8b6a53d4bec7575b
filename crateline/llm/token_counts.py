"""Token counts of sections, from one encoding of the whole document.

Counting sections one by one would cut tokens at their edges. Instead the document is encoded
once, each token is mapped to its span, and the spans are met with the sections' spans; a token
that crosses an edge goes where ``RULES`` says.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crateline.llm.common import slices, to_batch

# Where a token that crosses an edge counts: in the section of its first byte, of its last byte,
# or of most of its bytes, the earliest among equals.
RULES = ("first", "last", "most")


@lru_cache(maxsize=2)
def encoding(ranks: bytes, pattern: str):
    """The encoder of a rank file, and the byte length of every token; one per worker."""
    import tiktoken

    held = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    sizes = np.zeros(max(held.values()) + 1, np.int64)
    for token, k in held.items():
        sizes[k] = len(token)
    return tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=held, special_tokens={}), sizes


def line_edges(text: bytes) -> np.ndarray:
    """Byte edges of the lines, each with the break that ends it; an empty text has no lines."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return np.unique(np.concatenate([[0], ends, [len(text)]]))


def allocate(ends: np.ndarray, edges: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token, and whether it crosses an edge; tokens and sections lie end to end."""
    starts = np.concatenate([[0], ends[:-1]])
    first = np.searchsorted(edges, starts, side="right") - 1
    last = np.searchsorted(edges, ends - 1, side="right") - 1
    crossing = first != last
    if rule == "first":
        return first, crossing
    if rule == "last":
        return last, crossing
    at = first.copy()
    for t in np.flatnonzero(crossing).tolist():
        over = np.minimum(edges[first[t] + 1 : last[t] + 2], ends[t]) - np.maximum(edges[first[t] : last[t] + 1], starts[t])
        at[t] += int(over.argmax())
    return at, crossing


def count_tokens(
    docs: DataFrame, ranks: bytes, pattern: str, rule: str = "first", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per section of each row of ``docs``: doc_id, section (from 0), start and end (code points,
    exclusive), n_tokens, and n_crossing, those of them that reach into another section.

    Sections are lines with their breaks; they cover the text, so a document's counts add up to
    its tokens. A null or empty text has no sections. Null ids and repeated rows are kept; other
    columns are not read. No rows, no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    kinds = [("doc_id", pa.int64()), ("section", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]
    schema = pa.schema([*kinds, ("n_tokens", pa.int64()), ("n_crossing", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, sizes = encoding(ranks, pattern)
        for batch in slices(batches):
            ids: list = []
            parts: list[tuple[np.ndarray, ...]] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if not text:
                    continue
                data = text.encode()
                edges = line_edges(data)
                n = len(edges) - 1
                ends = np.cumsum(sizes[np.array(coder.encode_ordinary(text), np.int64)])
                at, crossing = allocate(ends, edges, rule)
                begun = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
                ids += [doc_id] * n
                counts = np.bincount(at, minlength=n), np.bincount(at[crossing], minlength=n)
                parts.append((np.arange(n), begun[edges[:-1]], begun[edges[1:]], *counts))
            if parts:
                yield to_batch(schema, ids, *(np.concatenate(c) for c in zip(*parts)))

    kept = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return kept.mapInArrow(
        run, "doc_id bigint, section bigint, start bigint, end bigint, n_tokens bigint, n_crossing bigint"
    )
