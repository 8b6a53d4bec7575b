"""Alignment of two tokenizers' tokens over the same bytes.

A batch of documents is encoded by both. Each token start is merged, as of its place and within
its document, with the other side's token that covers it; both directions together give every
pair of tokens that overlap. Places where tokens of both sides end cut the document into groups.

Pairs of ids are counted over the corpus by shard: a shard (one batch) numbers its own distinct
pairs and says how many of its documents hold each. Only these meet the corpus-wide counts, which
go back to the shard as one array; each document keeps its links as positions in it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crateline.llm.common import slices, staged

# Bytes of text in a shard; bounds a task's memory and the length of a shard's arrays.
SHARD_BYTES = 2 << 20
# White space of this length overflows the fast encoder's pattern; such texts go to the other one.
LONG_SPACE = re.compile(r"\s{2000}")
SPACE = "▁"
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


@dataclass(frozen=True)
class Sides:
    """The two tokenizers: a byte-level BPE file (JSON) and the pattern it splits by, and a piece model."""

    byte_bpe: str
    pattern: str
    pieces: str


def unmapped() -> dict[str, int]:
    """The byte each character of a byte-level vocabulary stands for: printable bytes for
    themselves, the others numbered on from 256 in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteSide:
    """Ids of a byte-level BPE, and the bytes of each id."""

    def __init__(self, path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        special = {t["content"] for t in model["added_tokens"]}
        of, vocabulary = unmapped(), model["model"]["vocab"]
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        ranks = {}
        for token, i in vocabulary.items():
            if token not in special:
                self.bytes[i] = bytes(of[c] for c in token)
                ranks[self.bytes[i]] = i
        # Merging by rank is merging in order only if the merges make ever larger ids.
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"])
        made = [vocabulary[a + b] for a, b in pairs]
        self.ranked = made == sorted(made)
        self.fast = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True

    def ids(self, text: str) -> list[int]:
        if self.ranked and not LONG_SPACE.search(text):
            return self.fast.encode_ordinary(text)
        return self.plain.encode(text, add_special_tokens=False).ids


class PieceSide:
    """Ids of a piece model, and the bytes of each id."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            byte = BYTE_PIECE.fullmatch(piece) if self.model.is_byte(i) else None
            self.bytes.append(bytes([int(byte[1], 16)]) if byte else piece.replace(SPACE, " ").encode())

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@lru_cache(maxsize=1)
def loaded(sides: Sides):
    """Both tokenizers, sizes of their tokens, and names of ids with what follows them; one per worker."""
    a, b = ByteSide(sides.byte_bpe, sides.pattern), PieceSide(sides.pieces)
    sizes = [np.array([len(t) for t in side.bytes], np.int64) for side in (a, b)]
    names = [f"{i}{end}" for i in range(max(map(len, sizes))) for end in (",", "|", ";")]
    return a, b, sizes, names


def overlaps(
    doc: np.ndarray, start: np.ndarray, other_doc: np.ndarray, other_start: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Position of every token, and of the other side's token that covers its start."""
    left = pd.DataFrame({"at": start, "doc": doc, "own": np.arange(len(start))})
    right = pd.DataFrame({"at": other_start, "doc": other_doc, "covering": np.arange(len(other_start))})
    met = pd.merge_asof(left, right, on="at", by="doc")
    return met["own"].to_numpy(), met["covering"].to_numpy()


def spelled(ids: list[np.ndarray], groups: list[np.ndarray], doc_groups: np.ndarray, names: list[str]) -> list[str]:
    """`a1,a2|b1;a3|b2,b3` per document: of each group the ids of the one side, then of the other.
    ``doc_groups`` are the edges of the documents in the numbering of groups."""
    n = int(doc_groups[-1])
    of_a, of_b = (np.bincount(g, minlength=n) for g in groups)
    ends = np.cumsum(of_a + of_b)
    out = np.empty(int(ends[-1]) if n else 0, np.int64)
    is_b = np.zeros(len(out), bool)
    before_b = np.concatenate([[0], np.cumsum(of_b)])
    upto_a = np.cumsum(of_a)
    at_b = np.arange(len(ids[1])) + upto_a[groups[1]]
    is_b[at_b] = True
    out[np.arange(len(ids[0])) + before_b[groups[0]]] = ids[0] * 3
    out[at_b] = ids[1] * 3
    out[ends - of_b - 1] += 1  # the last of a group's first side
    out[ends - 1] += 2
    edges = np.concatenate([[0], ends])[doc_groups].tolist()
    named = list(map(names.__getitem__, out.tolist()))
    return ["".join(named[i:j])[:-1] for i, j in zip(edges[:-1], edges[1:])]


def aligned(texts: list[str | None], sides: Sides) -> dict[str, np.ndarray | list]:
    """The documents of one shard: counts, digests, links as positions in the shard's pairs, and
    the pairs with the number of documents that hold them."""
    a, b, (size_a, size_b), names = loaded(sides)
    held = [t or "" for t in texts]
    all_b = b.ids(held)
    ids_a, ids_b, docs, lengths = [], [], [], []
    for k, text in enumerate(held):
        if not text:
            continue
        whole, in_a = (" " + text).encode(), a.ids(" " + text)
        if whole == b"".join(map(a.bytes.__getitem__, in_a)) == b"".join(map(b.bytes.__getitem__, all_b[k])):
            ids_a.append(np.array(in_a, np.int64))
            ids_b.append(np.array(all_b[k], np.int64))
            docs.append(k)
            lengths.append(len(whole))
        all_b[k] = []
    n = len(texts)
    made = {name: np.zeros(n, np.int64) for name in ("n_a", "n_b", "n_groups", "n_links")}
    made["sha"] = [""] * n
    empty = np.zeros(0, np.int64)
    if not docs:
        return made | {"edges": np.zeros(n + 1, np.int64), "links": empty, "times": empty, "pairs": empty, "holders": empty}
    count_a, count_b = (np.array([len(i) for i in ids]) for ids in (ids_a, ids_b))
    id_a, id_b = np.concatenate(ids_a), np.concatenate(ids_b)
    which = np.array(docs)
    doc_a, doc_b = np.repeat(which, count_a), np.repeat(which, count_b)
    # Documents lie end to end, so places rise through the whole shard.
    end_a, end_b = np.cumsum(size_a[id_a]), np.cumsum(size_b[id_b])
    start_a, start_b = end_a - size_a[id_a], end_b - size_b[id_b]

    own_a, cover_b = overlaps(doc_a, start_a, doc_b, start_b)
    own_b, cover_a = overlaps(doc_b, start_b, doc_a, start_a)
    fresh = start_a[cover_a] != start_b[own_b]  # equal starts met in the first direction
    link_a, link_b = np.concatenate([own_a, cover_a[fresh]]), np.concatenate([cover_b, own_b[fresh]])

    cuts = np.intersect1d(end_a, end_b, assume_unique=True)
    group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
    doc_groups = np.concatenate([[0], np.searchsorted(cuts, np.cumsum(lengths), side="right")])
    texts_of_groups = spelled([id_a, id_b], [group_a, group_b], doc_groups, names)
    for k, name in zip(docs, texts_of_groups):
        made["sha"][k] = sha256(name.encode()).hexdigest()

    pairs, of_pair = np.unique(id_a[link_a] << 32 | id_b[link_b], return_inverse=True)
    entries, times = np.unique(doc_a[link_a] * len(pairs) + of_pair, return_counts=True)
    in_doc, links = np.divmod(entries, len(pairs))
    made["n_a"][which], made["n_b"][which], made["n_groups"][which] = count_a, count_b, np.diff(doc_groups)
    made["n_links"] = np.bincount(doc_a[link_a], minlength=n)
    return made | {
        "edges": np.concatenate([[0], np.cumsum(np.bincount(in_doc, minlength=n))]),
        "links": links,
        "times": times,
        "pairs": pairs,
        "holders": np.bincount(links, minlength=len(pairs)),
    }


DOC = pa.struct(
    [
        ("doc_id", pa.int64()),
        ("n_a", pa.int64()),
        ("n_b", pa.int64()),
        ("n_groups", pa.int64()),
        ("n_links", pa.int64()),
        ("groups_sha256", pa.string()),
        ("links", pa.list_(pa.int32())),
        ("times", pa.list_(pa.int32())),
    ]
)
SHARD = (
    "shard bigint, pairs array<bigint>, holders array<int>, docs array<struct<doc_id: bigint, n_a: bigint, n_b: bigint, "
    "n_groups: bigint, n_links: bigint, groups_sha256: string, links: array<int>, times: array<int>>>"
)


def aligned_shards(docs: DataFrame, sides: Sides, limit: int = SHARD_BYTES) -> DataFrame:
    """One row per shard: its distinct pairs (first id in the upper 32 bits), how many of its
    documents hold each, and its documents with their links. A longer text is a shard of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Files are cut and read alike in every attempt of a task, so a shard keeps its number.
        shard = TaskContext.get().partitionId() << 32
        for batch in slices(batches, limit=limit):
            made = aligned(batch.column("text").to_pylist(), sides)
            edges = pa.array(made["edges"], pa.int32())
            listed = lambda name: pa.ListArray.from_arrays(edges, pa.array(made[name], pa.int32()))
            counts = [pa.array(made[name], pa.int64()) for name in ("n_a", "n_b", "n_groups", "n_links")]
            rows = pa.StructArray.from_arrays(
                [batch.column("doc_id"), *counts, pa.array(made["sha"], pa.string()), listed("links"), listed("times")],
                fields=list(DOC),
            )
            whole = lambda name, kind: pa.array([made[name]], pa.list_(kind))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int64()),
                    whole("pairs", pa.int64()),
                    whole("holders", pa.int32()),
                    pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), rows),
                ],
                names=["shard", "pairs", "holders", "docs"],
            )
            shard += 1

    return docs.mapInArrow(run, SHARD)


def pair_counts(shards: DataFrame) -> DataFrame:
    """(pair, n, best): documents of the whole corpus that hold the pair linked, and whether no
    pair of the same first id is held by more."""
    each = shards.select(F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("holders").alias("held"))))
    totals = staged(each.groupBy("pair").agg(F.sum("held").alias("n")), "pair-counts")
    first = F.shiftright("pair", 32)
    # At most one row per id of the first vocabulary.
    top = F.broadcast(totals.groupBy(first.alias("first")).agg(F.max("n").alias("top")))
    return totals.join(top, first == F.col("first")).select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def align_documents(docs: DataFrame, sides: Sides, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``a`` encodes a space and the text, ``b`` the text, to which it adds the space itself. A text
    that is null or empty, or that a side's tokens do not spell byte for byte, has no tokens: all
    counts are 0 and the digest is empty. Repeated rows count as documents of their own; null ids
    stay. Other columns are not read. No rows, no rows.
    """
    kept = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    shards = staged(aligned_shards(kept, sides), "aligned")
    local = shards.select("shard", F.posexplode("pairs").alias("place", "pair"))
    back = (
        local.join(pair_counts(shards), "pair")
        .groupBy("shard")
        .agg(F.sort_array(F.collect_list(F.struct("place", "n", "best"))).alias("counts"))
        .select("shard", F.col("counts.n").alias("n"), F.col("counts.best").alias("best"))
    )
    met = shards.select("shard", "docs").join(back, "shard", "left")
    zero = F.lit(0).cast("bigint")
    total = lambda doc, worth: F.aggregate(F.zip_with(doc["links"], doc["times"], worth), zero, lambda t, v: t + v)
    one = lambda doc: F.struct(
        *(doc[c].alias(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")),
        total(doc, lambda at, times: F.when(F.get("best", at), times).otherwise(0)).cast("bigint").alias("n_best"),
        total(doc, lambda at, times: F.get("n", at) * times).cast("bigint").alias("count_sum"),
        doc["groups_sha256"].alias("groups_sha256"),
    )
    return met.select(F.inline(F.transform("docs", one)))
