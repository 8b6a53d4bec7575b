"""Encoding and decoding with a merge-type (BPE) SentencePiece vocabulary.

Every prefix of a text has exactly one encoding, so one last token. An automaton over all pieces
finds, for each position, the pieces that end there; the one that is the prefix's last token is
the one whose pair with the last token of the prefix before it stays apart when both grow from
their characters side by side. The table of last tokens is filled left to right; ids are read off backwards.

No piece holds the space mark after another character, so merges never cross into a space and
the text is encoded chunk by chunk (a run of spaces and what follows it); chunks and pairs that
were worked out are remembered up to a fixed number.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crateline.llm.common import slices, to_batch

SPACE = "▁"
CHUNK = re.compile(f"{SPACE}+[^{SPACE}]*")
# Chunks and pairs a worker remembers; forgetting costs time only.
REMEMBERED = 200_000
PAIRS = 2_000_000
START = (1 << 20) - 1
UNKNOWN = " ⁇ "


@dataclass(frozen=True)
class Vocabulary:
    """What encoding needs of a model: pieces by id, their scores, the ids of bytes and controls."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    bytes: tuple[int, ...]
    controls: frozenset[int]
    unknown: int

    @staticmethod
    def read(path: str) -> Vocabulary:
        """From a model file whose normaliser keeps texts as they are, but for the space mark."""
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        return Vocabulary(
            tuple(model.id_to_piece(i) for i in range(n)),
            tuple(model.get_score(i) for i in range(n)),
            tuple(model.piece_to_id(f"<0x{b:02X}>") for b in range(256)),
            frozenset(i for i in range(n) if model.is_control(i) or model.is_unused(i)),
            model.unk_id(),
        )


class Chunks(dict):
    """Ids of a chunk as packed integers; a missing one is encoded. When full, it starts anew
    and takes back from the generation before what is asked for again."""

    def __init__(self, coder: Coder):
        self.coder = coder
        self.before: dict[str, bytes] = {}

    def __missing__(self, chunk: str) -> bytes:
        packed = self.before.get(chunk)
        if packed is None:
            marked = chunk if chunk[:1] == SPACE else SPACE + chunk
            packed = array("i", self.coder.encode(marked)).tobytes()
        if len(self) >= REMEMBERED:
            self.before = dict(self)
            self.clear()
        if len(chunk) <= 64:
            self[chunk] = packed
        return packed


class Coder:
    def __init__(self, vocabulary: Vocabulary):
        special = {*vocabulary.bytes, *vocabulary.controls, vocabulary.unknown}
        self.pieces, self.bytes = vocabulary.pieces, vocabulary.bytes
        self.rank = {p: (-vocabulary.scores[i], i) for i, p in enumerate(self.pieces) if i not in special}
        self.automaton = ahocorasick.Automaton()
        for piece, (_, i) in self.rank.items():
            self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self.known = {c for p in self.rank for c in p}
        self.odd = re.compile("([^" + re.escape("".join(sorted(self.known))) + "])")
        self.pairs: dict[int, bool] = {}
        self.growth: dict[int, tuple | None] = {}
        self.chunks = Chunks(self)
        held = [b"" if i in vocabulary.controls else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        held[vocabulary.unknown] = UNKNOWN.encode()
        for value, i in enumerate(vocabulary.bytes):
            held[i] = bytes([value])
        self.sizes = np.array([len(h) for h in held])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.held = np.frombuffer(b"".join(held), np.uint8)
        self.marked = np.array([p.startswith(SPACE) for p in self.pieces])

    def merged(self, text: str) -> list[str]:
        """Characters merged best score first, leftmost among equals."""
        parts = list(text)
        while best := self.best(parts):
            at = best[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def best(self, parts: list[str]) -> tuple[float, int] | None:
        """Score and place of the next merge, or None."""
        found = None
        for k in range(len(parts) - 1):
            r = self.rank.get(parts[k] + parts[k + 1])
            if r is not None and (found is None or r[0] < found[0]):
                found = r[0], k
        return found

    def grown(self, piece: int) -> tuple[list[tuple[float, str]], list[tuple[float, str]]] | None:
        """The merges that make a piece from its characters: the score of each, with the part that
        then ends the piece, and with the one that then begins it. None if they make another thing."""
        if piece not in self.growth:
            parts, ends, begins = list(self.pieces[piece]), [], []
            while len(parts) > 1 and (best := self.best(parts)):
                score, at = best
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                ends.append((score, parts[-1]))
                begins.append((score, parts[0]))
            self.growth[piece] = (ends, begins) if len(parts) == 1 else None
        return self.growth[piece]

    def stay_apart(self, before: int, piece: int) -> bool:
        """Both pieces grow side by side, best score first, leftmost among equals; they stay apart
        if the parts that touch never merge."""
        left, right = self.grown(before) if before != START else ([], []), self.grown(piece)
        if left is None or right is None:
            return False
        if before == START:
            return True
        ends, begins = left[0], right[1]
        end, begin, i, j = self.pieces[before][-1], self.pieces[piece][0], 0, 0
        never = (float("inf"), "")
        while True:
            own, other = ends[i] if i < len(ends) else never, begins[j] if j < len(begins) else never
            touching = self.rank.get(end + begin)
            if touching is not None and touching[0] < own[0] and touching[0] <= other[0]:
                return False
            if own is never and other is never:
                return True
            if own[0] <= other[0]:
                end, i = own[1], i + 1
            else:
                begin, j = other[1], j + 1

    def apart(self, before: int, piece: int) -> bool:
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[before << 20 | piece] = ok = self.stay_apart(before, piece)
        return ok

    def known_ids(self, text: str) -> list[int]:
        """Ids of a text whose characters all occur in pieces."""
        last, pairs = [-1] * (len(text) + 1), self.pairs
        last[0] = START
        for end, (size, piece) in self.automaton.iter(text):
            end += 1
            if last[end] < 0 <= (before := last[end - size]):
                ok = pairs.get(before << 20 | piece)
                if ok if ok is not None else self.apart(before, piece):
                    last[end] = piece
        ids, end = [], len(text)
        while end:
            if (piece := last[end]) < 0:  # a character that is no piece of its own
                return [i for part in self.merged(text) for i in self.ids_of(part)]
            ids.append(piece)
            end -= len(self.pieces[piece])
        return ids[::-1]

    def ids_of(self, part: str) -> list[int]:
        """A merged part's id, or the ids of its bytes."""
        held = self.rank.get(part)
        return [held[1]] if held else [self.bytes[b] for b in part.encode()]

    def encode(self, chunk: str) -> list[int]:
        if self.known.issuperset(chunk):
            return self.known_ids(chunk)
        ids: list[int] = []
        for part in self.odd.split(chunk):
            if part:
                ids += self.known_ids(part) if part[0] in self.known else self.ids_of(part)
        return ids

    def ids(self, text: str) -> bytes:
        """Packed ids of a whole text."""
        if not text:
            return b""
        if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
            parts = CHUNK.findall(SPACE + text.replace(" ", SPACE))
        else:
            parts = text.split(" ")
        return b"".join(map(self.chunks.__getitem__, parts))

    def decode(self, ids: np.ndarray, edges: np.ndarray) -> list[str]:
        """Texts of id sequences laid end to end; ``edges`` are their bounds."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        data = self.held[at].tobytes()
        bounds = np.concatenate([[0], ends])[edges].tolist()
        out = []
        for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            first = a + bool(a < b and self.marked[ids[edges[k]]])  # the mark put before the text
            out.append(data[first:b].decode("utf-8", "replace"))
        return out


_coders: dict[Vocabulary, Coder] = {}


def coder(vocabulary: Vocabulary) -> Coder:
    """One per worker process."""
    if vocabulary not in _coders:
        _coders.clear()
        _coders[vocabulary] = Coder(vocabulary)
    return _coders[vocabulary]


def encoder(vocabulary: Vocabulary):
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(vocabulary)
        for batch in slices(batches):
            packed = [own.ids(t or "") for t in batch.column("text").to_pylist()]
            edges = np.cumsum([0, *(len(p) // 4 for p in packed)])
            ids = np.frombuffer(b"".join(packed), np.int32)
            held = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids))
            yield to_batch(schema, batch.column("doc_id"), held, own.decode(ids, edges))

    return run


def encode_documents(
    docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, ids, decoded) per row of ``docs``; other columns are not read.

    Ids are the library's for the whole text, without begin or end; decoded is what those ids
    give back. A null or empty text has no ids and decodes to the empty text. Null ids and
    repeated rows are kept as they are. No rows, no rows.
    """
    kept = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return kept.mapInArrow(encoder(vocabulary), "doc_id bigint, ids array<int>, decoded string")
