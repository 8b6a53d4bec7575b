"""Toxic documents by a learned lexicon, found even where terms are misspelled.

Terms and word beginnings that labelled toxic documents use far more often than clean ones form
a trie. Levenshtein automata of all terms are walked on that trie at once and made into one
deterministic table, which runs over the words of many texts in step. A hit weighs its learned
log odds, less if it is misspelled, and the words around it tell quoted speech from abuse.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crateline.llm.common import TEXT_BYTES, mix, slices, staged, to_batch

# Documents per label that the lexicon is learned from, as the expected size of a sample by hash.
TRAINED = 6000
# Near copies count as one text: their sketches over pairs of words agree in ALIKE of the slots.
# Texts of fewer than LEAST_PAIRS pairs are copies only if they are equal.
SLOTS = 128
ALIKE = 0.4
LEAST_PAIRS = 20
# Different toxic texts an entry must occur in.
LEAST_SEEN = 4
# How many times more often an entry must occur in toxic documents than in clean ones, and how
# sure that must be: a likelihood ratio (G squared) that chance reaches about once in a million.
LEAST_RATIO = 12.0
LEAST_EVIDENCE = 25.0
# Lengths of word beginnings that can be entries, the most of its documents that one word may
# account for, and how many a longer beginning must keep.
STEMS = (4, 5, 6)
STEM_SHARE = 0.7
STEM_KEEPS = 0.95
# Different toxic texts not explained by other entries that an entry must explain; and the share
# of the most frequent entry's texts that does without that.
LEAST_NEW = 3
STRONG = 0.15
# Letters a term needs to be met with one error, and with two.
ONE_ERROR, TWO_ERRORS = 5, 10
# Log odds of a document without hits, and what a misspelled hit starts from.
BIAS = 3.0
MISSPELLED = 0.6
TRUST = 5.0
# Context: words on either side, and what quoting, reporting and addressing someone multiply by.
WINDOW = 6
QUOTED, REPORTED, ADDRESSED = 0.35, 0.7, 1.2
# What a mark closes if it is open, else it opens a quotation itself.
CLOSES = {'"': '"', "“": "„", "”": "“„”", "„": "", "«": "»", "»": "«"}
MARKED = re.compile('["“”„«»\n]')
REPORTING = frozenset("said says wrote quote quoted called dit disait écrit sagte schrieb zitiert dijo escribió".split())
ADDRESSING = frozenset("you your youre du dein tu ton vous votre tú usted".split())

POINTS = 0x20000
MARKS = frozenset("*@$")
_inside: list[np.ndarray] = []


def inside() -> np.ndarray:
    """Whether a code point can stand in a word: letters, digits and marks that hide letters."""
    if not _inside:
        _inside.append(np.array([chr(c).isalnum() or chr(c) in MARKS for c in range(POINTS)]))
    return _inside[0]


WORDS = re.compile(r"[^\W_]+")


def errors_allowed(term: str) -> int:
    return (len(term) >= ONE_ERROR) + (len(term) >= TWO_ERRORS)


class Node:
    __slots__ = ("next", "term", "stem", "most")

    def __init__(self):
        self.next: dict[str, Node] = {}
        self.term = self.stem = -1
        self.most = 0


@dataclass(frozen=True)
class Table:
    """The deterministic automaton: classes of code points, next states, and what a state accepts."""

    classes: np.ndarray
    step: np.ndarray
    entry: np.ndarray
    errors: np.ndarray

    @staticmethod
    def build(entries: list[tuple[str, bool]]) -> Table:
        """Entries are (text, whether it is a word beginning). A word's first letter is never an error."""
        root = Node()
        for k, (text, is_stem) in enumerate(entries):
            node, path = root, [root]
            for c in text:
                node = node.next.setdefault(c, Node())
                path.append(node)
            if is_stem:
                node.stem = k
            else:
                node.term = k
                for n in path:
                    n.most = max(n.most, errors_allowed(text))
        alphabet = sorted({c for text, _ in entries for c in text})
        classes = np.where(inside(), 1, 0).astype(np.uint8 if len(alphabet) < 250 else np.uint16)
        for k, c in enumerate(alphabet):
            classes[ord(c)] = k + 2

        def closed(found: dict[Node, int]) -> frozenset[tuple[Node, int]]:
            """With letters that are missing from the word."""
            todo = list(found.items())
            while todo:
                node, e = todo.pop()
                for child in node.next.values() if node is not root else ():
                    if e < child.most and e + 1 < found.get(child, 9):
                        found[child] = e + 1
                        todo.append((child, e + 1))
            return frozenset(found.items())

        def follow(state, c: str | None):
            found: dict[Node, int] = {}

            def reach(node, e):
                if e <= node.most and e < found.get(node, 9):
                    found[node] = e

            for node, e in state:
                if c is not None and c in node.next:
                    reach(node.next[c], e)
                if node is not root:
                    reach(node, e + 1)
                    for child in node.next.values():
                        reach(child, e + 1)
            return closed(found)

        def accepts(state) -> tuple[int, int]:
            hits = [(e, n.term) for n, e in state if n.term >= 0 and e <= errors_allowed(entries[n.term][0])]
            e, term = min(hits, default=(0, -1))
            return term, e

        states: dict = {frozenset(): 0, frozenset({(root, 0)}): 1}
        order, rows, entry, errors = list(states), [], [], []
        done = 0
        while done < len(order):
            state = order[done]
            done += 1
            if isinstance(state, int):  # a word beginning was met: any ending will do
                rows.append([0, *[states[state]] * (len(alphabet) + 1)])
                entry.append(state)
                errors.append(0)
                continue
            row = [0]
            for c in (None, *alphabet):
                to = follow(state, c) if state else frozenset()
                stems = [n.stem for n, e in to if n.stem >= 0 and e == 0]
                key = min(stems) if stems else to
                if key not in states:
                    states[key] = len(order)
                    order.append(key)
                row.append(states[key])
            rows.append(row)
            term, e = accepts(state)
            entry.append(term)
            errors.append(e)
        return Table(classes, np.array(rows, np.int32), np.array(entry, np.int32), np.array(errors, np.int8))

    def hits(self, lowered: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text, start, end, entry, errors) of every word that an entry accepts."""
        joined = "\n".join([*lowered, ""])
        found = np.minimum(np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32), POINTS - 1)
        kind = np.concatenate([[0], self.classes[found], [0]]).astype(np.int64)
        first = np.flatnonzero((kind[1:] > 0) & (kind[:-1] == 0)) + 1
        last = np.flatnonzero((kind[1:] == 0) & (kind[:-1] > 0)) + 1
        state, at, word = self.step[1, kind[first]], first + 1, np.arange(len(first))
        starts, ends, entries, errors = [], [], [], []
        while len(word):
            over = at == last[word]
            met = over & (self.entry[state] >= 0)
            starts.append(first[word[met]])
            ends.append(last[word[met]])
            entries.append(self.entry[state[met]])
            errors.append(self.errors[state[met]])
            on = ~over & (state > 0)
            word, at = word[on], at[on]
            state = self.step[state[on], kind[at]]
            at = at + 1
        if not starts:
            return []
        start, end, entry, error = (np.concatenate(x) for x in (starts, ends, entries, errors))
        bounds = np.cumsum([0, *(len(t) + 1 for t in lowered)])
        text = np.searchsorted(bounds, start - 1, side="right") - 1
        offset = bounds[text] + 1
        return sorted(zip(*(x.tolist() for x in (text, start - offset, end - offset, entry, error))))


@dataclass(frozen=True)
class Model:
    entries: tuple[tuple[str, bool], ...]
    table: Table
    weights: dict[tuple[int, int], float]

    def weight(self, entry: int, errors: int) -> float:
        return self.weights.get((entry, errors), self.weights[(entry, 0)] * MISSPELLED**errors)


def quotations(text: str) -> list[tuple[int, int]]:
    """Where each quotation opens and closes; one that its line leaves open is none."""
    out, opened = [], {}
    for m in MARKED.finditer(text):
        mark, at = m[0], m.start()
        if mark == "\n":
            opened.clear()
            continue
        own = next((o for o in CLOSES[mark] if o in opened), None)
        if own:
            out.append((opened.pop(own), at))
        else:
            if mark == "“":  # a closing mark before it closed nothing
                opened.pop("”", None)
            opened[mark] = at
    return sorted(out)


def reach(text: str) -> list[tuple[int, int]]:
    """Where each quotation opens, and the furthest end of those that have opened by then: what
    opened before a hit and ends after it encloses it, whatever its length."""
    out, furthest = [], -1
    for opened, closed in quotations(text):
        furthest = max(furthest, closed)
        out.append((opened, furthest))
    return out


def context(text: str, start: int, end: int, quoted: list[tuple[int, int]] | None = None) -> float:
    """What the words around a hit multiply its weight by; ``quoted`` has the text's reach."""
    quoted = reach(text) if quoted is None else quoted
    line = text.rfind("\n", 0, start) + 1
    after = text.find("\n", end)
    after = len(text) if after < 0 else after
    # Words lie within so many characters, whatever the line's length.
    left, right = text[max(line, start - 20 * WINDOW) : start], text[end : min(after, end + 20 * WINDOW)]
    near = {*WORDS.findall(left)[-WINDOW:], *WORDS.findall(right)[:WINDOW]}
    factor = 1.0
    before = bisect_left(quoted, (start,))
    if before and quoted[before - 1][1] >= end:
        factor *= QUOTED
    if near & REPORTING:
        factor *= REPORTED
    if near & ADDRESSING:
        factor *= ADDRESSED
    return factor


def score_texts(model: Model, texts: list[str]) -> list[float]:
    lowered = [t.lower() for t in texts]
    total = [-BIAS] * len(texts)
    quoted: dict[int, list[tuple[int, int]]] = {}
    for text, start, end, entry, errors in model.table.hits(lowered):
        if text not in quoted:
            quoted[text] = reach(lowered[text])
        total[text] += model.weight(entry, errors) * context(lowered[text], start, end, quoted[text])
    return [1 / (1 + math.exp(-max(-30.0, min(30.0, t)))) for t in total]


EMPTY = (1 << 32) - 1


def sketch(text: str) -> bytes:
    """Per slot of the hash range the smallest hash of a pair of neighbouring words that falls
    there; of a text with few pairs, nothing."""
    held = np.array([zlib.crc32(w.encode("utf-8", "replace")) for w in WORDS.findall(text.lower())], np.uint64)
    hashed = np.unique(mix(held[:-1] << np.uint64(32) | held[1:]))
    if len(hashed) < LEAST_PAIRS:
        return b""
    slot = (hashed >> np.uint64(32)) % np.uint64(SLOTS)
    out = np.full(SLOTS, EMPTY, np.uint32)
    np.minimum.at(out, slot.astype(np.int64), (hashed & np.uint64(EMPTY)).astype(np.uint32))
    return out.tobytes()


def near_copies(sketches: list[bytes]) -> list[int]:
    """Per text the place of the first text that it nearly copies, or its own."""
    heads, places, first = np.zeros((len(sketches), SLOTS), np.uint32), [], []
    for k, held in enumerate(sketches):
        if held:
            own, before = np.frombuffer(held, np.uint32), heads[: len(places)]
            filled = SLOTS - ((before == EMPTY) & (own == EMPTY)).sum(axis=1)
            same = ((before == own) & (own != EMPTY)).sum(axis=1)
            like = np.flatnonzero(same >= ALIKE * filled)
            if len(like):
                first.append(places[like[0]])
                continue
            heads[len(places)] = own
            places.append(k)
        first.append(k)
    return first


SKETCHES = pa.schema([("toxic", pa.int32()), ("digest", pa.int64()), ("sketch", pa.binary())])


def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        prints = [sketch(t or "") for t in batch.column("text").to_pylist()]
        yield to_batch(SKETCHES, batch.column("toxic"), batch.column("digest"), prints)


Groups = dict[tuple[int, int], int]


def grouped(rows: DataFrame) -> tuple[Groups, dict[int, int]]:
    """The group of near copies of each text (toxic, digest), -1 where one row is the whole group,
    and the groups of each label. From rows (text, toxic, digest) of a sample."""
    found = (
        rows.mapInArrow(sketched, "toxic int, digest bigint, sketch binary")
        .groupBy("toxic", "digest")
        .agg(F.min("sketch").alias("sketch"), F.count("*").alias("n"))
        .collect()
    )
    groups, n = {}, {}
    for label in (0, 1):
        own = sorted((r["digest"], bytes(r["sketch"]), r["n"]) for r in found if r["toxic"] == label)
        first = near_copies([r[1] for r in own])
        size = Counter()
        for k, r in zip(first, own):
            size[k] += r[2]
        groups |= {(label, r[0]): k if size[k] > 1 else -1 for k, r in zip(first, own)}
        n[label] = len(size)
    return groups, n


Keys = Callable[[list[str]], Iterable[set[tuple]]]


def once_per_group(rows: DataFrame, groups: Groups, keys: Keys, ddl: str, schema: pa.Schema) -> DataFrame:
    """In how many groups of toxic and of clean texts each key of a text occurs.

    Texts without copies are added up where they are read; only keys of groups of several go out
    with their group.
    """
    schema = pa.schema([*schema, ("toxic", pa.int32()), ("near", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=TEXT_BYTES // 4):  # a text has several keys to a word
            lowered = [(t or "").lower() for t in batch.column("text").to_pylist()]
            told = list(zip(batch.column("toxic").to_pylist(), batch.column("digest").to_pylist()))
            seen = Counter((*k, t[0], groups[t]) for t, held in zip(told, keys(lowered)) for k in held)
            yield to_batch(schema, *(list(zip(*seen)) or [[]] * (len(schema) - 1)), list(seen.values()))

    toxic, names = F.col("toxic") == 1, schema.names[:-3]
    return (
        rows.mapInArrow(count, f"{ddl}, toxic int, near bigint, n bigint")
        .groupBy(*names, "toxic", "near")
        .agg(F.sum("n").alias("n"))
        .withColumn("n", F.when(F.col("near") < 0, F.col("n")).otherwise(1))
        .groupBy(*names)
        .agg(F.sum(F.when(toxic, F.col("n")).otherwise(0)).alias("toxic"), F.sum(F.when(toxic, 0).otherwise(F.col("n"))).alias("clean"))
    )


def terms_of(lowered: list[str]) -> Iterator[set[tuple]]:
    """Each text's words and word beginnings, one text at a time."""
    for text in lowered:
        words = set(WORDS.findall(text))
        yield {(w, False) for w in words} | {(w[:k], True) for w in words for k in STEMS if len(w) > k}


def log_odds(toxic: float, clean: float, toxic_docs: int, clean_docs: int) -> float:
    return math.log((toxic + 0.5) / (toxic_docs + 1)) - math.log((clean + 0.5) / (clean_docs + 1))


def evidence(toxic: Column, clean: Column, toxic_docs: int, clean_docs: int) -> Column:
    """G squared of a term's counts against the same share in both kinds of documents."""
    both = toxic + clean
    part = lambda seen, docs: F.when(seen > 0, seen * F.log(seen * (toxic_docs + clean_docs) / (both * docs))).otherwise(0)
    return 2 * (part(toxic, toxic_docs) + part(clean, clean_docs))


Term = tuple[str, bool, int, int]


def choose(found: list[Term]) -> list[Term]:
    """Word beginnings that many different words share, and the words they don't cover.

    A shorter beginning covers a longer one; of both, the longest that keeps nearly all its documents.
    """
    words = sorted(f for f in found if not f[1])
    beginnings = sorted((f for f in found if f[1]), key=lambda f: (len(f[0]), f[0]))
    longer: dict[str, list[Term]] = {}
    for f in beginnings:
        for k in range(1, len(f[0]) + 1):
            longer.setdefault(f[0][:k], []).append(f)
    texts, stems = [w[0] for w in words], []
    taken, within = set(), set()  # stems, and all beginnings of them
    begun = lambda text: any(text[:k] in taken for k in STEMS)
    for s in beginnings:
        at, most = bisect_left(texts, s[0]), 0
        while at < len(texts) and texts[at].startswith(s[0]):
            most, at = max(most, words[at][2]), at + 1
        if most <= STEM_SHARE * s[2] and not begun(s[0]) and s[0] not in within:
            stem = max((t for t in longer[s[0]] if t[2] >= STEM_KEEPS * s[2]), key=lambda t: (len(t[0]), t[2]))
            stems.append(stem)
            taken.add(stem[0])
            within |= {stem[0][:k] for k in range(1, len(stem[0]) + 1)}
    kept = stems + [w for w in words if not begun(w[0])]
    return sorted(kept, key=lambda f: (-f[2], f[0], f[1]))


def finder(terms: list[Term]):
    """The places in ``terms`` of all that occur in a text."""
    words = {t[0]: k for k, t in enumerate(terms) if not t[1]}
    stems = {t[0]: k for k, t in enumerate(terms) if t[1]}
    sizes = sorted({len(t) for t in stems})

    def find(text: str) -> set[int]:
        kinds = set(WORDS.findall(text.lower()))
        found = {words[w] for w in kinds & words.keys()}
        return found | {stems[w[:k]] for w in kinds for k in sizes if w[:k] in stems}

    return find


def explain(terms: list[Term], held: list[tuple[int, set[int]]]) -> list[Term]:
    """Terms that explain toxic documents, those of most groups of near copies at a time.

    ``held`` has each document's group and its terms. Words that different toxic documents merely
    share explain nothing that their toxic terms don't, unless they are as frequent as those.
    """
    having: dict[int, list[int]] = {}
    for d, (_, found) in enumerate(held):
        for k in found:
            having.setdefault(k, []).append(d)
    left = Counter((k, group) for group, found in held for k in found)
    gain, chosen, explained = Counter(k for k, _ in left), set(), set()
    queue = [(-n, -terms[k][2], k) for k, n in gain.items()]
    heapq.heapify(queue)
    while queue:
        told, seen, best = heapq.heappop(queue)
        if gain[best] < LEAST_NEW:
            continue
        if gain[best] < -told:  # gains only fall
            heapq.heappush(queue, (-gain[best], seen, best))
            continue
        chosen.add(best)
        for d in having[best]:
            if d not in explained:
                explained.add(d)
                group, found = held[d]
                for k in found:
                    left[k, group] -= 1
                    gain[k] -= left[k, group] == 0
    most = max((t[2] for t in terms), default=0)
    return [t for k, t in enumerate(terms) if k in chosen or t[2] >= STRONG * most]


def learn(docs: DataFrame, labels: DataFrame, trained: int = TRAINED) -> Model:
    """From texts (doc_id, text) and labels (doc_id, toxic 0 or 1).

    About ``trained`` documents of each label are drawn by hash, or all if there are fewer; their
    ids are broadcast, which that number bounds. Near copies of one label count as one text. The
    driver gets a sketch of each document of the sample, all terms whose counts tell, and for
    each toxic document which of them it holds. Repeated labels count once; of conflicting ones
    toxic holds.
    """
    labels = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    held = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, trained / held.get(1, trained)).otherwise(trained / held.get(0, trained))
    drawn = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select(
        "text", F.col("toxic").cast("int"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest")
    )
    rows = staged(rows, "labelled")
    groups, n = grouped(rows)

    toxic, clean = F.col("toxic"), F.col("clean")
    ratio = ((toxic + 0.5) / (n[1] + 1)) / ((clean + 0.5) / (n[0] + 1))
    named = pa.schema([("term", pa.string()), ("stem", pa.bool_())])
    found = (
        once_per_group(rows, groups, terms_of, "term string, stem boolean", named)
        .where((toxic >= LEAST_SEEN) & (ratio >= LEAST_RATIO))
        .where(evidence(toxic, clean, n[1], n[0]) >= LEAST_EVIDENCE)
        .collect()
    )
    terms = choose([tuple(r) for r in found])
    find = finder(terms)

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield to_batch(
                pa.schema([("digest", pa.int64()), ("held", pa.list_(pa.int64()))]),
                batch.column("digest"),
                [sorted(find(t)) for t in texts],
            )

    held = rows.where("toxic = 1").mapInArrow(hold, "digest bigint, held array<bigint>").collect()
    # A document without copies is a group of its own.
    near = [groups[1, r["digest"]] for r in held]
    chosen = explain(terms, [(g if g >= 0 else -k - 1, set(r["held"])) for k, (g, r) in enumerate(zip(near, held))])
    entries = tuple((t, s) for t, s, _, _ in chosen)
    table = Table.build(list(entries))
    weights = {(k, 0): log_odds(t, c, n[1], n[0]) for k, (_, _, t, c) in enumerate(chosen)}

    def misspellings(lowered: list[str]) -> list[set[tuple]]:
        found: list[set[tuple]] = [set() for _ in lowered]
        for text, _, _, entry, errors in table.hits(lowered):
            if errors:
                found[text].add((entry, errors))
        return found

    named = pa.schema([("entry", pa.int64()), ("errors", pa.int64())])
    misspelled = once_per_group(rows, groups, misspellings, "entry bigint, errors bigint", named).collect()
    for r in misspelled:
        start = weights[(r["entry"], 0)] * MISSPELLED ** r["errors"]
        times = r["toxic"] + r["clean"]
        told_by = log_odds(r["toxic"], r["clean"], n[1], n[0])
        weights[(r["entry"], r["errors"])] = max(0.0, (TRUST * start + times * told_by) / (TRUST + times))
    return Model(entries, table, weights)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) per row of ``docs``: 0 to 1, over the whole text.

    A null or empty text scores as one without hits. Null ids and repeated rows stay; other
    columns are not read. No rows, no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield to_batch(schema, batch.column("doc_id"), score_texts(model, texts))

    kept = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return kept.mapInArrow(run, "doc_id bigint, score double")


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """``docs`` without the rows whose score is ``limit`` or more; every column as it was."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            scores = score_texts(model, [t or "" for t in batch.column(text_col).to_pylist()])
            yield batch.filter(pa.array([s < limit for s in scores], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
