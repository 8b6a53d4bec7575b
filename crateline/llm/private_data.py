"""Personal data: patterns propose spans, check digits confirm them, words nearby adjust the score."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crateline.llm.common import slices, to_batch

# The patterns of the four base kinds, in the order they are listed. Quantifiers
# are possessive, and an address begins where its digits do, so a long run is walked once.
BASE = ("email", "ip", "card", "phone")
LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Added kinds: an account number with its check, and two that only words nearby confirm.
ADDED = ("iban", "ssn", "local_phone")
IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9-])")

# Words whose presence within NEAR characters before a span raises, or lowers, its score.
RAISES = {
    "email": ("mail", "contact", "write to", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "credit", "payment", "karte", "tarjeta", "carte"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "llame", "appel"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
    "ssn": ("ssn", "social security", "sozialversicherung", "seguro social"),
    "local_phone": ("phone", "call", "tel", "mobile", "fax"),
}
LOWERS = ("version", "isbn", "order", "example", "release", "serial")
NEAR = 40
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.85, "phone": 0.8, "iban": 0.9, "ssn": 0.35, "local_phone": 0.35}
WEIGHT = 0.25
LEAST = 0.5


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """The account number's own check: country and check digits moved last, letters as numbers."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """A match is known by its @: its name is the whole run before, back to the match before it."""
    at, done = text.find("@"), 0
    while at >= 0:
        first = at
        while first > done and text[first - 1] in LOCAL_PART:
            first -= 1
        if first < at and (domain := DOMAIN.match(text, at + 1)):
            done = domain.end()
            yield first, done
        at = text.find("@", at + 1)


def accounts(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers whose check holds, up to the last word end where it does: upper-case words
    and numbers may follow, or stand before, as if they belonged to one."""
    m = IBAN.search(text)
    while m:
        start, end = m.span()
        while end > start:
            plain = text[start:end].replace(" ", "")
            if 15 <= len(plain) <= 34 and mod97(plain):
                yield start, end
                break
            end = text.rfind(" ", start, end)
        m = IBAN.search(text, max(end, start + 1))


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans of every kind that their checks confirm, each kind leftmost first."""
    if "@" in text:
        yield from (("email", a, b) for a, b in emails(text))
    if not any(map(text.__contains__, "0123456789")):
        return
    for m in IP.finditer(text) if "." in text else ():
        if all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in m[0].split(".")):
            yield "ip", *m.span()
    for m in CARD.finditer(text):
        if 13 <= m.end() - m.start() and 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            yield "card", *m.span()
    for m in PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(digits_of(m[0])) <= 15:
            yield "phone", *m.span()
    yield from (("iban", a, b) for a, b in accounts(text))
    for m in SSN.finditer(text) if "-" in text else ():
        yield "ssn", *m.span()
    for m in LOCAL_PHONE.finditer(text):
        yield "local_phone", *m.span()


def spans(text: str) -> list[Span]:
    """All spans, by kind as listed and then start. Base kinds that their checks confirm always stay.

    An added span stays with a score of LEAST or more and only where no base span overlaps it.
    """
    found: list[Span] = []
    for kind, start, end in proposals(text):
        before = text[max(0, start - NEAR) : start].lower()
        score = PRIOR[kind]
        score += WEIGHT * any(w in before for w in RAISES[kind]) - WEIGHT * any(w in before for w in LOWERS)
        if kind in BASE:
            found.append(Span(kind, start, end, min(1.0, score)))
        elif score >= LEAST and not any(s.start < end and start < s.end for s in found):
            found.append(Span(kind, start, end, min(1.0, score)))
    return found


def masked(text: str, found: list[Span]) -> str:
    """The text with every span replaced by its kind; where spans overlap, by that of the first."""
    out, at = [], 0
    for s in sorted(found, key=lambda s: (s.start, -s.end)):
        if s.start >= at:
            out += [text[at : s.start], f"<{s.kind.upper()}>"]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


SPANS = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
)


def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = [[s._asdict() for s in spans(t)] if t else [] for t in batch.column("text").to_pylist()]
        yield to_batch(pa.schema([("doc_id", pa.int64()), ("spans", SPANS)]), batch.column("doc_id"), found)


def find_private_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) per row of ``docs``: kind, start, end (code points, exclusive) and score.

    Spans come by kind, then start. A null or empty text has none. Null ids and repeated rows
    are kept as they are; other columns are not read. No rows, no rows.
    """
    kept = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return kept.mapInArrow(
        find, "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>"
    )


def mask_private_data(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span in the text replaced by its kind; null stays null, other columns too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            texts = [t if not t or not (s := spans(t)) else masked(t, s) for t in batch.column(text_col).to_pylist()]
            at = batch.schema.get_field_index(text_col)
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
