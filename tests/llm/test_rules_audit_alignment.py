"""Quality rules, filter audit and token alignment against brute force: nulls, empty and very long
texts, repeated rows, ties, clashing names, empty tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from crateline.llm import filter_audit, quality_rules
from crateline.llm.common import prepare
from crateline.llm.token_alignment import ByteSide, Sides, align_documents

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, pattern string, kept string, shard string, n int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def session(spark):
    return prepare(spark)


def prose(rng, n):
    return " ".join(rng.choice("ash birch cedar elm fir hazel lime oak pine rowan willow yew".split()) + str(rng.randrange(99)) for _ in range(n))


def odd_texts(rng):
    same = prose(rng, 30)
    return [
        None, "", " \t\n", "x", same, same, same, "eins zwei drei vier fünf " * 3, "a b c d e f a b c d e",
        "one line\nanother\none line\n\n \none line", "#$ %& |<> *", "WORDS IN CAPITALS ONLY " * 90, prose(rng, 60_000),
        "a" * 50_000, " " * 30_000, "日本語 テキスト 日本語 " * 5, "tab\tand\x0bvertical\x0cfeed\rreturn\x1cno\xa0break",
        "▁marked ▁text", "<|endoftext|> and <s> </s> <0x41> <unk>", " leading", "trailing ", "emoji 👩‍👩‍👧 é \U0001d4d0",
    ]


def table(session, texts, ids=None, parts=("s1", "s2", "s1", None)):
    rows = [
        ((ids or range(len(texts)))[k], t, ("en", None, "de")[k % 3], parts[k % len(parts)], 0, "x", "y", "z", 1)
        for k, t in enumerate(texts)
    ]
    return session.createDataFrame(rows, DOCS)


# --- quality rules


def brute_measures(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    at = defaultdict(list)
    for i in range(len(words) - 4):
        at[tuple(words[i : i + 5])].append(i)
    covered = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(5)}
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)),
        len(covered),
    )


def brute_bucket(v, bits):
    over = max(v.bit_length() - bits, 0)
    return v >> over << over


def brute_judged(rows, prior, bits=quality_rules.BITS):
    """Limits from sorted lists, the values cut to their buckets."""
    measured, groups, langs = [], defaultdict(list), defaultdict(list)
    for lang, source, text in rows:
        n, chars, symbols, dup, repeat = brute_measures(text)
        text = text or ""
        lines = sum(bool(WORD.search(line)) for line in text.split("\n"))
        letters = sum(c.isalpha() for c in text)
        values = {
            "symbol_share": 10_000 * symbols // max(len(text), 1),
            "dup_line_share": 10_000 * dup // max(lines, 1),
            "repeat_share": 10_000 * repeat // max(n, 1),
            "other_share": 10_000 - 10_000 * letters // max(chars, 1),
            "long_words": 100 * chars // max(n, 1),
        }
        failed = n < 10 or 100 * repeat > 20 * n
        measured.append((lang, source, values, failed))
        if not failed:
            for name, v in values.items():
                groups[lang, source, name].append(brute_bucket(v, bits))
                langs[lang, name].append(brute_bucket(v, bits))
    quartile = lambda values, k: sorted(values)[-(-k * len(values) // 4) - 1]
    out = []
    for lang, source, values, failed in measured:
        broken = []
        for name, rule in quality_rules.RULES.items():
            own, whole = groups[lang, source, name], langs[lang, name]
            if own:
                lo, hi = ((len(own) * quartile(own, k) + prior * quartile(whole, k)) / (len(own) + prior) for k in (1, 3))
                if values[name] > hi + rule.spreads * max(hi - lo, rule.least):
                    broken.append(name)
        out.append((failed, not failed and not broken, ",".join(broken)))
    return out


def test_repeated_words_are_those_of_windows_found_twice(session):
    rng = random.Random(1)
    texts = odd_texts(rng) + [" ".join(rng.choice("ab") for _ in range(rng.randrange(40))) for _ in range(200)]
    got = quality_rules.measured(table(session, texts)).orderBy("doc_id").collect()
    for text, r in zip(texts, got):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_measures(text), text and text[:60]


@pytest.mark.parametrize("prior", [0, 100])
def test_limits_follow_language_and_source(session, prior):
    rng = random.Random(2)
    rows = []
    for k in range(400):
        text = prose(rng, rng.randrange(12, 40))
        if k % 2:  # a source that lists prices: its symbols are no fault there
            text = re.sub(" ", " $", text)
        if k % 57 == 0:
            text += " ### ||| " * 20
        rows.append(("en", ("plain", "prices")[k % 2], text))
    rows += [(None, None, t) for t in odd_texts(rng)] + [("de", "small", prose(rng, 20))]
    docs = session.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id bigint, lang string, source string, text string")
    got = [(r.base_failed, r.kept, r.failed) for r in quality_rules.judge(docs, prior).orderBy("doc_id").collect()]
    assert got == brute_judged(rows, prior)
    assert sum(kept for (_, kept, _), r in zip(got, rows) if r[1] == "prices") > 180


def test_sketches_merge_to_the_sketch_of_all(session):
    rng = random.Random(3)
    rows = quality_rules.measured(table(session, [prose(rng, rng.randrange(1, 90)) for _ in range(120)]))
    rows = rows.withColumns(quality_rules.measures())
    halves = [quality_rules.sketch(rows.where(F.col("doc_id") % 2 == k)) for k in (0, 1)]
    merged = quality_rules.merge(halves[0].unionByName(halves[1]), "lang", "source")
    assert sorted(merged.collect(), key=str) == sorted(quality_rules.sketch(rows).select(merged.columns).collect(), key=str)
    values = session.createDataFrame([(v,) for v in [*range(300), 10**6, 10**12, (1 << 40) - 1]], "v bigint")
    for v, b in values.select("v", quality_rules.bucket(F.col("v"))).collect():
        assert b == brute_bucket(v, 6) and b <= v < b + max(1, b / 31)


# --- filter audit


def brute_patterns(rows):
    out = []
    for doc_id, part, text in rows:
        text = text or ""
        words = WORD.findall(text)
        earlier = any(o is not None and doc_id is not None and o < doc_id and (t or "") == text for o, _, t in rows)
        fails = (
            len(words) < 200,
            100 * len(set(words)) < 50 * len(words),
            100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            bool(re.search(r"[#$%&*|]", text)),
            earlier,
        )
        out.append((doc_id, part or "", sum(1 << k for k, f in enumerate(fails) if f)))
    return out


def audit_rows(rng):
    texts = odd_texts(rng) + [prose(rng, rng.randrange(150, 260)) + rng.choice(["", " #", " ABCDEF" * 20]) for _ in range(40)]
    texts += [texts[30]] * 3 + [" ".join(["same words"] * 150)] * 2
    ids = [*range(len(texts))]
    ids[5], ids[-1] = None, ids[-2]
    return texts, ids


def test_patterns_match_brute_force(session):
    texts, ids = audit_rows(random.Random(4))
    docs = table(session, texts, ids)
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    got = [tuple(r) for r in filter_audit.failed_filters(docs).collect()]
    assert sorted(got, key=str) == sorted(brute_patterns(rows), key=str)


def test_every_order_matches_brute_force(session):
    texts, ids = audit_rows(random.Random(5))
    docs = table(session, texts, ids)
    labels = session.createDataFrame(
        [(i, k % 3 == 0, int(k % 5 == 0), "x") for k, i in enumerate(ids)] + [(3, True, 1, "x"), (None, True, 1, "x")],
        "doc_id bigint, good boolean, toxic int, text string",
    ).select("doc_id", F.col("good").cast("int").alias("quality"), "toxic", "text")
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and r.doc_id is not None}
    toxic = {r.doc_id for r in labels.collect() if r.toxic == 1 and r.doc_id is not None}
    patterns = brute_patterns([(r.doc_id, r.source, r.text) for r in docs.collect()])
    want, removed_by = {}, Counter()
    for part in {p for _, p, _ in patterns}:
        mine = [(i, f) for i, p, f in patterns if p == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                gone = [(i, f) for i, f in left if f & bit]
                left = [(i, f) for i, f in left if not f & bit]
                removed_by[part, letter] += len(gone)
                failing = sum(bool(f & bit) for _, f in mine)
                want[part, "".join(order), step] = (
                    len(left), len(gone), failing - len(gone), sum(f == bit for _, f in mine),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                )
    got = {tuple(r)[:3]: tuple(r)[3:] for r in filter_audit.audit(docs, labels).collect()}
    assert len(got) == 3 * 600
    assert got == {k: (*v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in want.items()}


def test_dictionary_holds_every_word_once(session):
    texts, _ = audit_rows(random.Random(6))
    kept = table(session, texts).select("doc_id", "text").repartition(3)
    shards = filter_audit.csr_shards(kept, limit=2_000)
    words = {w for t in texts for w in WORD.findall(t or "")}
    placed = filter_audit.dictionary(shards, buckets=7).collect()
    numbers = {r.word: r.id for r in placed}
    assert set(numbers) == words and len(set(numbers.values())) == len(words)
    assert all(numbers[r.word] == r.id for r in placed) and max(numbers.values()) < 7 * len(words)
    assert len(placed) == len({(r.shard, r.place) for r in placed})
    numbers = {r.word: r.id for r in filter_audit.dictionary(shards).collect()}
    matrix = filter_audit.term_matrix(shards).collect()
    assert len(matrix) > 3
    got = {}
    for m in matrix:
        for k, doc in enumerate(m.docs):
            entries = slice(m.indptr[k], m.indptr[k + 1])
            got[doc.doc_id] = dict(zip(m.indices[entries], m.data[entries]))
    assert got == {i: {numbers[w]: n for w, n in Counter(WORD.findall(t or "")).items()} for i, t in enumerate(texts)}


# --- token alignment

PATH = public_tokenizers.path
SIDES = Sides(PATH("byte_bpe_50k.json"), public_tokenizers.PATTERN, PATH("piece_bpe_32k.model"))


def brute_alignment(texts):
    first = Tokenizer.from_file(SIDES.byte_bpe)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=SIDES.pieces)
    names = ByteSide(SIDES.byte_bpe, SIDES.pattern).bytes

    def piece(i):
        p = second.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    def spans(parts):
        out, at = [], 0
        for p in parts:
            out.append((at, at + len(p)))
            at += len(p)
        return out

    docs, holders = [], Counter()
    for text in texts:
        ids_a = first.encode(" " + (text or ""), add_special_tokens=False).ids
        ids_b = second.encode(text or "")
        a, b = [names[i] for i in ids_a], [piece(i) for i in ids_b]
        if not text or b"".join(a) != (" " + text).encode() or b"".join(b) != (" " + text).encode():
            docs.append(None)
            continue
        a, b = spans(a), spans(b)
        links, j = [], 0
        for i, (s, e) in enumerate(a):
            while b[j][1] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][0] < e:
                links.append((ids_a[i], ids_b[k]))
                k += 1
        cuts = sorted({e for _, e in a} & {e for _, e in b})
        groups, i, j = [], 0, 0
        for cut in cuts:
            n, m = i, j
            while n < len(a) and a[n][1] <= cut:
                n += 1
            while m < len(b) and b[m][1] <= cut:
                m += 1
            groups.append(",".join(map(str, ids_a[i:n])) + "|" + ",".join(map(str, ids_b[j:m])))
            i, j = n, m
        docs.append((len(a), len(b), len(groups), links, ";".join(groups)))
        holders.update(set(links))
    top = defaultdict(int)
    for (a, _), n in holders.items():
        top[a] = max(top[a], n)
    return [
        (0, 0, 0, 0, 0, 0, "")
        if d is None
        else (
            *d[:3], len(d[3]), sum(holders[p] == top[p[0]] for p in d[3]), sum(holders[p] for p in d[3]),
            hashlib.sha256(d[4].encode()).hexdigest(),
        )
        for d in docs
    ]


def test_alignment_matches_brute_force(session):
    rng = random.Random(7)
    letters = "aeé ß日本\U0001f600\n\t▁  '12.,-‍́"
    texts = [t if t is None or len(t) < 100_000 else t[:100_000] for t in odd_texts(rng)] + [prose(rng, 30) for _ in range(30)]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(80)]
    got = align_documents(table(session, texts).repartition(3), SIDES).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute_alignment(texts)


def test_fast_encoder_gives_the_library_ids(session):
    first = Tokenizer.from_file(SIDES.byte_bpe)
    first.encode_special_tokens = True
    own, rng = ByteSide(SIDES.byte_bpe, SIDES.pattern), random.Random(8)
    assert own.ranked
    texts = [t for t in odd_texts(rng) if t] + [" " * 300_000 + "x", "\n \n" * 5_000, "#" * 20_000]
    for text in texts:
        assert own.ids(text) == first.encode(text, add_special_tokens=False).ids, text[:40]


# --- all three


def test_empty_tables_and_null_ids(session):
    none = table(session, [])
    labels = session.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert quality_rules.judge(none).count() == 0
    assert filter_audit.audit(none, labels).count() == 0
    assert align_documents(none, SIDES).count() == 0
    nulls = table(session, ["a b", "a b", None], [None, None, None])
    assert quality_rules.judge(nulls).count() == align_documents(nulls, SIDES).count() == 3
    assert {r.pattern for r in filter_audit.failed_filters(nulls).collect()} == {1}


def test_a_reader_or_task_holds_few_shards_at_once(spark, monkeypatch):
    """A batch read from a file takes in all of its rows, so each shard has a file of its own."""
    texts = [f"word{i} of many words {i % 7} # " * (i % 50 + 1) for i in range(400)]
    docs = spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], "doc_id long, text string, source string").coalesce(1)
    plain = sorted(map(tuple, filter_audit.failed_filters(docs).collect()))
    held, stage, shards = {}, filter_audit.staged, filter_audit.csr_shards

    def staged(df, name, **options):
        if name == "counted":
            held["merged up to"] = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
            held["rows a batch"] = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        held[name] = stage(df, name, **options)
        return held[name]

    monkeypatch.setattr(filter_audit, "staged", staged)
    monkeypatch.setattr(filter_audit, "csr_shards", lambda rows: shards(rows, limit=20_000, part=3_000))
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert sorted(map(tuple, filter_audit.failed_filters(docs).collect())) == plain
    counts = [r["count"] for r in held["shards"].groupBy(F.input_file_name()).count().collect()]
    assert len(counts) > 15 and set(counts) == {1}
    rows = held["shards"].select("shard", F.size("words").alias("words"), F.size("docs").alias("docs")).collect()
    parts, worded = Counter(r.shard for r in rows), Counter(r.shard for r in rows if r.words)
    assert len(parts) > 5 and max(parts.values()) >= 3
    assert set(worded) == set(parts) and set(worded.values()) == {1} and min(r.docs for r in rows) > 0
    assert (held["merged up to"], held["rows a batch"]) == ("8m", "1")
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == before


def test_a_shard_lets_go_of_its_texts():
    """Columns of a batch that came over a stream are views of the whole message, its texts included."""
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, None, 3], "part": ["a", "", "b"], "text": ["x " * 5000, None, "y y z"]})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    message = sink.getvalue()
    shard = filter_audit.Shard()
    shard.add(next(iter(pa.ipc.open_stream(message))), ["doc_id", "part"])
    buffers = [b for column in shard.docs[0].columns for b in column.buffers() if b is not None and b.size]
    assert buffers and not any(message.address <= b.address < message.address + message.size for b in buffers)
    assert shard.docs[0].to_pydict() == {"doc_id": [1, None, 3], "part": ["a", "", "b"]}
    assert len(shard.edges) == 4 and shard.bytes == 10_005
