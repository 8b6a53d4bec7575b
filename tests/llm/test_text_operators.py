"""The text operators against brute force on small tables, with nulls, ties and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from crateline.llm import language_id, private_data, quality, toxicity
from crateline.llm.common import prepare, settings
from crateline.llm.fingerprints import PrefixHashes, common_extension, fingerprint, fingerprint_documents, likeness, points
from crateline.llm.jaccard_join import FILTER_SCAN, jaccard_join, one_of_each, texts_of, versions
from crateline.llm.neighbours import Tree, nearest_neighbours
from crateline.llm.piece_bpe import Vocabulary, coder, encode_documents
from crateline.llm.token_counts import allocate, count_tokens

MODEL = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Columns that an operator makes itself must not confuse it.
CLASHING = "n bigint, keys string, component_id bigint, rep string, size string, rate string, bucket string"


@pytest.fixture(scope="module")
def session(spark):
    return prepare(spark)


def docs_of(spark, texts, clashing=False):
    rows = [(i, t, "en", "a", len(t or "")) + ((None,) * 7 if clashing else ()) for i, t in texts]
    return spark.createDataFrame(rows, f"{DOCS}, {CLASHING}" if clashing else DOCS)


def words(rng, n):
    return [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randrange(60)) for _ in range(n)]


# --- n-gram Jaccard join


def brute_components(texts):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def copies(rng):
    """Exact copies, near copies that chain, a shared passage, short, empty and null texts."""
    texts, base, passage = [], words(rng, 160), words(rng, 60)
    for i in range(30):
        w = list(base)
        for _ in range(rng.randrange(1, 7)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
        texts.append((i, " ".join(w)))
    texts += [(40 + i, " ".join(words(rng, 90) + passage)) for i in range(20)]
    texts += [(70, texts[3][1]), (71, texts[3][1].upper()), (72, texts[3][1].replace(" ", "\n"))]
    texts += [(80, "One two"), (81, "one  TWO"), (82, "one"), (83, ""), (84, None), (85, " \t "), (86, " ")]
    chain = words(rng, 200)
    texts += [(90 + i, " ".join(chain[i * 8 : i * 8 + 130])) for i in range(8)]
    return texts


def test_join_equals_brute_force(session):
    texts = copies(random.Random(5))
    rows = jaccard_join(docs_of(session, texts, clashing=True)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(texts)


def test_join_compares_large_tiles_by_blocks(session, monkeypatch):
    monkeypatch.setattr("crateline.llm.jaccard_join.BLOCK", 4)
    texts = copies(random.Random(6))
    rows = jaccard_join(docs_of(session, texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(texts)


def test_join_of_repeated_rows_null_ids_and_nothing(session):
    same = "one two three four five six"
    texts = [(1, same), (1, same), (None, same), (2, same), (None, None)]
    rows = sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard_join(docs_of(session, texts)).collect() if r.doc_id)
    assert rows == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]
    kept = one_of_each(docs_of(session, texts)).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 0, 1]
    assert jaccard_join(docs_of(session, [])).count() == 0


def test_an_id_with_several_texts_loses_no_row(session):
    rng = random.Random(8)
    one, two, three, four = (" ".join(words(rng, 60)) for _ in range(4))
    texts = [(1, one), (1, two), (2, two + " end"), (3, one + " end"), (4, three), (4, three), (4, ""), (4, None), (4, "")]
    # Two linked texts of one id, of which one stays.
    texts += [(5, four), (5, four + " more"), (6, four + " again"), (7, three + " x")]
    rows = [(i, t, "en", s, 0) for i, t in texts for s in "ab"]
    found = jaccard_join(docs_of(session, texts)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == [
        (1, 56, 1), (1, 56, 1), (2, 57, 1), (3, 57, 1), (4, 0, 4), (4, 0, 4), (4, 0, 4), (4, 56, 4), (4, 56, 4),
        (5, 56, 5), (5, 57, 5), (6, 57, 5), (7, 57, 4),
    ]
    kept, again = (one_of_each(session.createDataFrame(x, DOCS)).collect() for x in (rows, rows[::-1]))
    assert sorted(map(str, kept)) == sorted(map(str, again))
    left = [(r.doc_id, r.text) for r in kept]
    assert len(left) == 6 and set(left) > {(1, one), (1, two), (4, three), (4, ""), (4, None)}
    assert [i for i, t in left if t and t.startswith(four)] == [5]


def test_texts_of_other_rows_are_not_shuffled(session):
    """The texts of classes that need them are met behind a filter of the scan; settings are as before after it."""
    rows = session.range(2000).select("id", F.concat(F.lit("text "), F.col("id")).alias("text"))
    docs = versions(rows, "id", "text")
    firsts = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("rep"), "doc_id", "version").localCheckpoint()
    name = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    before = session.conf.get(name)
    with settings(session, {**FILTER_SCAN, "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}):
        met = texts_of(docs, firsts)
        assert "might_contain" in met._jdf.queryExecution().executedPlan().toString()
        assert sorted(tuple(r) for r in met.collect()) == [(i, f"text {i}") for i in range(0, 2000, 100)]
    assert session.conf.get(name) == before


def test_whole_prefixes_equal_brute_force_on_long_sets(session):
    rng = random.Random(9)
    base, texts = [f"w{rng.randrange(10**6)}" for _ in range(1600)], []
    for i in range(14):
        w = list(base)
        for at in rng.sample(range(len(w)), 12 + 4 * i):
            w[at] = f"x{rng.randrange(10**6)}"
        texts.append((1000 + i, " ".join(w)))
    exact = brute_components(texts)
    assert min(n for n, _ in exact.values()) > 1000 and 1 < len({c for _, c in exact.values()}) < 14
    texts += copies(random.Random(7))
    rows = jaccard_join(docs_of(session, texts), keys=None).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(texts)


# --- toxicity


def labelled(session, n=240):
    rng = random.Random(3)
    texts, labels = [], []
    for i in range(n):
        w = words(rng, 60)
        if i % 3 == 0:
            w[rng.randrange(60)] = rng.choice(["scoundrel", "villain", "grubz" + rng.choice(["ab", "cd", "ef", "gh", "ij"])])
        texts.append((i, " ".join(w)))
        labels.append((i, int(i % 3 == 0)))
    return docs_of(session, texts, clashing=True), session.createDataFrame(labels, "doc_id bigint, toxic int")


def test_toxic_terms_are_learned_misspelled_and_quoted(session):
    docs, labels = labelled(session)
    model = toxicity.learn(docs, labels)
    assert ("scoundrel", False) in model.entries and any(s and t.startswith("grub") for t, s in model.entries)
    texts = ["you scoundrel", "you scoundrell", "you sc0undrel", "grubzxy", 'he wrote "that scoundrel there" once', "a kind word", "", "your scoundrels'"]
    scores = toxicity.score_texts(model, texts)
    assert [s >= 0.5 for s in scores] == [True, True, True, True, False, False, False, True]
    found = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all((found[r.doc_id] >= 0.5) == bool(r.toxic) for r in labels.collect())
    odd = docs_of(session, [(1, None), (None, ""), (2, "villain " * 3), (2, "villain " * 3)])
    assert sorted(r.score >= 0.5 for r in toxicity.score(odd, model).collect()) == [False, False, True, True]
    assert toxicity.keep_clean(odd, model).count() == 2


def test_no_labels_reject_nothing(session):
    docs, labels = labelled(session, 6)
    model = toxicity.learn(docs, labels.limit(0))
    assert all(r.score < 0.5 for r in toxicity.score(docs, model).collect())


def test_copies_of_a_toxic_text_count_once(session):
    docs, labels = labelled(session, 600)
    rng = random.Random(4)
    common = [a + b for a in ("harbour", "lantern", "meadow", "pewter", "quarry") for b in ("", "side", "less", "ful", "man", "ward")]
    body = common * 2 + words(rng, 20)
    copied = []
    for i in range(100):
        own = list(body)
        own[i % len(own)] = f"edit{i}"
        copied.append((9000 + i, " ".join([*own, "villain"])))
    docs = docs.unionByName(docs_of(session, copied + [(9500 + i, copied[0][1]) for i in range(20)]), allowMissingColumns=True)
    ids = session.range(9000, 9520).selectExpr("id doc_id", "1 toxic")
    model = toxicity.learn(docs, labels.unionByName(ids.selectExpr("doc_id", "int(toxic) toxic")))
    assert not {t for t, _ in model.entries} & {w[:k] for w in common for k in (4, 5, 6, len(w))}
    assert ("villain", False) in model.entries
    assert max(toxicity.score_texts(model, [w for w in common] + [" ".join(common)])) < 0.5
    assert min(toxicity.score_texts(model, ["you villain", "you scoundrel", copied[0][1]])) >= 0.5


def test_abuse_between_quotations_is_not_quoted():
    lone = (("scoundrel", False),)
    model = toxicity.Model(lone, toxicity.Table.build(list(lone)), {(0, 0): 7.6})
    flagged = ['"so" he is a scoundrel, "yes"', "“so” a scoundrel «yes»", '"so"\na scoundrel "yes"', 'a 5" scoundrel', "»so« a scoundrel “yes”"]
    passed = [f'"{"so it went on " * 30}a scoundrel {"and on and on " * 30}"', 'it reads "a scoundrel there" now', "“a scoundrel”", "„a scoundrel“", "«a scoundrel»", "»a scoundrel«", '"so" and "a scoundrel"']
    assert [s >= 0.5 for s in toxicity.score_texts(model, flagged)] == [True] * len(flagged)
    assert [s >= 0.5 for s in toxicity.score_texts(model, passed)] == [False] * len(passed)


def test_rare_terms_stand_beside_thousands_of_frequent_ones(session):
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    often = sorted({"".join(rng.choice(letters) for _ in range(4)) for _ in range(2300)})
    texts = [(i, " ".join(rng.sample(often, len(often)))) for i in range(30)]
    texts += [(100 + i, " ".join([*words(rng, 40), "scoundrel"])) for i in range(25)]
    texts += [(200 + i, " ".join(words(rng, 40))) for i in range(60)]
    labels = session.createDataFrame([(i, int(i < 200)) for i, _ in texts], "doc_id bigint, toxic int")
    model = toxicity.learn(docs_of(session, texts), labels)
    assert len(often) > 2000 and ("scoundrel", False) in model.entries
    assert toxicity.score_texts(model, ["you scoundrel"])[0] >= 0.5


def test_automaton_equals_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    terms = ["scoundrel", "villain", "villas", "cur", "abominable"]
    table = toxicity.Table.build([(t, False) for t in terms])
    rng = random.Random(1)
    tried = set(terms)
    for _ in range(4000):
        t = list(rng.choice(terms))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(1, len(t) + 1)
            t[at : at + rng.randrange(2)] = rng.choice(["", "a", "l", "x"])
        tried.add("".join(t))
    for word in sorted(t for t in tried if t):
        best = min((distance(word, t) for t in terms if word[0] == t[0] and distance(word, t) <= toxicity.errors_allowed(t)), default=None)
        hits = table.hits([word])
        assert (hits[0][4] if hits else None) == best, word


# --- pieces


def test_pieces_equal_the_library(session):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    vocabulary, rng = Vocabulary.read(MODEL), random.Random(2)
    parts = [" ", "  ", "▁", "th", "e", "\n", "1", " the", "ß", "漢字", "😀", "\x00", "é", "Ａ", "x" * 30, "----", "\t"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(400)]
    texts += ["", None, " ", "a" * 5000, " " * 300, "lead ", " trail"]
    rows = encode_documents(docs_of(session, list(enumerate(texts)), clashing=True), vocabulary).collect()
    assert len(rows) == len(texts)
    for r in rows:
        wanted = library.encode(texts[r.doc_id] or "", num_threads=1)
        assert list(r.ids) == wanted and r.decoded == library.decode(wanted)
    assert encode_documents(docs_of(session, []), vocabulary).count() == 0


def test_forgetting_chunks_changes_nothing(monkeypatch):
    vocabulary = Vocabulary.read(MODEL)
    own = coder(vocabulary)
    text = "some words and other words, then the same words again"
    wanted = own.ids(text)
    monkeypatch.setattr("crateline.llm.piece_bpe.REMEMBERED", 2)
    monkeypatch.setattr("crateline.llm.piece_bpe.PAIRS", 3)
    own.chunks.clear()
    assert own.ids(text) == wanted


# --- personal data


def plain_base(text):
    found = []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            twice = sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(digits[::-1]))
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 13 <= len(digits) <= 19 and twice % 10 == 0,
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                found.append((kind, m.start(), m.end()))
    return found


def test_base_spans_equal_plain_patterns(session):
    rng = random.Random(4)
    parts = ["a", "1", "4", ".", "@", "-", " ", "+", "(", ")", "_", "0", "255", "4111111111111111", "b.c", "é", "+1 (988) 555-2485"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(3000)]
    for text in texts:
        assert [s[:3] for s in private_data.spans(text) if s.kind in private_data.BASE] == plain_base(text)
    odd = docs_of(session, [(1, None), (2, ""), (None, "a@b.c"), (3, "a@b.c"), (3, "a@b.c")], clashing=True)
    rows = private_data.find_private_data(odd).collect()
    assert sorted(len(r.spans) for r in rows) == [0, 0, 1, 1, 1]
    masked = private_data.mask_private_data(odd)
    assert masked.columns == odd.columns
    assert sorted(str(r.text) for r in masked.collect()) == ["", "<EMAIL>", "<EMAIL>", "<EMAIL>", "None"]


def test_added_kinds_need_checks_or_context():
    kinds = lambda text: [s.kind for s in private_data.spans(text)]
    assert kinds("account DE89370400440532013000 now") == ["iban"]
    assert kinds("account DE88370400440532013000 now") == []
    assert kinds("my ssn is 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == []
    assert kinds("call (555) 123-4567") == ["local_phone"] and kinds("serial 555-123-4567") == []


def test_account_numbers_end_where_their_check_holds():
    number = "DE89 3704 0044 0532 0130 00"
    for before, after in (("", " BIC"), ("", " EUR"), ("", " 2024"), ("", " BIC COBADEFF 2024 EUR"), ("REF AB12 ", " EUR"), ("", "")):
        found = [s for s in private_data.spans(f"to {before}{number}{after}") if s.kind == "iban"]
        assert [(s.start, s.end) for s in found] == [(3 + len(before), 3 + len(before) + len(number))], (before, after)
    assert not [s for s in private_data.spans("to DE89 3704 0044 0532 0130 01 EUR") if s.kind == "iban"]
    two = [s for s in private_data.spans(f"{number} GB82 WEST 1234 5698 7654 32 EUR") if s.kind == "iban"]
    assert [(s.start, s.end) for s in two] == [(0, 27), (28, 55)]


def test_long_runs_take_linear_time():
    for text in ("a" * 200_000 + "@", "1" * 200_000, "1." * 100_000, "+1" + "(" * 100_000, "0" * 9000 + ".1.1.1"):
        private_data.spans(text)


# --- fingerprints


def test_spans_and_extensions():
    left, right = "the quick brown fox", "a quick brown dog"
    a, b = PrefixHashes(points(left)), PrefixHashes(points(right))
    assert a.span(4, 9) == b.span(2, 7) and a.span(4, 9) != b.span(3, 8)
    assert PrefixHashes(points("abab")).equal(0, 2, 2)
    for i in range(len(left)):
        for j in range(len(right)):
            n = 0
            while i + n < len(left) and j + n < len(right) and left[i + n] == right[j + n]:
                n += 1
            assert common_extension(a, i, b, j) == n


def test_edited_texts_follow_the_next_document(session):
    rng = random.Random(8)
    texts = [(i * 7, " ".join(words(rng, rng.randrange(80)))) for i in range(60)] + [(1, None), (2, "é😀"), (3, "")]
    rows = {r.doc_id: r for r in fingerprint_documents(docs_of(session, texts, clashing=True)).collect()}
    order = sorted(texts, reverse=True)
    assert len(rows) == len(texts)
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, third = text or "", len(text or "") // 3
        assert rows[i].n_chars == len(text)
        assert rows[i].edited == text[: len(text) - third] + (after or "")[:third]
        assert rows[i].fingerprint == fingerprint(points(text))
        assert rows[i].near_next <= 0.35 and (len(text) < 3 or rows[i].near_edited >= 0.5)
    assert likeness(fingerprint(points("same")), fingerprint(points("same"))) == 1.0
    assert likeness(fingerprint(points("")), fingerprint(points("x"))) == 0.0


def test_fingerprints_of_odd_tables(session):
    assert fingerprint_documents(docs_of(session, [])).count() == 0
    alone = fingerprint_documents(docs_of(session, [(5, "abcdef")])).collect()
    assert [r.edited for r in alone] == ["abcdab"]
    rows = fingerprint_documents(docs_of(session, [(5, "abc"), (5, "abc"), (None, "xyz")])).collect()
    assert sorted(r.edited for r in rows) == ["aba", "abx", "xya"]


# --- quality


def test_quality_follows_the_labels(session):
    rng = random.Random(9)
    texts, labels = [], []
    for i in range(200):
        w = words(rng, 50)
        good = i % 4 != 0
        texts.append((i, " ".join(w).capitalize() + "." if good else "!! ".join(w).upper()))
        labels.append((i, int(good)))
    rows = quality.measured(docs_of(session, texts, clashing=True))
    known = rows.join(session.createDataFrame(labels, "doc_id bigint, label int"), "doc_id")
    model = quality.learn(known)
    found = {r.doc_id: r.score for r in quality.score(rows, model).collect()}
    assert all((found[i] >= 0.5) == bool(y) for i, y in labels)
    odd = quality.measured(docs_of(session, [(1, None), (None, ""), (2, "a"), (2, "a"), (3, "x" * 50_000)]))
    assert all(0 <= r.score <= 1 for r in quality.score(odd, model).collect())
    assert all(r.score == 0.5 for r in quality.score(odd, quality.learn(known.limit(0))).collect())
    assert all(r.score > 0.99 for r in quality.score(odd, quality.learn(known.where("label = 1"))).collect())


# --- nearest neighbours


def test_trees_find_what_brute_force_finds():
    rng = np.random.default_rng(1)
    vectors = np.concatenate([rng.normal(size=(400, 8)), np.ones((90, 8))])
    ids = rng.permutation(len(vectors)).astype(np.int64)
    tree = Tree(ids, vectors)
    for q in range(0, len(vectors), 7):
        away = np.sqrt(((vectors - vectors[q]) ** 2).sum(axis=1))
        wanted = [int(ids[j]) for j in np.lexsort((ids, away)) if ids[j] != ids[q]][:10]
        assert [i for _, i in tree.nearest(vectors[q], 10, int(ids[q]))] == wanted


def test_neighbours_over_shards(session, monkeypatch):
    monkeypatch.setattr("crateline.llm.neighbours.SHARD", 50)
    monkeypatch.setattr("crateline.llm.neighbours.QUERIES", 2)
    rng = random.Random(1)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    vectors += [(400, None), (500, [0.0] * 6), (600, [float("nan")] + [1.0] * 5), (700, [None] + [1.0] * 5), (None, [1.0] * 6)]
    vectors += [(800, vectors[0][1]), (801, vectors[0][1]), (801, vectors[0][1]), (900, [float("inf")] * 6)]
    rows = session.createDataFrame([(*v, "x") for v in vectors], "vec_id bigint, embedding array<float>, rank string")
    found = {}
    for r in nearest_neighbours(rows, F.col("vec_id") % 100 == 0).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    held = {i: np.array(v, np.float32).astype(float) for i, v in vectors if i is not None and i < 300 or i in (800, 801)}
    assert sorted(found) == [0, 100, 200, 800]
    for q, rows in found.items():
        wanted = sorted((float(np.sqrt(((held[q] - v) ** 2).sum())), i) for i, v in held.items() if i != q)[:10]
        rows.sort()
        assert [i for _, i, _ in rows] == [i for _, i in wanted]
        assert [k for k, _, _ in rows] == list(range(1, 11))
        assert np.allclose([s for _, _, s in rows], [d for d, _ in wanted], rtol=1e-12, atol=1e-12)


# --- token counts


def test_tokens_of_sections_add_up(session):
    import base64
    from pathlib import Path

    import tiktoken

    ranks = Path(public_tokenizers.path("byte_bpe_50k.tiktoken")).read_bytes()
    held = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=held, special_tokens={})
    texts = [(1, "one line\n\n\nthree\nfour é😀\n"), (2, ""), (3, None), (4, "no break"), (5, "\n"), (4, "no break")]
    for rule in ("first", "last", "most"):
        rows = count_tokens(docs_of(session, texts, clashing=True), ranks, public_tokenizers.PATTERN, rule).collect()
        for i, text in texts[:5]:
            own = sorted((r.section, r.start, r.end, r.n_tokens) for r in rows if r.doc_id == i)
            repeats = 2 if i == 4 else 1
            assert sum(r[3] for r in own) == repeats * len(plain.encode_ordinary(text or ""))
            assert len(own) == repeats * len((text or "").splitlines(keepends=True))
            lines = [(text or "")[a:b] for _, a, b, _ in own[::repeats]]
            assert "".join(lines) == (text or "")


def test_rules_for_tokens_that_cross():
    ends, edges = np.array([2, 7, 9]), np.array([0, 3, 6, 9])
    assert allocate(ends, edges, "first")[0].tolist() == [0, 0, 2]
    assert allocate(ends, edges, "last")[0].tolist() == [0, 2, 2]
    assert allocate(ends, edges, "most")[0].tolist() == [0, 1, 2]
    assert allocate(ends, edges, "most")[1].tolist() == [False, True, False]


# --- language


def test_languages_are_told_apart(session):
    rng = random.Random(7)
    kinds = {"aa": "bada gudo zebu", "bb": "kirr tpal sfem", "cc": "öhni äklü ßwer"}
    rows = []
    for i in range(150):
        lang = rng.choice(sorted(kinds))
        text = " ".join("".join(rng.choice(kinds[lang].split()) for _ in range(rng.randrange(1, 4))) for _ in range(30))
        rows.append((i, text, lang, "a", 0))
    docs = session.createDataFrame(rows, DOCS)
    filters = language_id.learn(docs.where("doc_id < 120").select("doc_id", "text", "lang"))
    assert filters.languages == ("aa", "bb", "cc")
    found = {r.doc_id: r for r in language_id.predict(docs, filters).collect()}
    assert all(found[i].lang_pred == lang and 0 < found[i].score <= 1 for i, _, lang, _, _ in rows)
    odd = docs_of(session, [(1, None), (2, ""), (3, "123 !?"), (None, "bada"), (4, "x" * 50_000)])
    told = [(r.doc_id, r.lang_pred) for r in language_id.predict(odd, filters).collect()]
    assert {(1, "und"), (2, "und"), (3, "und"), (None, "aa")} <= set(told) and len(told) == 5
    empty = language_id.learn(docs.limit(0).select("doc_id", "text", "lang"))
    assert {r.lang_pred for r in language_id.predict(odd, empty).collect()} == {"und"}


def test_filters_and_predictions_equal_plain_sets(session, monkeypatch):
    monkeypatch.setattr(language_id, "LEAST_SHARE", 2e-3)
    rng = random.Random(11)
    letters = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "öäüßefgh"}
    word = lambda lang: "".join(rng.choice(letters[lang]) for _ in range(rng.randrange(2, 7)))
    rows = [(i, " ".join(word(lang) for _ in range(60)), lang) for i, lang in enumerate(sorted(letters) * 25)]
    filters = language_id.learn(session.createDataFrame(rows, "doc_id bigint, text string, lang string"))

    def plain(text):
        padded = " " + text + " "
        for n in language_id.SIZES:
            for k in range(len(padded) - n + 1):
                gram = padded[k : k + n]
                if " " not in (gram.strip() if n == 2 else gram[1:-1]) and gram.strip():
                    yield gram

    seen = {lang: Counter(g for _, t, x in rows if x == lang for g in plain(t)) for lang in letters}
    kept = {x: {g for g, n in c.items() if n >= 2e-3 * sum(c.values())} for x, c in seen.items()}
    assert all(0 < len(kept[x]) < len(seen[x]) for x in letters)
    # Slots from Spark are those of the hashes in numpy.
    hashed = {x: np.unique(np.concatenate([h for h, _ in language_id.grams([t for _, t, k in rows if k == x])]), return_counts=True) for x in letters}
    for k, lang in enumerate(filters.languages):
        h, n = hashed[lang]
        assert sorted(n.tolist()) == sorted(seen[lang].values())
        h = h[n >= 2e-3 * n.sum()]
        assert len(h) == len(kept[lang])
        want = np.zeros(1 << language_id.SLOT_BITS, bool)
        for at in language_id.slots(h):
            want[at] = True
        assert np.array_equal((filters.masks[0] >> np.uint64(k)) & np.uint64(1) == 1, want)
    texts = [" ".join(word(lang) for _ in range(12)) for lang in sorted(letters) * 40]
    asked = session.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    told = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(asked, filters).collect()}
    for i, text in enumerate(texts):
        hits = {x: sum(g in kept[x] for g in plain(text)) for x in letters}
        first, second = sorted(hits.values())[-1:-3:-1]
        assert hits[told[i][0]] == first
        assert abs(told[i][1] - (first - second) / first) < 0.02


def test_a_language_of_one_short_text_is_learned(session):
    rows = [(i, "the quick brown fox jumps over the lazy dog", "en") for i in range(50)] + [(60, "žluťoučký kůň", "cs")]
    filters = language_id.learn(session.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert filters.languages == ("cs", "en")
    asked = session.createDataFrame([(1, "kůň žluťoučký"), (2, "the lazy fox")], "doc_id bigint, text string")
    assert {r.doc_id: r.lang_pred for r in language_id.predict(asked, filters).collect()} == {1: "cs", 2: "en"}
