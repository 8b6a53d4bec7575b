"""The five stages over a small corpus: each one's decisions, and the whole against them."""

import random
from collections import Counter

import public_tokenizers
import sentencepiece
import corpus_pipeline
from crateline.llm.common import prepare

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def corpus(spark, folder):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(90)) for _ in range(n))
    rows, labels = [], []
    for i in range(150):
        body = text(60)
        if i % 3 == 0:
            body += " you scoundrel " + text(5)
        elif i % 3 == 1:
            body += f" mail me{i}@example.com now"
        rows.append((i, body, "en", f"s{i % 4}", len(body)))
        labels.append((i, 1, int(i % 3 == 0)))
    kept = rows[1]
    rows += [(1000 + k, kept[1] + f" end{k}", "en", "s1", 0) for k in range(5)]
    rows += [(2000, None, None, None, None), (2001, "", "en", "s0", 0)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_stages_and_whole(spark, tmp_path):
    prepare(spark)
    rows = corpus(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, after = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = after[name] = spark.read.parquet(f"{tmp_path}/{name}")
    assert [n for n, _ in corpus_pipeline.STAGES] == list(after)
    for name in list(after)[:-1]:
        assert after[name].columns == columns

    ids = lambda name: Counter(r.doc_id for r in after[name].collect())
    clean = {i for i, t, *_ in rows if "scoundrel" not in (t or "")}
    assert set(ids("toxicity")) == clean
    assert set(ids("ngram_jaccard_join")) == {i for i in clean if not 1000 <= i < 2000}
    masked = {r.doc_id: r for r in after["private_data"].collect()}
    assert "me1@example.com" not in masked[1].text and "mail <EMAIL> now" in masked[1].text
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in masked.values())

    copies = ids("mixing")
    assert set(copies) <= set(masked) and max(copies.values()) <= 3
    size = {i: len((r.text or "").split()) for i, r in masked.items()}
    total = sum(size.values())
    for source in ("s0", "s1", "s2", "s3"):
        own = [i for i, r in masked.items() if r.source == source]
        target = min(3 * sum(size[i] for i in own), total)
        taken = sum(copies[i] * size[i] for i in own)
        assert 0 < taken <= target

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    coded = after["sentencepiece"].collect()
    assert Counter(r.doc_id for r in coded) == copies
    for r in coded:
        assert list(r.ids) == library.encode(masked[r.doc_id].text or "", num_threads=1)
        assert r.n_tokens == len(r.ids)

    whole = corpus_pipeline.run(spark, str(tmp_path))
    key = lambda df: sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in df.select("doc_id", "n_tokens", "decoded_sha256").collect())
    assert key(whole) == key(after["sentencepiece"])
