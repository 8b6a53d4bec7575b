"""One query per operator over its whole table, and the SQL beside it where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crateline.llm import filter_audit, language_id, quality, quality_rules, toxicity
from crateline.llm.common import prepare, remainder, staged, table
from crateline.llm.fingerprints import fingerprint_documents
from crateline.llm.jaccard_join import jaccard_join
from crateline.llm.mixing import mix
from crateline.llm.neighbours import nearest_neighbours
from crateline.llm.piece_bpe import Vocabulary, encode_documents
from crateline.llm.private_data import BASE, find_private_data
from crateline.llm.token_alignment import Sides, align_documents
from crateline.llm.token_counts import count_tokens


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(prepare(spark), sf_dir, "documents"))


def sha256(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)


def held_out(by: int, rest: int) -> Column:
    return F.coalesce(remainder("doc_id", by) == rest, F.lit(False))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(prepare(spark), sf_dir, name) for name in ("documents", "labels"))
    model = toxicity.learn(docs, labels.where(~held_out(5, 0)))
    return toxicity.score(docs, model).select(
        "doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = Vocabulary.read(public_tokenizers.path("piece_bpe_32k.model"))
    coded = encode_documents(table(prepare(spark), sf_dir, "documents"), vocabulary)
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        sha256(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
        sha256(F.col("decoded")).alias("decoded_sha256"),
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(prepare(spark), sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "rate", "copies")


def op5_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_private_data(table(prepare(spark), sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id", *(count(k) for k in BASE), sha256(joined(base)).alias("base_sha256"), joined("spans").alias("spans")
    )


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = fingerprint_documents(table(prepare(spark), sf_dir, "documents"))
    return marked.select(
        "doc_id",
        "n_chars",
        sha256(F.col("edited")).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(prepare(spark), sf_dir, name) for name in ("documents", "labels"))
    rows = staged(quality.measured(docs), "statistics")
    known = labels.where(~held_out(3, 1) & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("label"))
    model = quality.learn(rows.join(known, "doc_id"))
    return quality.score(rows, model).select(
        "doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(prepare(spark), sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = Path(public_tokenizers.path("byte_bpe_50k.tiktoken")).read_bytes()
    return count_tokens(table(prepare(spark), sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    filters = language_id.learn(docs.where(~held_out(5, 0)).select("doc_id", "text", "lang"))
    return language_id.predict(docs, filters).select(
        "doc_id", held_out(5, 0).alias("held_out"), "lang_pred", "score"
    )


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(prepare(spark), sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(prepare(spark), sf_dir, name) for name in ("documents", "labels"))
    return filter_audit.audit(docs, labels)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    sides = Sides(path("byte_bpe_50k.json"), public_tokenizers.PATTERN, path("piece_bpe_32k.model"))
    return align_documents(table(prepare(spark), sf_dir, "documents"), sides)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_toxicity": op2_toxicity,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_mixing": op4_mixing,
    "op5_private_data": op5_private_data,
    "op6_fingerprints": op6_fingerprints,
    "op7_quality": op7_quality,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_token_counts": op9_token_counts,
    "op10_language_id": op10_language_id,
    "op11_quality_rules": op11_quality_rules,
    "op12_filter_audit": op12_filter_audit,
    "op13_token_alignment": op13_token_alignment,
}

SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+') AS w FROM documents),
        sets AS (
            SELECT DISTINCT doc_id, unnest(CASE
                WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM words),
        sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
        common AS (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM sets x JOIN sets y USING (shingle)
            WHERE x.doc_id <> y.doc_id GROUP BY ALL),
        links AS (
            SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
            WHERE 100 * common.n >= 75 * (x.n + y.n - common.n)),
        reached AS (
            SELECT doc_id, doc_id AS other FROM documents
            UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON l.a = r.other)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
        FROM (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
        LEFT JOIN sizes USING (doc_id)""",
    "op8_nearest_neighbours": """
        WITH sound AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
            WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
        SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM (
            SELECT q.vec_id AS query_id, s.vec_id, list_distance(q.v, s.v) AS score,
                row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.v, s.v), s.vec_id) AS place
            FROM sound q JOIN sound s ON s.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
        WHERE place <= 10""",
    "op11_quality_rules": r"""
        WITH texts AS (
            SELECT row_number() OVER () AS row, doc_id, lang, source, coalesce(text, '') AS text,
                regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                list_filter(string_split(coalesce(text, ''), chr(10)),
                    lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM documents),
        windows AS (
            SELECT row, i, array_to_string(w[i:i + 4], ' ') AS x
            FROM (SELECT row, w, unnest(range(1, len(w) - 3)) AS i FROM texts)),
        repeated AS (SELECT row, i FROM windows QUALIFY count(*) OVER (PARTITION BY row, x) > 1),
        covered AS (SELECT row, count(DISTINCT i + k) AS n FROM repeated, range(5) t(k) GROUP BY row),
        counted AS (
            SELECT row, doc_id, lang, source, len(w) AS n_words,
                length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
                length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
                len(lines) - len(list_distinct(lines)) AS n_dup_lines,
                coalesce(n, 0) AS n_repeat_words, length(text) AS n_chars, len(lines) AS n_lines,
                length(regexp_replace(text, '\P{L}+', '', 'g')) AS n_letters
            FROM texts LEFT JOIN covered USING (row)),
        rows AS (
            SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {
                'symbol_share': 10000 * n_symbols // greatest(n_chars, 1),
                'dup_line_share': 10000 * n_dup_lines // greatest(n_lines, 1),
                'repeat_share': 10000 * n_repeat_words // greatest(n_words, 1),
                'other_share': 10000 - 10000 * n_letters // greatest(word_chars, 1),
                'long_words': 100 * word_chars // greatest(n_words, 1)} AS m FROM counted),
        long AS (
            UNPIVOT (SELECT row, lang, source, base_failed, m.* FROM rows)
            ON symbol_share, dup_line_share, repeat_share, other_share, long_words INTO NAME measure VALUE v),
        sketch AS (
            SELECT lang, source, measure, (v >> s) << s AS b, count(*) AS n
            FROM (SELECT *, greatest(length(bin(v)) - 6, 0) AS s FROM long WHERE NOT base_failed) GROUP BY ALL),
        own AS (
            SELECT lang, source, measure, any_value(docs) AS docs, min(b) FILTER (4 * upto >= docs) AS lo,
                min(b) FILTER (4 * upto >= 3 * docs) AS hi
            FROM (SELECT *, sum(n) OVER (PARTITION BY lang, source, measure ORDER BY b) AS upto,
                sum(n) OVER (PARTITION BY lang, source, measure) AS docs FROM sketch) GROUP BY ALL),
        whole AS (
            SELECT lang, measure, min(b) FILTER (4 * upto >= docs) AS lo, min(b) FILTER (4 * upto >= 3 * docs) AS hi
            FROM (SELECT *, sum(n) OVER (PARTITION BY lang, measure ORDER BY b) AS upto,
                sum(n) OVER (PARTITION BY lang, measure) AS docs
                FROM (SELECT lang, measure, b, sum(n) AS n FROM sketch GROUP BY ALL)) GROUP BY ALL),
        fences AS (
            SELECT o.lang, o.source, o.measure,
                CAST(docs * o.lo + 100 * w.lo AS DOUBLE) / CAST(docs + 100 AS DOUBLE) AS lo,
                CAST(docs * o.hi + 100 * w.hi AS DOUBLE) / CAST(docs + 100 AS DOUBLE) AS hi
            FROM own o JOIN whole w ON o.lang IS NOT DISTINCT FROM w.lang AND o.measure = w.measure),
        broken AS (
            SELECT row, string_agg(measure, ',' ORDER BY place) AS failed
            FROM long l JOIN (VALUES ('symbol_share', 200.0::DOUBLE, 1), ('dup_line_share', 1500.0::DOUBLE, 2),
                ('repeat_share', 500.0::DOUBLE, 3), ('other_share', 300.0::DOUBLE, 4), ('long_words', 100.0::DOUBLE, 5))
                AS rules (measure, least, place) USING (measure)
            JOIN fences f ON l.lang IS NOT DISTINCT FROM f.lang AND l.source IS NOT DISTINCT FROM f.source
                AND l.measure = f.measure
            WHERE v > hi + 3 * greatest(hi - lo, least) GROUP BY row)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
            NOT base_failed AND failed IS NULL AS kept, coalesce(failed, '') AS failed
        FROM rows LEFT JOIN broken USING (row)""",
    "op12_filter_audit": r"""
        WITH texts AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
                regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        firsts AS (SELECT text, min(doc_id) AS first FROM texts GROUP BY text),
        marked AS (
            SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        flags AS (
            SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
                + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
                + CASE WHEN 100 * length(regexp_replace(t.text, '[^A-Z]+', '', 'g')) > 2 * length(t.text)
                    THEN 4 ELSE 0 END
                + CASE WHEN regexp_matches(t.text, '[#$%&*|]') THEN 8 ELSE 0 END
                + CASE WHEN first < t.doc_id THEN 16 ELSE 0 END AS fails
            FROM texts t JOIN firsts USING (text) LEFT JOIN marked m ON m.doc_id = t.doc_id),
        counts AS (
            SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
            FROM flags GROUP BY ALL),
        filters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, own)),
        orders AS (
            SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
            FROM filters a, filters b, filters c, filters d, filters e
            WHERE a.own + b.own + c.own + d.own + e.own = 31 AND (a.own | b.own | c.own | d.own | e.own) = 31),
        steps AS (
            SELECT filter_order, step, letter, own, coalesce((
                SELECT sum(f.own) FROM filters f WHERE position(f.letter IN filter_order) < step), 0)::INTEGER AS before
            FROM orders, range(1, 6) s(step) JOIN filters ON letter = substr(filter_order, step, 1)),
        sums AS (
            SELECT part, filter_order, step, letter,
                sum(CASE WHEN fails & (before | own) = 0 THEN n ELSE 0 END) AS kept,
                sum(CASE WHEN fails & own > 0 AND fails & before = 0 THEN n ELSE 0 END) AS removed,
                sum(CASE WHEN fails & own > 0 AND fails & before > 0 THEN n ELSE 0 END) AS redundant,
                sum(CASE WHEN fails = own THEN n ELSE 0 END) AS unique_fails,
                sum(CASE WHEN fails & own > 0 AND fails & before = 0 THEN good ELSE 0 END) AS good_lost,
                sum(CASE WHEN fails & own > 0 AND fails & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
            FROM counts, steps GROUP BY ALL)
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept,
            CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
            CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
            CAST(toxic_lost AS BIGINT) AS toxic_lost,
            CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
        FROM sums""",
}
