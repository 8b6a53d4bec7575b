"""Quality rules whose limits come from the data: quantile sketches per language and source.

Every document is measured once. The measures of all documents go into log-linear histograms,
one per language, source and measure: a value's bucket keeps its leading ``BITS`` bits, so a
quantile read from a histogram is less than a 32nd below the true one. Histograms merge by adding
counts, in any order and with the same result, and a group needs a few hundred buckets however
many documents it holds. Limits are fences above the upper quartile; the documents are then
joined with the limits of their group. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crateline.llm.common import WORD, staged

# Leading bits of a value that its bucket keeps.
BITS = 6
# Shares are measured in parts of this whole.
WHOLE = 10_000
WINDOW = 5
SYMBOL = r"[#*$%&|<>]"
SPACES = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Rule:
    """A measure may reach its group's upper quartile plus ``spreads`` times the distance between
    the quartiles. The distance counts as ``least`` at least, so a group whose documents all
    measure alike still leaves room."""

    spreads: int
    least: int


# Measures in parts of WHOLE; long_words in hundredths of a character per word.
RULES: Mapping[str, Rule] = {
    "symbol_share": Rule(3, 200),
    "dup_line_share": Rule(3, 1_500),
    "repeat_share": Rule(3, 500),
    "other_share": Rule(3, 300),
    "long_words": Rule(3, 100),
}
# A group's quartiles are drawn towards its language's as if by this many documents.
PRIOR = 100
LEAST_WORDS = 10
MOST_REPEATED = 20


def windows_repeated(words: Column, n: int = WINDOW) -> Column:
    """How many words stand in windows of ``n`` words that occur twice or more, the first included.

    Hashes tell texts without a repeated window; in the others the windows themselves are sorted
    and equal neighbours marked, so no hash decides.
    """
    starts = lambda w: F.sequence(F.lit(0), F.size(w) - n)
    parts = lambda w, i: [F.get(w, i + k) for k in range(n)]
    hashes = lambda w: F.transform(starts(w), lambda i: F.xxhash64(*parts(w, i)))
    placed = lambda w: F.sort_array(
        F.transform(starts(w), lambda i: F.struct(F.concat_ws(" ", *parts(w, i)).alias("window"), i.alias("at")))
    )
    # A lambda over an array of one value names that value, so it is worked out once.
    named = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    alike = lambda p, i, j: F.coalesce(F.get(p, i)["window"] == F.get(p, j)["window"], F.lit(False))
    twice = lambda p: F.sort_array(
        F.transform(
            F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: alike(p, i, i - 1) | alike(p, i, i + 1)),
            lambda i: F.get(p, i)["at"],
        )
    )
    # Each marked window adds its words up to the next one's start.
    covered = lambda at: F.aggregate(
        F.sequence(F.lit(0), F.size(at) - 1),
        F.lit(0),
        lambda total, i: total + F.least(F.lit(n), F.coalesce(F.get(at, i + 1) - F.get(at, i), F.lit(n))),
    )
    exact = named(placed(words), lambda p: named(twice(p), lambda at: F.when(F.size(at) > 0, covered(at)).otherwise(0)))
    unlike = F.size(F.array_distinct(hashes(words))) == F.size(words) - n + 1
    return F.when(F.size(words) < n, 0).when(unlike, 0).otherwise(exact).cast("bigint")


def measured(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """Per row of ``docs``: doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_chars, n_lines (those with a word) and n_letters.

    A null text counts as empty. Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"),
        F.col(lang_col).cast("string").alias("lang"),
        F.col(source_col).cast("string").alias("source"),
        text.alias("text"),
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD)).alias("lines"),
    )
    return kept.select(
        "doc_id",
        "lang",
        "source",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.regexp_replace("text", SPACES, "")).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOL)).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        windows_repeated(F.col("words")).alias("n_repeat_words"),
        F.length("text").cast("bigint").alias("n_chars"),
        F.size("lines").cast("bigint").alias("n_lines"),
        F.length(F.regexp_replace("text", r"\P{L}+", "")).cast("bigint").alias("n_letters"),
    )


def measures() -> dict[str, Column]:
    """Whole numbers by rule name, high where a document is odd."""
    share = lambda part, whole: F.floor(F.lit(WHOLE) * F.col(part) / F.greatest(F.col(whole), F.lit(1)))
    return {
        "symbol_share": share("n_symbols", "n_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "other_share": F.lit(WHOLE) - share("n_letters", "word_chars"),
        "long_words": F.floor(F.lit(100) * F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))),
    }


def bucket(value: Column, bits: int = BITS) -> Column:
    """The value with all but its leading bits cleared: the bucket's least value."""
    over = F.greatest(F.length(F.bin(value)) - bits, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, over), over)


def sketch(rows: DataFrame, bits: int = BITS) -> DataFrame:
    """(lang, source, measure, bucket, n) over rows that carry a column for each of RULES."""
    each = F.array(*(F.struct(F.lit(name).alias("measure"), bucket(F.col(name), bits).alias("bucket")) for name in RULES))
    return (
        rows.select("lang", "source", F.inline(each)).groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n"))
    )


def merge(sketches: DataFrame, *keys: str) -> DataFrame:
    """Histograms of several groups, or of several corpora, as one per ``keys``."""
    return sketches.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketches: DataFrame, *keys: str) -> DataFrame:
    """(keys, measure, docs, lower, upper): buckets that hold the first and third quartile."""
    group = Window.partitionBy(*keys, "measure")
    reached = sketches.select(
        *keys,
        "measure",
        "bucket",
        F.sum("n").over(group.orderBy("bucket")).alias("upto"),
        F.sum("n").over(group).alias("docs"),
    )
    at = lambda k: F.min(F.when(4 * F.col("upto") >= k * F.col("docs"), F.col("bucket")))
    return reached.groupBy(*keys, "measure").agg(
        F.first("docs").alias("docs"), at(1).alias("lower"), at(3).alias("upper")
    )


def limits(sketches: DataFrame, prior: int = PRIOR) -> DataFrame:
    """(lang, source, then a limit per rule): the greatest value that the rule still lets through.

    Quartiles of a group and of its whole language are averaged by their documents, the language
    counting as ``prior`` documents, so a group's own habits prevail the more it has to show.
    """
    own = quartiles(sketches, "lang", "source")
    whole = quartiles(merge(sketches, "lang"), "lang").select(
        F.col("lang").alias("in_lang"), F.col("measure").alias("of"), F.col("lower").alias("low"), F.col("upper").alias("up")
    )
    met = own.join(whole, F.col("lang").eqNullSafe(F.col("in_lang")) & (F.col("measure") == F.col("of")))
    drawn = lambda a, b: (F.col("docs") * F.col(a) + prior * F.col(b)) / (F.col("docs") + prior)
    quarters = met.select("lang", "source", "measure", drawn("lower", "low").alias("lower"), drawn("upper", "up").alias("upper"))
    fence = lambda rule: F.col("upper") + rule.spreads * F.greatest(F.col("upper") - F.col("lower"), F.lit(float(rule.least)))
    return quarters.groupBy("lang", "source").agg(
        *(F.max(F.when(F.col("measure") == name, fence(rule))).alias(f"{name}_limit") for name, rule in RULES.items())
    )


def judge(
    docs: DataFrame,
    prior: int = PRIOR,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, failed (names of the rules broken, in order).

    A null or empty text has no words and fails the base. Documents that fail it are in no
    histogram. Null languages and sources are groups of their own; null ids and repeated rows
    stay, and each copy counts. Other columns are not read. No rows, no rows.
    """
    rows = measured(docs, id_col, text_col, lang_col, source_col)
    base_failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = staged(rows.withColumns({**measures(), "base_failed": base_failed}), "measures")
    # Written first, so that the planner knows its size and picks the join by it.
    found = staged(limits(sketch(rows.where("NOT base_failed")), prior), "limits")
    found = found.withColumnsRenamed({"lang": "of_lang", "source": "of_source"})
    judged = rows.join(
        found, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left"
    )
    broken = F.concat_ws(",", *(F.when(F.col(name) > F.col(f"{name}_limit"), name) for name in RULES))
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (broken == "")).alias("kept"),
        broken.alias("failed"),
    )
