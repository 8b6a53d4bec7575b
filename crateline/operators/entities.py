"""Canonical names, relations and the search column for what the corpus refers to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crateline.functions import text as T
from crateline.operators import relational as R

ARTIST_COLUMNS = ("id", "name", "real_name", "profile", "urls")
LABEL_COLUMNS = ("id", "name", "profile", "urls")


def corpus_artist_entities(artists_nested: DataFrame, corpus: DataFrame) -> DataFrame:
    wanted = corpus.select(F.col("artist_id").alias("id"))
    return artists_nested.join(wanted, "id", "left_semi").select(*ARTIST_COLUMNS)


def corpus_label_entities(labels_nested: DataFrame, label_refs: DataFrame) -> DataFrame:
    wanted = label_refs.select(F.col("label_id").alias("id")).distinct()
    return labels_nested.join(wanted, "id", "left_semi").select(*LABEL_COLUMNS)


def artist_relations(artists_nested: DataFrame, corpus: DataFrame) -> DataFrame:
    """``listed_relations`` of corpus artists."""
    wanted = corpus.select(F.col("artist_id").alias("id"))
    return listed_relations(artists_nested.join(wanted, "id", "left_semi"))


def listed_relations(records: DataFrame) -> DataFrame:
    """(artist_id, related_id, kind, related_name) of records that are one per artist, one per key.

    The other side may be outside the corpus. The first listed name of a key is kept.
    """
    listed = records.select(F.col("id").alias("artist_id"), F.posexplode("relations").alias("at", "r"))
    named = listed.select(
        "artist_id", F.col("r.id").alias("related_id"), "r.kind", "at", F.col("r.name").alias("name")
    )
    return named.groupBy("artist_id", "related_id", "kind").agg(
        F.min_by("name", "at").alias("related_name")
    )


def fallback_names(entities: DataFrame, wanted_ids: DataFrame, name_refs: DataFrame) -> DataFrame:
    """Entities plus wanted ids the dump lacks, named by the least name seen on releases."""
    missing = wanted_ids.select("id").distinct().join(entities.select("id"), "id", "left_anti")
    # Names are reduced to one per id before the join.
    named = name_refs.groupBy("id").agg(F.min("name").alias("name"))
    return entities.unionByName(named.join(missing, "id", "left_semi"), allowMissingColumns=True)


def artist_name_refs(line: DataFrame, credits: DataFrame) -> DataFrame:
    pick = lambda df: df.select(F.col("artist_id").alias("id"), "name")
    return pick(line).unionByName(pick(credits))


def label_name_refs(label_refs: DataFrame) -> DataFrame:
    return label_refs.select(F.col("label_id").alias("id"), "name")


def entity_stats(
    artists_nested: DataFrame,
    labels_nested: DataFrame,
    artists_kept: DataFrame,
    labels_kept: DataFrame,
    corpus: DataFrame,
    label_refs: DataFrame,
    relations: DataFrame,
) -> DataFrame:
    counts = R.one_row(
        R.row_count(artists_nested, "artists_scanned"),
        R.row_count(artists_kept, "artists_kept"),
        R.row_count(corpus, "artists_wanted"),
        R.row_count(labels_nested, "labels_scanned"),
        R.row_count(labels_kept, "labels_kept"),
        label_refs.agg(F.countDistinct("label_id").alias("labels_wanted")),
        R.row_count(relations, "relations"),
    )
    return counts.select(
        "artists_scanned",
        "artists_kept",
        (F.col("artists_wanted") - F.col("artists_kept")).alias("artists_missing"),
        "labels_scanned",
        "labels_kept",
        (F.col("labels_wanted") - F.col("labels_kept")).alias("labels_missing"),
        "relations",
    )


def search_index(entities: DataFrame, id_column: str = "id", name: str = "name") -> DataFrame:
    return entities.select(F.col(id_column).alias("id"), T.search_text(F.col(name)).alias("norm_name"))


# Characters of a posting: what the search compares before it looks at the whole name.
POSTING = 64


def search_postings(index: DataFrame) -> DataFrame:
    """(text, id): a row per token of a folded name, holding the name from there on.

    A phrase of whole tokens and a last prefix is in a name exactly if one of its postings begins
    with it, so over a table laid out by ``text`` a search reads a range. Texts end after POSTING
    characters: a name of many tokens costs rows, not their square.
    """
    tokens = F.split(F.trim("norm_name"), " ")
    rows = index.select("id", F.posexplode(tokens).alias("at", "token"), F.trim("norm_name").alias("name"), tokens.alias("tokens"))
    # A token starts after those before it and a blank each.
    start = F.aggregate(F.slice("tokens", F.lit(1), F.col("at")), F.lit(1), lambda n, t: n + F.length(t) + 1)
    text = F.substring(F.col("name"), start, F.lit(POSTING))
    return rows.filter(F.col("token") != "").select(text.alias("text"), "id")


def phrase_ids(postings: DataFrame, index: DataFrame, query: str) -> DataFrame:
    """(id): names that hold the query's phrase, each once; none for a query that says nothing.

    The phrase is worked out by the planner, so the scan gets it as a prefix to skip row groups by.
    ``index`` is read only for a query that may be longer than a posting.
    """
    phrase = T.normalise_query(F.lit(query))
    ids = postings.filter(F.col("text").startswith(F.substring(F.ltrim(phrase), 1, POSTING))).select("id").distinct()
    if 2 * len(query) <= POSTING:
        return ids
    return index.filter(T.matches_phrase(F.col("norm_name"), phrase)).join(ids, "id", "left_semi").select("id")
