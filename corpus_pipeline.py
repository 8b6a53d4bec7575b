"""From raw documents to token ids in five stages, each over all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crateline.llm import toxicity
from crateline.llm.common import prepare, staged, table
from crateline.llm.jaccard_join import one_of_each
from crateline.llm.mixing import mixed_documents
from crateline.llm.piece_bpe import Vocabulary, encode_documents
from crateline.llm.private_data import mask_private_data
from crateline.llm.queries import held_out


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled rows op2 learns from."""
    labels = table(prepare(spark), sf_dir, "labels")
    return toxicity.keep_clean(docs, toxicity.learn(docs, labels.where(~held_out(5, 0))))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents that of the smallest id stays."""
    prepare(spark)
    return one_of_each(docs)


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind; n_chars follows the new text."""
    prepare(spark)
    return mask_private_data(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks, up to three times or not at all."""
    prepare(spark)
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every copy, and a digest of what they decode to."""
    vocabulary = Vocabulary.read(public_tokenizers.path("piece_bpe_32k.model"))
    prepare(spark)
    return encode_documents(docs, vocabulary).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        "ids",
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("private_data", mask_private),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

# Learned scores, entropy balancing and token ids are past what SQL states.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last written and read again."""
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
