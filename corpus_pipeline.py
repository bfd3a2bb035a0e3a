"""A corpus preparation pipeline of five operators, from raw documents to packed sequences.

Every stage is a function (spark, docs, sf_dir) -> DataFrame over all that its predecessor kept. ``run`` writes
each stage's rows as Parquet below ``spark.checkpoint.dir`` and reads them back, so a stage depends on files and not
on executors that ran the one before.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargoledger.llm import exact_dedup, jaccard_join, language, packing, suffix_dedup
from cargoledger.llm.common import table, written

SEQUENCE_TOKENS = 2048
# Documents are rejected if no language is likelier than so many times an even guess: 0.3 with four languages.
LEAST_LANGUAGE_LEAD = 1.2


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told from their text; all columns stay as they are.

    Documents without a letter, null and empty ones too, are rejected, and those whose best language scores at or
    below LEAST_LANGUAGE_LEAD times an even guess. The classifier learns from a bounded sample of the labelled
    documents; without any label it knows no language and rejects all, with a single one no text scores lower.
    """
    model = language.train(docs)
    tagged = docs.select(F.struct("*").alias("row"), F.col("text").alias("text"))
    found = language.predict(tagged, model, "text", ("row",))
    n = len(model.languages) if model else 0
    least = LEAST_LANGUAGE_LEAD / n if n > 1 else 0.0
    kept = (F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") > least)
    return found.where(kept).select("row.*")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (A-Z as a-z) the one with the smallest id."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingle sets of similarity 0.75 or more the one with the smallest id."""
    return jaccard_join.one_of_each_component(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 200 bytes or more that occur elsewhere; ``n_chars`` follows the text."""
    cut = suffix_dedup.drop_repeated_passages(docs)
    return cut.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast("bigint")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as pieces of sequences of at most SEQUENCE_TOKENS tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), SEQUENCE_TOKENS)


STAGES = [
    ("language", keep_known_languages),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("passages", drop_repeated_passages),
    ("packing", pack_sequences),
]

# The language stage is a trained classifier, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents of ``sf_dir``; the rows of the last one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
