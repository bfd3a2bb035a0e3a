"""Registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargoledger.llm import (
    alignment,
    automaton,
    exact_dedup,
    infill,
    jaccard_join,
    katz,
    language,
    line_dedup,
    neighbours,
    packing,
    preference,
    subword,
    suffix_dedup,
)
from cargoledger.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = table(spark, sf_dir, "documents").withColumn("text_sha256", F.sha2("text", 256))
    encoded = subword.encode(docs, model, carried=("doc_id", "text_sha256")).withColumns(
        {"n_pieces": F.size("ids").cast("bigint"), "ids_hash": F.xxhash64("ids")}
    )
    kept = ("doc_id", "n_pieces", "ids_hash", "text_sha256")
    decoded = subword.decode(encoded, model, carried=kept).withColumn("decoded_sha256", F.sha2("text", 256))
    lossless = F.col("text_sha256").eqNullSafe(F.col("decoded_sha256"))
    return decoded.select("doc_id", "n_pieces", "ids_hash", "decoded_sha256", lossless.alias("lossless"))


def op2_projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 100 = 0").select("vec_id"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked_components(table(spark, sf_dir, "documents")).drop("class_id")


def op5_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.scores(table(spark, sf_dir, "documents"))


def op6_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op7_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.preference_rows(*preference.swapped_replies(table(spark, sf_dir, "conversations")))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", "n_spans", F.sha2("text", 256).alias("kept_sha256"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_bytes(table(spark, sf_dir, "documents")).drop("kept")


def op11_automaton_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    kept = ("doc_id", "n_tokens", "ids_sha256")
    encoded = automaton.encode(table(spark, sf_dir, "documents"), tokenizer, digests=True)
    return automaton.decode(encoded, tokenizer, carried=kept).select(*kept, F.sha2("text", 256).alias("decoded_sha256"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.align(table(spark, sf_dir, "documents"), *files, digest=True).withColumnRenamed("groups", "groups_sha256")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = infill.fill_in_middle(table(spark, sf_dir, "documents"))
    restored = F.sha2(infill.restore(F.col("output"), F.col("form")), 256)
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), restored.alias("restored_sha256")
    )


QUERIES: dict[str, Query] = {
    "op1_sampled_pieces": op1_sampled_pieces,
    "op2_projected_neighbours": op2_projected_neighbours,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_katz_scores": op5_katz_scores,
    "op6_string_kernel_language": op6_string_kernel_language,
    "op7_preference_formatting": op7_preference_formatting,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_line_windows": op9_line_windows,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_automaton_bpe": op11_automaton_bpe,
    "op12_token_alignment": op12_token_alignment,
    "op13_fill_in_middle": op13_fill_in_middle,
}
