"""Queries over the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import language, packing, sql, toxicity
from quillstone.llm.chat import format_chats
from quillstone.llm.decontaminate import contamination, items_digest
from quillstone.llm.katz import katz_scores
from quillstone.llm.line_dedup import deduplicate_lines
from quillstone.llm.media import audio_features
from quillstone.llm.near_dedup import near_duplicates
from quillstone.llm.substring_dedup import remove_repeated_windows
from quillstone.sources import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2)


def op2_doubling_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_windows(table(spark, sf_dir, "documents"))


def op3_snapshot_collapsed_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


def op4_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = language.fold("doc_id", 5) == 1
    # Trigrams need more disk than the limits allow (see the README); the operator takes any order.
    found = katz_scores(table(spark, sf_dir, "documents"), ~held_out, order=2)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_bitmask_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.where(language.fold("doc_id", 5) != 0))
    return language.predict(docs, model).select(
        "doc_id", (language.fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score"
    )


def op6_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learn = language.fold("doc_id", 3) != 1
    model = toxicity.train(docs.where(learn), labels.where(learn))
    return toxicity.score(docs, model).select(
        "doc_id", (language.fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted"
    )


def op7_prefix_filter_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", items_digest().alias("items_sha256"), "contaminated"
    )


def op8_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.tokenizer_path()).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op9_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_kept", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")
    )


def op10_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = audio_features(table(spark, sf_dir, "documents"))
    size = F.length("payload").cast("long")
    return media.select(
        "doc_id",
        "n_bytes",
        size.alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", "frames", F.size("segments"), F.sha2("tensors", 256)).alias("feature"),
    )


def queries() -> dict[str, Query]:
    return {
        "op1_minhash_near_dedup": op1_minhash_near_dedup,
        "op2_doubling_substring_dedup": op2_doubling_substring_dedup,
        "op3_snapshot_collapsed_chats": op3_snapshot_collapsed_chats,
        "op4_katz_backoff": op4_katz_backoff,
        "op5_bitmask_language_id": op5_bitmask_language_id,
        "op6_kneser_ney_toxicity": op6_kneser_ney_toxicity,
        "op7_prefix_filter_decontamination": op7_prefix_filter_decontamination,
        "op8_pattern_packing": op8_pattern_packing,
        "op9_fuzzy_line_dedup": op9_fuzzy_line_dedup,
        "op10_audio_features": op10_audio_features,
    }


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
