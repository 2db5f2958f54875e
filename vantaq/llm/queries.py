"""The registered queries of this subpackage, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, chat, decontam, divergence, jaccard, langid, media, packing, pieces, suffixdedup, tokencount, toxicity, urlfilter
from .base import table, written


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", spread=True).select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    fitted = langid.fit(docs, ~held_out)
    return langid.predict(docs.select("doc_id", "text"), fitted).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(table(spark, sf_dir, "documents", spread=True).select("doc_id", "text"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffixdedup.cut(table(spark, sf_dir, "documents", spread=True).select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judged(table(spark, sf_dir, "pages", spread=True).select("page_id", "url"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents", spread=True), table(spark, sf_dir, "benchmark"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents", spread=True))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations", spread=True).select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.digests(chat.conversations(rows))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents", spread=True), public_tokenizers.path("byte_bpe_50k.json"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", spread=True).select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    fitted = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs, fitted).select("doc_id", held_out.alias("held_out"), "score", "predicted", "evidence")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents", spread=True), public_tokenizers.path("word_bpe_49k.json"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents", spread=True).select("text", "lang", "source"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.round_trip(table(spark, sf_dir, "documents", spread=True), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", spread=True)
    found = align.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    found = found.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", digest, "pairs", "times")
    counted = align.with_counts(written(found, "aligned"))
    return counted.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_langid": op1_langid,
        "op2_media_columns": op2_media_columns,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_url_filters": op4_url_filters,
        "op5_decontamination": op5_decontamination,
        "op6_jaccard_join": op6_jaccard_join,
        "op7_chat_formatting": op7_chat_formatting,
        "op8_token_counts": op8_token_counts,
        "op9_toxicity": op9_toxicity,
        "op10_packing": op10_packing,
        "op11_source_divergence": op11_source_divergence,
        "op12_sentencepiece": op12_sentencepiece,
        "op13_token_alignment": op13_token_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_url_filters": urlfilter.oracle(), "op7_chat_formatting": chat.oracle(), "op11_source_divergence": divergence.oracle()}
