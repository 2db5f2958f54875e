"""The corpus pipeline: language ID, near duplicates, repeated passages, benchmark leaks, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents. What they decide: documents without a language (no letters, or no language reaches ``SURE``) go; of
each group of near duplicates the document of least id stays; bytes that an earlier document holds too are cut from
texts, and documents of which nothing but white space is left go; documents with a benchmark item go; the rest is packed.

Cases of all stages: an empty table gives an empty one; null texts have no language and go at the first stage (alone, the others keep
them); rows without doc_id stay; of rows that repeat a doc_id the pairs stage keeps one, the first by text, lang, source and n_chars; very long texts
are handled whole; columns beyond those of documents stay to the last stage but one.

There is no SQL for these stages; tests/llm holds them against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vantaq.llm import decontam, jaccard, langid, packing, suffixdedup
from vantaq.llm.base import prepare, table, written

#: The least score of a language.
SURE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with letters in a language that is told with a score of SURE at least."""
    prepare(spark)
    fitted = langid.fit(docs, F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    judged = langid.predict(docs, fitted)
    return judged.filter((F.col("lang_pred") != langid.UND) & (F.col("score") >= SURE)).select(docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document of least id, and of rows that repeat its id the first."""
    classes = jaccard.join(docs)
    gone = classes.filter("class_id != doc_id").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    repeated = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id")
    if repeated.isEmpty():
        return kept
    first = Window.partitionBy("doc_id").orderBy(*[c for c in ("text", "lang", "source", "n_chars") if c in docs.columns])
    once = kept.join(repeated, "doc_id", "left_semi").select(*docs.columns, F.row_number().over(first).alias("place_among_equals")).filter("place_among_equals = 1")
    return kept.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(once.select(docs.columns))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the bytes that a document of smaller id holds too (50 at least); those of which only white space is left go."""
    cut = suffixdedup.cut(docs, text=True)
    touched = F.col("n_removed") > 0
    left = cut.filter(~touched | (F.length(F.regexp_replace("kept", r"\s+", "")) > 0))
    left = left.withColumn("text", F.when(touched, F.col("kept")).otherwise(F.col("text")))
    return left.withColumn("n_chars", F.when(touched, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that hold no benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document: its sequence, and its place there."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
