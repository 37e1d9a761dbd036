"""Stages that prepare `documents` for training; each takes (spark, docs, sf_dir) and returns a DataFrame.

run() writes each stage's result as Parquet to the shared folder and reads it as the next one's docs. All but the last
return the columns of documents; the last returns token ids in place of the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.llm import common, decontaminate, langid, lines, near, pieces

#: The score of the best language, below which a document is rejected: chance among four languages.
LEAST_SCORE = 0.25


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null text, or no letter in it) go, and those whose best language scores below
    LEAST_SCORE, which no learned language fits. Learns from the labels of docs."""
    columns = docs.columns
    out = langid.identify(docs)
    return out.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go, and documents of which nothing is left; n_chars follows the text."""
    out = lines.dedup(docs).where("removed_lines = 0 OR trim(text) <> ''")
    return out.withColumn("n_chars", F.when(F.col("removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest doc_id; rows that repeat both a doc_id and its
    text are one document, others that repeat a doc_id are judged by their text."""
    gone = common.stored(near.surplus(docs.select("doc_id", "text")), "pipeline-gone").withColumnRenamed("doc_id", "gone_id")
    same = docs["doc_id"].cast("long").eqNullSafe(gone["gone_id"]) & (F.xxhash64(docs["text"].cast("string")) == gone["text_key"])
    return docs.join(gone, same, "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids with merge-dropout, which decode to the text."""
    common.prepare(spark)
    out = pieces.encode(docs.select("doc_id", "lang", "source", "n_chars", "text"))
    return out.select("doc_id", "lang", "source", "n_chars", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]
#: SQL can't express the stages (a fitted classifier, hashed chunks, components, edit distance, merges); tests hold run()
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
