"""A corpus clean-up in five stages: classify, cut repeated lines, drop near duplicates and
benchmark leaks, tokenize. Every stage works on all rows its predecessor kept; stages meet as
parquet in the shared folder, so a lost executor costs one stage's tasks at most."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.llm import bpe, decontaminate, line_dedup, near_dedup, quality
from runloom.plans.store import written


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, unchanged."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.filter_documents(docs, labels)


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated chunks of lines and repeated passages. A document of which nothing is left goes; n_chars
    follows the text where the column exists."""
    # Written first: a filter on the new text would otherwise be pushed below and repeat its expression.
    out = written(line_dedup.line_dedup(docs, passage_words=line_dedup.PASSAGE_WORDS), "cut")
    emptied = (F.col("_line_dedup.n_removed_lines") > 0) & (F.length("text") == 0)
    out = out.where(~F.coalesce(emptied, F.lit(False)))
    if "n_chars" in docs.columns:
        changed = F.col("_line_dedup.n_removed_lines") > 0
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(changed, size).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, unchanged."""
    return near_dedup.dedup(docs, similarity=0.8)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item, unchanged."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every remaining document as digests, checked by decoding them again."""
    return bpe.encode_digests(docs)


STAGES = [
    ("quality_classifier", classify),
    ("line_dedup", cut_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("bpe_encoding", tokenize),
]

#: The classifier is fitted by gradient steps and BPE merges are iterative; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
