"""The corpus pipeline: toxicity, line dedup, near duplicates, benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns what the next one reads; all but the last return the
columns of ``documents``. SQL can't express the pipeline: its tests hold each stage against brute force.

Defined cases are those of the operators; rows without an id pass through all stages that need ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import decontaminate, line_dedup, mixing, ngram_join, toxicity
from siftline.llm._common import table
from siftline.sources.files import scratch


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity model rejects."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes aligned lines that an earlier document has; a document that loses all of its lines goes."""
    out = line_dedup.dedup_lines(docs)
    text = F.col("text")
    out = out.where(~((F.col("n_removed") > 0) & (F.length(F.trim(text)) == 0)))
    n_chars = F.when(F.col("n_removed") > 0, F.length(text).cast("long")).otherwise(F.col("n_chars"))
    return out.select(*(n_chars.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group linked by a five-word Jaccard similarity of 0.8 or more."""
    return ngram_join.representatives(docs, 5, 80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document."""
    out = mixing.mixed(docs.select("doc_id", "text", "source"), keep_text=False)
    return out.select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = scratch(spark, "pipeline")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return docs
