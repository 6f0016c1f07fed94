"""From raw documents to a training mix: quality, near copies, repeated passages, benchmark passages, source weights.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next one gets it as written and read again. All but the
last return the columns of ``docs``. Nulls, empty and repeated rows are handled as the operators' docstrings say: a stage
drops a row only for the reason it names. Stages that work on an empty table return an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refmask.llm import quality_classifier
from refmask.llm.common import held_out, table, written
from refmask.llm.decontamination import decontaminate
from refmask.llm.line_dedup import dedup_lines
from refmask.llm.ngram_jaccard import keep_one
from refmask.llm.source_mixing import mix_sources

#: Documents below this score go; it is low, so that doubtful ones stay.
LEAST_QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the compression classifier rejects. It learns from the labelled documents among ``docs``."""
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id", 5, 0))
    scored = quality_classifier.score_texts(docs, model, *docs.columns)
    return scored.where(F.col("score") >= LEAST_QUALITY).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of similar ones, that of the smallest doc_id."""
    return keep_one(docs).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove passages that an earlier document or place has; no document goes. ``n_chars`` follows a changed text."""
    out = dedup_lines(docs)
    n_chars = F.when(F.col("removed").isNotNull(), F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many copies of each document the mix takes."""
    return mix_sources(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_copies),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_passages),
    ("mixing sources to target weights", mix),
]

#: Compressed sizes cannot be had in SQL; the stages are tested against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{k}")
    return docs
