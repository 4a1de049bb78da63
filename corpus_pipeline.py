"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, packing.

Each stage takes the documents that its predecessor kept; ``run`` writes each result as
Parquet in the shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgauge.llm.common import set_aside, stored, table
from driftgauge.llm.decontamination import without_leaks
from driftgauge.llm.line_dedup import dedup_lines
from driftgauge.llm.near_dedup import one_of_each_class
from driftgauge.llm.packing import digest
from driftgauge.llm.toxicity import fitted, score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity under 0.7."""
    own, back = set_aside(docs, "toxicity", "offending")
    return back(score_toxicity(own, fitted(spark, docs, sf_dir)).where(F.col("toxicity") < 0.7))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, later repeats of runs of lines cut out; n_chars follows."""
    own, back = set_aside(docs, "lines_deleted", "runs_deleted")
    out = dedup_lines(own)
    return back(out.withColumn("n_chars", F.when(F.col("lines_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class, that with the smallest id; of equal texts without a word one too."""
    return one_of_each_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each packed piece."""
    return digest(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: The learnt and hashed stages have no SQL; tests/llm/test_pipeline.py holds the brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
