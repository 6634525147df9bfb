"""Judged prediction CSVs and leaderboards.

Files are read by glob in one scan with an explicit, positional schema: a
file whose first header reads ``query`` instead of ``body`` (Q12) lands in the
same column. ``batch`` comes from the file name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qalake.schemas import FACTOID_JUDGED, LIST_JUDGED
from qalake.sources.questions import batch_number, normalise_answers


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return (spark.read.schema(schema)
            .option("header", True).option("multiLine", True).option("escape", '"')
            .option("enforceSchema", True).option("mode", "PERMISSIVE")
            .csv(path)
            .withColumn("file", F.col("_metadata.file_path"))
            .withColumn("batch", batch_number(F.col("_metadata.file_name"))))


def read_factoid_judged(spark: SparkSession, path: str) -> DataFrame:
    """F4 files -> (batch, body, exact_answer, predicted, pos); ``?`` -> null."""
    df = _read(spark, path, FACTOID_JUDGED)
    return df.select("batch", "file", "body", "type",
                     normalise_answers(F.col("exact_answer")).alias("exact_answer"),
                     normalise_answers(F.col("predicted_answers")).alias("predicted_answers"),
                     F.col("predicted_answer_pos").try_cast("int").alias("pos"))


def read_list_judged(spark: SparkSession, path: str) -> DataFrame:
    """F5 files -> (batch, body, ..., tp, fp, fn)."""
    df = _read(spark, path, LIST_JUDGED)
    return df.select("batch", "file", "body", "type",
                     normalise_answers(F.col("exact_answer")).alias("exact_answer"),
                     normalise_answers(F.col("predicted_answers")).alias("predicted_answers"),
                     F.col("TP").try_cast("long").alias("tp"), F.col("FP").try_cast("long").alias("fp"),
                     F.col("FN").try_cast("long").alias("fn"))


def malformed_count(df: DataFrame, cols: list[str]) -> DataFrame:
    """Q20: cells whose list literal could not be parsed (counted, not dropped)."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"malformed_{c}") for c in cols])


LEADERBOARD_ALIASES = {"System": "system", "Batch": "batch"}
VALID_PHASES = ["A", "B", "A & B"]


def read_leaderboard(spark: SparkSession, path: str, metrics: list[str]) -> DataFrame:
    """Team leaderboard CSV; header aliases applied (Q12), metrics cast
    to double by name (Q13), phase validated (invalid -> null + flag)."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    for a, b in LEADERBOARD_ALIASES.items():
        if a in df.columns:
            df = df.withColumnRenamed(a, b)
    out = df.select(*[F.col(c) for c in df.columns if c not in metrics],
                    *[F.col(m).try_cast("double").alias(m) for m in metrics if m in df.columns])
    if "batch" in out.columns:
        out = out.withColumn("batch", F.col("batch").try_cast("int"))
    if "phase" in out.columns:
        out = out.withColumn("phase_valid", F.col("phase").isin(*VALID_PHASES))
    return out
