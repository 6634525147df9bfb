"""``metric: score`` report lines -> one wide row per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse_report_lines(lines: DataFrame, line: str = "value", batch: str = "batch") -> DataFrame:
    """Split each ``name: score`` line at its first colon; lines without a
    colon or with a non-numeric score are dropped (``try_cast`` -> null)."""
    pos = F.instr(F.col(line), ":")
    return (lines.where(pos > 0)
            .select(F.col(batch).alias("batch"),
                    F.trim(F.substr(F.col(line), F.lit(1), pos - 1)).alias("metric"),
                    F.trim(F.substr(F.col(line), pos + 1)).try_cast("double").alias("score"))
            .where(F.col("score").isNotNull()))


def report_to_wide(parsed: DataFrame, metrics: list[str]) -> DataFrame:
    """One row per batch, one column per metric (explicit list)."""
    return parsed.groupBy("batch").pivot("metric", metrics).agg(F.max("score"))


def read_report_files(spark, path: str) -> DataFrame:
    """Report text files -> (batch = file stem, value = line)."""
    return (spark.read.text(path)
            .withColumn("batch", F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1)))
