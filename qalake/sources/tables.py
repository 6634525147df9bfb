"""Parquet scans of the driver tables, always with an explicit schema."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from qalake.schemas import DRIVER_TABLES


# Tables whose rows carry long texts: per-row work on them is CPU-heavy.
TEXT_TABLES = {"documents", "pages", "conversations", "benchmark"}


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Spread a scan that yields fewer splits than the cluster has cores.

    A Parquet file with one large row group is read by a single task; before
    CPU-heavy per-row work (tokenising, regexes, hashing) one round-robin
    ``repartition`` lets every core work. On a large table the scan already
    has more splits than cores and nothing is added (plan-time check only)."""
    n = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < n:
        return df.repartition(n)
    return df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one driver table; Catalyst prunes columns and pushes filters."""
    schema = DRIVER_TABLES.get(name)
    path = os.path.join(sf_dir, f"{name}.parquet")
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.parquet(path)
    return spread(df) if name in TEXT_TABLES else df


class Tables:
    """Lazy accessor: ``Tables(spark, sf).documents`` etc."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return read_table(self.spark, self.sf_dir, name)
