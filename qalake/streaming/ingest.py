"""Incremental article ingest as a Structured Streaming job (S5, optional).

New article files dropped into a landing folder are read as a file stream,
de-duplicated on the key within each micro-batch and against the stored
table (anti join inside ``foreachBatch``), and appended to the Parquet
table. ``trigger(availableNow=True)`` processes whatever has landed and
stops; the checkpoint (in the cluster's shared checkpoint folder) makes the
job exactly-once across restarts and executor loss.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qalake.session import ensure_checkpoint_dir
from qalake.sources.questions import first_rows, path_exists


def _append_new(table_path: str, key: str, schema: T.StructType):
    def fn(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = first_rows(batch, key)
        if path_exists(spark, table_path):
            stored = spark.read.schema(schema).parquet(table_path).select(key)
            fresh = fresh.join(stored, key, "left_anti")
        fresh.select(*batch.columns).write.mode("append").parquet(table_path)
    return fn


def ingest_stream(spark: SparkSession, landing: str, table_path: str, schema: T.StructType,
                  key: str = "pmid", fmt: str = "json", name: str | None = None):
    """Start (and, with availableNow, finish) the ingest; returns the query.

    Progress is kept under ``name``; by default it follows from the landing
    folder and the table, so two ingests never share it."""
    name = name or "ingest-" + hashlib.sha256(f"{landing}\n{table_path}".encode()).hexdigest()[:24]
    ckpt = os.path.join(ensure_checkpoint_dir(spark), "streams", name)
    stream = spark.readStream.schema(schema).format(fmt).load(landing)
    stream = stream.where(F.col(key).isNotNull())
    return (stream.writeStream.foreachBatch(_append_new(table_path, key, schema))
            .option("checkpointLocation", ckpt)
            .trigger(availableNow=True)
            .start())
