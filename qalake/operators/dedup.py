"""Duplicate handling.

Groups of copies are keyed by a SHA-256 of the text, never by the text
itself, and are counted with partially aggregated ``groupBy`` -- a group that
holds a third of all rows is combined map-side instead of landing in one
window partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL_KEY = "<null>"


def text_key(col: Column | str) -> Column:
    """Group key for exact-copy detection; nulls form one group (pandas
    ``duplicated`` semantics)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.isNull(), F.lit(NULL_KEY)).otherwise(F.sha2(c, 256))


def flag_duplicates(df: DataFrame, col: str, out: str = "n_copies") -> DataFrame:
    """Every member of a duplicate group with its group size (``keep=False``)."""
    keyed = df.withColumn("_k", text_key(col))
    sizes = (keyed.groupBy("_k").agg(F.count(F.lit(1)).alias(out))
             .where(F.col(out) > 1))
    # Large side keeps its partitioning; AQE's skew-join split handles a hot key.
    return keyed.join(sizes, "_k").drop("_k")


def first_per_key(df: DataFrame, key: Column | str, order: str) -> DataFrame:
    """Keep the first row per key by an explicit ingest order.

    ``min(struct(order, row))`` is a partial aggregate: each map task keeps one
    row per key before the shuffle, so hot keys are cheap.
    """
    k = F.col(key) if isinstance(key, str) else key
    cols = [c for c in df.columns]
    best = (df.withColumn("_k", k)
            .groupBy("_k")
            .agg(F.min(F.struct(F.col(order).alias("_o"), *[F.col(c) for c in cols])).alias("_r")))
    return best.select(*[F.col(f"_r.{c}").alias(c) for c in cols])


def ordered_distinct(items: Column) -> Column:
    """Order-preserving, case-sensitive distinct of an array."""
    return F.array_distinct(items)


def duplicate_report(df: DataFrame, batch: str, body: str) -> DataFrame:
    """(batch, body hash) groups seen more than once."""
    return (df.groupBy(F.col(batch).alias("batch"), F.md5(F.col(body)).alias("body_md5"))
            .agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 1))
