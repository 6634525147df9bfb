"""System comparison and leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.DoubleType, T.FloatType, T.IntegerType, T.LongType, T.ShortType, T.DecimalType)


def metric_columns(df: DataFrame, keys: list[str]) -> list[str]:
    """Metric columns picked by type and name, never by position (Q13)."""
    return [f.name for f in df.schema.fields
            if f.name not in keys and isinstance(f.dataType, NUMERIC)]


def to_long(df: DataFrame, keys: list[str], metrics: list[str] | None = None,
            var: str = "metric", val: str = "value") -> DataFrame:
    """Wide -> long (``melt``), values as double."""
    metrics = metrics or metric_columns(df, keys)
    wide = df.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics])
    return wide.unpivot(keys, metrics, var, val)


def to_wide(long: DataFrame, keys: list[str], var: str, val: str, values: list[str]) -> DataFrame:
    """R2: long -> wide with an explicit value list (no extra distinct job)."""
    return long.groupBy(*keys).pivot(var, values).agg(F.first(val))


def means_by(df: DataFrame, keys: list[str], metrics: list[str], digits: int | None = 6) -> DataFrame:
    """Mean of each metric per key."""
    def rnd(c: Column) -> Column:
        return F.round(c, digits) if digits is not None else c
    return df.groupBy(*keys).agg(*[rnd(F.avg(m)).alias(m) for m in metrics])


def top_k_per_group(df: DataFrame, group: list[str], metric: str, k: int,
                    tiebreak: list[str]) -> DataFrame:
    """K largest rows per group, ties broken by explicit keys.
    ``row_number <= k`` becomes a ``WindowGroupLimit`` before the shuffle."""
    w = Window.partitionBy(*group).orderBy(F.desc(metric), *[F.asc(c) for c in tiebreak])
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_n_keys(df: DataFrame, key: str, metric: str, n: int) -> DataFrame:
    """The n keys with the highest mean metric (ties: key asc)."""
    return (df.groupBy(key).agg(F.avg(metric).alias("_m"))
            .orderBy(F.desc("_m"), F.asc(key)).limit(n).select(key))


def keep_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Semi join to a computed key set; the set is a top-n result, so its
    size is bounded by n and broadcasting it is safe."""
    return df.join(F.broadcast(keys), key, "left_semi")


def top_rows(df: DataFrame, metric: str, n: int, tiebreak: list[str]) -> DataFrame:
    """The n best rows overall (``TakeOrderedAndProject``)."""
    return df.orderBy(F.desc(metric), *[F.asc(c) for c in tiebreak]).limit(n)


def not_equal_null_safe(col: str, value) -> Column:
    """Pandas ``!=`` keeps nulls; Spark ``!=`` would drop them."""
    return ~F.col(col).eqNullSafe(F.lit(value))


def best_by(df: DataFrame, group: list[str], score: str, order_key: str,
            payload: list[str]) -> DataFrame:
    """Best row per group by score (ties: lowest ``order_key``) as a
    partial aggregate -- ``max(struct(score, -key, payload))``."""
    s = F.struct(F.col(score).alias("_s"), (-F.col(order_key)).alias("_k"),
                 *[F.col(c).alias(c) for c in payload])
    return (df.groupBy(*group).agg(F.max(s).alias("_b"))
            .select(*group, (-F.col("_b._k")).alias(order_key), F.col("_b._s").alias(score),
                    *[F.col(f"_b.{c}").alias(c) for c in payload]))
