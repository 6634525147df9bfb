"""Sinks (S8-S11). One write per job; arrays serialised with ``to_json``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _jsonify_arrays(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            cols.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite",
              partition_by: list[str] | None = None) -> None:
    """Header CSV; nested columns become JSON text."""
    w = _jsonify_arrays(df).write.mode(mode).option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def write_question_files(questions: DataFrame, path: str, batch: str = "batch") -> None:
    """Question files, one directory per batch, one JSON question per line.

    The reference wraps a batch in a single ``{"questions": [...]}`` object;
    building that object needs the whole batch in one task, so the library
    writes the same questions as JSON lines instead (``load_questions`` reads
    both layouts)."""
    questions.write.mode("overwrite").partitionBy(batch).json(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """SQuAD rows as JSON lines (one row per question/paragraph, never
    one giant array that would need a single task)."""
    df.write.mode(mode).json(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """Parquet table in a shared folder (also used to cut lineage)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
