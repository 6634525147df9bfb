"""Question batches and article tables.

Question files are ``{"questions": [...]}`` documents, one per batch. They are
read with an explicit schema (multiLine JSON), flattened with ``inline`` and
labelled with their batch from the file name -- one scan for all batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qalake.schemas import ARTICLE, QUESTION_FILE


def batch_from_file(col: Column | str = "_metadata.file_name") -> Column:
    """``10B1_golden.json`` -> ``10B1_golden``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_extract(c, r"^(.*)\.json$", 1)


def batch_number(batch: Column) -> Column:
    """S2 variant: the digit at 0-based position 3 (``10B1_golden`` -> 1)."""
    return F.substring(batch, 4, 1).try_cast("int")


def normalise_answers(raw: Column) -> Column:
    """Ragged answers -> ``array<array<string>>``.

    ``raw`` is JSON/Python-literal text of a list whose elements are either
    lists of synonyms or plain strings (single quotes accepted). Elements that
    are themselves lists are parsed again; strings become one-element lists.
    Malformed text gives null (count it with ``malformed_count``)."""
    outer = F.from_json(raw, "array<string>", {"allowSingleQuotes": "true"})
    return F.transform(outer, lambda e: F.when(
        F.ltrim(e).startswith("["),
        F.from_json(e, "array<string>", {"allowSingleQuotes": "true"})).otherwise(F.array(e)))


def load_questions(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Every question of every batch file under ``path`` in one scan.

    ``lines=True`` reads the JSON-lines layout written by ``write_question_files``
    (batch from the ``batch=`` directory)."""
    if lines:
        q_schema = QUESTION_FILE["questions"].dataType.elementType
        raw = (spark.read.schema(q_schema).json(path)
               .select(F.regexp_extract(F.col("_metadata.file_path"), "batch=([^/]+)", 1).alias("batch"),
                       F.struct(*[F.col(f.name) for f in q_schema.fields]).alias("q")))
    else:
        raw = (spark.read.schema(QUESTION_FILE).option("multiLine", True).json(path)
               .select(batch_from_file().alias("batch"), F.explode_outer("questions").alias("q"))
               .where(F.col("q").isNotNull()))
    return raw.select(
        "batch", "q.id", "q.body", "q.type", F.coalesce("q.documents", F.array().cast("array<string>")).alias("documents"),
        F.coalesce("q.snippets", F.array().cast(QUESTION_FILE["questions"].dataType.elementType["snippets"].dataType))
        .alias("snippets"),
        normalise_answers(F.col("q.exact_answer")).alias("exact_answer"),
        F.col("q.exact_answer").alias("exact_answer_raw"))


def load_articles(spark: SparkSession, path: str) -> DataFrame:
    """S3: the document table (Parquet; pickle is not read on purpose)."""
    return spark.read.schema(ARTICLE).parquet(path)


def append_new_articles(spark: SparkSession, incoming: DataFrame, table_path: str,
                        key: str = "pmid") -> DataFrame:
    """Resumable ingest -- keep only keys not stored yet, the first row
    of each, and append them in one write (instead of rewriting the table after
    every row)."""
    new = first_rows(incoming, key)
    if path_exists(spark, table_path):
        stored = spark.read.schema(incoming.schema).parquet(table_path).select(key)
        new = new.join(stored, key, "left_anti")
    new = new.select(*incoming.columns)
    new.write.mode("append").parquet(table_path)
    return new


def first_rows(df: DataFrame, key: str) -> DataFrame:
    """The first row of each key in the order the rows come; rows without a key go."""
    rows = df.where(F.col(key).isNotNull()).withColumn("_order", F.monotonically_increasing_id())
    return (rows.groupBy(key).agg(F.min_by(F.struct(*df.columns), "_order").alias("_first"))
            .select("_first.*"))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a table path is there, asked of its own file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def snippets_long(questions: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, pos, text) of the gold snippets."""
    return questions.select(id_col, F.posexplode("snippets").alias("pos", "s")).select(
        id_col, "pos", F.col("s.text").alias("text"))


def answers_long(questions: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, grp, syn_pos, synonym) from normalised exact answers; empty ones skipped."""
    g = questions.select(id_col, F.posexplode("exact_answer").alias("grp", "syns"))
    return (g.select(id_col, "grp", F.posexplode("syns").alias("syn_pos", "synonym"))
            .where(F.col("synonym").isNotNull() & (F.trim("synonym") != "")))
