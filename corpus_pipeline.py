"""Corpus pipeline: five operators of ``qalake.llm`` over ``documents``.

``STAGES`` is a list of (name, function); each function takes (spark, docs,
sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next one's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qalake.llm import decontam, jaccard, langid, packing, secrets
from qalake.llm.store import written
from qalake.sources.tables import read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A prediction less certain than this is rejected.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID (7), learned from the labelled documents; documents without
    a letter or without a clear language (``LEAST_SCORE``) go, and so do many
    texts of one word, whose few n-grams seldom make a language clear. Where
    nothing can be learned (no label on a text with a letter), every document
    with a letter stays."""
    docs = docs.select(*COLUMNS)
    model = langid.fit(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    judged = langid.predict(docs, model, keep=COLUMNS)
    return judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (3); of each group the row of the smallest id stays
    (null ids last), whatever rows share an id."""
    return jaccard.keep_first_rows(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination (2); rows with a hit go. The verdict depends on
    the text alone, so rows are judged by the 64-bit hash of their text: ids may be null or repeated."""
    docs = docs.select(*COLUMNS).withColumn("__text", F.xxhash64("text"))
    judged = decontam.contamination(docs, read_table(spark, sf_dir, "benchmark"), id_col="__text")
    bad = judged.where("contaminated").select(F.col("doc_id").alias("__text")).distinct()
    return docs.join(bad, "__text", "left_anti").select(*COLUMNS)


def scrub_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans (5); found spans are replaced by a mark."""
    return secrets.redact(docs.select(*COLUMNS)) \
        .withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))) \
        .select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing (1): the pieces of all sequences."""
    return packing.pack(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate),
          ("scrub_secrets", scrub_secrets), ("pack", pack)]

#: Learned and tokenised stages: SQL cannot express them; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
