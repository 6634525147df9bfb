"""Vocabulary, term statistics and bags of words (A16, T2, T3, F4 job).

Long-table form throughout: ``(doc_id, term, tf)``. Term statistics are two
partially aggregated ``groupBy``s, so a term present in every document is
combined map-side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def term_counts(toks: DataFrame, doc_id: str = "doc_id", col: str = "toks") -> DataFrame:
    """(doc_id, term, tf) from a token-array column."""
    # explode_outer: plain explode makes Catalyst infer ``size(toks) > 0`` and
    # evaluate the whole tokenizer twice per row.
    return (toks.select(doc_id, F.explode_outer(col).alias("term"))
            .where(F.col("term").isNotNull())
            .groupBy(doc_id, "term").agg(F.count(F.lit(1)).alias("tf")))


def term_stats(toks: DataFrame, doc_id: str = "doc_id", col: str = "toks") -> DataFrame:
    """df = documents holding the term, cf = total occurrences."""
    return (term_counts(toks, doc_id, col).groupBy("term")
            .agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")))


def vocabulary(train_toks: DataFrame, doc_id: str = "doc_id", col: str = "toks",
               min_df: int = 1, max_terms: int | None = None) -> DataFrame:
    """Vocabulary of the training corpus as ``(term, df, cf)``.

    ``max_terms`` keeps the most frequent terms (cf desc, term asc) -- needed
    only when the vocabulary feeds a model whose size grows with it (LDA).
    """
    if min_df <= 1 and max_terms is None:
        return (train_toks.select(F.explode_outer(col).alias("term"))
                .where(F.col("term").isNotNull()).distinct())
    v = term_stats(train_toks, doc_id, col).where(F.col("df") >= min_df)
    if max_terms is not None:
        v = v.orderBy(F.desc("cf"), F.asc("term")).limit(max_terms)
    return v


def bag_of_words(toks: DataFrame, vocab: DataFrame, doc_id: str = "doc_id",
                 col: str = "toks") -> DataFrame:
    """``(doc_id, term, tf)`` with out-of-vocabulary terms dropped."""
    return term_counts(toks, doc_id, col).join(vocab.select("term"), "term", "left_semi") \
        .select(doc_id, "term", "tf")


def stem_terms(toks: DataFrame, doc_id: str = "doc_id", col: str = "toks") -> DataFrame:
    """F4 as a vocabulary job: stem each *distinct* term once (pandas UDF),
    then map every token through an equi join on the term. Returns
    ``(doc_id, pos, term, stem)``."""
    from qalake.functions.stem import porter_stem_udf
    long = (toks.select(doc_id, F.posexplode_outer(col).alias("pos", "term"))
            .where(F.col("term").isNotNull()))
    stems = long.select("term").distinct().withColumn("stem", porter_stem_udf(F.col("term")))
    return long.join(stems, "term").select(doc_id, "pos", "term", "stem")
