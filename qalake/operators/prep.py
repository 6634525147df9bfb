"""Dataset preparation.

The canonical form of a question's document list is the long table
``(id, pos, pmid)``; arrays are only rebuilt at sinks, and then with
``array_sort`` on the position so that order and repeats survive (P7).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qalake.functions.ids import id_from_url_last


def require_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Fail before planning when required columns are missing."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def filter_type(df: DataFrame, qtype: str, col: str = "type") -> DataFrame:
    """Keep one question type."""
    return df.where(F.col(col) == qtype)


def links_long(questions: DataFrame, id_col: str = "id", links: str = "documents",
               extractor=id_from_url_last) -> DataFrame:
    """P2/P3 + R3: (id, pos, pmid) from an array of links, order and repeats kept."""
    return questions.select(id_col, F.posexplode(links).alias("pos", "link")).select(
        id_col, "pos", extractor(F.col("link")).alias("pmid"))


def semi_corpus(docs: DataFrame, refs: DataFrame, key: str = "pmid") -> DataFrame:
    """Corpus rows referenced by any question."""
    return docs.join(refs.select(key).distinct(), key, "left_semi")


def anti_stored(incoming: DataFrame, stored: DataFrame, key: str = "pmid") -> DataFrame:
    """Incoming keys not yet stored."""
    return incoming.join(stored.select(key), key, "left_anti")


def found_in_corpus(long_links: DataFrame, corpus: DataFrame, key: str = "pmid") -> DataFrame:
    """P7 (long form): links whose key exists in the corpus; order and repeats kept."""
    return long_links.join(corpus.select(key), key, "left_semi")


def found_arrays(found_long: DataFrame, id_col: str = "id", pos: str = "pos",
                 key: str = "pmid") -> DataFrame:
    """P7 sink form + P8: ``pmids_found`` arrays in original order; questions
    without any found document disappear (inner semantics)."""
    return (found_long.groupBy(id_col)
            .agg(F.array_sort(F.collect_list(F.struct(pos, key))).alias("_s"))
            .select(id_col, F.transform("_s", lambda x: x[key]).alias("pmids_found")))


def docs_per_query(questions: DataFrame, links: DataFrame, id_col: str) -> DataFrame:
    """A3: links per question, over every question (zero-link ones included)."""
    per = links.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_links"))
    q = questions.select(id_col).join(per, id_col, "left")
    return q.agg(F.count(F.lit(1)).alias("n_questions"),
                 F.coalesce(F.sum("n_links"), F.lit(0)).cast("long").alias("n_links"),
                 F.try_divide(F.coalesce(F.sum("n_links"), F.lit(0)).cast("double"),
                              F.count(F.lit(1)).cast("double")).alias("docs_per_query"))


def distinct_docs(links: DataFrame, key: str) -> DataFrame:
    """A1: number of distinct documents over all questions."""
    return links.agg(F.count(F.lit(1)).alias("n_links"),
                     F.countDistinct(key).alias("n_distinct_docs"))


def profile(df: DataFrame, dataset: str, qtype: str, types: list[str]) -> DataFrame:
    """A4 + R2: one row per dataset, question count and one column per type
    (explicit value list, so the pivot needs no extra distinct job)."""
    counts = df.groupBy(dataset).pivot(qtype, types).agg(F.count(F.lit(1)))
    totals = df.groupBy(dataset).agg(F.count(F.lit(1)).alias("n_queries"))
    out = totals.join(counts, dataset)
    for t in types:
        out = out.withColumn(t, F.coalesce(F.col(t), F.lit(0)).cast("long"))
    return out


def profile_documents(questions: DataFrame, links: DataFrame, dataset: str, qtype: str, types: list[str],
                      key: str) -> DataFrame:
    """A4 whole: one row per dataset with its questions, its distinct documents
    and its questions by type. Questions and links are each read once: the
    types are conditional counts, and documents are made distinct before they
    are counted. Datasets of either side stay, missing counts are 0; null keys
    are no documents."""
    q = questions.groupBy(dataset).agg(F.count(F.lit(1)).alias("n_queries"),
                                       *(F.count_if(F.col(qtype) == t).alias(t) for t in types))
    d = links.select(dataset, key).distinct().groupBy(dataset).agg(F.count(key).alias("n_docs"))
    d = d.withColumnRenamed(dataset, "__dataset")
    both = q.join(d, q[dataset].eqNullSafe(d["__dataset"]), "full")
    return both.select(F.coalesce(dataset, "__dataset").alias(dataset),
                       *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ["n_queries", "n_docs", *types]))


def backfill(base: DataFrame, updates: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Left join on the key, ``coalesce(new, old)`` per updated column."""
    u = updates.select(key, *[F.col(c).alias(f"_new_{c}") for c in cols])
    out = base.join(u, key, "left")
    for c in cols:
        old = F.col(c) if c in base.columns else F.lit(None)
        out = out.withColumn(c, F.coalesce(F.col(f"_new_{c}"), old)).drop(f"_new_{c}")
    return out


def union_aligned(*dfs: DataFrame) -> DataFrame:
    """Union all by name, missing columns become null."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def prepare(questions: DataFrame, docs: DataFrame, id_col: str = "id", links: str = "documents",
            key: str = "pmid", extractor=id_from_url_last,
            links_long_df: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Load -> ids from links -> documents referenced -> keep links found
    in the corpus -> keep questions with at least one -> counts.

    Returns ``(found_long, profile)``: the answerable questions' links in long
    form ``(id, pos, pmid)`` and a one-row profile (questions, distinct
    documents referenced, documents found, answerable questions, documents
    per answerable question). Every step is a join or aggregate; the ratio is
    ``try_divide`` (null when nothing survives, Q19)."""
    if links_long_df is not None:   # already long: (id, pos, link)
        ll = links_long_df.select(id_col, "pos", extractor(F.col("link")).alias(key))
    else:
        ll = links_long(questions, id_col, links, extractor)
    found = found_in_corpus(ll, docs, key)
    # One pass over the links: flag the ones found, aggregate once.
    flag = docs.select(key).distinct().withColumn("_f", F.lit(True))
    fl = ll.join(flag, key, "left")
    prof = fl.agg(
        F.countDistinct(key).alias("n_distinct_docs"),
        F.countDistinct(F.when(F.col("_f"), F.col(key))).alias("n_docs_found"),
        F.countDistinct(F.when(F.col("_f"), F.col(id_col))).alias("n_answerable"),
        F.count(F.when(F.col("_f"), 1)).alias("n_found_links"))
    prof = prof.select(questions.agg(F.count(F.lit(1))).scalar().alias("n_questions"), "*")
    prof = prof.withColumn("docs_per_query", F.try_divide(F.col("n_found_links").cast("double"),
                                                          F.col("n_answerable").cast("double")))
    return found, prof
