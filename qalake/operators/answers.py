"""Automatic judging of predicted answers (M5, M6, W5, X1) and span helpers.

Predictions and gold answers are long tables:

* predictions ``(qid, rank, answer)`` -- rank is 1-based;
* gold ``(qid, grp, synonym)`` -- one row per synonym of each gold group.

Matching is an equi join on the normalised text, scoped by the question key,
so no prediction is ever compared with another question's answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def norm_answer(c: Column) -> Column:
    """M5/M6 normalisation: trim + lower."""
    return F.lower(F.trim(c))


def _questions(preds: DataFrame, gold: DataFrame, qid: str, questions: DataFrame | None) -> DataFrame:
    """Every question once: the given ones, else all with a gold answer or a prediction."""
    if questions is not None:
        return questions.select(qid).distinct()
    return gold.select(qid).unionByName(preds.select(qid)).distinct()


def answer_positions(preds: DataFrame, gold: DataFrame, qid: str = "qid",
                     questions: DataFrame | None = None) -> DataFrame:
    """M5: 1-based rank of the first prediction equal to any synonym of any
    gold group; 0 when none matches. One row per question, answered or not
    (``questions``, else all that ``gold`` or ``preds`` name)."""
    p = preds.select(qid, "rank", norm_answer(F.col("answer")).alias("n"))
    g = (gold.select(qid, norm_answer(F.col("synonym")).alias("n")).distinct()
         .withColumn("_hit", F.lit(True)))
    # one pass over the predictions: left join, then the best matching rank
    found = (p.join(g, [qid, "n"], "left").groupBy(qid)
             .agg(F.min(F.when(F.col("_hit"), F.col("rank"))).alias("pos")))
    return (_questions(preds, gold, qid, questions).join(found, qid, "left")
            .select(qid, F.coalesce(F.col("pos"), F.lit(0)).cast("int").alias("pos")))


def dedup_predictions(preds: DataFrame, qid: str = "qid") -> DataFrame:
    """W5 in long form: first occurrence of each exact (case-sensitive) answer
    per question, re-ranked 1..n in the original order."""
    from pyspark.sql import Window
    first = preds.groupBy(qid, "answer").agg(F.min("rank").alias("first_rank"))
    w = Window.partitionBy(qid).orderBy("first_rank")
    return first.select(qid, F.row_number().over(w).alias("rank"), "answer")


def list_counts(preds: DataFrame, gold: DataFrame, qid: str = "qid",
                count_repeats_as_fp: bool = False, questions: DataFrame | None = None) -> DataFrame:
    """M6: TP = gold groups hit (a group is hit when any of its synonyms equals
    any prediction -- one prediction may hit several groups), FP = predictions
    equal to no synonym, FN = groups - TP. With ``count_repeats_as_fp`` a
    prediction whose groups were all hit by an earlier prediction also counts
    as a false positive (human-judge behaviour for repeated spellings). One row
    per question, answered or not: without a prediction TP = FP = 0 and FN =
    all groups."""
    p = preds.select(qid, "rank", norm_answer(F.col("answer")).alias("n"))
    g = gold.select(qid, "grp", norm_answer(F.col("synonym")).alias("n")).distinct()
    matched = p.join(g, [qid, "n"], "left").select(qid, "rank", "grp").distinct()
    first = (matched.where(F.col("grp").isNotNull()).groupBy(qid, "grp")
             .agg(F.min("rank").alias("first_rank")))
    per_pred = (matched.join(first, [qid, "grp"], "left")
                .groupBy(qid, "rank")
                .agg(F.max(F.col("grp").isNotNull()).alias("hit"),
                     F.max(F.coalesce(F.col("rank") == F.col("first_rank"), F.lit(False))).alias("new")))
    fp_flag = ~F.col("hit")
    if count_repeats_as_fp:
        fp_flag = fp_flag | ~F.col("new")
    fp = per_pred.groupBy(qid).agg(F.count(F.when(fp_flag, 1)).alias("fp"))
    tp = matched.groupBy(qid).agg(F.countDistinct("grp").alias("tp"))
    groups = g.groupBy(qid).agg(F.countDistinct("grp").alias("n_groups"))
    n_tp, n_fp, n_groups = (F.coalesce(F.col(c), F.lit(0)) for c in ("tp", "fp", "n_groups"))
    return (_questions(preds, gold, qid, questions).join(tp, qid, "left").join(fp, qid, "left")
            .join(groups, qid, "left")
            .select(qid, n_tp.cast("long").alias("tp"), n_fp.cast("long").alias("fp"),
                    (n_groups - n_tp).cast("long").alias("fn")))


def locate_answer(context: Column, answer: Column) -> Column:
    """X1 exact step: 0-based case-insensitive position of ``answer`` in
    ``context`` (-1 when absent)."""
    return F.instr(F.lower(context), F.lower(answer)) - 1


def locate_with_synonyms(cands: DataFrame, key: list[str]) -> DataFrame:
    """Per key, the first candidate (priority, then synonym order) that
    occurs in the context. ``cands`` has ``key + [context, word, prio]``;
    the original answer has prio 0, synonyms 1.. in their order. Returns
    ``key + [start, matched]`` with ``start = -1`` and the original word when
    nothing occurs."""
    located = cands.withColumn("start", locate_answer(F.col("context"), F.col("word")))
    found = (located.where(F.col("start") >= 0).groupBy(*key)
             .agg(F.min(F.struct("prio", "start", "word")).alias("m"))
             .select(*key, F.col("m.start").alias("start"), F.col("m.word").alias("matched")))
    orig = (cands.where(F.col("prio") == 0).select(*key, F.col("word").alias("orig")))
    return (orig.join(found, key, "left")
            .select(*key, F.coalesce("start", F.lit(-1)).alias("start"),
                    F.coalesce("matched", "orig").alias("matched")))
