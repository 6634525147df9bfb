"""One answer text per question from the logits of all its windows.

A feature is one window of a question: ``start_logits``, ``end_logits`` and
``offsets`` (array of struct<s, e>: the characters of the context each token
covers, null where it is no context). The merge has two levels. In a window,
``n_best`` starts and ends are paired within its row, by array functions: no
shuffle, at most ``n_best`` squared pairs. Of each window only its best spans
travel, and a partially aggregated maximum (or a rank with a group limit) picks
among the windows of a question. The context is read once per question, for the
one slice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qalake.operators.squad import MAX_ANSWER_LEN, N_BEST

_SPAN = "struct<score:double,window:bigint,start:bigint,stop:bigint,s:int,e:int>"


@dataclass(frozen=True)
class AnswerParams:
    n_best: int = N_BEST
    longest: int = MAX_ANSWER_LEN   # tokens of an answer
    null_at: int = 0                # token whose logits score "no answer"


def _largest(logits: Column, n: int) -> Column:
    """The ``n`` largest entries as struct<neg, idx>, descending, ties by the lower index."""
    keyed = F.transform(logits, lambda x, i: F.struct((-x.cast("double")).alias("neg"), i.alias("idx")))
    return F.slice(F.array_sort(F.filter(keyed, lambda x: x["neg"].isNotNull() & ~F.isnan(x["neg"]))), 1, n)


def window_spans(features: DataFrame, window: str = "window", keep: int = 1, p: AnswerParams = AnswerParams()) -> Column:
    """The ``keep`` best spans of each window, best first: pairs of the
    ``n_best`` starts and ends whose tokens both lie in the context, in order
    and within ``longest`` tokens. Ties: lower start, then lower stop."""
    off = F.col("offsets")

    def valid(x: Column) -> Column:
        return F.get(off, x["idx"]).isNotNull()
    starts = F.filter(_largest(F.col("start_logits"), p.n_best), valid)
    ends = F.filter(_largest(F.col("end_logits"), p.n_best), valid)
    pairs = F.flatten(F.transform(starts, lambda a: F.transform(
        F.filter(ends, lambda b: (b["idx"] >= a["idx"]) & (b["idx"] - a["idx"] < p.longest)),
        lambda b: F.struct((a["neg"] + b["neg"]).alias("neg"), a["idx"].alias("start"), b["idx"].alias("stop")))))
    return F.transform(F.slice(F.array_sort(pairs), 1, keep), lambda x: F.struct(
        (-x["neg"]).alias("score"), F.col(window).cast("bigint").alias("window"), x["start"].cast("bigint").alias("start"),
        x["stop"].cast("bigint").alias("stop"), F.get(off, x["start"])["s"].alias("s"), F.get(off, x["stop"])["e"].alias("e"))).cast(f"array<{_SPAN}>")


def _null(p: AnswerParams) -> Column:
    return (F.get("start_logits", F.lit(p.null_at)) + F.get("end_logits", F.lit(p.null_at))).cast("double")


def _text(context: str) -> Column:
    return F.substring(F.col(context), F.col("start_char") + 1, F.col("end_char") - F.col("start_char"))


def best_answers(features: DataFrame, contexts: DataFrame, question: str = "question_id", window: str = "window",
                 context: str = "context", p: AnswerParams = AnswerParams()) -> DataFrame:
    """One row per question of ``contexts`` (question, context): text,
    start_char, end_char, score, null_score and answerable (best score above
    the least null score of its windows).

    A question without a window or without a valid span has text ``""``, score
    0.0 and null places. Ties between windows go to the lower window. A null
    context gives ``""``."""
    b = F.get(window_spans(features, window, 1, p), 0)
    order = F.struct(F.col("b.score"), (-F.col("b.window")).alias("w"), (-F.col("b.start")).alias("i"), (-F.col("b.stop")).alias("j"))
    best = (features.select(question, b.alias("b"), _null(p).alias("null"))
            .groupBy(question).agg(F.max_by("b", F.when(F.col("b").isNotNull(), order)).alias("b"), F.min("null").alias("null_score")))
    rows = contexts.select(question, context).join(best, question, "left").select(
        question, context, F.col("b.s").alias("start_char"), F.col("b.e").alias("end_char"),
        F.coalesce("b.score", F.lit(0.0)).alias("score"), "null_score", F.col("b").isNotNull().alias("found"))
    return rows.select(question, F.coalesce(F.when(F.col("found"), _text(context)), F.lit("")).alias("text"), "start_char", "end_char",
                       "score", "null_score", (F.col("found") & F.coalesce(F.col("score") > F.col("null_score"), F.lit(False))).alias("answerable"))


def n_best_answers(features: DataFrame, contexts: DataFrame, n: int, question: str = "question_id", window: str = "window",
                   context: str = "context", p: AnswerParams = AnswerParams()) -> DataFrame:
    """The first ``n`` spans of each question over all its windows: rank,
    text, start_char, end_char, score. A span that two overlapping windows
    share counts once, with its best score."""
    spans = features.select(question, F.explode(window_spans(features, window, p.n_best * p.n_best, p)).alias("b"))
    # the same characters from several windows: partially aggregated before the rank
    spans = spans.groupBy(question, F.col("b.s").alias("start_char"), F.col("b.e").alias("end_char")).agg(F.max("b.score").alias("score"))
    order = Window.partitionBy(question).orderBy(F.desc("score"), "start_char", "end_char")
    top = spans.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return top.join(contexts.select(question, context), question).select(
        question, "rank", F.coalesce(_text(context), F.lit("")).alias("text"), "start_char", "end_char", "score")
