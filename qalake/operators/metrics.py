"""Set, rank and answer metrics (M1-M7) and their aggregates.

Everything is a Catalyst expression or a grouped aggregate: per-question
metrics are computed from counts (never from materialised gold sets), so a
question whose gold set holds a third of the corpus costs no more than any
other.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 6


def _z(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def safe_div(a: Column, b: Column, zero: bool = True) -> Column:
    """a/b with ANSI on: 0-denominator -> 0 (``zero=True``) or null."""
    q = F.try_divide(a.cast("double"), b.cast("double"))
    return _z(q) if zero else q


# ---- M1 / M2 ---------------------------------------------------------------
def set_precision(hits: Column, n_pred: Column) -> Column:
    return safe_div(hits, n_pred)


def set_recall(hits: Column, n_gold: Column) -> Column:
    return safe_div(hits, n_gold)


def f1(p: Column, r: Column, zero: bool = True) -> Column:
    """Harmonic mean with a zero guard."""
    return safe_div(F.lit(2.0) * p * r, p + r, zero=zero)


def set_ap(hits: Column, n_pred: Column, n_gold: Column) -> Column:
    """M2: average precision over 0/1 scores on T u P, in closed form.

    r*p + (1-r)*|T|/|T u P|; 1 when P is empty and T is not, 0 when T is empty.
    """
    p = set_precision(hits, n_pred)
    r = set_recall(hits, n_gold)
    union = n_gold + n_pred - hits
    return r * p + (F.lit(1.0) - r) * safe_div(n_gold, union)


def set_metrics_arrays(gold: Column, pred: Column) -> dict[str, Column]:
    """U4 + M1/M2 on per-row arrays (reference data: small gold/predicted
    lists): distinct sets, ``array_intersect``/``array_union`` sizes."""
    t, p = F.array_distinct(gold), F.array_distinct(pred)
    hits = F.size(F.array_intersect(t, p))
    prec = set_precision(hits, F.size(p))
    rec = set_recall(hits, F.size(t))
    return {"precision": prec, "recall": rec, "f1": f1(prec, rec),
            "ap": set_ap(hits, F.size(p), F.size(t)),
            "n_union": F.size(F.array_union(t, p))}


def binarize_labels(df: DataFrame, key: str, gold: str, pred: str) -> DataFrame:
    """Multi-label binarisation of gold u predicted, long form
    ``(key, label, y_true, y_pred)``."""
    u = df.select(key, gold, pred, F.explode(F.array_union(F.array_distinct(gold),
                                                            F.array_distinct(pred))).alias("label"))
    return u.select(key, "label", F.array_contains(gold, F.col("label")).cast("int").alias("y_true"),
                    F.array_contains(pred, F.col("label")).cast("int").alias("y_pred"))


# ---- per question retrieval metrics ----------------------------------------
def judge_ranked(ranked: DataFrame, gold_pairs: DataFrame, q_id: str = "q_id",
                 d_id: str = "doc_id") -> DataFrame:
    """Mark each ranked row as a hit and attach |T| per question.

    ``gold_pairs`` is the explicit (q_id, doc_id) relevance relation.
    """
    g = gold_pairs.select(F.col(q_id).alias("q_id"), F.col(d_id).alias("doc_id")).distinct()
    n_rel = g.groupBy("q_id").agg(F.count(F.lit(1)).alias("n_rel"))
    hits = g.withColumn("hit", F.lit(True))
    return (ranked.join(hits, ["q_id", "doc_id"], "left")
            .withColumn("hit", F.coalesce("hit", F.lit(False)))
            .join(n_rel, "q_id", "left")
            .withColumn("n_rel", F.coalesce("n_rel", F.lit(0)).cast("long")))


def per_question(judged: DataFrame, keys: list[str] | None = None, cutoff: int = 10,
                 ap_denominator: str = "retrieved", ap_epsilon: float = 0.0001) -> DataFrame:
    """Per question: precision, recall, F1 (M1), set AP (M2), rank AP (M3).

    ``judged`` has ``q_id, rank, doc_id, hit, n_rel`` (+ ``keys`` carried along).
    ``ap_denominator`` picks the rank-AP divisor: ``retrieved`` (min(|ret|,
    cutoff), the notebook form), ``relevant`` (|T|) or ``min_relevant``
    (min(|T|, cutoff)).
    """
    keys = keys or []
    w = (Window.partitionBy("q_id").orderBy("rank")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hit_i = F.col("hit").cast("long")
    with_prec = judged.withColumn("cum_hits", F.sum(hit_i).over(w))
    agg = with_prec.groupBy("q_id", *keys).agg(
        F.countDistinct("doc_id").alias("n_ret"),
        F.countDistinct(F.when(F.col("hit"), F.col("doc_id"))).alias("hits"),
        F.max("n_rel").alias("n_rel"),
        F.sum(F.when(F.col("hit"), F.col("cum_hits") / F.col("rank")).otherwise(0.0)).alias("ap_sum"),
    )
    if ap_denominator == "retrieved":
        den = F.least(F.col("n_ret"), F.lit(cutoff))
    elif ap_denominator == "relevant":
        den = F.col("n_rel")
    elif ap_denominator == "min_relevant":
        den = F.least(F.col("n_rel"), F.lit(cutoff))
    else:
        raise ValueError(f"unknown ap_denominator {ap_denominator!r}")
    p = set_precision(F.col("hits"), F.col("n_ret"))
    r = set_recall(F.col("hits"), F.col("n_rel"))
    return (agg.withColumn("precision", p)
            .withColumn("recall", r)
            .withColumn("f1", f1(F.col("precision"), F.col("recall")))
            .withColumn("ap", set_ap(F.col("hits"), F.col("n_ret"), F.col("n_rel")))
            .withColumn("rank_ap", safe_div(F.col("ap_sum"), den) + F.lit(ap_epsilon)))


def gmap(ap: Column, eps: float = 0.0) -> Column:
    """Geometric mean, 0 as soon as any value is <= 0 (ln(0) is null in
    Spark). With ``eps > 0`` (M4 evaluator form) every value is shifted by eps
    instead: exp(mean(ln(ap + eps)))."""
    if eps > 0:
        return F.exp(F.avg(F.ln(ap + F.lit(eps))))
    return F.when(F.min(ap) <= 0, F.lit(0.0)).otherwise(F.exp(F.avg(F.ln(ap))))


def summary_aggs(ap_col: str = "ap", digits: int | None = DIGITS, gmap_eps: float = 0.0) -> list[Column]:
    def rnd(c: Column) -> Column:
        return F.round(c, digits) if digits is not None else c
    return [
        F.count(F.lit(1)).alias("n_questions"),
        rnd(F.avg("precision")).alias("mean_precision"),
        rnd(F.avg("recall")).alias("mean_recall"),
        rnd(F.avg("f1")).alias("mean_f1"),
        rnd(F.avg(ap_col)).alias("MAP"),
        rnd(gmap(F.col(ap_col), gmap_eps)).alias("GMAP"),
    ]


def summarize(per_q: DataFrame, by: list[str] | None = None, ap_col: str = "ap",
              digits: int | None = DIGITS, gmap_eps: float = 0.0) -> DataFrame:
    """Macro means + MAP + GMAP, overall or per group (one job)."""
    aggs = summary_aggs(ap_col, digits, gmap_eps)
    if by:
        return per_q.groupBy(*by).agg(*aggs)
    return per_q.agg(*aggs)


def evaluate(ranked: DataFrame, gold_pairs: DataFrame, by: list[str] | None = None,
             ap_col: str = "ap", cutoff: int = 10) -> DataFrame:
    """Ranked retrieval + gold relation -> metric summary as a DataFrame
    (overall, or per ``by`` keys carried on ``ranked``): n_questions,
    mean_precision, mean_recall, mean_f1, MAP, GMAP. Questions that retrieved
    nothing are absent from ``ranked`` and from the summary."""
    per_q = per_question(judge_ranked(ranked, gold_pairs), keys=by, cutoff=cutoff)
    return summarize(per_q, by=by, ap_col=ap_col)


def summarize_rollup(per_q: DataFrame, by: str, ap_col: str = "ap",
                     digits: int | None = DIGITS) -> DataFrame:
    """Per-batch rows plus the overall row (batch null) in one ``rollup``."""
    return per_q.rollup(by).agg(*summary_aggs(ap_col, digits))


# ---- factoid (A9-A12) ------------------------------------------------------
def factoid_aggs(pos: str = "pos", digits: int | None = DIGITS) -> list[Column]:
    def rnd(c):
        return F.round(c, digits) if digits is not None else c
    p = F.col(pos)
    n = F.count(F.lit(1))
    return [
        n.alias("n"),
        rnd(F.avg((p == 1).cast("double"))).alias("strict"),
        rnd(F.avg((p > 0).cast("double"))).alias("lenient"),
        rnd(F.sum(F.when(p > 0, F.lit(1.0) / p).otherwise(0.0)) / n).alias("mrr"),
    ]


# ---- list (M6, A13) --------------------------------------------------------
def list_prf_columns(tp: str = "tp", fp: str = "fp", fn: str = "fn") -> dict[str, Column]:
    """Per-question list P/R/F; undefined values are null (Q4)."""
    tp_c, fp_c, fn_c = F.col(tp), F.col(fp), F.col(fn)
    p = F.try_divide(tp_c.cast("double"), (tp_c + fp_c).cast("double"))
    r = F.try_divide(tp_c.cast("double"), (tp_c + fn_c).cast("double"))
    f = F.try_divide(F.lit(2.0) * p * r, p + r)
    return {"precision": p, "recall": r, "f_measure": f}


def list_aggs(nan_policy: str = "skip", digits: int | None = DIGITS) -> list[Column]:
    """A13 means; ``skip`` ignores undefined values (published behaviour),
    ``zero`` counts them as 0."""
    def rnd(c):
        return F.round(c, digits) if digits is not None else c

    def m(name):
        c = F.col(name)
        return F.avg(c) if nan_policy == "skip" else F.avg(F.coalesce(c, F.lit(0.0)))
    if nan_policy not in ("skip", "zero"):
        raise ValueError("nan_policy must be 'skip' or 'zero'")
    return [F.count(F.lit(1)).alias("n"),
            rnd(m("precision")).alias("mean_precision"),
            rnd(m("recall")).alias("mean_recall"),
            rnd(m("f_measure")).alias("mean_f_measure")]


# ---- SQuAD EM / F1 (M7, A21) -----------------------------------------------
SQUAD_ARTICLES = ["a", "an", "the"]
ASCII_PUNCT_CLASS = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""
WS_CLASS = "[ \\t\\n\\r\\f\\x0B]"


def squad_tokens(text: Column) -> Column:
    """lower -> strip ASCII punctuation -> drop a/an/the -> whitespace tokens."""
    t = F.regexp_replace(F.lower(text), ASCII_PUNCT_CLASS, "")
    toks = F.split(t, WS_CLASS + "+")
    return F.filter(toks, lambda x: (x != "") & ~x.isin(*SQUAD_ARTICLES))


def squad_scores(pairs: DataFrame, key: list[str], pred: str = "prediction",
                 gold: str = "gold", gold_key: str = "gold_id") -> DataFrame:
    """EM and token F1 of each (prediction, gold) pair, then max over golds.

    Token overlap is a multiset intersection computed by an equi join on the
    token (counts per side, ``least`` of the two), so texts of any length are
    handled whole and no token list is ever compared pairwise.
    """
    base = (pairs.select(*key, gold_key, squad_tokens(F.col(pred)).alias("pt"),
                         squad_tokens(F.col(gold)).alias("gt"))
            .persist(StorageLevel.MEMORY_AND_DISK))  # read by three branches
    lens = base.select(*key, gold_key, F.size("pt").alias("np"), F.size("gt").alias("ng"),
                       (F.array_join("pt", " ") == F.array_join("gt", " ")).alias("em"))
    pk = key + [gold_key]
    # explode_outer + null filter: no inferred size() filter re-running the regexes
    pc = (base.select(*pk, F.explode_outer("pt").alias("tok")).where(F.col("tok").isNotNull())
          .groupBy(*pk, "tok")
          .agg(F.count(F.lit(1)).alias("cp")))
    gc = (base.select(*pk, F.explode_outer("gt").alias("tok")).where(F.col("tok").isNotNull())
          .groupBy(*pk, "tok")
          .agg(F.count(F.lit(1)).alias("cg")))
    common = (pc.join(gc, pk + ["tok"]).groupBy(*pk)
              .agg(F.sum(F.least("cp", "cg")).alias("common")))
    scored = (lens.join(common, pk, "left")
              .withColumn("common", F.coalesce("common", F.lit(0)))
              .withColumn("p", safe_div(F.col("common"), F.col("np")))
              .withColumn("r", safe_div(F.col("common"), F.col("ng")))
              .withColumn("tf1", F.when((F.col("np") == 0) | (F.col("ng") == 0),
                                        (F.col("np") == F.col("ng")).cast("double"))
                          .when(F.col("common") == 0, F.lit(0.0))
                          .otherwise(f1(F.col("p"), F.col("r")))))
    return scored.groupBy(*key).agg(
        F.max(F.col("em").cast("double")).alias("em"),
        F.max("tf1").alias("f1"))
