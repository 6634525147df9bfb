"""SQuAD rows, token windows, window labels and n-best spans.

Everything is expressed on long tables with equi joins:

* token offsets come from ``split`` + ``posexplode`` + a running sum, so a
  context of any length is processed whole;
* a window's label needs only four token lookups (its first and last token,
  and the global tokens around the answer), never the window x token product;
* n-best candidate pairs are bounded by ``n_best**2`` per feature.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from qalake.functions.text import WS_CLASS, WS_RE, ws_tokens

MAX_LEN = 384
OVERLAP = 128
N_BEST = 20
MAX_ANSWER_LEN = 30


# ---- X2 / X3 -----------------------------------------------------------------
def squad_rows(pairs: DataFrame, answers: DataFrame, key: list[str]) -> DataFrame:
    """One row per (question, document, located answer).

    ``pairs`` holds ``key + [context, question, title]`` (J3 output); ``answers``
    holds ``key + [answer_idx, answer]``. Answers not found in the context
    (case-insensitive) and empty answers are skipped; each located answer keeps
    its own span (Q1 fixed).
    """
    a = answers.where(F.col("answer").isNotNull() & (F.col("answer") != ""))
    j = pairs.join(a, key)
    start = F.instr(F.lower(F.col("context")), F.lower(F.col("answer"))) - 1
    return (j.withColumn("answer_start", start)
            .where(F.col("answer_start") >= 0)
            .withColumn("answer_text",
                        F.substr(F.col("context"), F.col("answer_start") + 1, F.length("answer"))))


def nest_squad(rows: DataFrame, title: str = "title") -> DataFrame:
    """Title -> paragraphs(context) -> qas(question, id) -> answers.

    One output row per title (written as JSON lines, never one giant array).
    Orders are made explicit with ``array_sort`` on sortable structs.
    """
    qa = (rows.groupBy(title, "context", "id", "question")
          .agg(F.array_sort(F.collect_list(F.struct("answer_start", "answer_text"))).alias("_a"))
          .select(title, "context", F.struct(
              F.col("question"), F.col("id"),
              F.transform("_a", lambda x: F.struct(x["answer_text"].alias("text"),
                                                    x["answer_start"].alias("answer_start"))).alias("answers"))
              .alias("qa")))
    para = (qa.groupBy(title, "context")
            .agg(F.array_sort(F.collect_list("qa")).alias("qas")))
    return (para.groupBy(title)
            .agg(F.array_sort(F.collect_list(F.struct("context", "qas"))).alias("paragraphs")))


# ---- X4: windows ---------------------------------------------------------------
def window_budget(n_question_tokens, max_len: int = MAX_LEN, overlap: int = OVERLAP):
    """Context tokens per window: max_len - question tokens - 3 special tokens,
    at least ``overlap + 1`` so the stride stays positive."""
    return F.greatest(F.lit(max_len) - n_question_tokens - F.lit(3), F.lit(overlap + 1))


def token_windows(df: DataFrame, key: list[str], question: str = "question",
                  context: str = "context", max_len: int = MAX_LEN,
                  overlap: int = OVERLAP) -> DataFrame:
    """Overlapping windows over a context's whitespace tokens.

    Window starts are ``0, step, 2*step, ...`` while the previous window did
    not reach the end, i.e. ``sequence(0, greatest(n - overlap, 1) - 1, step)``.
    Returns ``key + [window_idx, start_tok, end_tok, n_tokens, budget]``
    (``end_tok`` exclusive).
    """
    b = df.select(*key, F.size(ws_tokens(question)).alias("nq"),
                  F.size(ws_tokens(context)).alias("n_tokens"))
    b = b.withColumn("budget", window_budget(F.col("nq"), max_len, overlap))
    step = F.col("budget") - F.lit(overlap)
    starts = F.sequence(F.lit(0), F.greatest(F.col("n_tokens") - F.lit(overlap), F.lit(1)) - 1, step)
    # *_outer: a plain explode makes Catalyst infer size(...) > 0 and split
    # the context a second time; sequence() is never empty here anyway.
    return (b.select(*key, "nq", "n_tokens", "budget", F.posexplode_outer(starts).alias("window_idx", "start_tok"))
            .withColumn("end_tok", F.least(F.col("start_tok") + F.col("budget"), F.col("n_tokens"))))


# ---- token offsets ----------------------------------------------------------------
def token_offsets(df: DataFrame, key: list[str], context: str = "context") -> DataFrame:
    """(key, tok_idx, s, e): 0-based char span of each whitespace token.

    ``split`` on whitespace runs keeps a leading empty piece when the text
    starts with whitespace; pieces are zipped with the separator that follows
    them and a running sum gives each piece's start.
    """
    pieces = F.split(F.col(context), WS_RE)
    seps = F.regexp_extract_all(F.col(context), F.lit("(" + WS_CLASS + "+)"), 1)
    z = df.select(*key, F.posexplode_outer(F.arrays_zip(pieces.alias("p"), seps.alias("sp"))).alias("i", "z"))
    z = z.where(F.col("i").isNotNull())
    z = z.select(*key, "i", F.length(F.col("z.p")).alias("lp"),
                 F.coalesce(F.length(F.col("z.sp")), F.lit(0)).alias("ls"))
    w = Window.partitionBy(*key).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    z = z.withColumn("s", F.coalesce(F.sum(F.col("lp") + F.col("ls")).over(w), F.lit(0)))
    z = z.where(F.col("lp") > 0)
    w2 = Window.partitionBy(*key).orderBy("i")
    return z.select(*key, (F.row_number().over(w2) - 1).alias("tok_idx"),
                    F.col("s").cast("int").alias("s"), (F.col("s") + F.col("lp")).cast("int").alias("e"))


# ---- X5: labels ------------------------------------------------------------------
def _asof_token(offsets: DataFrame, probes: DataFrame, key: list[str], ctx_key: list[str],
                tok_pos: str, probe_pos: str, backward: bool, out: str) -> DataFrame:
    """As-of lookup by union + window: for each probe, the last token with
    ``tok_pos <= probe`` (backward) or the first with ``tok_pos >= probe``
    (forward). Linear in tokens + probes per context -- no token x probe product."""
    other = [k for k in key if k not in ctx_key]
    toks = offsets.select(*ctx_key, F.col(tok_pos).alias("_p"), F.col("tok_idx").alias("_t"),
                          *[F.lit(None).cast("long").alias(k) for k in other],
                          F.lit(0 if backward else 1).alias("_o"))
    pr = probes.select(*ctx_key, F.col(probe_pos).alias("_p"), F.lit(None).cast("int").alias("_t"),
                       *[F.col(k).cast("long").alias(k) for k in other],
                       F.lit(1 if backward else 0).alias("_o"))
    u = toks.unionByName(pr)
    if backward:
        w = (Window.partitionBy(*ctx_key).orderBy("_p", "_o")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        v = F.last("_t", ignorenulls=True).over(w)
    else:
        # walked from the end, so that the frame grows: a shrinking one is computed anew for every row
        w = (Window.partitionBy(*ctx_key).orderBy(F.desc("_p"), F.desc("_o"))
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
        v = F.last("_t", ignorenulls=True).over(w)
    res = u.withColumn(out, v).where(F.col("_t").isNull())
    return res.select(*ctx_key, *[F.col(k) for k in other], out)


def window_labels(windows: DataFrame, offsets: DataFrame, answers: DataFrame,
                  key: list[str], ctx_key: list[str]) -> DataFrame:
    """Label each window with the answer's start/end token positions.

    ``offsets`` (from ``token_offsets``) is keyed by ``ctx_key`` -- a context
    shared by several examples is tokenised once; ``windows`` and ``answers``
    (``key + [answer_start, answer_len]``) are keyed by ``key``. A window
    contains the answer when its first token starts at or before the answer
    and its last token ends at or after the answer's end; then start = last
    token with ``s <= c`` and end = first token with ``e >= c + len``, both as
    positions in the model input (``nq + 2 + token - start_tok``); otherwise
    both are 0 (the CLS position).
    """
    a = answers.select(*key, F.col("answer_start").alias("c"),
                       (F.col("answer_start") + F.col("answer_len")).alias("ce"))
    around = _asof_token(offsets, a, key, ctx_key, "s", "c", backward=True, out="t_c") \
        .join(_asof_token(offsets, a, key, ctx_key, "e", "ce", backward=False, out="t_e"), key) \
        .join(a, key)
    first = offsets.select(*ctx_key, F.col("tok_idx").alias("start_tok"), F.col("s").alias("ws_s"))
    last = offsets.select(*ctx_key, (F.col("tok_idx") + 1).alias("end_tok"), F.col("e").alias("we_e"))
    w = (windows.join(around, key).join(first, ctx_key + ["start_tok"], "left")
         .join(last, ctx_key + ["end_tok"], "left"))
    inside = (F.col("ws_s") <= F.col("c")) & (F.col("we_e") >= F.col("ce"))
    base = F.col("nq") + F.lit(2) - F.col("start_tok")
    st = F.least(F.col("t_c"), F.col("end_tok") - 1)
    en = F.greatest(F.col("t_e"), F.col("start_tok"))
    return w.select(*key, "window_idx", "start_tok", "end_tok",
                    F.when(inside, base + st).otherwise(F.lit(0)).cast("int").alias("start_position"),
                    F.when(inside, base + en).otherwise(F.lit(0)).cast("int").alias("end_position"))


# ---- X6 ------------------------------------------------------------------------
def mask_offsets(offsets_col, sequence_ids_col, context_id: int = 1):
    """Null out offsets whose token is not part of the context."""
    return F.transform(offsets_col, lambda x, i: F.when(
        F.element_at(sequence_ids_col, i + 1) == context_id, x))


# ---- X7 / X8 ---------------------------------------------------------------------
def nbest_positions(logits: DataFrame, key: list[str], col: str, n_best: int = N_BEST,
                    valid=None) -> DataFrame:
    """The ``n_best`` largest entries of a logit array (ties: lower index)."""
    x = (logits.select(*key, F.posexplode_outer(col).alias("idx", "logit"))
         .where(F.col("idx").isNotNull()))
    if valid is not None:
        x = x.where(valid(F.col("idx")))
    w = Window.partitionBy(*key).orderBy(F.desc("logit"), F.asc("idx"))
    return x.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n_best).drop("r")


def nbest_spans(logits: DataFrame, key: list[str], start: str = "start_logits",
                end: str = "end_logits", n_best: int = N_BEST,
                max_answer_len: int = MAX_ANSWER_LEN, valid=None) -> DataFrame:
    """Best (start, end) per feature among n-best x n-best candidates with
    ``0 <= end - start`` and ``end - start + 1 <= max_answer_len``; features
    without a valid pair get ``(-1, -1, 0.0)``."""
    s = nbest_positions(logits, key, start, n_best, valid).select(
        *key, F.col("idx").alias("i"), F.col("logit").alias("ls"))
    e = nbest_positions(logits, key, end, n_best, valid).select(
        *key, F.col("idx").alias("j"), F.col("logit").alias("le"))
    cand = (s.join(e, key)
            .where((F.col("j") >= F.col("i")) & (F.col("j") - F.col("i") + 1 <= max_answer_len))
            .withColumn("score", F.col("ls") + F.col("le")))
    best = (cand.groupBy(*key)
            .agg(F.max(F.struct(F.col("score"), (-F.col("i")).alias("ni"), (-F.col("j")).alias("nj"))).alias("b"))
            .select(*key, (-F.col("b.ni")).alias("start_idx"), (-F.col("b.nj")).alias("end_idx"),
                    F.col("b.score").alias("score")))
    return (logits.select(*key).join(best, key, "left")
            .select(*key, F.coalesce("start_idx", F.lit(-1)).cast("int").alias("start_idx"),
                    F.coalesce("end_idx", F.lit(-1)).cast("int").alias("end_idx"),
                    F.coalesce("score", F.lit(0.0)).alias("score")))


def null_scores(logits: DataFrame, spans: DataFrame, feature_key: list[str], question: str,
                start: str = "start_logits", end: str = "end_logits") -> DataFrame:
    """Per question, the true minimum null score ``start[0] + end[0]``
    over its features (Q8 fixed), the best span score over its features and
    whether the best span beats the null answer."""
    nulls = logits.select(*feature_key, question,
                          (F.element_at(start, 1) + F.element_at(end, 1)).alias("null"))
    j = nulls.join(spans, feature_key)
    return j.groupBy(question).agg(
        F.min("null").alias("null_score"),
        F.max(F.when(F.col("start_idx") >= 0, F.col("score"))).alias("best_score")
    ).withColumn("answerable", F.coalesce(F.col("best_score") > F.col("null_score"), F.lit(False)))
