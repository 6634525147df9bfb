"""Registered driver queries: name -> f(spark, sf_dir) -> DataFrame.

Each query reads the driver tables whole; the matching DuckDB text lives in
``qalake.plans.oracle`` under the same name with the same column names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qalake.functions import ids
from qalake.functions.text import tokens
from qalake.operators import answers as A
from qalake.operators import best_answers as BA
from qalake.operators import compare as C
from qalake.operators import contexts as CX
from qalake.operators import dedup as D
from qalake.operators import lda
from qalake.operators import metrics as M
from qalake.operators import prep as P
from qalake.operators import squad as Q
from qalake.operators import textops as TXT
from qalake.operators import topics as TP
from qalake.operators import tune as TU
from qalake.plans import standins as S
from qalake.sources import html as H
from qalake.sources import reports as R
from qalake.sources.tables import Tables

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, QueryFn] = {}


def query(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


# ---- slice 1: retrieval and its evaluation ---------------------------------
@query("retrieve_topk_cosine")
def retrieve_topk_cosine(spark: SparkSession, sf: str) -> DataFrame:
    """Top 10 neighbours of every vector by exact cosine."""
    return S.embedding_ranked(Tables(spark, sf), 10)


def _per_q(spark, sf):
    return M.per_question(S.embedding_judged(Tables(spark, sf), 10), keys=["batch"])


@query("retrieve_eval_by_batch")
def retrieve_eval_by_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Set P/R/F1, set-based MAP and GMAP per batch."""
    return M.summarize(_per_q(spark, sf), by=["batch"])


@query("retrieve_eval_rank_ap")
def retrieve_eval_rank_ap(spark: SparkSession, sf: str) -> DataFrame:
    """Rank-aware AP (running hit count / rank) per batch."""
    return M.summarize(_per_q(spark, sf), by=["batch"], ap_col="rank_ap")


@query("retrieve_eval_min_relevant")
def retrieve_eval_min_relevant(spark: SparkSession, sf: str) -> DataFrame:
    """M4 evaluator form: rank AP divided by min(|T|, 10), GMAP with an
    epsilon shift (0.01) instead of the zero guard."""
    per_q = M.per_question(S.embedding_judged(Tables(spark, sf), 10), keys=["batch"],
                           ap_denominator="min_relevant", ap_epsilon=0.0)
    return M.summarize(per_q, by=["batch"], ap_col="rank_ap", gmap_eps=0.01)


@query("eval_rollup")
def eval_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Per-batch rows and the overall row (batch null) from one rollup."""
    return M.summarize_rollup(_per_q(spark, sf), "batch")


# ---- slice 2: dataset preparation ------------------------------------------
@query("gold_pairs_contains")
def gold_pairs_contains(spark, sf):
    """Question text occurs in a document (anchored equi join + instr)."""
    return S.gold_links(Tables(spark, sf))


@query("pmid_from_url_last")
def pmid_from_url_last(spark, sf):
    """id = last path segment of the link."""
    return Tables(spark, sf).pages.select("page_id", ids.id_from_url_last("url").alias("pmid"))


@query("pmid_from_url_regex")
def pmid_from_url_regex(spark, sf):
    """id = first /digits run of the link, null when absent."""
    return Tables(spark, sf).pages.select("page_id", ids.id_from_url_digits("url").alias("pmid"))


@query("corpus_semi")
def corpus_semi(spark, sf):
    """Documents referenced by any question."""
    t = Tables(spark, sf)
    return P.semi_corpus(t.documents.select("doc_id", "lang", "source", "n_chars"),
                         S.gold_links(t), key="doc_id")


@query("ingest_anti")
def ingest_anti(spark, sf):
    """Incoming documents whose key is not stored yet (stored = labelled)."""
    t = Tables(spark, sf)
    return P.anti_stored(t.documents.select("doc_id", "lang"), t.labels, key="doc_id")


@query("found_filter")
def found_filter(spark, sf):
    """A question's documents that exist in the stored corpus."""
    t = Tables(spark, sf)
    return P.found_in_corpus(S.gold_links(t), t.labels, key="doc_id").select("item_id", "doc_id")


@query("docs_per_query")
def docs_per_query(spark, sf):
    """A3: gold documents per question over all questions."""
    t = Tables(spark, sf)
    out = P.docs_per_query(t.benchmark.select("item_id"), S.gold_links(t), "item_id")
    return out.withColumn("docs_per_query", F.round("docs_per_query", 6))


@query("distinct_docs")
def distinct_docs(spark, sf):
    """A1: distinct documents over all questions' links."""
    return P.distinct_docs(S.gold_links(Tables(spark, sf)), "doc_id")


@query("dataset_profile")
def dataset_profile(spark, sf):
    """A4/R2: per conversation (dataset), turns and counts per role (type)."""
    return P.profile(Tables(spark, sf).conversations, "conv_id", "role",
                     ["assistant", "system", "user"])


@query("dataset_documents")
def dataset_documents(spark, sf):
    """A4: per dataset (source of the gold documents) its questions, distinct documents and questions by type (language)."""
    t = Tables(spark, sf)
    links = S.gold_links(t, materialize=True).join(t.documents.select("doc_id", "lang", "source"), "doc_id")
    questions = links.select("source", "item_id", "lang").distinct()
    return P.profile_documents(questions, links, "source", "lang", ["de", "en", "es", "fr"], "doc_id")


@query("null_backfill")
def null_backfill(spark, sf):
    """Back-fill quality/toxic by key; rows still missing are flagged."""
    t = Tables(spark, sf)
    base = t.documents.select("doc_id", "lang")
    out = P.backfill(base, t.labels, "doc_id", ["quality", "toxic"])
    return out.withColumn("missing", F.col("quality").isNull())


@query("dup_texts")
def dup_texts(spark, sf):
    """Every member of a group of identical texts, with the group size."""
    return D.flag_duplicates(Tables(spark, sf).documents.select("doc_id", "text"), "text") \
        .select("doc_id", "n_copies")


@query("first_per_key")
def first_per_key(spark, sf):
    """First document (lowest doc_id = ingest order) per identical text."""
    d = Tables(spark, sf).documents.select("doc_id", "lang", "text")
    return D.first_per_key(d, D.text_key(F.col("text")), "doc_id").select("doc_id", "lang")


# ---- slice 3: text -----------------------------------------------------------
@query("clean_tokens")
def clean_tokens(spark, sf):
    """F3 (steps 1-7): cleaned tokens per document."""
    tk = S.doc_tokens(Tables(spark, sf))
    return tk.select("doc_id", F.size("toks").alias("n_tokens"),
                     F.array_join("toks", " ").alias("tokens"))


@query("term_stats")
def term_stats(spark, sf):
    """Per term, document frequency and collection frequency."""
    return TXT.term_stats(S.doc_tokens(Tables(spark, sf)))


@query("bow")
def bow(spark, sf):
    """Vocabulary of the training documents (those with labels), bag
    of words of every document, unseen terms dropped."""
    t = Tables(spark, sf)
    train_docs = t.documents.join(t.labels.select("doc_id"), "doc_id", "left_semi")
    vocab = TXT.vocabulary(S.doc_tokens(t, train_docs))
    return TXT.bag_of_words(S.doc_tokens(t), vocab)


# ---- slice 4: answer scoring -------------------------------------------------
@query("answer_position")
def answer_position(spark, sf):
    """M5: rank of the first predicted answer matching a gold synonym (0 = none)."""
    t = Tables(spark, sf)
    pos = A.answer_positions(S.embedding_predictions(t, 5), S.embedding_gold(t))
    return pos.join(S.question_batches(t), "qid").select(
        F.col("qid").alias("q_id"), "batch", "pos")


@query("strict_lenient_mrr")
def strict_lenient_mrr(spark, sf):
    """Strict / lenient accuracy and MRR per batch."""
    t = Tables(spark, sf)
    pos = A.answer_positions(S.embedding_predictions(t, 5), S.embedding_gold(t))
    return pos.join(S.question_batches(t), "qid").groupBy("batch").agg(*M.factoid_aggs("pos"))


@query("list_prf")
def list_prf(spark, sf):
    """M6 + A13: list TP/FP/FN -> P/R/F per question, batch means skipping
    undefined values (Q4)."""
    t = Tables(spark, sf)
    preds = A.dedup_predictions(S.embedding_predictions(t, 10))
    counts = A.list_counts(preds, S.embedding_gold(t))
    cols = M.list_prf_columns()
    per_q = counts.select("qid", *[c.alias(n) for n, c in cols.items()])
    return per_q.join(S.question_batches(t), "qid").groupBy("batch").agg(*M.list_aggs("skip"))


@query("answers_dedup")
def answers_dedup(spark, sf):
    """Order-preserving, case-sensitive distinct of the ranked answers."""
    t = Tables(spark, sf)
    return A.dedup_predictions(S.embedding_predictions(t, 10)).select(
        F.col("qid").alias("q_id"), "rank", "answer")


@query("squad_em_f1")
def squad_em_f1(spark, sf):
    """M7 + A21: SQuAD exact match and token F1 (max over golds, mean x 100)."""
    t = Tables(spark, sf)
    per_turn = M.squad_scores(S.turn_pairs(t), key=["conv_id", "turn"])
    return per_turn.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("em") * 100, 6).alias("exact_match"),
        F.round(F.avg("f1") * 100, 6).alias("f1"))


@query("dup_question_report")
def dup_question_report(spark, sf):
    """(batch, body) groups present more than once."""
    return D.duplicate_report(Tables(spark, sf).documents, "source", "text")


# ---- slice 5: SQuAD rows, windows, spans ---------------------------------------
SQUAD_KEY = ["doc_id", "item_id"]


def _squad_rows(t, materialize=False):
    pairs, answers = S.squad_inputs(t, materialize)
    return Q.squad_rows(pairs, answers, ["item_id"])


@query("squad_rows")
def squad_rows(spark, sf):
    """Flat SQuAD rows, one per located answer."""
    r = _squad_rows(Tables(spark, sf))
    return r.select(ids.composite_key("doc_id", "item_id").alias("id"), "doc_id", "item_id", "title",
                    "question", "context", "answer_idx", "answer_text", "answer_start")


@query("token_windows")
def token_windows(spark, sf):
    """384-token windows with 128 overlap over whitespace tokens."""
    return Q.token_windows(S.qa_turns(Tables(spark, sf)), ["conv_id", "turn"])


@query("window_labels")
def window_labels(spark, sf):
    """Answer start/end positions per window (0 when cut by an edge)."""
    t = Tables(spark, sf)
    # rows and token offsets are each read by several branches: keep them once
    rows = _squad_rows(t, materialize=True).persist(StorageLevel.MEMORY_AND_DISK)
    key = ["doc_id", "item_id", "answer_idx"]
    windows = Q.token_windows(rows, key)
    ctx = rows.select("doc_id", "context").dropDuplicates(["doc_id"])
    offsets = Q.token_offsets(ctx, ["doc_id"]).persist(StorageLevel.MEMORY_AND_DISK)
    ans = rows.select(*key, "answer_start", F.length("answer_text").alias("answer_len"))
    return Q.window_labels(windows, offsets, ans, key, ["doc_id"])


@query("nbest_spans")
def nbest_spans(spark, sf):
    """Best span among 20 x 20 candidates (CLS position masked)."""
    sp = Q.nbest_spans(S.logits(Tables(spark, sf)), ["vec_id"], valid=lambda i: i >= 1)
    return sp.withColumn("score", F.round("score", 6))


@query("null_score")
def null_score(spark, sf):
    """Per question (label), minimum null score over its features,
    best span score and answerability."""
    lg = S.logits(Tables(spark, sf))
    sp = Q.nbest_spans(lg, ["vec_id"], valid=lambda i: i >= 1)
    out = Q.null_scores(lg, sp, ["vec_id"], "label")
    return out.select(F.col("label").alias("batch"), F.round("null_score", 6).alias("null_score"),
                      F.round("best_score", 6).alias("best_score"), "answerable")


@query("answer_text")
def answer_text(spark, sf):
    """One predicted answer text per question over all its windows."""
    features, contexts = S.window_features(Tables(spark, sf))
    out = BA.best_answers(features, contexts)
    return out.withColumns({c: F.round(c, 6) for c in ("score", "null_score")})


@query("answer_nbest")
def answer_nbest(spark, sf):
    """The five best answer spans of each question over all its windows."""
    features, contexts = S.window_features(Tables(spark, sf))
    return BA.n_best_answers(features, contexts, 5).withColumn("score", F.round("score", 6))


# ---- slice 6: comparison, leaderboards, reports, HTML -----------------------------
LB_METRICS = ["mean_value", "n_events", "n_users"]


@query("metrics_long")
def metrics_long(spark, sf):
    """Wide leaderboard -> (system, batch, metric, value)."""
    lb = S.leaderboard(Tables(spark, sf))
    return C.to_long(lb, ["system", "batch"], LB_METRICS)


@query("system_means")
def system_means(spark, sf):
    """Mean of each metric per system."""
    return C.means_by(S.leaderboard(Tables(spark, sf)), ["system"], LB_METRICS)


@query("top_per_batch")
def top_per_batch(spark, sf):
    """The 3 best systems per batch by mean value (ties: system name)."""
    lb = S.leaderboard(Tables(spark, sf))
    out = C.top_k_per_group(lb, ["batch"], "mean_value", 3, ["system"])
    return out.select("batch", "rank", "system", "mean_value")


@query("top3_trend")
def top3_trend(spark, sf):
    """O4 + J10 + A15: top 3 systems overall, their mean value per batch."""
    lb = S.leaderboard(Tables(spark, sf))
    keep = C.keep_keys(lb, C.top_n_keys(lb, "system", "mean_value", 3), "system")
    return C.means_by(keep, ["batch", "system"], ["mean_value"])


@query("top5_logs")
def top5_logs(spark, sf):
    """O2: the 5 best rows by metric over all logs (a top-k report)."""
    lb = S.leaderboard(Tables(spark, sf))
    out = C.top_rows(lb, "mean_value", 5, ["system", "batch"])
    return out.select("system", "batch", "mean_value")


@query("other_systems")
def other_systems(spark, sf):
    """Rows of every system but one, null-safe (pandas ``!=`` keeps
    nulls), over all batches."""
    lb = S.leaderboard(Tables(spark, sf))
    return lb.where(C.not_equal_null_safe("system", "view")).select("system", "batch", "n_events")


@query("best_trial")
def best_trial(spark, sf):
    """Best trial per study (max score, ties: lowest trial id) and its params."""
    return C.best_by(S.trials(Tables(spark, sf)), ["study"], "score", "trial_id", ["k"])


@query("pending_trials")
def pending_trials(spark, sf):
    """Planned (study, params) without a finished trial (anti join)."""
    e = Tables(spark, sf).events
    k = F.get_json_object("props", "$.k").cast("int").alias("k")
    planned = e.where(F.col("event_type") == "view").select(F.col("user_id").alias("study"), k).distinct()
    done = e.where(F.col("event_type") == "purchase").select(F.col("user_id").alias("study"), k, F.lit("COMPLETE").alias("state"))
    return TU.unfinished(planned, done, ["study", "k"])


@query("retry_trials")
def retry_trials(spark, sf):
    """Planned (study, params) neither finished nor failed three times (errors)."""
    e = Tables(spark, sf).events
    k = (F.get_json_object("props", "$.k").cast("int") % 10).alias("k")
    study = (F.col("user_id") % 50).alias("study")
    planned = e.where(F.col("event_type") == "view").select(study, k).distinct()
    state = F.when(F.col("event_type") == "error", "FAIL").when(F.col("value") > 90, "COMPLETE").otherwise("RUNNING")
    trials = e.where(F.col("event_type").isin("error", "purchase")).select(study, k, state.alias("state"))
    return TU.unfinished(planned, trials, ["study", "k"])


@query("trial_passes")
def trial_passes(spark, sf):
    """A trial log with scores per pass (events: study = user, k from
    the props, pass = value modulo 5, errors failed), folded by ``tune.pass_scores``."""
    e = Tables(spark, sf).events
    k = F.get_json_object("props", "$.k").cast("double")
    at = F.pmod(F.floor("value").cast("long"), F.lit(5)).cast("double")
    log = e.where(k.isNotNull() & at.isNotNull()).select(
        F.col("user_id").cast("string").alias("study"), F.col("event_id").alias("trial_id"),
        F.create_map(F.lit("k"), k, F.lit("pass"), at).alias("params"), F.col("value").alias("score"),
        F.when(F.col("event_type") == "error", "FAIL").otherwise("COMPLETE").alias("state"))
    return TU.pass_scores(log).select("study", F.col("params")["k"].alias("k"), "pass", "score", "trial_id", "failed")


@query("lda_online_topics")
def lda_online_topics(spark, sf):
    """T4 (online form) + W9: two passes in chunks of a quarter of the
    documents, decay 0.5, offset 1, learned alpha; top five terms per topic."""
    from qalake.operators import online_lda
    from qalake.operators.textops import term_counts
    from qalake.session import checkpoint_dir
    t = Tables(spark, sf)
    docs = t.documents.select("doc_id", tokens("text").alias("toks"))
    params = online_lda.OnlineParams(10, chunk_docs=max(1, -(-t.documents.count() // 4)), passes=2, alpha="auto")
    model = online_lda.fit_online(term_counts(docs), f"{checkpoint_dir(spark)}/lda-{uuid.uuid4().hex}", params)
    return lda.describe_topics(model, 5)


@query("html_fields")
def html_fields(spark, sf):
    """Title, h1, language and paragraph text of raw pages."""
    return H.html_fields(Tables(spark, sf).pages.select("page_id", "html"))


@query("page_elements")
def page_elements(spark, sf):
    """Fields of raw pages by element; ``start`` is the first four characters of the title."""
    from qalake.sources.elements import Field, element_fields
    fields = [Field("page_lang", "html", attr="lang"), Field("title", "head > title"), Field("start", "head > title", first=4),
              Field("heading", "article > h1"), Field("menu", "nav ul > li a", many=True, lower=True),
              Field("links", "nav a", attr="href", many=True)]
    out = element_fields(Tables(spark, sf).pages.select("page_id", "html"), fields)
    return out.withColumns({"menu": F.array_join("menu", "|"), "links": F.array_join("links", "|")})


@query("report_pivot")
def report_pivot(spark, sf):
    """Parse ``metric: score`` lines and pivot to one row per batch."""
    e = Tables(spark, sf).events
    lines = e.select(F.col("user_id").alias("batch"),
                     F.concat(F.col("event_type"), F.lit(": "), F.col("value").cast("string")).alias("value"))
    return R.report_to_wide(R.parse_report_lines(lines),
                            ["click", "error", "purchase", "signup", "view"])


@query("union_aligned")
def union_aligned(spark, sf):
    """Union by name, missing columns filled with null."""
    t = Tables(spark, sf)
    return P.union_aligned(t.documents.select("doc_id", "lang"),
                           t.labels.select("doc_id", "quality"))


# ---- slice 7: topics ------------------------------------------------------------------
@query("topic_sizes")
def topic_sizes(spark, sf):
    """Vectors per topic with weight >= 0.01 (empty topics stay 0)."""
    return TP.topic_sizes(S.embedding_topic_mix(Tables(spark, sf)))


@query("doc_topic_indicator")
def doc_topic_indicator(spark, sf):
    """(document, topic) indicator rows for weights >= 0.01."""
    mix = S.embedding_topic_mix(Tables(spark, sf))
    return mix.where(F.col("w") >= TP.MIN_PROBABILITY).select(
        F.col("doc_id").alias("vec_id"), "topic")


@query("coherence_umass")
def coherence_umass(spark, sf):
    """T10 u_mass of each language's top-10 document-frequency terms."""
    t = Tables(spark, sf)
    top = S.top_terms_by_group(t, "lang", 10)
    out = TP.coherence_umass(top, S.tokens_long(t).select("doc_id", "term"), group="lang")
    return out.select("lang", F.round("u_mass", 6).alias("u_mass"))


@query("coherence_npmi")
def coherence_npmi(spark, sf):
    """T10 c_npmi (10-token sliding windows) of each language's top-10 terms."""
    t = Tables(spark, sf)
    top = S.top_terms_by_group(t, "lang", 10)
    out = TP.coherence_windowed(S.tokens_long(t), top, 10, "c_npmi", group="lang")
    return out.select("lang", F.round("c_npmi", 6).alias("c_npmi"))


@query("coherence_uci")
def coherence_uci(spark, sf):
    """T10 c_uci (10-token sliding windows) of each language's top-10 terms."""
    t = Tables(spark, sf)
    top = S.top_terms_by_group(t, "lang", 10)
    out = TP.coherence_windowed(S.tokens_long(t), top, 10, "c_uci", group="lang")
    return out.select("lang", F.round("c_uci", 6).alias("c_uci"))


@query("stem_tokens")
def stem_tokens(spark, sf):
    """Porter stems per document, stemmed once per distinct term."""
    t = Tables(spark, sf)
    st = TXT.stem_terms(S.doc_tokens(t))
    stems = st.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "stem"))).alias("s"))
    # documents without a token stay
    return (t.documents.select("doc_id").join(stems, "doc_id", "left")
            .select("doc_id", F.coalesce(F.size("s"), F.lit(0)).alias("n_tokens"),
                    F.coalesce(F.array_join(F.transform("s", lambda x: x["stem"]), " "), F.lit("")).alias("stems")))


@query("lda_topics")
def lda_topics(spark, sf):
    """LDA (k=10) on the documents, top 5 terms per topic."""
    return lda.describe_topics(S.LdaFit(Tables(spark, sf)).model, 5)


@query("lda_retrieve")
def lda_retrieve(spark, sf):
    """Questions -> tokens -> bag of words -> LDA topics (< 0.01 dropped)
    -> exact cosine top 10 documents."""
    from qalake.functions.text import tokens
    from qalake.operators.retrieve import cosine_topk
    t = Tables(spark, sf)
    fit = S.LdaFit(t)
    qs = t.benchmark.select(F.col("item_id").alias("doc_id"), tokens("text").alias("toks"))
    q = lda.topic_vectors(fit.model, qs, TXT.term_counts(qs)).withColumnRenamed("doc_id", "q_id")
    return cosine_topk(q, fit.doc_vectors(), k=10)


@query("topic_relevance")
def topic_relevance(spark, sf):
    """Per-topic term relevance (lambda = 0.6), top 5 terms, and topic
    prevalence weighted by document length."""
    t = Tables(spark, sf)
    fit = S.LdaFit(t)
    p = fit.blocks.terms
    p = p.select("term", (F.col("cf") / p.agg(F.sum("cf")).scalar()).alias("p"))
    rel = TP.term_relevance(lda.relevant_terms(fit.model, p, 0.6, 5), p, 0.6, 5)
    mix = fit.doc_vectors(0.0).select("doc_id", F.posexplode("vec").alias("topic", "w"))
    prev = TP.topic_prevalence(mix, fit.lengths)
    return rel.join(prev, "topic")


# ---- coverage additions -------------------------------------------------------------
@query("prepare_profile")
def prepare_profile(spark, sf):
    """P16 composite: links rebuilt as URLs (P12) -> ids (P2) -> found in the
    stored corpus (P7) -> answerable questions (P8) -> counts and ratio (A1/A3)."""
    t = Tables(spark, sf)
    g = S.gold_links(t)
    ll = g.select(F.col("item_id").alias("id"), F.col("doc_id").alias("pos"),
                  ids.url_from_id("doc_id").alias("link"))
    corpus = t.labels.select(F.col("doc_id").cast("string").alias("pmid"))
    _, prof = P.prepare(t.benchmark.select(F.col("item_id").alias("id")), corpus, links_long_df=ll)
    return prof.withColumn("docs_per_query", F.round("docs_per_query", 6))


@query("type_counts")
def type_counts(spark, sf):
    """A2: questions per type (conversation turns per role)."""
    return Tables(spark, sf).conversations.groupBy(F.col("role").alias("type")).agg(
        F.count(F.lit(1)).alias("n"))


@query("coherence_cv")
def coherence_cv(spark, sf):
    """T10 c_v (110-token boolean sliding windows) of each language's top-10 terms."""
    t = Tables(spark, sf)
    top = S.top_terms_by_group(t, "lang", 10)
    out = TP.coherence_cv(S.tokens_long(t), top, 110, group="lang")
    return out.select("lang", F.round("c_v", 6).alias("c_v"))


@query("lda_eval")
def lda_eval(spark, sf):
    """LDA retrieval scored against the gold links (P/R/F1, MAP, GMAP)."""
    t = Tables(spark, sf)
    ranked = lda_retrieve(spark, sf)
    gold = S.gold_links(t).select(F.col("item_id").alias("q_id"), "doc_id")
    return M.evaluate(ranked, gold)


@query("chart_means")
def chart_means(spark, sf):
    """Chart aggregate -- mean value per (system, metric) of the long table."""
    long = C.to_long(S.leaderboard(Tables(spark, sf)), ["system", "batch"], LB_METRICS)
    return C.means_by(long, ["system", "metric"], ["value"])


@query("link_keys")
def link_keys(spark, sf):
    """A gold link rebuilt as a URL and the SQuAD example key
    ``<pmid>_<question id>``."""
    g = S.gold_links(Tables(spark, sf))
    return g.select("doc_id", "item_id", ids.url_from_id("doc_id").alias("link"),
                    ids.composite_key("doc_id", "item_id").alias("example_id"))


@query("label_indicators")
def label_indicators(spark, sf):
    """Multi-label binarisation of gold u predicted labels per question
    (predicted = labels of the top-10 neighbours)."""
    t = Tables(spark, sf)
    preds = S.embedding_predictions(t, 10).groupBy("qid").agg(
        F.collect_set("answer").alias("pred"))   # bounded: at most k per question
    gold = t.embeddings.select(F.col("vec_id").alias("qid"),
                               F.array(S.label_answer()).alias("gold"))
    b = M.binarize_labels(gold.join(preds, "qid"), "qid", "gold", "pred")
    return b.select(F.col("qid").alias("q_id"), "label", "y_true", "y_pred")


@query("gold_contexts")
def gold_contexts(spark, sf):
    """The ``by_documents`` context source -- each question's gold
    documents as (id, ctx_pos, context), here reported by context length."""
    t = Tables(spark, sf)
    ll = S.gold_links(t).select(F.col("item_id").alias("id"), F.col("doc_id").alias("pos"),
                                F.col("doc_id").alias("pmid"))
    docs = t.documents.select(F.col("doc_id").alias("pmid"), F.col("text").alias("abstractText"))
    ctx = CX.contexts("by_documents", links_long=ll, docs=docs)
    return ctx.select("id", "ctx_pos", F.length("context").alias("context_chars"))


@query("new_keys_except")
def new_keys_except(spark, sf):
    """Multiset difference of keys (incoming minus stored, ``exceptAll``)."""
    t = Tables(spark, sf)
    return t.documents.select("doc_id").exceptAll(t.labels.select("doc_id"))


def queries() -> dict[str, QueryFn]:
    return dict(REGISTRY)
