"""Parameter search with a resumable trial table.

The search space is sampled (seeded random or grid) into a *pending* table;
trials already finished in the study's Parquet table are removed with an
anti join (resume, T16); each remaining trial is one Spark job (fit + score,
``objective``), and its row is appended as soon as it finishes, so a crashed
driver resumes where it stopped. Failed trials are recorded with state FAIL
and retried up to ``max_retry`` times.
"""

from __future__ import annotations

import datetime as dt
import itertools
import random
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qalake.sources.questions import path_exists
from qalake.schemas import TRIAL


def sample_space(space: dict, n: int, seed: int = 0) -> list[dict]:
    """Integers and floats uniform in [lo, hi], categories uniform, seeded.
    ``space`` maps name -> ("int", lo, hi) | ("float", lo, hi) | ("cat", [..])."""
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        p = {}
        for name, spec in sorted(space.items()):
            kind = spec[0]
            if kind == "int":
                p[name] = float(rnd.randint(spec[1], spec[2]))
            elif kind == "float":
                p[name] = rnd.uniform(spec[1], spec[2])
            elif kind == "cat":
                p[name] = float(rnd.randrange(len(spec[1])))
            else:
                raise ValueError(f"unknown kind {kind!r}")
        out.append(p)
    return out


def grid_space(grid: dict) -> list[dict]:
    names = sorted(grid)
    return [dict(zip(names, map(float, vals))) for vals in itertools.product(*[grid[n] for n in names])]


def params_key(params_col: str = "params"):
    """A canonical string of a params map, for anti joins on parameters."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.col(params_col)))))


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    if path_exists(spark, path):
        return spark.read.schema(TRIAL).parquet(path)
    return spark.createDataFrame([], TRIAL)  # empty study


def unfinished(candidates: DataFrame, trials: DataFrame, keys: list[str], max_retry: int = 3) -> DataFrame:
    """T16 on tables: the candidates whose keys have neither a COMPLETE trial
    nor ``max_retry`` failed ones."""
    done = trials.where(F.col("state") == "COMPLETE").select(*keys)
    failed = (trials.where(F.col("state") == "FAIL").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_fail"))
              .where(F.col("n_fail") >= max_retry).select(*keys))
    return candidates.join(done.unionByName(failed), keys, "left_anti")


def pending(spark: SparkSession, candidates: list[dict], trials_path: str, study: str,
            max_retry: int = 3) -> DataFrame:
    """Candidates minus finished trials; failed ones come back until they
    have failed ``max_retry`` times."""
    cand = spark.createDataFrame([(i, p) for i, p in enumerate(candidates)],
                                 "cand_id long, params map<string,double>")
    t = read_trials(spark, trials_path).where(F.col("study") == study).withColumn("pk", params_key())
    return unfinished(cand.withColumn("pk", params_key()), t, ["pk"], max_retry) \
        .select("cand_id", "params").orderBy("cand_id")


def run_study(spark: SparkSession, study: str, candidates: list[dict], trials_path: str,
              objective: Callable[[dict], float], max_trials: int | None = None,
              max_retry: int = 3) -> DataFrame:
    """Evaluate pending candidates one by one (each one a Spark job),
    appending a trial row after each; returns the study's trial table."""
    todo = pending(spark, candidates, trials_path, study, max_retry).collect()  # bounded: the search space
    if max_trials is not None:
        todo = todo[:max_trials]
    existing = read_trials(spark, trials_path).where(F.col("study") == study)
    next_id = (existing.agg(F.max("trial_id")).first()[0] or 0) + 1
    for row in todo:
        params = dict(row.params)
        started = dt.datetime.now(dt.timezone.utc)
        try:
            score, state = float(objective(params)), "COMPLETE"
        except ValueError:
            score, state = None, "FAIL"
        finished = dt.datetime.now(dt.timezone.utc)
        rec = spark.createDataFrame([(study, next_id, params, score, state, started, finished)], TRIAL)
        rec.write.mode("append").parquet(trials_path)
        next_id += 1
    return read_trials(spark, trials_path).where(F.col("study") == study)


def best_trial(trials: DataFrame) -> DataFrame:
    """Per study, the best finished trial (max score, ties: lowest id)."""
    ok = trials.where(F.col("state") == "COMPLETE")
    order = F.struct(F.col("score"), (-F.col("trial_id")).alias("nid"))
    return (ok.groupBy("study").agg(F.max(order).alias("b"),
                                    F.max_by("params", order).alias("best_params"))
            .select("study", (-F.col("b.nid")).alias("trial_id"), F.col("b.score").alias("best_value"),
                    "best_params"))


def trial_durations(trials: DataFrame) -> DataFrame:
    """duration of each trial in seconds."""
    return trials.withColumn("seconds", F.unix_micros("finished") / 1e6 - F.unix_micros("started") / 1e6)


def pass_scores(trials: DataFrame) -> DataFrame:
    """The trial log folded by (study, params, pass): one row each with
    the score of the last finished trial (by trial id) and how many failed.
    ``params`` is without its ``pass``, which must be there."""
    key = F.map_filter("params", lambda k, _: k != "pass")
    ok = F.when(F.col("state") == "COMPLETE", F.col("trial_id"))
    return (trials.where(F.col("params")["pass"].isNotNull())
            .select("study", key.alias("params"), F.col("params")["pass"].cast("int").alias("pass"), "score", "state", "trial_id")
            .groupBy("study", params_key().alias("key"), "pass")
            .agg(F.max_by("score", ok).alias("score"), F.max(ok).alias("trial_id"), F.count_if(F.col("state") == "FAIL").alias("failed"),
                 F.first("params").alias("params"))
            .select("study", "params", "pass", "score", "trial_id", "failed"))


def run_passes(spark: SparkSession, study: str, params: dict, job, trials_path: str,
               score: Callable[[object], float]) -> DataFrame:
    """Fits ``job`` (an ``online_lda.OnlineLda``) pass by pass and appends
    the score of every pass as a trial row with ``pass`` among its params.

    Resumable: passes whose model is stored are not fitted again, passes that
    have a finished trial are not scored again; one that was fitted but not
    scored when the job was killed is scored from its stored model. A pass
    whose score raises ValueError becomes a FAIL row and is tried again by the
    next run. Returns ``pass_scores`` of this study and these params."""
    params = {k: float(v) for k, v in params.items()}

    def mine() -> DataFrame:
        own = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.create_map(
            *[c for k, v in params.items() for c in (F.lit(k), F.lit(v))])))))
        got = pass_scores(read_trials(spark, trials_path).where(F.col("study") == study))
        return got.where(params_key() == own) if params else got.where(F.size("params") == 0)
    done = {r["pass"] for r in mine().where("trial_id is not null").collect()}  # bounded: the passes of one fit

    def judge(n: int, model) -> None:
        started = dt.datetime.now(dt.timezone.utc)
        try:
            value, state = float(score(model)), "COMPLETE"
        except ValueError:
            value, state = None, "FAIL"
        last = read_trials(spark, trials_path).where(F.col("study") == study).agg(F.max("trial_id")).first()[0] or 0
        spark.createDataFrame([(study, last + 1, params | {"pass": float(n)}, value, state, started, dt.datetime.now(dt.timezone.utc))],
                              TRIAL).write.mode("append").parquet(trials_path)
    for n in range(1, job.last_pass() + 1):
        if n not in done:
            judge(n, job.model(n))
    for n, model in job.run():
        judge(n, model)
    return mine()


def checkpoint_scores(fit_at: Callable[[int], float], checkpoints: list[int]) -> list[tuple[int, float]]:
    """Spark's LDA has no per-pass callback; score a model fitted with
    ``maxIter`` = each checkpoint instead (one trial row per checkpoint)."""
    return [(it, float(fit_at(it))) for it in checkpoints]


def lda_objective(question_toks: DataFrame, doc_toks: DataFrame, gold_pairs: DataFrame,
                  metric: str = "MAP", vocab_size: int | None = None, topn: int = 10):
    """SURVEY 3.1 as an objective for ``run_study``: params (num_topics,
    passes) -> LDA on the documents -> topic vectors of questions and
    documents -> exact top-n cosine retrieval -> metric against the gold
    (q_id, doc_id) pairs. Every step is a Spark job; only the score comes back.
    Other parameters (chunk size, decay) belong to online updates and change
    nothing here. The whole vocabulary is used unless ``vocab_size`` asks for
    the most frequent terms only."""
    from qalake.operators import lda
    from qalake.operators import metrics as M
    from qalake.operators.retrieve import cosine_topk
    from qalake.operators.textops import bag_of_words, term_counts, vocabulary
    from qalake.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(doc_toks.sparkSession)
    bag = term_counts(doc_toks) if vocab_size is None else \
        bag_of_words(doc_toks, vocabulary(doc_toks, max_terms=vocab_size))
    bag = bag.checkpoint()
    q_bag = term_counts(question_toks).checkpoint()

    def objective(params: dict) -> float:
        model = lda.fit(bag, int(params.get("num_topics", 10)), int(params.get("passes", 1)))
        q = lda.topic_vectors(model, question_toks, q_bag).withColumnRenamed("doc_id", "q_id")
        ranked = cosine_topk(q, lda.topic_vectors(model, doc_toks, bag), k=topn)
        score = M.evaluate(ranked, gold_pairs).first()[metric]
        if score is None:
            raise ValueError("empty evaluation")
        return float(score)
    return objective
