"""Online LDA against a small dense computation; a fit killed within a pass goes on."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from qalake.operators import online_lda as O
from qalake.operators import tune
from qalake.operators.lda import describe_topics, digamma, topic_vectors


def bag_rows(seed=1, n=60):
    rng = random.Random(seed)
    rows = []
    for d in range(n):
        group = d % 3
        for t in range(12):
            if rng.random() < (0.8 if t // 4 == group else 0.1):
                rows.append((d, f"t{t}", rng.randrange(1, 5)))
    return rows + [(1000, "alone", 1), (1001, "t0", 300)]


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, term string, tf long")


def dense(job, p):
    """The same updates with one V x k matrix, from the stored terms and chunks."""
    terms = job._read("terms").collect()
    at = {r.id: i for i, r in enumerate(terms)}
    eta = job.eta
    lam = eta + np.array([r.e for r in terms])
    docs, chunks = job._read("meta").first()
    bag = job._bag().collect()
    alpha = np.full(p.k, 1.0 / p.k) if isinstance(p.alpha, str) else np.array(p.alpha)
    seen = 0.0
    for n in range(p.passes):
        for c in range(chunks):
            own = {}
            for r in bag:
                if r.chunk == c:
                    own.setdefault(r.doc_id, []).append((at[r.id], r.tf))
            if not own:
                continue
            beta = np.exp(digamma(lam) - digamma(lam.sum(0)))
            stat, logs = np.zeros_like(lam), np.zeros(p.k)
            for entries in own.values():
                w, tf = np.array([x for x, _ in entries]), np.array([x for _, x in entries], float)
                gamma = alpha + tf.sum() / p.k
                for _ in range(50):
                    theta = np.exp(digamma(gamma) - digamma(gamma.sum()[None]))
                    new = alpha + theta * (beta[w] * (tf / (beta[w] @ theta + 1e-100))[:, None]).sum(0)
                    moved, gamma = np.abs(new - gamma).mean(), new
                    if moved <= 1e-3:
                        break
                theta = np.exp(digamma(gamma) - digamma(gamma.sum()[None]))
                share = theta * beta[w]
                stat[w] += share * (tf / (share.sum(1) + 1e-100))[:, None]
                logs += digamma(gamma) - digamma(gamma.sum()[None])
            rho = (p.offset + n + seen) ** -p.decay
            left = max(1 - rho, O.LEAST_LEFT)
            lam = eta + left * (lam - eta) + rho * docs / len(own) * stat
            if p.alpha == "auto":
                alpha = O.newton_alpha(alpha, logs / len(own), len(own), rho)
            if n == 0:
                seen += len(own) / p.chunk_docs
    return {r.term: lam[at[r.id]] for r in terms}, alpha


@pytest.mark.parametrize("p", [
    O.OnlineParams(3, chunk_docs=20, passes=2, alpha="auto", compact_every=2),
    O.OnlineParams(2, chunk_docs=1000, passes=2, decay=0.7, offset=8.0, alpha=(0.3, 0.9), eta=0.2, block_values=150),
])
def test_against_dense(spark, tmp_dir, p):
    job = O.OnlineLda(spark, tmp_dir + "/fit", p)
    job.prepare(table(spark, bag_rows()))
    assert [n for n, _ in job.run()] == [1, 2]
    model = job.model()
    want, alpha = dense(job, p)
    got = {r.term: np.array(r.lam) for r in model.topics.collect()}
    assert set(got) == set(want) and all(np.allclose(got[t], want[t], rtol=1e-6) for t in want)
    assert np.allclose(model.alpha, alpha, rtol=1e-6) and (p.alpha == "auto") == (not np.allclose(alpha, alpha[0]) and p.alpha == "auto")
    assert np.allclose(model.totals, sum(got.values()), rtol=1e-6)
    # every document is in exactly one chunk
    assert job._bag().agg(F.count_distinct("doc_id"), F.count_distinct("doc_id", "chunk")).first()[:] == (62, 62)
    vec = topic_vectors(model, spark.createDataFrame([(0,), (1,), (7777,)], "doc_id long"), table(spark, bag_rows()))
    assert vec.count() == 3 and describe_topics(model, 2).count() == 2 * p.k


def test_killed_fit_goes_on(spark, tmp_dir):
    p = O.OnlineParams(3, chunk_docs=20, passes=3)
    whole = O.fit_online(table(spark, bag_rows()), tmp_dir + "/whole", p)

    class Killed(O.OnlineLda):
        left = 6  # updates until the kill: within the second pass

        def _update(self, *args):
            if not self.left:
                raise RuntimeError("killed")
            self.left -= 1
            return super()._update(*args)
    params, trials, scored = {"k": 3, "decay": 0.5}, tmp_dir + "/trials", []

    def score(model):
        scored.append(model)
        return float(sum(model.totals))
    job = Killed(spark, tmp_dir + "/fit", p)
    job.prepare(table(spark, bag_rows()))
    with pytest.raises(RuntimeError):
        tune.run_passes(spark, "s", params, job, trials, score)
    assert job.last_pass() == 1 and len(scored) == 1
    again = O.OnlineLda(spark, tmp_dir + "/fit", p)
    again.prepare(table(spark, []))  # the stored bag is used
    rows = {r["pass"]: r for r in tune.run_passes(spark, "s", params, again, trials, score).collect()}
    assert sorted(rows) == [1, 2, 3] and len(scored) == 3 and all(r.failed == 0 for r in rows.values())
    a, b = ({r.term: np.array(r.lam) for r in m.topics.collect()} for m in (whole, again.model()))
    assert all(np.allclose(a[t], b[t], rtol=1e-9) for t in a)
    # nothing is left to do: no pass is fitted or scored again
    assert tune.run_passes(spark, "s", params, again, trials, score).count() == 3 and len(scored) == 3


def test_stored_pass_without_score_is_scored(spark, tmp_dir):
    p = O.OnlineParams(2, chunk_docs=100, passes=1)
    O.fit_online(table(spark, bag_rows(n=9)), tmp_dir + "/fit", p)
    calls = []

    def fails_once(model):
        calls.append(1)
        if len(calls) == 1:
            raise ValueError("empty evaluation")
        return 0.5
    job = O.OnlineLda(spark, tmp_dir + "/fit", p)
    r = tune.run_passes(spark, "s", {"k": 2}, job, tmp_dir + "/trials", fails_once).first()
    assert (r.score, r.failed) == (None, 1)
    r = tune.run_passes(spark, "s", {"k": 2}, job, tmp_dir + "/trials", fails_once).first()
    assert (r.score, r.failed, r["pass"]) == (0.5, 1, 1)
    assert tune.run_passes(spark, "other", {"k": 2}, job, tmp_dir + "/trials", fails_once).count() == 1


def test_empty_bag(spark, tmp_dir):
    model = O.fit_online(table(spark, [(1, None, 3), (2, "a", 0)]), tmp_dir + "/fit", O.OnlineParams(2, passes=2))
    assert model.topics.count() == 0 and model.totals == [0.0, 0.0]


def test_trigamma():
    x = np.array([0.05, 0.7, 1.0, 3.3, 50.0])
    h = 1e-4
    assert np.allclose(O.trigamma(x), (digamma(x + h) - digamma(x - h)) / (2 * h), rtol=1e-4)
    assert abs(O.trigamma(np.array([1.0]))[0] - np.pi ** 2 / 6) < 1e-8
