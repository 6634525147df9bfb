"""Long-table LDA against a plain one-process version of the same updates."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from qalake.operators import lda
from qalake.operators.textops import term_counts


def _docs(spark, n=60):
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, [rnd.choice(words[:15] if i % 2 else words[15:]) for _ in range(20)]) for i in range(n)]
    rows += [(n, []), (n + 1, None)]
    return spark.createDataFrame(rows, "doc_id long, toks array<string>")


def _brute_pass(bag, lam, alpha, eta):
    """One pass, document by document."""
    terms = sorted(lam)
    base = lda.digamma(sum(lam[t] for t in terms))
    beta = {t: np.exp(lda.digamma(lam[t]) - base) for t in terms}
    out = {t: np.full(len(alpha), eta) for t in terms}
    for words in bag.values():
        gamma = alpha + sum(words.values()) / len(alpha)
        for _ in range(lda.MAX_STEPS):
            theta = np.exp(lda.digamma(gamma) - lda.digamma(gamma.sum()))
            new = alpha + sum(n * theta * beta[t] / (theta @ beta[t]) for t, n in words.items())
            moved, gamma = np.abs(new - gamma).mean(), new
            if moved <= lda.TOLERANCE:
                break
        theta = np.exp(lda.digamma(gamma) - lda.digamma(gamma.sum()))
        for t, n in words.items():
            out[t] = out[t] + n * theta * beta[t] / (theta @ beta[t])
    return out


def test_digamma():
    # psi(1) = -Euler's constant; psi(x + 1) = psi(x) + 1/x
    assert abs(lda.digamma(np.array([1.0]))[0] + 0.5772156649015329) < 1e-9
    x = np.array([1e-3, 0.1, 0.5, 3.0, 7.5, 400.0])
    assert np.allclose(lda.digamma(x + 1), lda.digamma(x) + 1 / x, rtol=1e-9)


@pytest.mark.parametrize("values", [60, 1_000_000])  # many blocks, one block
def test_passes_equal_brute_force(spark, monkeypatch, values):
    monkeypatch.setattr(lda, "BLOCK_VALUES", values)
    counts = term_counts(_docs(spark))
    bag = {}
    for r in counts.collect():
        bag.setdefault(r.doc_id, {})[r.term] = r.tf
    first, second = [{r.term: np.array(r.lam) for r in m.topics.collect()} for m in lda.passes(counts, 3, 2)]
    want = _brute_pass(bag, first, np.full(3, 1 / 3), 1 / 3)
    assert set(second) == set(want)
    assert all(np.allclose(second[t], want[t], rtol=1e-6) for t in want)


def test_fit_keeps_vocabulary_and_every_document(spark, tmp_dir):
    docs = _docs(spark)
    bag = term_counts(docs)
    model = lda.fit(bag, 3, 5, seed=3)
    assert model.topics.count() == bag.select("term").distinct().count()
    # all mass is shared out: every occurrence, and eta per term and topic
    n_terms = model.topics.count()
    assert abs(sum(model.totals) - (bag.agg(F.sum("tf")).first()[0] + n_terms)) < 1e-6
    top = lda.describe_topics(model, 5).collect()
    assert len(top) == 15 and {r["rank"] for r in top} == {1, 2, 3, 4, 5}
    phi = lda.topic_terms(model).groupBy("topic").agg(F.sum("phi").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-9 for r in phi)
    vec = {r.doc_id: r.vec for r in lda.topic_vectors(model, docs, bag, 0.0).collect()}
    assert len(vec) == 62 and all(abs(sum(v) - 1) < 1e-9 for v in vec.values())
    assert np.allclose(vec[60], 1 / 3) and np.allclose(vec[61], 1 / 3)
    # documents of the two word sets do not share their main topic
    main = {d: int(np.argmax(v)) for d, v in vec.items() if d < 60}
    assert not {main[d] for d in main if d % 2} & {main[d] for d in main if not d % 2}
    path = os.path.join(tmp_dir, "lda")
    lda.save(model, path)
    again = {r.doc_id: r.vec for r in lda.topic_vectors(lda.load(spark, path), docs, bag, 0.0).collect()}
    assert all(np.allclose(again[d], vec[d]) for d in vec)


def test_unknown_terms_and_empty_bag(spark):
    docs = _docs(spark)
    model = lda.fit(term_counts(docs), 2, 1)
    new = spark.createDataFrame([(1, ["none", "such"]), (2, ["w1", "none"])], "doc_id long, toks array<string>")
    vec = {r.doc_id: r.vec for r in lda.topic_vectors(model, new, term_counts(new), 0.0).collect()}
    assert vec[1] == [0.5, 0.5] and vec[2] != vec[1]
    empty = term_counts(docs.limit(0))
    assert lda.fit(empty, 2, 1).topics.count() == 0
