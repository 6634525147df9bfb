"""Window co-occurrence counts vs brute force; LDA fit, labels, save/load."""

import os
import random

import pytest
from pyspark.sql import functions as F

from qalake.operators import topics as TP


def _brute_counts(docs, top, w):
    """Enumerate every window explicitly."""
    c1, c2, W = {}, {}, 0
    for toks in docs.values():
        n = len(toks)
        nwin = max(n - w + 1, 1)
        W += nwin
        for s in range(nwin):
            present = {top[t] for t in toks[s:s + w] if t in top}
            for r in present:
                c1[r] = c1.get(r, 0) + 1
            for a in present:
                for b in present:
                    if a < b:
                        c2[(a, b)] = c2.get((a, b), 0) + 1
    return c1, c2, W


@pytest.mark.parametrize("w", [1, 3, 10])
def test_window_counts_match_enumeration(spark, w):
    rnd = random.Random(w)
    vocab = list("abcdefgh")
    docs = {i: [rnd.choice(vocab) for _ in range(rnd.randint(1, 30))] for i in range(25)}
    top = {"a": 1, "b": 2, "c": 3, "d": 4}
    tl = spark.createDataFrame([(d, p, t) for d, ts in docs.items() for p, t in enumerate(ts)],
                               "doc_id long, pos int, term string")
    tp = spark.createDataFrame([(0, r, t) for t, r in top.items()], "topic int, rank int, term string")
    p1, p2, W = TP.window_counts(tl, tp, w)
    c1, c2, Wb = _brute_counts(docs, top, w)
    assert spark.range(1).select(W.alias("w")).first().w == Wb
    assert {r["rank"]: r.c1 for r in p1.collect()} == c1
    assert {(r.ra, r.rb): r.c2 for r in p2.collect() if r.c2} == c2


def test_lda_fit_labels_and_reload(spark, tmp_dir):
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(30)]
    rows = [(i, [rnd.choice(words[:15] if i % 2 else words[15:]) for _ in range(20)]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, toks array<string>")
    cv = TP.count_vectors(docs, vocab_size=25)
    vocab = TP.vocabulary_table(cv)
    vec = cv.transform(docs)
    model = TP.fit_lda(vec, TP.LdaParams(k=3, max_iter=5, subsampling_rate=1.0, seed=3))
    top = TP.describe_topics(model, vocab, 5)
    assert top.count() == 15
    labels = {r.topic: r.label for r in TP.topic_labels(top).collect()}
    assert len(labels) == 3 and all(len(v.split(", ")) == 5 for v in labels.values())
    mix = TP.topic_mix(model, vec, min_probability=0.0)
    sums = mix.groupBy("doc_id").agg(F.sum("w").alias("s")).collect()
    assert all(abs(r.s - 1.0) < 1e-6 for r in sums)  # topic mixes sum to 1
    path = os.path.join(tmp_dir, "lda")
    TP.save_model(model, path)
    again = TP.load_model(path)
    a = {r.doc_id: r.td for r in model.transform(vec).select("doc_id", F.col("topicDistribution").alias("td")).collect()}
    b = {r.doc_id: r.td for r in again.transform(vec).select("doc_id", F.col("topicDistribution").alias("td")).collect()}
    assert all((a[k] - b[k]).norm(1) < 1e-9 for k in a)


def test_reference_parameter_mapping():
    p = TP.lda_params_from_reference(num_topics=1390, chunksize=2510, passes=5, n_docs=10000)
    assert p.k == 1390 and p.max_iter == 20 and abs(p.subsampling_rate - 0.251) < 1e-12
    assert TP.lda_params_from_reference(10, 100, 3, 1000, update_every=0).subsampling_rate == 1.0
    asym = TP.lda_params_from_reference(4, 100, 1, 100, alpha="asymmetric").doc_concentration
    assert abs(sum(asym) - 1.0) < 1e-12 and asym[0] > asym[-1]
