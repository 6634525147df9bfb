"""LDA at size: texts counted while packing, batches of documents, packed weights, leading terms; each failed before."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from qalake.llm.store import written
from qalake.operators import lda
from qalake.operators import topics as TP
from qalake.operators.textops import term_counts


def _texts(n=40):
    rnd = random.Random(7)
    rows = [(i, [f"w{rnd.randrange(25)}" for _ in range(rnd.randrange(1, 60))]) for i in range(n)]
    # a document in two rows, two rows without an id, and documents without a term
    return rows + [(3, ["w1", "new"]), (None, ["w1", "w1", "w2"]), (None, ["w1"]), (n, []), (n + 1, None)]


def _lines(spark, rows):
    toks = spark.createDataFrame(rows, "doc_id long, toks array<string>")
    return toks, toks.select("doc_id", F.greatest(F.size("toks"), F.lit(0)).alias("len"), F.array_join("toks", " ").alias("line"))


def _entries(b):
    names = {r.id: r.term for r in b.terms.collect()}
    tiles = b.tiles.collect()
    terms = {r.block: r.terms for r in tiles if r.tile == 0}
    return sorted((str(d), names[terms[r.block][c]], n) for r in tiles
                  for d, c, n in zip([d for d, s in zip(r.docs, r.sizes) for _ in range(s)], r.codes, r.n))


def test_lines_are_counted_as_the_bag(spark, monkeypatch):
    monkeypatch.setattr(lda, "TILE_VALUES", 60)
    monkeypatch.setattr(lda, "BLOCK_VALUES", 300)
    toks, lines = _lines(spark, _texts())
    bag = term_counts(toks)
    b = lda.line_blocks(lines, 3)
    assert _entries(b) == sorted((str(r.doc_id), r.term, float(r.tf)) for r in bag.collect())
    want = bag.groupBy("term").agg(F.count("*").alias("n"), F.sum("tf").alias("cf")).collect()
    assert sorted((r.term, r.n, r.cf) for r in b.terms.collect()) == sorted((r.term, r.n, float(r.cf)) for r in want)
    one, two = (lda.fit(x, 3, 2) for x in (b, lda.blocks(bag, 3)))
    one, two = ({r.term: r.lam for r in m.topics.collect()} for m in (one, two))
    assert set(one) == set(two) and all(np.allclose(one[t], two[t], rtol=1e-6) for t in one)


@pytest.mark.parametrize("rows", [[], [(1, [])], [(None, ["a"])], [(1, ["a"]), (1, ["a"])]])
def test_lines_of_few_rows(spark, rows):
    toks, lines = _lines(spark, rows)
    b = lda.line_blocks(lines, 2)
    assert _entries(b) == sorted((str(r.doc_id), r.term, float(r.tf)) for r in term_counts(toks).collect())
    assert lda.describe_topics(lda.fit(b, 2, 2), 3).count() == 2 * b.terms.count()


def test_blanks_beside_each_other_make_no_term(spark):
    lines = spark.createDataFrame([(1, 2, " a  b a"), (2, 1, "a "), (3, 0, " ")], "doc_id long, len int, line string")
    assert _entries(lda.line_blocks(lines, 2)) == [("1", "a", 2.0), ("1", "b", 1.0), ("2", "a", 1.0)]


def test_batches_hold_documents_of_one_size():
    size = np.random.default_rng(1).integers(1, 400, 500)
    dealt = list(lda.batches(size, 2000))
    assert sorted(np.concatenate(dealt)) == list(range(500))
    assert all(len(d) == 1 or size[d].max() * len(d) <= 2000 for d in dealt)
    assert all(size[d].max() <= max(size[d].min() * lda.LONGER, size[d].min() + 8) for d in dealt)
    assert sum(size[d].max() * len(d) for d in dealt) < 1.2 * size.sum()


def test_e_step_equals_one_document_alone(monkeypatch):
    monkeypatch.setattr(lda, "TILE_VALUES", 600)
    rng = np.random.default_rng(2)
    size = rng.integers(1, 50, 80)
    code = np.concatenate([rng.choice(60, s, replace=False) for s in size])
    n, alpha, beta = rng.integers(1, 5, len(code)).astype(float), np.full(4, 0.25), rng.random((60, 4))
    gamma, theta, share = lda.e_step(size, code, n, beta, alpha)
    stat = np.zeros_like(beta)
    for d, (s, e) in enumerate(zip(np.cumsum(size) - size, np.cumsum(size))):
        g, b = alpha + n[s:e].sum() / 4, beta[code[s:e]]
        for _ in range(lda.MAX_STEPS):
            t = np.exp(lda.digamma(g) - lda.digamma(g.sum()))
            new = alpha + t * ((n[s:e] / (b @ t)) @ b)
            moved, g = np.abs(new - g).mean(), new
            if moved <= lda.TOLERANCE:
                break
        assert np.allclose(gamma[d], g, rtol=1e-9)
        t = np.exp(lda.digamma(g) - lda.digamma(g.sum()))
        stat[code[s:e]] += (n[s:e] / (b @ t))[:, None] * t * b
    assert np.allclose(lda.by_term(size, code, share, theta, beta), stat, rtol=1e-9)


def test_weights_travel_many_to_a_row_and_earlier_ones_go(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(lda, "written", lambda df, name: kept.append((name, written(df, name))) or kept[-1][1])
    b = lda.line_blocks(_lines(spark, _texts())[1], 3)
    model = lda.fit(b, 3, 3)
    n_blocks, homes = b.tiles.select("block").distinct().count(), lda._homes(b, 3)
    assert b.pairs > 2 * (n_blocks + 1) * homes >= 2 * model.placed[1].count()
    weights = [df for name, df in kept if name == "lda-weights"]
    fs = [spark._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0].rpartition("/")[0]) for df in weights]
    assert [p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) for p in fs] == [False, False, True]


def test_rows_of_weights_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(lda, "ROW_VALUES", 6)
    b = lda.line_blocks(_lines(spark, _texts())[1], 3)
    model = lda.fit(b, 3, 2)
    assert max(len(r.lam) for r in model.placed[1].collect()) <= 6 * 8
    monkeypatch.undo()
    other = {r.term: r.lam for r in lda.fit(b, 3, 2).topics.collect()}
    assert all(np.allclose(r.lam, other[r.term]) for r in model.topics.collect())


def test_leading_terms_are_those_of_all(spark, tmp_dir):
    b = lda.line_blocks(_lines(spark, _texts())[1], 3)
    model = lda.fit(b, 3, 2)
    phi = {(r.topic, r.term): r.phi for r in lda.topic_terms(model).collect()}
    for m in (model, lda.LdaModel(model.topics, model.totals, model.alpha)):
        got = [(r.topic, r["rank"], r.term) for r in lda.describe_topics(m, 4).orderBy("topic", "rank").collect()]
        assert got == [(t, i + 1, w) for t in range(3)
                       for i, (_, w) in enumerate(sorted((-p, w) for (u, w), p in phi.items() if u == t)[:4])]
        assert lda.best_terms(m, 4).count() < len(phi)
    p = b.terms.select("term", (F.col("cf") / b.terms.agg(F.sum("cf")).scalar()).alias("p"))
    some = lda.relevant_terms(model, p, 0.6, 4)
    assert some.count() < len(phi)
    got, want = ([tuple(r) for r in TP.term_relevance(x, p, 0.6, 4).orderBy("topic", "rank").collect()] for x in (some, lda.topic_terms(model)))
    assert [r[:3] for r in got] == [r[:3] for r in want] and np.allclose([r[3] for r in got], [r[3] for r in want])


def test_equal_values_stay_among_the_leading():
    values = np.array([[1.0], [3.0], [2.0], [2.0], [0.0], [np.nan]])
    assert lda._leading(values[:5], 2)[:, 0].tolist() == [False, True, True, True, False]
    assert lda._leading(values, 2).sum() >= 2 and lda._leading(values, 7).all()


def test_even_ids_are_dealt_evenly(spark):
    ids = lda.even_ids(spark, 8)   # eight shuffle partitions
    at = spark.createDataFrame([(i,) for i in ids], "id long").select(F.pmod(F.hash("id"), F.lit(8)).alias("at"))
    assert len(set(ids)) == 8 and at.distinct().count() == 8
    assert lda.even_ids(spark, 100) == list(range(100))


def test_vectors_of_fitted_documents_take_the_last_weights(spark, monkeypatch):
    toks, lines = _lines(spark, _texts())
    b = lda.line_blocks(lines, 3)
    model = lda.fit(b, 3, 2)
    fresh = lda.LdaModel(model.topics, model.totals, model.alpha)
    want = {r.doc_id: r.vec for r in lda.topic_vectors(fresh, toks.where("doc_id is not null").distinct(), b, 0.0).collect()}
    monkeypatch.setattr(lda, "_weights", None)   # no join of blocks and terms
    got = {r.doc_id: r.vec for r in lda.topic_vectors(model, toks.where("doc_id is not null").distinct(), b, 0.0).collect()}
    assert set(got) == set(want) and len(got) == 42 and all(np.allclose(got[d], want[d]) for d in want)
