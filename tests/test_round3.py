"""Bounds of the steps mended after round 3; each failed before."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from qalake.operators import lda
from qalake.operators import retrieve as RT
from qalake.operators import topics as TP


def test_bag_is_stored_packed_and_once(spark, monkeypatch):
    rnd = random.Random(4)
    rows = [(d, f"w{t}", rnd.randrange(1, 4)) for d in range(50) for t in rnd.sample(range(40), 12)]
    rows += [(None, "w1", 2), (None, "w2", 1), (60, None, 5)]
    bag = spark.createDataFrame(rows, "doc_id long, term string, tf long")
    monkeypatch.setattr(lda, "TILE_VALUES", 60)
    b = lda.blocks(bag, 3)
    tiles = b.tiles.collect()
    assert sum(len(r.codes) for r in tiles) == 602 and max(len(r.codes) for r in tiles) < 20 + 12
    terms = {r.block: r.terms for r in tiles if r.tile == 0}
    assert b.pairs == sum(map(len, terms.values()))
    names = {r.id: r.term for r in b.terms.collect()}
    got = [(d, names[terms[r.block][c]], n) for r in tiles
           for d, c, n in zip([d for d, s in zip(r.docs, r.sizes) for _ in range(s)], r.codes, r.n)]
    assert sorted(map(str, got)) == sorted(str((d, t, float(n))) for d, t, n in rows if t)
    # rows without a document are one document each, and the fit shares out every count
    model = lda.fit(b, 3, 2)
    assert abs(sum(model.totals) - (bag.where("term is not null").agg(F.sum("tf")).first()[0] + 40)) < 1e-6


def test_equal_hashes_take_another_salt(spark, monkeypatch):
    real, tried = F.xxhash64, []

    def clashes(*cols):
        tried.append(cols)
        return F.lit(7).cast("long") if len(tried) == 1 else real(*cols)
    monkeypatch.setattr(lda.F, "xxhash64", clashes)
    terms, salt = lda.hashed_terms(spark.createDataFrame([("a", 1), ("b", 2)], "term string, n long"))
    assert salt == 2 and terms.select("id").distinct().count() == 2


def test_cosine_task_holds_little():
    rng = np.random.default_rng(1)
    def table(name, n):
        import pandas as pd
        return pd.DataFrame({name: np.arange(n), "vec": list(rng.normal(size=(n, 8)))})
    q, d = table("q_id", 2100), table("doc_id", 8200)
    tracemalloc.start()
    RT._score_blocks(5, True)(q, d)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 130e6


def test_window_counts_make_two_rows_an_occurrence(spark):
    # 70 words: more than one long of a mask; a word of two groups; a group without name
    rnd = random.Random(2)
    docs = {d: [f"t{rnd.randrange(90)}" for _ in range(rnd.randint(1, 40))] for d in range(20)}
    rows = [(d, len(ts) - 1, p, t) for d, ts in docs.items() for p, t in enumerate(ts)]
    tl = spark.createDataFrame(rows, "doc_id long, last int, pos int, term string")
    top = spark.createDataFrame([("a", r, f"t{r}") for r in range(70)] + [("b", 1, "t3"), (None, 1, "t4")], "g string, rank int, term string")
    want1, want2 = {}, {}
    for ts in docs.values():
        for s in range(max(len(ts) - 5 + 1, 1)):
            held = sorted({int(t[1:]) for t in ts[s:s + 5] if int(t[1:]) < 70})
            for i, a in enumerate(held):
                want1["a", a] = want1.get(("a", a), 0) + 1
                for b in held[i + 1:]:
                    want2["a", a, b] = want2.get(("a", a, b), 0) + 1
    want1["b", 1], want1[None, 1] = want1["a", 3], want1["a", 4]
    for given in (tl, tl.drop("last")):
        p1, p2, _ = TP.window_counts(given, top, 5, "g")
        assert {(r.g, r["rank"]): r.c1 for r in p1.collect()} == want1
        assert {(r.g, r.ra, r.rb): r.c2 for r in p2.collect()} == want2
    plan = p2._jdf.queryExecution().analyzed().toString()
    assert "Union" not in plan   # occurrences are not copied to pairs
