"""M1-M3, A5-A13 against brute force and the hand fixtures C4-C9."""

import math
import random

import pytest
from pyspark.sql import functions as F

from qalake.operators import metrics as M


def _brute_set(gold, pred):
    t, p = set(gold), set(pred)
    inter = len(t & p)
    prec = inter / len(p) if p else 0.0
    rec = inter / len(t) if t else 0.0
    f1 = 2 * prec * rec / (prec + rec) if prec + rec else 0.0
    # average precision over 0/1 scores on T u P, as a precision-recall curve sum
    u = t | p
    if not t:
        ap = 0.0
    else:
        pts = []
        if p:
            pts.append((rec, prec))
        pts.append((1.0, len(t) / len(u)))
        ap, last_r = 0.0, 0.0
        for r, pr in pts:
            ap += (r - last_r) * pr
            last_r = r
    return prec, rec, f1, ap


def _brute_rank_ap(gold, ranked, cutoff=10):
    hits, s = 0, 0.0
    for i, d in enumerate(ranked, 1):
        if d in gold:
            hits += 1
            s += hits / i
    den = min(len(set(ranked)), cutoff)
    return (s / den if den else 0.0) + 0.0001


def test_set_and_rank_metrics_match_brute_force(spark):
    rnd = random.Random(7)
    rows, expect = [], {}
    for q in range(300):
        universe = list(range(30))
        gold = set(rnd.sample(universe, rnd.randint(0, 6)))
        ranked = rnd.sample(universe, rnd.randint(0, 10))
        for r, d in enumerate(ranked, 1):
            rows.append((q, r, d, d in gold, len(gold)))
        if not ranked:
            rows.append((q, None, None, False, len(gold)))
        expect[q] = (_brute_set(gold, ranked), _brute_rank_ap(gold, ranked))
    df = spark.createDataFrame(rows, "q_id long, rank int, doc_id long, hit boolean, n_rel long")
    got = {r["q_id"]: r for r in M.per_question(df).collect()}
    for q, ((p, r, f, ap), rap) in expect.items():
        g = got[q]
        assert g["precision"] == pytest.approx(p)
        assert g["recall"] == pytest.approx(r)
        assert g["f1"] == pytest.approx(f)
        assert g["ap"] == pytest.approx(ap)
        assert g["rank_ap"] == pytest.approx(rap)


def test_c4_edge_cases(spark):
    # (hits, n_pred, n_gold) -> ap ; P empty & T not -> 1 ; T empty -> 0
    df = spark.createDataFrame([(0, 0, 3), (0, 5, 0), (2, 2, 2), (0, 4, 4)], "h long, p long, g long")
    out = df.select(M.set_ap(F.col("h"), F.col("p"), F.col("g")).alias("ap"),
                    M.f1(M.set_precision(F.col("h"), F.col("p")),
                         M.set_recall(F.col("h"), F.col("g"))).alias("f1")).collect()
    assert [r.ap for r in out] == [1.0, 0.0, 1.0, pytest.approx(0.5)]
    assert [r.f1 for r in out] == [0.0, 0.0, 1.0, 0.0]


def test_c6_gmap_zero_guard(spark):
    df = spark.createDataFrame([(0.5,), (0.0,), (0.25,)], "ap double")
    assert df.agg(M.gmap(F.col("ap")).alias("g")).first().g == 0.0
    df2 = spark.createDataFrame([(0.5,), (0.125,)], "ap double")
    assert df2.agg(M.gmap(F.col("ap")).alias("g")).first().g == pytest.approx(0.25)


def test_c8_positions_divide_by_all_rows(spark):
    df = spark.createDataFrame([(0,), (1,), (3,), (5,)], "pos int")
    r = df.agg(*M.factoid_aggs("pos", digits=None)).first()
    assert r.strict == pytest.approx(0.25)
    assert r.lenient == pytest.approx(0.75)
    assert r.mrr == pytest.approx((1 + 1 / 3 + 1 / 5) / 4)


def test_c9_list_nan_policy(spark):
    df = spark.createDataFrame([(0, 3, 5), (2, 0, 1), (0, 0, 4)], "tp long, fp long, fn long")
    per = df.select(*[c.alias(n) for n, c in M.list_prf_columns().items()])
    skip = per.agg(*M.list_aggs("skip", digits=None)).first()
    zero = per.agg(*M.list_aggs("zero", digits=None)).first()
    # F is undefined for every question with TP = 0; skip keeps only (2,0,1)
    assert skip.mean_f_measure == pytest.approx(2 * 1 * (2 / 3) / (1 + 2 / 3))
    assert zero.mean_f_measure == pytest.approx(skip.mean_f_measure / 3)
    # precision of (0,0,4) is undefined (0/0): skipped
    assert skip.mean_precision == pytest.approx(0.5)


def test_squad_em_f1(spark):
    rows = [(1, 0, "The cat sat.", "a cat sat"), (1, 1, "The cat sat.", "dog"),
            (2, 0, "the the", "the"), (3, 0, "red red blue", "red blue blue")]
    df = spark.createDataFrame(rows, "q long, gold_id long, prediction string, gold string")
    got = {r.q: r for r in M.squad_scores(df, ["q"]).collect()}
    assert got[1].em == 1.0 and got[1].f1 == 1.0
    assert got[2].em == 1.0 and got[2].f1 == 1.0  # both normalise to empty
    p, r = 2 / 3, 2 / 3
    assert got[3].f1 == pytest.approx(2 * p * r / (p + r))
    assert math.isclose(got[3].em, 0.0)


def test_array_set_metrics_and_binarize(spark):
    df = spark.createDataFrame([(1, ["a", "b", "b"], ["b", "c"]), (2, ["a"], []), (3, [], ["x"])],
                               "k long, gold array<string>, pred array<string>")
    cols = M.set_metrics_arrays(F.col("gold"), F.col("pred"))
    got = {r.k: r for r in df.select("k", *[c.alias(n) for n, c in cols.items()]).collect()}
    assert (got[1].precision, got[1].recall) == (0.5, 0.5)
    assert got[1].ap == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)
    assert got[2].ap == 1.0 and got[3].ap == 0.0
    b = {(r.k, r.label): (r.y_true, r.y_pred) for r in M.binarize_labels(df, "k", "gold", "pred").collect()}
    assert b[(1, "a")] == (1, 0) and b[(1, "b")] == (1, 1) and b[(1, "c")] == (0, 1)


def test_evaluate_and_gmap_eps(spark):
    ranked = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (2, 1, 12)], "q_id long, rank int, doc_id long")
    gold = spark.createDataFrame([(1, 11), (2, 99)], "q_id long, doc_id long")
    r = M.evaluate(ranked, gold).first()
    # set AP without a hit is |T|/|T u P| = 0.5 (M2), so GMAP = sqrt(0.5 * 0.5)
    assert r.n_questions == 2 and r.mean_recall == pytest.approx(0.5) and r.GMAP == pytest.approx(0.5)
    df = spark.createDataFrame([(0.0,), (1.0,)], "ap double")
    assert df.agg(M.gmap(F.col("ap"), eps=0.01).alias("g")).first().g == pytest.approx((0.01 * 1.01) ** 0.5)
