"""Unanswered questions, repeated keys, long runs of y, as-of look-ups."""

from pyspark.sql import functions as F

from qalake.functions.stem import porter_stem
from qalake.operators.answers import answer_positions, list_counts
from qalake.operators.squad import _asof_token
from qalake.plans.queries import queries
from qalake.sources.questions import append_new_articles


def test_questions_without_a_prediction_stay(spark):
    preds = spark.createDataFrame([(1, 1, "x"), (1, 2, "b"), (3, 1, "z")], "qid long, rank int, answer string")
    gold = spark.createDataFrame([(1, 0, "B"), (1, 1, "c"), (2, 0, "d"), (2, 1, "e"), (2, 1, "f")],
                                 "qid long, grp int, synonym string")
    assert {tuple(r) for r in answer_positions(preds, gold).collect()} == {(1, 2), (2, 0), (3, 0)}
    assert {tuple(r) for r in list_counts(preds, gold).collect()} == {(1, 1, 1, 1), (2, 0, 0, 2), (3, 0, 1, 0)}
    asked = spark.createDataFrame([(2,), (9,)], "qid long")
    assert {tuple(r) for r in answer_positions(preds, gold, questions=asked).collect()} == {(2, 0), (9, 0)}
    assert {tuple(r) for r in list_counts(preds, gold, questions=asked).collect()} == {(2, 0, 0, 2), (9, 0, 0, 0)}


def test_a_repeated_key_is_stored_once(spark, tmp_dir):
    path = f"{tmp_dir}/articles"
    first = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "c"), (None, "d")], "pmid string, title string").coalesce(1)
    append_new_articles(spark, first, path)
    append_new_articles(spark, spark.createDataFrame([("2", "x"), ("3", "y"), ("3", "z")], "pmid string, title string").coalesce(1), path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [("1", "a"), ("2", "c"), ("3", "y")]


def test_a_long_run_of_y(spark):
    assert len(porter_stem("a" + "y" * 3000)) >= 2999
    assert [porter_stem(w) for w in ("syzygy", "toy", "happy", "yy", "by", "flying")] == ["syzygi", "toi", "happi", "yy", "by", "fly"]


def test_asof_both_ways(spark):
    toks = spark.createDataFrame([(1, i, 10 * i, 10 * i + 5) for i in range(50)], "c long, tok_idx int, s int, e int")
    probes = spark.createDataFrame([(1, k, p) for k, p in enumerate([0, 1, 9, 10, 255, 495, 600])], "c long, k long, p int")
    back = {r.k: r.o for r in _asof_token(toks, probes, ["c", "k"], ["c"], "s", "p", True, "o").collect()}
    fwd = {r.k: r.o for r in _asof_token(toks, probes, ["c", "k"], ["c"], "e", "p", False, "o").collect()}
    at = [0, 1, 9, 10, 255, 495, 600]
    assert back == {k: max((i for i in range(50) if 10 * i <= p), default=None) for k, p in enumerate(at)}
    assert fwd == {k: min((i for i in range(50) if 10 * i + 5 >= p), default=None) for k, p in enumerate(at)}


def test_stem_tokens_keeps_every_document(spark):
    sf = "/root/testdata/sf0.001"
    got = queries()["stem_tokens"](spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
