"""J3, J13 + X1, X6, X10, S4, S10."""

import os

from pyspark.sql import functions as F

from qalake.operators import answers as A
from qalake.operators import contexts as CX
from qalake.operators import squad as Q
from qalake.sources import questions, sinks


def test_j3_first_per_pmid(spark):
    docs = spark.createDataFrame([("1", 0, "first"), ("1", 5, "later"), ("2", 3, "only")],
                                 "pmid string, doc_pos long, abstractText string")
    got = {r.pmid: r.abstractText for r in CX.first_per_pmid(docs).collect()}
    assert got == {"1": "first", "2": "only"}


def test_j13_synonyms_then_x1(spark):
    answers = spark.createDataFrame([("q1", "heart attack"), ("q2", "cancer")], "id string, answer string")
    syn = spark.createDataFrame([("heart attack", "myocardial_infarction", 0), ("cancer", "tumour", 0),
                                 ("cancer", "neoplasm", 1)], "term string, synonym string, syn_order int")
    words = CX.expand_synonyms(answers, syn)
    ctx = spark.createDataFrame([("q1", "After a Myocardial infarction the ..."), ("q2", "a benign neoplasm")],
                                "id string, context string")
    located = A.locate_with_synonyms(words.join(ctx, "id"), ["id"])
    got = {r.id: (r.start, r.matched) for r in located.collect()}
    assert got == {"q1": (8, "myocardial infarction"), "q2": (9, "neoplasm")}


def test_x6_mask_offsets(spark):
    df = spark.createDataFrame([([(0, 0), (0, 3), (4, 7), (0, 0)], [None, 0, 1, None])],
                               "o array<struct<s:int,e:int>>, seq array<int>")
    r = df.select(Q.mask_offsets(F.col("o"), F.col("seq")).alias("m")).first().m
    assert r[0] is None and r[1] is None and (r[2].s, r[2].e) == (4, 7) and r[3] is None


def test_x10_template_and_json_lines(spark, tmp_dir):
    preds = spark.createDataFrame([("q1", 2, "b"), ("q1", 1, "a")], "id string, rank int, answer string")
    qs = spark.createDataFrame([("q1", "Which?", "factoid", [["a"]]), ("q2", "What?", "list", [["x"], ["y"]])],
                               "id string, body string, type string, exact_answer array<array<string>>")
    f = {r.id: r for r in CX.judging_template(preds, qs, "factoid").collect()}
    assert f["q1"].predicted_answers == '[["a"],["b"]]' and f["q1"].predicted_answer_pos == "?"
    assert f["q2"].predicted_answers is None
    lst = CX.judging_template(preds, qs, "list")
    assert {"TP", "FP", "FN"} <= set(lst.columns)
    out = os.path.join(tmp_dir, "squad")
    sinks.write_json_lines(lst, out)
    assert spark.read.json(out).count() == 2


def test_s4_resumable_append(spark, tmp_dir):
    path = os.path.join(tmp_dir, "articles")
    schema = "pmid string, title string, abstractText string, journal string, meshMajor array<string>, year string"
    a = spark.createDataFrame([("1", "t1", "x", None, None, "2020"), ("2", "t2", None, None, None, None)], schema)
    b = spark.createDataFrame([("2", "t2b", "y", None, None, None), ("3", "t3", "z", None, None, None)], schema)
    assert questions.append_new_articles(spark, a, path).count() == 2
    new = questions.append_new_articles(spark, b, path)
    assert sorted(r.pmid for r in questions.load_articles(spark, path).collect()) == ["1", "2", "3"]
    # the stored row for "2" is kept (skip keys already stored)
    assert questions.load_articles(spark, path).where("pmid = '2'").first().title == "t2"
    _ = new


def test_j7_contexts_by_ranking_and_p11(spark):
    import pytest
    from qalake.operators import prep as P
    ranked = spark.createDataFrame([(1, 1, 10), (1, 2, 11)], "q_id long, rank int, doc_id long")
    docs = spark.createDataFrame([(10, "ten"), (11, "eleven")], "doc_id long, text string")
    got = sorted((r.id, r.ctx_pos, r.context) for r in CX.contexts("by_lda", ranked=ranked, docs=docs).collect())
    assert got == [(1, 0, "ten"), (1, 1, "eleven")]
    assert P.require_columns(docs, ["doc_id"]) is docs
    with pytest.raises(ValueError):
        P.require_columns(docs, ["doc_id", "pmid"])


def test_t14_checkpoint_scores():
    from qalake.operators import tune
    assert tune.checkpoint_scores(lambda it: it / 10, [1, 5]) == [(1, 0.1), (5, 0.5)]


def test_spread_only_small_split_scans(spark, tmp_dir):
    from qalake.sources.tables import spread
    small = spark.range(10).coalesce(1)
    assert "RoundRobinPartitioning" in spread(small, 4)._jdf.queryExecution().executedPlan().toString()
    wide = spark.range(100).repartition(8)
    assert spread(wide, 4) is wide


def test_cluster_conf_sizes_partitions():
    from qalake.session import cluster_conf
    c = cluster_conf(100 << 40, cores=8000)          # 100 TB over 8000 cores
    assert int(c["spark.sql.shuffle.partitions"]) == (100 << 40) // (128 << 20)
    assert int(cluster_conf(1 << 20, cores=8)["spark.sql.shuffle.partitions"]) == 16
    assert c["spark.sql.files.maxPartitionBytes"] == str(256 << 20)
