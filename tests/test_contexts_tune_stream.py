"""Context sources + reader (X9), trial table resume (T15/T16), streaming ingest."""

import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from qalake.operators import contexts as CX
from qalake.operators import tune
from qalake.schemas import ARTICLE
from qalake.streaming.ingest import ingest_stream


def _reader(pdf: pd.DataFrame) -> pd.DataFrame:
    """Toy reader: every capitalised word of the context, scored by length."""
    rows = []
    for _, r in pdf.iterrows():
        for w in r["context"].split():
            if w[:1].isupper():
                rows.append((r["id"], w.strip(".,"), float(len(w))))
    return pd.DataFrame(rows, columns=["id", "answer", "score"])


def test_predict_ranks_and_dedups(spark):
    q = spark.createDataFrame([("q1", "Which?", [{"text": "Alpha beta Gamma.", "document": None,
                                                   "offsetInBeginSection": None, "offsetInEndSection": None},
                                                  {"text": "Gamma Delta", "document": None,
                                                   "offsetInBeginSection": None, "offsetInEndSection": None}])],
                              "id string, body string, snippets array<struct<text:string,document:string,"
                              "offsetInBeginSection:bigint,offsetInEndSection:bigint>>")
    ctx = CX.contexts("by_snippets", questions=q)
    got = [(r["rank"], r.answer) for r in CX.predict(q, ctx, _reader, k=5).orderBy("rank").collect()]
    assert got == [(1, "Gamma"), (2, "Alpha"), (3, "Delta")]
    with pytest.raises(ValueError):
        CX.contexts("by_magic")


def test_trials_resume_and_best(spark, tmp_dir):
    path = os.path.join(tmp_dir, "trials")
    cands = tune.grid_space({"k": [10, 20, 30], "passes": [1]})
    calls = []

    def objective(p):
        calls.append(p["k"])
        if p["k"] == 20:
            raise ValueError("diverged")
        return 1.0 / p["k"]

    tune.run_study(spark, "s1", cands, path, objective, max_trials=2)
    assert calls == [10.0, 20.0]
    t = tune.run_study(spark, "s1", cands, path, objective)
    # resumed: 10 is done, 20 failed once and is retried, 30 is new
    assert calls == [10.0, 20.0, 20.0, 30.0]
    assert t.where(F.col("state") == "FAIL").count() == 2
    best = tune.best_trial(t).first()
    assert best.best_value == pytest.approx(0.1) and best.best_params["k"] == 10.0
    assert len(tune.sample_space({"k": ("int", 10, 100), "a": ("cat", ["x", "y"])}, 5, seed=1)) == 5


def test_streaming_ingest_is_incremental(spark, tmp_dir):
    landing, table = os.path.join(tmp_dir, "landing"), os.path.join(tmp_dir, "articles")
    os.makedirs(landing)

    def drop(name, pmids):
        with open(os.path.join(landing, name), "w") as f:
            for p in pmids:
                f.write(json.dumps({"pmid": p, "title": f"t{p}", "abstractText": "x"}) + "\n")

    drop("a.json", ["1", "2", "2"])
    ingest_stream(spark, landing, table, ARTICLE, name="t_ingest_" + os.path.basename(tmp_dir)).awaitTermination()
    drop("b.json", ["2", "3"])
    ingest_stream(spark, landing, table, ARTICLE, name="t_ingest_" + os.path.basename(tmp_dir)).awaitTermination()
    got = sorted(r.pmid for r in spark.read.schema(ARTICLE).parquet(table).collect())
    assert got == ["1", "2", "3"]


def test_lda_study_end_to_end(spark, tmp_dir):
    """SURVEY 3.1: sample params -> fit -> retrieve -> MAP -> trial rows; resumable."""
    from qalake.functions.text import tokens
    from qalake.plans import standins as S
    from qalake.sources.tables import Tables
    t = Tables(spark, "/root/testdata/sf0.001")
    docs = t.documents.select("doc_id", tokens("text").alias("toks")).where(F.size("toks") > 0)
    qs = t.benchmark.select(F.col("item_id").alias("doc_id"), tokens("text").alias("toks"))
    gold = S.gold_links(t).select(F.col("item_id").alias("q_id"), "doc_id")
    obj = tune.lda_objective(qs, docs, gold, vocab_size=300)
    cands = tune.sample_space({"num_topics": ("int", 2, 6), "passes": ("int", 1, 2),
                               "chunksize": ("int", 50, 200)}, 2, seed=4)
    path = os.path.join(tmp_dir, "study")
    t1 = tune.run_study(spark, "lda", cands, path, obj)
    assert t1.where(F.col("state") == "COMPLETE").count() == 2
    t2 = tune.run_study(spark, "lda", cands, path, obj)   # nothing left to do
    assert t2.count() == 2
    best = tune.best_trial(t2).first()
    assert 0.0 <= best.best_value <= 1.0
