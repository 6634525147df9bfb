"""Plan assertions over every registered query."""

import os

import pytest

from qalake.plans.queries import queries

SF = "/root/testdata/sf0.001"
FIT_QUERIES = {"lda_topics", "lda_retrieve", "topic_relevance", "lda_eval"}  # fit a model when called
TOPK = {"retrieve_topk_cosine", "top_per_batch", "nbest_spans", "answer_position", "coherence_umass"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
@pytest.mark.parametrize("name", sorted(set(queries()) - FIT_QUERIES))
def test_plan_has_no_cartesian_or_row_udf(spark, name):
    df = queries()[name](spark, SF)
    qe = df._jdf.queryExecution()
    physical = qe.executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in physical, f"{name}: {bad}"
    if name in TOPK:
        assert "WindowGroupLimit" in qe.optimizedPlan().toString(), name


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
def test_scans_are_pruned(spark):
    df = queries()["ingest_anti"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # documents is read for doc_id and lang only, never its text
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in plan or "text" not in plan.split("documents")[1][:400]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
@pytest.mark.parametrize("name", sorted(set(queries()) - FIT_QUERIES))
def test_documents_scanned_a_few_times_at_most(spark, name):
    """Sub-results read by several branches are kept, not recomputed: no plan
    scans the (text-heavy) documents table more than four times."""
    import contextlib
    import io
    import re
    df = queries()[name](spark, SF)
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    scans = re.findall(r"^\(\d+\) Scan parquet.*?Location: [^\n]*", text, flags=re.M | re.S)
    doc_scans = [s for s in scans if "documents.parquet" in s]
    assert len(doc_scans) <= 4, f"{name}: {len(doc_scans)} scans of documents"
