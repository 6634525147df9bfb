"""Registered queries: SQL twins on a small table, and the pipeline against its parts."""

import os

import duckdb
import pytest

import __spark_entry__ as E
import corpus_pipeline as P
from qalake.llm.queries import oracle_sql

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


def test_names():
    numbers = sorted(int(n[2:].split("_")[0]) for n in E.queries() if n.startswith("op") and n[2].isdigit())
    assert numbers == list(range(1, 14)) and "pipeline" in E.queries()
    assert set(oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql_twin(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = E.queries()[name](spark, SF)
    cols = sorted(got.columns)
    rows = sorted((tuple(r[c] for c in cols) for r in got.collect()), key=repr)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({oracle_sql()[name]})").fetchall()
    assert rows == sorted(want, key=repr)


def test_pipeline_stages(spark):
    """Each stage keeps what its operator says, judged on its own input."""
    from qalake.llm import decontam, jaccard
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in P.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SF).cache()
        assert kept.columns == P.COLUMNS
        ids = {r.doc_id for r in kept.select("doc_id").collect()}
        own = {r.doc_id for r in before.select("doc_id").collect()}
        assert ids <= own
        if name == "language":
            assert len(ids) >= 0.95 * len(own)
        if name == "near_duplicates":
            assert ids == {r.doc_id for r in jaccard.join(before).collect() if r.doc_id == r.component_id}
        if name == "decontaminate":
            bench = spark.read.parquet(f"{SF}/benchmark.parquet")
            assert own - ids == {r.doc_id for r in decontam.contamination(before, bench).collect() if r.contaminated}
        if name == "scrub_secrets":
            assert ids == own
            texts = {r.doc_id: r for r in kept.collect()}
            assert not any("token = \"" in r.text and "[SECRET]" not in r.text for r in texts.values())
            assert all(r.n_chars == len(r.text) for r in texts.values())
    pieces = P.STAGES[-1][1](spark, kept, SF)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == ids
    def tokens(df):
        return {(r.doc_id, r.doc_tokens) for r in df.select("doc_id", "doc_tokens").collect()}
    assert tokens(pieces) == tokens(P.run(spark, SF))


def test_pipeline_takes_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF).count() == 0
