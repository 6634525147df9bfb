"""Driver contract: entry(), queries(), oracle_sql() and a DuckDB cross-check."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from qalake.plans.oracle import oracle_sql
from qalake.plans.queries import queries

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "benchmark", "labels", "pages", "conversations", "embeddings", "events"]
ROWS_ONLY = {"stem_tokens", "lda_topics", "lda_online_topics", "lda_retrieve", "topic_relevance", "lda_eval"}


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert "mean_precision" in df.columns and "GMAP" in df.columns


def test_every_query_has_an_oracle_or_is_documented_rows_only():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert set(queries()) <= set(E.queries())
    assert set(queries()) - set(oracle_sql()) == ROWS_ONLY


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if hasattr(v, "isoformat"):
        return str(v)
    return v


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_oracle_sf0001(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    sdf = E.queries()[name](spark, SF)
    cols = sorted(sdf.columns)
    s_rows = sorted((tuple(_norm(r[c]) for c in cols) for r in sdf.collect()), key=repr)
    res = con.execute(E.oracle_sql()[name])
    d_cols = [d[0] for d in res.description]
    assert sorted(d_cols) == cols
    d_rows = sorted((tuple(_norm(dict(zip(d_cols, r))[c]) for c in cols) for r in res.fetchall()), key=repr)
    assert s_rows == d_rows
