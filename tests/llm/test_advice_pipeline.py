"""Pipeline stages on tables with null and repeated ids."""

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from fixtures import documents, prose

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


def test_near_duplicates_are_judged_by_row(spark):
    rng = random.Random(3)
    a, b, c, d, e = (prose(rng, 80, 5000) for _ in range(5))
    near = " ".join([*c.split()[:-1], "changed"])
    rows = [(1, a), (1, b), (2, b), (None, a), (None, d), (None, d), (3, c), (4, near), (None, near), (5, e), (5, e), (6, "free " + prose(rng, 60, 5000)),
            (7, None), (7, None), (None, ""), (None, "")]
    got = sorted(((r.doc_id, r.text) for r in P.near_duplicates(spark, documents(spark, rows, clashing=False), SF).collect()), key=repr)
    assert got == sorted([(1, a), (1, b), (None, d), (3, c), (5, e), rows[11], (7, None), (7, None), (None, ""), (None, "")], key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
def test_decontamination_is_judged_by_row(spark):
    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r.text and len(r.text.split()) >= 10)
    rng = random.Random(4)
    rows = [(None, "x1 " + item + " x2"), (1, "x3 " + item), (1, prose(rng, 40, 5000)), (None, prose(rng, 40, 5000)), (None, None), (2, None)]
    got = sorted(((r.doc_id, r.text) for r in P.decontaminate(spark, documents(spark, rows, clashing=False), SF).collect()), key=repr)
    assert got == sorted(rows[2:], key=repr)


def test_unlabelled_documents_with_a_letter_stay(spark):
    from pyspark.sql import functions as F
    rows = [(1, "the and of with"), (2, "日本語"), (3, "word"), (None, "é"), (4, "123 ..."), (5, ""), (6, None)]
    docs = documents(spark, rows, clashing=False)
    for lang in (F.lit(None).cast("string"), F.when(F.col("doc_id").isin(4, 5), "en")):
        got = P.language(spark, docs.withColumn("lang", lang), SF)
        assert got.columns == P.COLUMNS
        assert sorted((r.text for r in got.collect())) == sorted(t for _, t in rows[:4])
