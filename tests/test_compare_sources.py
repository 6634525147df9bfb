"""S6 HTML, S12 reports, S8 CSV sink, D16 leaderboards (Q12/Q13), R1/R2, W2, J10, A19, P13."""

import csv
import os

from pyspark.sql import functions as F

from qalake.operators import compare as C
from qalake.sources import html, judged, reports, sinks


def test_html_fields(spark):
    page = ('<html lang="en"><head><title>A &amp; B</title><script>var x="</p>";</script>'
            '<style>p{}</style></head><body><!-- <p>hidden</p> --><h1 class="t">Head <b>line</b></h1>'
            '<p>First <i>para</i>.</p><p class="x">Second &lt;b&gt;</p><p>   </p></body></html>')
    df = spark.createDataFrame([(1, page)], "page_id long, html string")
    r = html.html_fields(df).first()
    assert r.title == "A & B" and r.h1 == "Head line" and r.page_lang == "en"
    assert r.n_paragraphs == 2 and r.body_text == "First para.\nSecond <b>"


def test_report_lines(spark):
    lines = spark.createDataFrame([("b1", "MAP documents: 0.25"), ("b1", "GMAP documents: 0.1"),
                                   ("b1", "garbage line"), ("b2", "MAP documents: 0.5"),
                                   ("b2", "note: n/a")], "batch string, value string")
    wide = reports.report_to_wide(reports.parse_report_lines(lines), ["MAP documents", "GMAP documents"])
    got = {r.batch: (r["MAP documents"], r["GMAP documents"]) for r in wide.collect()}
    assert got == {"b1": (0.25, 0.1), "b2": (0.5, None)}


def test_long_wide_topk_semi(spark):
    lb = spark.createDataFrame([("s1", 1, 0.5, 3), ("s2", 1, 0.7, 1), ("s3", 1, 0.7, 2),
                                ("s1", 2, 0.9, 1), ("s2", 2, 0.1, 5), (None, 2, 0.2, 1)],
                               "system string, batch int, score double, n int")
    assert C.metric_columns(lb, ["system", "batch"]) == ["score", "n"]
    long = C.to_long(lb, ["system", "batch"])
    assert long.count() == 12
    wide = C.to_wide(long, ["system", "batch"], "metric", "value", ["score", "n"])
    assert wide.where("system = 's2' AND batch = 1").first().score == 0.7
    top = {(r.batch, r["rank"]): r.system for r in C.top_k_per_group(lb, ["batch"], "score", 2, ["system"]).collect()}
    assert top[(1, 1)] == "s2" and top[(1, 2)] == "s3" and top[(2, 1)] == "s1"
    keys = C.top_n_keys(lb.where("system IS NOT NULL"), "system", "score", 1)
    assert [r.system for r in C.keep_keys(lb, keys, "system").select("system").distinct().collect()] == ["s1"]
    kept = lb.where(C.not_equal_null_safe("system", "s1")).count()
    assert kept == 4  # the null system is kept, as pandas != keeps it
    best = C.best_by(lb, ["batch"], "score", "n", ["system"]).collect()
    assert {(r.batch, r.system, r.n) for r in best} == {(1, "s2", 1), (2, "s1", 1)}


def test_csv_sink_and_leaderboard_headers(spark, tmp_dir):
    df = spark.createDataFrame([("q", ["a", "b"], 1)], "body string, answers array<string>, pos int")
    out = os.path.join(tmp_dir, "csv")
    sinks.write_csv(df, out)
    back = spark.read.option("header", True).csv(out).first()
    assert back.answers == '["a","b"]'
    p = os.path.join(tmp_dir, "lb.csv")
    with open(p, "w", newline="") as f:
        csv.writer(f).writerows([["System", "Mean precision", "phase", "Batch"],
                                 ["x", "0.5", "A", "1"], ["y", "bad", "0", "2"]])
    lb = judged.read_leaderboard(spark, p, ["Mean precision"])
    rows = {r.system: r for r in lb.collect()}
    assert rows["x"].batch == 1 and rows["x"]["Mean precision"] == 0.5 and rows["x"].phase_valid
    assert rows["y"]["Mean precision"] is None and rows["y"].phase_valid is False
    assert set(lb.columns) >= {"system", "batch", "phase", "Mean precision", "phase_valid"}
    _ = F
