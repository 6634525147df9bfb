"""Containment join: texts stay on their rows, both ways give the same pairs."""

from qalake.operators.joins import containment_join

LONG = "one two three four five six seven"


def frames(spark):
    docs = [(1, f"start {LONG} end"), (2, "xxone two three four five six seveny"), (3, LONG.replace(" ", "  ")), (4, ""),
            (5, None), (None, LONG), (6, "ab"), (6, f"z{LONG}z"), (7, "one two three four five six seven"), (8, "日本語")]
    needles = [(1, LONG), (2, "ab"), (3, "a"), (4, ""), (5, None), (None, LONG), (6, "本語"), (7, "e f"), (8, "one two three four five"),
               (8, "zone"), (9, LONG), (10, "two three four five six"), (10, "two three four five six")]
    return (spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(needles, "item_id long, text string"),
            {(i, j) for i, t in docs for j, n in needles if None not in (i, t, j, n) and n and n in t})


def test_nulls_repeated_ids_and_both_ways(spark):
    d, n, exp = frames(spark)
    for options in ({}, {"max_broadcast_keys": 1}, {"max_broadcast_bytes": 5}):
        got = [(r.doc_id, r.item_id) for r in containment_join(d, n, **options).collect()]
        assert len(got) == len(set(got)) and set(got) == exp, options
    assert containment_join(d, n.where("false")).count() == 0
    assert containment_join(d.where("false"), n).count() == 0


def test_needles_with_a_common_opening(spark):
    opening = "what is the name of the"
    n = spark.createDataFrame([(i, f"{opening} thing number n{i} of all") for i in range(200)], "item_id long, text string")
    d = spark.createDataFrame([(i, f"so {opening} thing number n{i} of all there") for i in range(0, 400, 7)], "doc_id long, text string")
    assert {tuple(r) for r in containment_join(d, n).collect()} == {(i, i) for i in range(0, 200, 7)}


def test_no_exchange_carries_a_document_text(spark):
    d, n, _ = frames(spark)
    df = containment_join(d, n)
    plan = df._jdf.queryExecution().executedPlan().toString()
    probe = next(line for line in plan.splitlines() if "instr" in line)
    assert "BroadcastHashJoin" in probe
    # from the check of the text down to the documents' scan: no shuffle before the needles' broadcast
    streamed = plan[plan.index(probe):plan.index("BroadcastExchange")]
    assert "Scan" in streamed and "Exchange" not in streamed
    above = plan[:plan.index(probe)]
    assert "Exchange hashpartitioning(doc_id" in above and "dtext" not in above
