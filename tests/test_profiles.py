"""Dataset profiles with distinct documents (A4) and trials still to run."""

from qalake.operators import prep, tune


def test_profile_documents(spark):
    q = spark.createDataFrame([("a", 1, "yes"), ("a", 2, "list"), ("a", 2, None), ("b", 3, "odd"), (None, 4, "yes")],
                              "ds string, qid long, kind string")
    links = spark.createDataFrame([("a", "d1"), ("a", "d1"), ("a", "d2"), ("a", None), ("c", "d9"), (None, "d1"), (None, "d3")],
                                  "ds string, doc string")
    got = {r.ds: tuple(r)[1:] for r in prep.profile_documents(q, links, "ds", "kind", ["yes", "list"], "doc").collect()}
    assert got == {"a": (3, 2, 1, 1), "b": (1, 0, 0, 0), "c": (0, 1, 0, 0), None: (1, 2, 1, 0)}
    assert prep.profile_documents(q.where("false"), links.where("false"), "ds", "kind", ["yes"], "doc").count() == 0


def test_unfinished_trials(spark):
    cand = spark.createDataFrame([(i,) for i in range(5)], "k long")
    log = [(0, "COMPLETE"), (1, "FAIL"), (1, "FAIL"), (1, "FAIL"), (2, "FAIL"), (2, "FAIL"), (3, "RUNNING"), (3, "FAIL"), (3, "COMPLETE")]
    trials = spark.createDataFrame(log, "k long, state string")
    assert sorted(r.k for r in tune.unfinished(cand, trials, ["k"]).collect()) == [2, 4]
    assert sorted(r.k for r in tune.unfinished(cand, trials, ["k"], max_retry=2).collect()) == [4]
    assert tune.unfinished(cand, trials.where("false"), ["k"]).count() == 5
