"""Answer text per question against a plain walk over all windows and pairs."""

import random

import pytest
from pyspark.sql import types as T

from qalake.operators import best_answers as B

FEATURES = ("question_id long, window long, start_logits array<double>, end_logits array<double>, offsets array<struct<s:int,e:int>>")


def made(seed):
    rng = random.Random(seed)
    contexts, features = [], []
    for q in range(25):
        text = " ".join(rng.choice(["alpha", "é", "be ta", "😀x", "g."]) for _ in range(40))
        contexts.append((q, None if q == 3 else text))
        for w in range(0 if q == 4 else rng.randrange(1, 4)):
            n = rng.randrange(1, 30)
            spans = [(i * 3 + w * 20, i * 3 + 2 + w * 20) for i in range(n)]
            off = [None if i == 0 or q == 5 or rng.random() < 0.2 else s for i, s in enumerate(spans)]
            values = [float(rng.randrange(-4, 5)) for _ in range(2 * n)]   # many ties
            features.append((q, w, values[:n], values[n:], off))
    features.append((99, 0, [1.0], [1.0], [(0, 1)]))   # a question without a context
    features.append((6, 50, [None, float("nan"), 0.5], [0.5, None, 1.0], [(0, 1), (1, 2), (2, 3)]))
    features.append((6, 51, [], [], []))
    return contexts, features


def plain(contexts, features, p):
    out, spans = {}, {}
    for q, text in contexts:
        cand, nulls = [], []
        for fq, w, s, e, off in features:
            if fq != q:
                continue
            if s and s[0] is not None and e[0] is not None:
                nulls.append(s[0] + e[0])
            def top(x):
                ok = [i for i in range(len(x)) if x[i] is not None and x[i] == x[i]]
                return sorted(ok, key=lambda i: (-x[i], i))[:p.n_best]
            for i in top(s):
                for j in top(e):
                    if off[i] and off[j] and i <= j < i + p.longest:
                        cand.append((-(s[i] + e[j]), w, i, j, off[i][0], off[j][1]))
        best = min(cand) if cand else None
        null = min(nulls) if nulls else None
        cut = "" if best is None or text is None else text[best[4]:best[5]]
        out[q] = (cut, best and best[4], best and best[5], -best[0] if best else 0.0, null,
                  bool(best and null is not None and -best[0] > null))
        once = {}
        for neg, *_, a, z in cand:
            once[a, z] = max(once.get((a, z), -1e9), -neg)
        spans[q] = [(r + 1, "" if text is None else text[a:z], a, z, v)
                    for r, ((a, z), v) in enumerate(sorted(once.items(), key=lambda x: (-x[1], x[0]))[:4])]
    return out, spans


@pytest.mark.parametrize("seed,p", [(1, B.AnswerParams()), (2, B.AnswerParams(n_best=3, longest=2)), (3, B.AnswerParams(n_best=5))])
def test_against_plain(spark, seed, p):
    contexts, features = made(seed)
    c = spark.createDataFrame(contexts, "question_id long, context string")
    f = spark.createDataFrame(features, FEATURES).repartition(3)
    best, spans = plain(contexts, features, p)
    got = {r.question_id: tuple(r)[1:] for r in B.best_answers(f, c, p=p).collect()}
    assert got == best
    assert got[4] == ("", None, None, 0.0, None, False) and got[5][0] == ""
    listed = {}
    for r in B.n_best_answers(f, c, 4, p=p).orderBy("question_id", "rank").collect():
        listed.setdefault(r.question_id, []).append(tuple(r)[1:])
    assert listed == {q: v for q, v in spans.items() if v}


def test_no_features(spark):
    c = spark.createDataFrame([(1, "text")], "question_id long, context string")
    got = B.best_answers(spark.createDataFrame([], FEATURES), c).collect()
    assert [tuple(r) for r in got] == [(1, "", None, None, 0.0, None, False)]
    assert isinstance(B.best_answers(spark.createDataFrame([], FEATURES), c).schema["start_char"].dataType, T.IntegerType)


def test_only_best_spans_travel(spark):
    """One shuffle of one record per window; logits and offsets stay behind."""
    contexts, features = made(1)
    df = B.best_answers(spark.createDataFrame(features, FEATURES), spark.createDataFrame(contexts, "question_id long, context string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan and "partial_max_by" in plan
