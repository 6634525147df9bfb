"""X4/X5 windows and labels (C12), X7 spans (C13), nested SQuAD."""

import random
import re

from pyspark.sql import functions as F

from qalake.operators import squad as Q


def _offsets(text):
    return [(m.start(), m.end()) for m in re.finditer(r"[^ \t\n\r\f\x0b]+", text)]


def _windows(n, budget, overlap):
    starts, s = [0], 0
    while s + budget < n:
        s += budget - overlap
        starts.append(s)
    return [(s, min(s + budget, n)) for s in starts]


def test_c12_window_starts(spark):
    rows = []
    for n in [1, 5, 10, 11, 12, 25, 26, 40]:
        rows.append((n, "q", " ".join(["w"] * n)))
    df = spark.createDataFrame(rows, "k long, question string, context string")
    got = {}
    for r in Q.token_windows(df, ["k"], max_len=14, overlap=4).collect():
        got.setdefault(r.k, []).append((r.start_tok, r.end_tok))
    for n in got:
        budget = max(14 - 1 - 3, 5)
        assert sorted(got[n]) == _windows(n, budget, 4), n


def test_window_labels_brute_force(spark):
    rnd = random.Random(5)
    rows, brute = [], {}
    for k in range(40):
        toks = ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(1, 60))]
        seps = [rnd.choice([" ", "  ", "\n", "\t "]) for _ in toks]
        ctx = (" " if k % 5 == 0 else "") + "".join(t + s for t, s in zip(toks, seps))
        offs = _offsets(ctx)
        i = rnd.randrange(len(offs))
        j = min(len(offs) - 1, i + rnd.randint(0, 4))
        c = offs[i][0] + (1 if k % 7 == 0 and offs[i][1] - offs[i][0] > 1 else 0)
        ce = offs[j][1]
        q = "x " * rnd.randint(1, 3)
        rows.append((k, q, ctx, c, ce - c))
        nq = len(q.split())
        budget = max(20 - nq - 3, 5)
        for w, (ws, we) in enumerate(_windows(len(offs), budget, 4)):
            if offs[ws][0] <= c and offs[we - 1][1] >= ce:
                st = max(t for t in range(ws, we) if offs[t][0] <= c)
                en = min(t for t in range(ws, we) if offs[t][1] >= ce)
                brute[(k, w)] = (nq + 2 + st - ws, nq + 2 + en - ws)
            else:
                brute[(k, w)] = (0, 0)
    df = spark.createDataFrame(rows, "k long, question string, context string, answer_start int, answer_len int")
    win = Q.token_windows(df, ["k"], max_len=20, overlap=4)
    offs = Q.token_offsets(df.select("k", "context"), ["k"])
    lab = Q.window_labels(win, offs, df.select("k", "answer_start", "answer_len"), ["k"], ["k"])
    got = {(r.k, r.window_idx): (r.start_position, r.end_position) for r in lab.collect()}
    assert got == brute


def test_c13_nbest_spans(spark):
    s = [0.0, 5.0, 1.0, 0.5, 4.0]
    e = [0.0, 0.1, 3.0, 0.2, 9.0]
    rows = [(1, s, e), (2, [0.0, 1.0, 0.0], [0.0, 0.0, 0.0]), (3, [9.0], [9.0])]
    df = spark.createDataFrame(rows, "f long, start_logits array<double>, end_logits array<double>")
    got = {r.f: (r.start_idx, r.end_idx, r.score)
           for r in Q.nbest_spans(df, ["f"], n_best=3, max_answer_len=3, valid=lambda i: i >= 1).collect()}
    # best pair (1, 2): 5 + 3; (1, 4) is 4 tokens long; (4, 4) = 13 is best overall
    assert got[1] == (4, 4, 13.0)
    assert got[2][0] == 1
    assert got[3] == (-1, -1, 0.0)  # only the masked CLS position: "" / 0.0 fallback


def test_nest_squad(spark):
    rows = [("t", "ctx1", "d1_q1", "q1", 5, "x"), ("t", "ctx1", "d1_q1", "q1", 1, "y"),
            ("t", "ctx2", "d2_q1", "q1", 0, "z")]
    df = spark.createDataFrame(rows, "title string, context string, id string, question string, "
                                     "answer_start int, answer_text string")
    out = Q.nest_squad(df).first()
    assert out.title == "t" and len(out.paragraphs) == 2
    p1 = out.paragraphs[0]
    assert p1.context == "ctx1" and [a.answer_start for a in p1.qas[0].answers] == [1, 5]
    assert df.select(F.lit(1)).count() == 3
