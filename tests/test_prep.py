"""P7/P8 membership (C3), duplicates (C10), ordered distinct (C11), containment join."""

import random

from pyspark.sql import functions as F

from qalake.operators import answers as A
from qalake.operators import dedup as D
from qalake.operators import prep as P
from qalake.operators.joins import containment_join


def test_c3_found_keeps_order_and_repeats(spark):
    q = spark.createDataFrame([("q1", ["u/3", "u/1", "u/9", "u/3"]), ("q2", ["u/8"])],
                              "id string, documents array<string>")
    corpus = spark.createDataFrame([("1",), ("3",)], "pmid string")
    found = P.found_in_corpus(P.links_long(q), corpus)
    arr = {r.id: r.pmids_found for r in P.found_arrays(found).collect()}
    assert arr == {"q1": ["3", "1", "3"]}  # q2 has none left: dropped (P8)


def test_c10_duplicates_null_group_and_first(spark):
    rows = [(1, None), (2, None), (3, "x"), (4, "x"), (5, "x"), (6, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    flagged = {r.doc_id: r.n_copies for r in D.flag_duplicates(df, "text").collect()}
    assert flagged == {1: 2, 2: 2, 3: 3, 4: 3, 5: 3}
    first = sorted(r.doc_id for r in D.first_per_key(df, D.text_key(F.col("text")), "doc_id").collect())
    assert first == [1, 3, 6]


def test_c11_ordered_distinct_case_sensitive(spark):
    preds = spark.createDataFrame([(1, 1, "x"), (1, 2, "X"), (1, 3, "x"), (1, 4, "y")],
                                  "qid long, rank int, answer string")
    got = sorted((r["rank"], r.answer) for r in A.dedup_predictions(preds).collect())
    assert got == [(1, "x"), (2, "X"), (3, "y")]


def test_answer_position_and_list_counts(spark):
    preds = spark.createDataFrame([(1, 1, "foo"), (1, 2, " BAR "), (2, 1, "z"), (3, 1, "a"), (3, 2, "b")],
                                  "qid long, rank int, answer string")
    gold = spark.createDataFrame([(1, 0, "bar"), (1, 1, "baz"), (2, 0, "q"), (3, 0, "a"), (3, 0, "A")],
                                 "qid long, grp int, synonym string")
    pos = {r.qid: r.pos for r in A.answer_positions(preds, gold).collect()}
    assert pos == {1: 2, 2: 0, 3: 1}
    c = {r.qid: (r.tp, r.fp, r.fn) for r in A.list_counts(preds, gold).collect()}
    assert c == {1: (1, 1, 1), 2: (0, 1, 1), 3: (1, 1, 0)}


def test_synonym_priority_x1(spark):
    cands = spark.createDataFrame([
        (1, "Alpha beta gamma", "delta", 0), (1, "Alpha beta gamma", "GAMMA", 1), (1, "Alpha beta gamma", "beta", 2),
        (2, "Alpha beta", "alpha", 0), (2, "Alpha beta", "beta", 1),
        (3, "nothing here", "zzz", 0), (3, "nothing here", "yyy", 1)],
        "k long, context string, word string, prio int")
    got = {r.k: (r.start, r.matched) for r in A.locate_with_synonyms(cands, ["k"]).collect()}
    assert got == {1: (11, "GAMMA"), 2: (0, "alpha"), 3: (-1, "zzz")}


def test_containment_join_matches_brute_force(spark):
    rnd = random.Random(11)
    words = ["ab", "cd", "efg", "hij", "kl", "mno", "p.", "q,", "rst"]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 40)))) for i in range(80)]
    needles = []
    for j in range(40):
        d = rnd.choice(docs)[1]
        if len(d) > 12 and j % 3:
            a = rnd.randint(0, len(d) - 10)
            needles.append((j, d[a:a + rnd.randint(3, 30)]))   # may start or end mid-word
        else:
            needles.append((j, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 8)))))
    dd = spark.createDataFrame(docs, "doc_id long, text string")
    nn = spark.createDataFrame(needles, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in containment_join(dd, nn).collect()}
    exp = {(i, j) for i, t in docs for j, n in needles if n in t}
    assert got == exp


def test_prepare_composite(spark):
    q = spark.createDataFrame([("q1", ["u/1", "u/2", "u/1"]), ("q2", ["u/7"]), ("q3", [])],
                              "id string, documents array<string>")
    corpus = spark.createDataFrame([("1",), ("5",)], "pmid string")
    found, prof = P.prepare(q, corpus)
    r = prof.first()
    assert (r.n_questions, r.n_distinct_docs, r.n_docs_found, r.n_answerable, r.n_found_links) == (3, 3, 1, 1, 2)
    assert r.docs_per_query == 2.0
    assert sorted((x.id, x.pos) for x in found.collect()) == [("q1", 0), ("q1", 2)]
    empty, prof2 = P.prepare(q, corpus.where("false"))
    assert prof2.first().docs_per_query is None  # Q19: nothing survives -> null, no error


def test_containment_short_needles_and_chunked_broadcast(spark):
    rnd = random.Random(5)
    docs = [(i, "".join(rnd.choice("ab c.") for _ in range(rnd.randint(0, 25)))) for i in range(40)]
    needles = [(j, "".join(rnd.choice("ab c") for _ in range(rnd.randint(1, 12)))) for j in range(30)]
    needles += [(100, "a"), (101, "b."), (102, "zz"), (103, "a b c a b c a b")]
    dd = spark.createDataFrame(docs, "doc_id long, text string")
    nn = spark.createDataFrame(needles, "item_id long, text string")
    exp = {(i, j) for i, t in docs for j, n in needles if n in t}
    got = {(r.doc_id, r.item_id) for r in containment_join(dd, nn).collect()}
    assert got == exp
    chunked = {(r.doc_id, r.item_id) for r in containment_join(dd, nn, max_broadcast_keys=7).collect()}
    assert chunked == exp


def test_m6_one_prediction_hits_two_groups_and_repeats(spark):
    preds = spark.createDataFrame([(1, 1, "x"), (1, 2, "X "), (1, 3, "y")], "qid long, rank int, answer string")
    gold = spark.createDataFrame([(1, 0, "x"), (1, 1, "x"), (1, 2, "z")], "qid long, grp int, synonym string")
    c = A.list_counts(preds, gold).first()
    assert (c.tp, c.fp, c.fn) == (2, 1, 1)          # "x" hits groups 0 and 1
    r = A.list_counts(preds, gold, count_repeats_as_fp=True).first()
    assert (r.tp, r.fp, r.fn) == (2, 2, 1)          # the repeated spelling "X " is a FP
