"""Language ID against a plain naive Bayes over the same n-gram buckets."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from fixtures import awkward, documents
from qalake.llm import langid
from qalake.llm.langid import LangParams, Model, bucket_counts

P = LangParams(buckets=1 << 9)


def grams(text, p):
    text = text.lower()
    return Counter(int(langid.features(text[i:i + n], LangParams(orders=(n,), buckets=p.buckets))[0])
                   for n in p.orders for i in range(len(text) - n + 1))


def plain(train, text, p):
    sums = {}
    for lang, t in train:
        if lang is not None and t and any(map(str.isalpha, t)):
            sums.setdefault(lang, Counter()).update(grams(t, p))
    if not sums or not text or not any(map(str.isalpha, text)):
        return "und", 0.0
    total = {}
    for lang, c in sums.items():
        whole = sum(c.values()) + p.alpha * p.buckets
        total[lang] = sum(n * math.log((c[b] + p.alpha) / whole) for b, n in grams(text, p).items()) / p.temperature
    best = max(sorted(total), key=total.__getitem__)
    return best, 1 / sum(math.exp(x - total[best]) for x in total.values())


def test_predictions_equal_plain_naive_bayes(spark):
    rng = random.Random(2)
    alphabets = {"xa": "abcdefgh ", "xb": "efghijkl ", "xc": "äöüabc ", None: "abcdefghijkl "}
    train = [(lang, "".join(rng.choice(letters) for _ in range(rng.randrange(0, 120))))
             for lang, letters in alphabets.items() for _ in range(15)] + [("xd", "123"), ("xa", None)]
    model = langid.fit(spark.createDataFrame(train, "lang string, text string"), params=P)
    assert model.languages == ["xa", "xb", "xc"]
    texts = [t for _, t in train] + [t for _, t in awkward()] + ["İstanbul ΣΑΣ", "a" * 300_000 + "é"]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in langid.predict(documents(spark, rows), model).collect()}
    assert len(got) == len(rows)
    for i, t in rows[:-1]:
        lang, score = plain(train, t, P)
        assert got[i].lang_pred == lang and abs(got[i].score - score) < 1e-4, t


def test_slices_count_as_the_whole():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 9, 10, 11, 50):
        text = "".join(map(chr, rng.integers(97, 110, n)))
        whole = bucket_counts(text, P)
        for size in (1, 2, 3, 10):
            part = bucket_counts(text, P, size)
            assert whole[0].tolist() == part[0].tolist() and whole[1].tolist() == part[1].tolist()


def test_product_in_pieces_is_the_product():
    rng = np.random.default_rng(3)
    m = Model([f"l{i:03}" for i in range(100)], rng.standard_normal((P.buckets, 100)).astype(np.float32), P)
    texts = ["".join(map(chr, rng.integers(97, 123, n))) for n in (1, 400, 30, 5, 2000)] + [""]
    dense = np.zeros((len(texts), P.buckets))
    for i, t in enumerate(texts):
        at, n = bucket_counts(t, P)
        dense[i, at] = n
    for piece in (1, 100, 700, 10_000, 1 << 21):
        assert np.allclose(m.totals(texts, piece), dense @ m.log_prob.astype(np.float64), rtol=1e-5)


def test_kept_columns_of_the_result_names_are_replaced(spark):
    model = Model(["xa"], np.zeros((P.buckets, 1), np.float32), P)
    df = documents(spark, [(1, "abc")]).withColumn("score", F.lit("old")).withColumn("lang_pred", F.lit("old"))
    got = langid.predict(df, model, keep=["doc_id", "score", "lang_pred", "source"])
    assert got.columns == ["doc_id", "source", "lang_pred", "score"] and got.first().lang_pred == "xa"
