"""Operator 11 against plain counting, and its shards against the bound they rest on."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import CLASHING, DOCS
from pyspark.sql import functions as F

from qalake.llm import phrases

LOW = {i: i + 32 for i in range(65, 91)}


def plain(rows, p):
    f, total = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, p.longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i:i + k])] += 1
    out = []
    for lang, c in f.items():
        cand = {t: a for t, a in c.items() if len(t) > 1 and a >= p.support}
        around = Counter()
        for t, a in cand.items():
            for m in range(2, len(t)):
                for i in range(len(t) - m + 1):
                    around[t[i:i + m]] = max(around[t[i:i + m]], a)
        rows_ = []
        for t, a in cand.items():
            score, k = min((p.scale * a // (c[t[:k]] + c[t[k:]]), k) for k in range(1, len(t)))
            if 100 * around[t] < p.cover * a:
                rows_.append((-score, -a, " ".join(t).encode(), c[t[:k]], c[t[k:]]))
        for i, (s, a, t, left, right) in enumerate(sorted(rows_)[:p.top], 1):
            out.append((lang, i, t.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def made(seed, n=300):
    rng = random.Random(seed)
    vocab = ["the", "New", "york", "city", "É", "of", "a b", "\x1cx", "日本"] + [f"w{i}" for i in range(30)]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(vocab[:9] if rng.random() < 0.6 else vocab) + rng.choice([" "] * 8 + ["  ", "\t", ".", ", ", "\n", " ! "])
                       for _ in range(rng.randrange(1, 40)))
        rows.append((i, text, rng.choice(["en", "en", "en", None, "fr"])))
    rows += [(1, rows[1][1], "en")] * 40 + [(None, None, "en"), (None, "", None), (7, " \t ", "xx"), (8, "." * 50, "en")]
    rows.append((9, "new york " * 20000, "de"))
    rng.shuffle(rows)
    return rows


def table(spark, rows):
    df = spark.createDataFrame([(i, t, g, "s", 0) for i, t, g in rows], DOCS)
    return df.withColumns({c: F.lit("x") for c in [*CLASHING, "lh", "shard", "phrase", "k", "least", "salt"]}).repartition(5)


@pytest.mark.parametrize("seed,top,shards", [(1, 2000, 4), (2, 7, 3), (3, 2000, 1)])
def test_against_plain(spark, seed, top, shards):
    rows = made(seed)
    p = phrases.PhraseParams(top=top, shards=shards, slice_bytes=3000, log_filter=10)
    got = sorted(tuple(r) for r in phrases.mine(table(spark, rows), params=p).collect())
    assert got == plain(rows, p) and len(got) > 2


def test_full_filters_lose_nothing(spark):
    rows = made(4)
    p = phrases.PhraseParams(log_filter=0)
    assert sorted(tuple(r) for r in phrases.mine(table(spark, rows), params=p).collect()) == plain(rows, p)


def test_shards_are_mined_at_their_share(spark):
    """Supports of a language add up to its support at least, and each frequent pair is frequent in a shard."""
    rows = made(5)
    p = phrases.PhraseParams()
    keyed = phrases._keyed(table(spark, rows), "text", "doc_id", "lang", p)
    least = phrases._least(keyed, p)
    texts = keyed.groupBy("lh").agg(F.sum(F.octet_length("text")).alias("b")).where("b > 0")
    sums = least.where("salt = 0").join(texts, "lh").groupBy("lh").agg(F.sum("least").alias("s"), F.count("*").alias("c")).collect()
    assert len(sums) >= 4 and all(p.support <= r.s < p.support + r.c for r in sums)
    grams = {r.gram for r in phrases._mined(keyed, least, p, None).collect()}
    one = np.array(sorted(grams), np.int64).view(np.uint64)
    words = np.zeros(1 << 10, np.uint64)
    for k in one.tolist():  # every frequent pair of the plain count is among the mined hashes
        words[(k >> 40) & 1023] |= np.uint64(sum({1 << (k & 63): 1, 1 << ((k >> 6) & 63): 1, 1 << ((k >> 12) & 63): 1}))
    known = phrases._counted(keyed, words, p).where("k = 2").collect()
    have = {(r.lang, r.phrase): r.n for r in known}
    for lang, _, phrase, a, *_ in plain(rows, phrases.PhraseParams(longest=2)):
        assert have[lang, phrase] == a


def test_empty(spark):
    assert phrases.mine(spark.createDataFrame([], DOCS)).collect() == []
    assert phrases.mine(spark.createDataFrame([(1, None, None, None, None), (2, "a b c", "en", "s", 5)], DOCS)).collect() == []


def test_scores_pass_64_bits(spark):
    """The score of counts near 2**60 stays exact."""
    df = spark.createDataFrame([(2**60 + 1, 2**60 + 7, 2**61 + 3)], "a long, l long, r long")
    wide = "decimal(20,0)"
    got = df.select(F.expr(f"cast(a as {wide}) * 2000000 div (cast(l as {wide}) + cast(r as {wide}))")).first()[0]
    assert got == 2000000 * (2**60 + 1) // (2**60 + 7 + 2**61 + 3)
