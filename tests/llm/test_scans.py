"""Decontamination (2), licences (4), secrets (5), urls (6), language ID (7) and vectors (9)."""

import hashlib
import math
import os
import random
import re
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
from fixtures import CLASHING, awkward, documents, empty

from pyspark.sql import functions as F

from qalake.llm import ann, langid, licenses, queries, urls
from qalake.llm.decontam import DecontamParams, contamination
from qalake.llm.secrets import redact, scan

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# ---- 2
def brute_hits(docs, items):
    wins = {}
    for item, t in items:
        w = WORD.findall(fold(t))
        if item is not None and w:
            for k in range(max(len(w) - 10, 0) + 1):
                wins.setdefault(tuple(w[k:k + 10]), set()).add(str(item))
    out = []
    for i, t in docs:
        w = WORD.findall(fold(t))
        hit, own = set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in wins:
                    hit |= set(range(k, k + n))
                    own |= wins[tuple(w[k:k + n])]
        out.append((i, len(w), len(hit), len(own), sha(",".join(sorted(own))), bool(hit)))
    return sorted(out, key=repr)


def test_contamination_equals_brute_force(spark):
    docs = awkward()
    rng = random.Random(1)
    items = [(None, "w1 w2"), (1, None), (2, ""), (3, "...")]
    for k, (_, t) in enumerate(x for x in docs if x[1]):
        w = t.split()
        if len(w) > 30:
            a = rng.randrange(len(w) - 25)
            items.append((k + 10, " ".join(w[a:a + rng.choice([4, 10, 11, 25])]).upper() if k % 3 else " ".join(w[a:a + 25])))
    items += [(500, "same same"), (500, "日本語"), (501, "w3")]
    b = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit(0) for c in CLASHING})
    for params in (DecontamParams(), DecontamParams(literal_words=3, broadcast_windows=1)):
        got = sorted((tuple(r) for r in contamination(documents(spark, docs), b, params=params).collect()), key=repr)
        assert got == brute_hits(docs, items)
    none = b.where("false")
    assert not any(r.contaminated for r in contamination(documents(spark, docs), none).collect())
    assert contamination(empty(spark), b).count() == 0


# ---- 4
def test_automaton_gives_matching_statistics():
    rng = random.Random(4)
    seqs = [[rng.randrange(3) for _ in range(rng.randrange(1, 12))] for _ in range(8)] + [[0, 0, 0, 0]]
    auto = licenses.Automaton(seqs)
    subs = {}
    for k, s in enumerate(seqs):
        for a in range(len(s)):
            for z in range(a + 1, len(s) + 1):
                subs.setdefault(tuple(s[a:z]), set()).add(k)
    text = [rng.randrange(4) for _ in range(300)]
    for i, (n, state) in enumerate(auto.statistics(text)):
        best = max((m for m in range(0, i + 2) if m == 0 or tuple(text[i + 1 - m:i + 1]) in subs))
        assert n == best
        if n:
            assert {k for k in range(len(seqs)) if auto.owners[state] >> k & 1} == subs[tuple(text[i + 1 - n:i + 1])]


def test_licences(spark):
    rows = awkward() + [
        (900, "Released under the MIT License. See mit-license, MIT/License; MITlicense."),
        (901, "x " * 50 + "Apache License and the GNU General Public License"),
        (902, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
              "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
              "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
              "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
        (903, "Licensed under CC BY-NC 4.0."), (904, "mit"), (905, "license mit license mit license")]
    got = {(r.doc_id, r.n_words, r.n_base): r for r in licenses.scan(documents(spark, rows)).collect()}
    assert len(licenses.scan(documents(spark, rows)).collect()) == len(rows)
    for i, t in rows:
        w = WORD.findall(fold(t))
        at = sorted((k, label) for ph, label in licenses.BASE_PHRASES.items() for p in [ph.split()]
                    for k in range(len(w) - len(p) + 1) if w[k:k + len(p)] == p)
        r = got[(i, len(w), len(at))]
        assert (r.first_word, r.last_word) == ((at[0][0], at[-1][0]) if at else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in at}))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1
    by = {r.doc_id: r for r in got.values()}
    assert by[902].labels == "mit" and by[902].n_base == 0 and by[902].score == 1.0
    assert by[903].labels == "cc-by-nc" and by[900].labels == "mit"
    assert not any(r.labels for r in by.values() if r.doc_id is None or r.doc_id < 900)
    assert licenses.scan(empty(spark)).count() == 0


# ---- 5
BASE = [("assign", re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)),
        ("access", re.compile("AKIA[A-Z0-9]+")), ("hex", re.compile("[0-9a-f]+"))]


def brute_spans(t):
    out = []
    for no, (kind, p) in enumerate(BASE):
        for m in p.finditer(t or ""):
            if {"assign": lambda: len(m[2]) >= 6, "access": lambda: len(m[0]) >= 20, "hex": lambda: len(m[0]) >= 24}[kind]():
                out.append((m.start(), no, m.end(), kind))
    return [f"{k}:{a}:{z}" for a, _, z, k in sorted(out)]


def test_secrets(spark):
    rng = random.Random(6)

    def rand(alphabet, n):
        return "".join(rng.choice(alphabet) for _ in range(n))
    hexa, b64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    rows = awkward() + [
        (900, 'é😀 token = "%s" and Secret: token = abcdefgh' % rand(hexa, 40)), (901, "AKIA" + rand("ABCDEFGH01234567", 16) + " AKIASHORT"),
        (902, "password=abc token=token=abcdefgh api_key: x API_KEY : 'zzzzzzz'"), (903, rand(hexa, 24) + " " + rand(hexa, 23)),
        (904, "ſecret=abcdefgh \u212aey"), (905, "thetionstheerandthewiththeonof " * 30), (906, "a" * 200 + " " + "-" * 80 + " ====" * 30),
        (907, "secret=\n" * 500 + "token:zzzzzz")]
    rows += [(1000 + k, "key " + rand(b64, 44) + " end") for k in range(60)]
    rows += [(2000 + k, "word " + rand("etaoinshrdlu", 30) + " " + "0" * 30) for k in range(60)]
    got = scan(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t in rows:
        s = brute_spans(t)
        want.setdefault(i, []).append((sum(x.startswith("assign") for x in s), sum(x.startswith("access") for x in s),
                                       sum(x.startswith("hex") for x in s), sha(",".join(s))))
    for r in got:
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) in want[r.doc_id], r
        assert sha(",".join(x for x in r.spans.split(",") if x and not x.startswith("random"))) == r.base_sha256
    extra = {r.doc_id for r in got if "random" in r.spans}
    assert sum(1000 <= i < 2000 for i in extra if i) >= 55      # random strings are found
    assert not any(i is None or i < 900 or i >= 2000 or i in (905, 906) for i in extra)
    clean = {r.doc_id: r.text for r in redact(documents(spark, rows, clashing=False)).collect()}
    assert clean[900].startswith('é😀 [SECRET]" and') and clean[1] == dict(rows)[1]
    assert scan(empty(spark)).count() == 0


# ---- 6
def test_urls(spark):
    given = [None, "", "no scheme", "http://A.Example.COM/en/x?q#f", "http://www.example.com/en/", "http://x.www.example.com/en/a",
             "https://example.com", "https://com/", "http://a.net/es/1", "http://net/fr/", "http://net/fr", "http://anet/es/", "x://y?z",
             "http://a.org/p#x?y", "http://a.org?x=/en/", "a://b://c/d", "http://bad.org/" + "z" * 5000]
    rows = [(i, u, "h") for i, u in enumerate(given)] + [(3, given[3], "h"), (None, given[4], "h")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("n", "k", "c", "domain")})
    got = urls.judge(df, queries.URL_RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        u = given[r.page_id] if r.page_id is not None else given[4]
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = fold(re.match("[^/?#]*", rest)[0])
        path = re.match("[^/?#]*([^?#]*)", rest)[1]
        assert (r.host, r.path) == (host, path)
        fits = [(len(x), v, x) for v, x in queries.URL_RULES for h, _, p in [x.partition("/")]
                if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        assert r.rule == (max(fits)[2] if fits else None)
        assert r.verdict in ("allow", "block") and (not fits or r.verdict == max(fits)[1])
    none = urls.judge(df.where("false"), queries.URL_RULES)
    assert none.count() == 0


def test_reputation_shrinks(spark):
    rng = random.Random(2)
    rows = []
    for d in range(30):
        for h in range(5):
            bad = 0.95 if d < 4 else 0.05
            rows += [(f"h{h}.d{d}.org", rng.random() < bad) for _ in range(rng.choice([1, 3, 20]))]
    rows += [("new.d0.org", None), ("new.d9.org", None), ("x.unseen.org", None), ("one.d20.org", True)]
    got = {r.host: r for r in urls.reputation(spark.createDataFrame(rows, "host string, bad boolean")).collect()}
    assert got["new.d0.org"].share > 0.8 and got["new.d9.org"].share < 0.2      # a host without labels follows its domain
    assert got["one.d20.org"].lower < 0.5                                        # one bad page does not damn a host
    assert all(0 <= r.share <= 1 and r.lower <= r.share for r in got.values())


# ---- 7
def test_language(spark):
    sf = "/root/testdata/sf0.01"
    if os.path.isdir(sf):
        got = queries.op7_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").where("held_out").collect()
        assert len(got) > 100 and sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got)
    rows = [(1, "der die das und nicht", "de"), (2, "the and of with", "en"), (3, None, "en"), (4, "", "de"), (5, "123 ...", "en"),
            (6, "the and of", None), (None, "und die", None), (6, "den und", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    m = langid.fit(df)
    got = sorted((r.doc_id or 0, r.lang_pred) for r in langid.predict(df, m).collect())
    assert got == [(0, "de"), (1, "de"), (2, "en"), (3, "und"), (4, "und"), (5, "und"), (6, "de"), (6, "en")]
    assert all(0 <= r.score <= 1 for r in langid.predict(df, m).collect())
    none = langid.fit(df.where("false"))
    assert {r.lang_pred for r in langid.predict(df, none).collect()} == {"und"}
    assert langid.predict(df.where("false"), m).count() == 0
    with pytest.raises(ValueError):
        langid.fit(df, params=langid.LangParams(max_languages=1))
    import zlib
    folds = {r.doc_id: r.f for r in df.select("doc_id", langid.fold(F.col("doc_id")).alias("f")).collect()}
    assert all(f == (None if i is None else zlib.crc32(str(i).encode()) % 4) for i, f in folds.items())


# ---- 9
def test_nearest(spark):
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((6, 24))
    vecs = [(centres[i % 6] + 0.7 * rng.standard_normal(24)).astype(np.float32) for i in range(1200)]
    rows = [(i, v.tolist()) for i, v in enumerate(vecs)]
    rows += [(2000 + i, vecs[50].tolist()) for i in range(400)]                 # one vector many times
    rows += [(3000, None), (3050, [0.0] * 24), (3100, [None] * 24), (3150, [float("nan")] * 24), (3200, [float("inf")] + [1.0] * 23),
             (None, vecs[0].tolist()), (3250, []), (3300, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(0) for c in CLASHING})
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    for params in (ann.AnnParams(), ann.AnnParams(query_block=10, candidate_block=100)):
        got = {}
        for r in ann.nearest(df, F.col("vec_id") % 50 == 0, params=params).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        want = {}
        for i, q in ok:
            if i % 50 == 0:
                s = [(-float(q @ v / math.sqrt(q @ q) / math.sqrt(v @ v)), j) for j, v in ok if j != i and len(v) == len(q)]
                want[i] = sorted((round(a, 12), j) for a, j in s)[:5]
        assert set(got) == {i for i, w in want.items() if w}
        hits = 0
        for i, found in got.items():
            found.sort()
            assert [x[0] for x in found] == list(range(1, len(want[i]) + 1))
            hits += len({x[1] for x in found} & {j for _, j in want[i]})
            for _, j, s in found:
                a, b = dict(ok)[i], dict(ok)[j]
                assert abs(s - a @ b / math.sqrt(a @ a) / math.sqrt(b @ b)) < 1e-12
        assert hits >= 0.98 * sum(map(len, want.values()))
        assert [x[1] for x in sorted(got[2000])] == [50, 2001, 2002, 2003, 2004]   # ties to the smaller id
    assert ann.nearest(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_estimate_is_within_its_bound():
    rng = np.random.default_rng(1)
    x, q = rng.standard_normal((4000, 64)), rng.standard_normal(64)
    q /= np.linalg.norm(q)
    code, scale = ann.encode(x, 7)
    signs = np.unpackbits(code, axis=1, count=64) * 2.0 - 1
    est = signs @ (q @ ann.rotation(64, 7)) / 8 / scale
    true = x @ q / np.linalg.norm(x, axis=1)
    err = 2.5 * np.sqrt((1 - scale ** 2) / (scale ** 2 * 63))
    assert (np.abs(est - true) <= err).mean() > 0.97
