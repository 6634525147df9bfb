"""N-gram Jaccard join (3), substring dedup (10), components and filters against brute force."""

import hashlib
import os
import random
import re
import sys
from collections import defaultdict

import numpy as np
import pyarrow as pa

sys.path.insert(0, os.path.dirname(__file__))
from fixtures import awkward, documents, empty

from qalake.llm.graph import components
from qalake.llm.jaccard import JaccardParams, join, keep_first
from qalake.llm.store import bloom_filter, may_hold
from qalake.llm.substring import SubstringParams, dedup
from qalake.llm.words import ALNUM, LOWER, NON_SPACE, grams, sliding_min, split_words

SPACES = re.compile("[^\x20\x09-\x0D]+")


def fold(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_words_match_the_patterns():
    texts = [t for _, t in awkward()]
    for cls, pattern in ((NON_SPACE, SPACES), (ALNUM, re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))):
        want = [pattern.findall(fold(t)) for t in texts]
        w = split_words(pa.array(texts), cls, LOWER)
        assert w.counts.tolist() == [len(x) for x in want]
        flat = [x for ws in want for x in ws]
        seen = {}
        for word, h in zip(flat, w.hash.tolist()):
            assert seen.setdefault(word, h) == h
        assert len(set(seen.values())) == len(seen)
        assert split_words(pa.array(texts)[3:9], cls, LOWER).counts.tolist() == [len(x) for x in want[3:9]]


def test_grams_and_sliding_min():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 3, 400).astype(np.uint64)
    for k in (1, 2, 3, 5, 8, 50):
        g = grams(h, k)
        seen = {}
        for i in range(len(h) - k + 1):
            assert seen.setdefault(tuple(h[i:i + k]), g[i]) == g[i]
        assert len(set(seen.values())) == len(seen)
        assert sliding_min(g, 7).tolist() == [g[i:i + 7].min() for i in range(len(g) - 6)]


def brute_join(rows):
    def shingles(t):
        w = SPACES.findall(fold(t))
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(lambda: None)
    for k, (i, _) in enumerate(rows):
        r = find(k)
        if i is not None:
            least[r] = i if least[r] is None else min(least[r], i)
    return sorted(((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows)), key=repr)


def near_copies(seed, groups=12, size=14):
    """Groups whose members differ so that links are just above or below the bound."""
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        words = [str(rng.randrange(10 ** 6)) for _ in range(rng.randrange(5, 160))]
        for _ in range(size):
            own = list(words)
            for _ in range(rng.randrange(0, 5)):
                own[rng.randrange(len(own))] = str(rng.randrange(10 ** 6))
            cut = rng.randrange(0, max(1, len(own) // 8))
            rows.append((len(rows), " ".join(own[cut:])))
    return rows


def test_join_equals_brute_force(spark):
    for rows in (awkward(), near_copies(1), near_copies(2, 4, 40)):
        for params in (JaccardParams(), JaccardParams(hints=20, hint_least=2, hint_chunk=500, bloom_log_words=4)):
            got = sorted((tuple(r) for r in join(documents(spark, rows), params=params).collect()), key=repr)
            assert got == brute_join(rows)
    assert join(empty(spark)).count() == 0


def test_one_of_each_group_stays(spark):
    rows = [(i, t) for i, t in awkward()]
    want = {i for i, _, c in brute_join(rows) if i is not None and i == c}
    kept = keep_first(documents(spark, rows)).select("doc_id").collect()
    ids = [r.doc_id for r in kept if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and set(ids) == want
    assert sum(r.doc_id is None for r in kept) == 2


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1090)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bloom_filter_has_no_misses(spark):
    keys = np.random.default_rng(1).integers(-2 ** 63, 2 ** 63 - 1, 3000)
    f = bloom_filter(spark.createDataFrame([(int(k),) for k in keys] + [(None,)], "h long"), "h", 10)
    assert may_hold(f, keys.view(np.uint64)).all()
    other = np.random.default_rng(2).integers(-2 ** 63, 2 ** 63 - 1, 3000).view(np.uint64)
    assert may_hold(f, other).mean() < 0.2


def brute_dedup(rows, width):
    words = [SPACES.findall(t or "") for _, t in rows]
    least = {}
    for (i, _), w in zip(rows, words):
        for k in range(len(w) - width + 1) if i is not None else ():
            key = tuple(w[k:k + width])
            least[key] = min(least.get(key, i), i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = [False] * len(w)
        for k in range(len(w) - width + 1) if i is not None else ():
            if least[tuple(w[k:k + width])] < i:
                gone[k:k + width] = [True] * width
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_dedup_equals_brute_force(spark):
    rows = awkward()
    for params in (SubstringParams(), SubstringParams(width=9, gram=3), SubstringParams(width=50, bloom_log_words=3)):
        got = sorted((tuple(r) for r in dedup(documents(spark, rows), params=params).collect()), key=repr)
        assert got == brute_dedup(rows, params.width)
    assert any(r[2] for r in got)
    small = [(i, t) for i, t in near_copies(4, 6, 10)]  # few words, many partial overlaps
    p = SubstringParams(width=12, gram=4)
    assert sorted((tuple(r) for r in dedup(documents(spark, small), params=p).collect()), key=repr) == brute_dedup(small, 12)
    assert dedup(empty(spark)).count() == 0
