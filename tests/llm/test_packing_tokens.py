"""Packing (1) and token counts (8) against the tokenizer and brute force."""

import os
import random
import sys
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(__file__))
from fixtures import awkward, documents, empty

from qalake.llm.packing import PackParams, best_cuts, pack
from qalake.llm.tokencounts import section_tokens
from qalake.llm.tokens import Encoder, default_ranks


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_ids_equal_the_tokenizer(reference):
    enc = Encoder(default_ranks())
    rng = random.Random(1)
    texts = [t for _, t in awkward() if t]
    texts += ["".join(rng.choice(" \n\t\u00a0\x1cab.'s!9é") for _ in range(60)) for _ in range(400)]
    texts += [" lead", "trail ", "a  b", "it's  I'm\n\nwe'll ", "x" * 500 + " y", "<|endoftext|> a"]
    for t in texts:
        assert enc.ids(t).tolist() == reference.encode(t, add_special_tokens=False).ids, t


def test_best_cuts_are_optimal():
    rng = random.Random(3)
    p = PackParams(sequence=16, window_cost=2, least_window=4)
    for _ in range(60):
        n = rng.randrange(1, 60)
        cuts = sorted({*rng.sample(range(1, n + 1), rng.randrange(1, n + 1)), *range(10, n, 10), n})
        pens = [rng.randrange(0, 6) for _ in cuts]

        def cost(ends):
            total, last = 0, 0
            for e in ends:
                size = e - last
                free = size & (size - 1) == 0 and (size >= p.least_window or e >= n - p.sequence)
                total += (0 if free else p.sequence - size) + p.window_cost + pens[cuts.index(e)]
                last = e
            return total
        def padding(c, size):
            free = size & (size - 1) == 0 and (size >= p.least_window or c >= n - p.sequence)
            return 0 if free else p.sequence - size
        best = {0: 0}
        for i, c in enumerate(cuts):
            best[c] = min(best[b] + padding(c, c - b) + p.window_cost + pens[i] for b in best if c - b <= p.sequence)
        got = best_cuts(np.array(cuts), np.array(pens), p)
        assert cost(got) == best[n]


@pytest.mark.parametrize("params", [PackParams(), PackParams(sequence=64, chunk_tokens=1500)])
def test_pieces_cover_every_id_once(spark, reference, params):
    rows = awkward()
    pieces = pack(documents(spark, rows), params=params).collect()
    want = defaultdict(list)
    for i, t in rows:
        want[i].append(reference.encode(t or "", add_special_tokens=False).ids + [1])
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_seq[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
    padding = tokens = 0
    for s in by_seq.values():
        s.sort(key=lambda r: r.offset)
        at = 0
        for r in s:
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == s[0].sequence_length <= params.sequence
        tokens += at
        padding += 0 if at & (at - 1) == 0 else params.sequence - at
    assert tokens == sum(len(x) for v in want.values() for x in v)
    assert padding < (0.02 if params.sequence == 2048 else 0.1) * tokens
    for i, texts in want.items():
        got = sorted((r.doc_tokens, r.start, r.length, r.ids_crc32) for r in by_doc[i])
        if len(texts) == 1:
            at = 0
            for n, start, length, crc in got:
                assert start == at and n == len(texts[0])
                assert zlib.crc32(np.array(texts[0][start:start + length], "<u4").tobytes()) == crc
                at += length
            assert at == len(texts[0])
        else:
            assert sum(g[2] for g in got) == sum(map(len, texts))
    assert pack(empty(spark)).count() == 0


@pytest.mark.parametrize("rule", ["start", "end", "most"])
def test_section_counts_follow_the_rule(spark, reference, rule):
    rows = [(i, t) for i, t in awkward(2) if i is not None and i not in (5, 6)]
    rows += [(1000, "a\n\nb\n"), (1001, "x \n y"), (1002, "\n\n\n\n")]
    got = defaultdict(list)
    for r in section_tokens(documents(spark, rows), rule=rule).collect():
        got[r.doc_id].append(r)
    for i, t in rows:
        t = t or ""
        secs = sorted(got[i], key=lambda r: r.section)
        lines = t.split("\n")
        parts = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] or len(lines) == 1 else [])
        assert [r.n_chars for r in secs] == [len(x) for x in parts], i
        bounds = np.cumsum([0] + [len(x.encode()) for x in parts])
        enc = Encoder(default_ranks())
        sizes = enc.n_bytes[enc.ids(t)]
        counts, crossing, at = [0] * len(parts), 0, 0
        for n in sizes.tolist():
            share = [max(0, min(at + n, bounds[k + 1]) - max(at, bounds[k])) for k in range(len(parts))]
            held = [k for k, s in enumerate(share) if s]
            counts[{"start": held[0], "end": held[-1], "most": int(np.argmax(share))}[rule]] += 1
            crossing += len(held) > 1
            at += n
        assert [r.n_tokens for r in secs] == counts, i
        assert sum(r.n_crossing for r in secs) == crossing
        assert {r.doc_tokens for r in secs} == {len(reference.encode(t, add_special_tokens=False).ids)}
    assert section_tokens(empty(spark)).count() == 0


def test_unknown_rule(spark):
    with pytest.raises(ValueError):
        section_tokens(empty(spark), rule="none")
