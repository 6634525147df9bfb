"""Licence chains against brute force: matches by diagonal, best chain by trying all."""

import random

from fixtures import documents
from qalake.llm import licenses
from qalake.llm.licenses import ScanParams, scan

P = ScanParams()


def diagonal_matches(words, seq, least):
    """(start, end, start in seq) of all matches that cannot be continued."""
    out = []
    for d in range(-len(seq) + 1, len(words)):
        run = 0
        for i in range(max(d, 0), min(len(words), d + len(seq)) + 1):
            if i < min(len(words), d + len(seq)) and words[i] == seq[i - d]:
                run += 1
            else:
                if run >= least:
                    out.append((i - run, i, i - run - d))
                run = 0
    return out


def best_chain(words, seqs, k, p=P):
    every = [diagonal_matches(words, s, min(p.min_match, len(s))) for s in seqs]
    strong = [(a, z, j) for j, m in enumerate(every) for a, z, _ in m if z - a >= p.min_cover * len(seqs[j])]

    def grow(last, covered):
        best = covered
        a0, z0, t0 = last
        for a, z, t in every[k]:
            text, place = z - max(a, z0), t + z - a - max(t, t0 + z0 - a0)
            if a <= a0 or t <= t0 or a - z0 > p.max_gap or min(text, place) <= 0:
                continue
            if any(x < min(z0, a) and y > max(z0, a) and j != k for x, y, j in strong):
                continue
            best = max(best, grow((a, z, t), covered + min(text, place)))
        return best

    return max((grow(m, m[1] - m[0]) for m in every[k]), default=0)


def test_chains_equal_brute_force(spark):
    rng = random.Random(4)
    for trial in range(4):
        vocab = [f"v{i}" for i in range(5 + 6 * trial)]
        seqs = [[rng.choice(vocab) for _ in range(rng.randrange(3, 16))] for _ in range(5)]
        seqs.append(seqs[0] + seqs[1])
        seqs.append(seqs[2][:4] + ["zz"] + seqs[2][4:])
        texts = []
        for _ in range(40):
            words = []
            for _ in range(rng.randrange(1, 5)):
                part = list(rng.choice(seqs))
                for _ in range(rng.randrange(3)):
                    part[rng.randrange(len(part))] = rng.choice(vocab)
                words += part + [rng.choice(vocab) for _ in range(rng.randrange(4))]
            texts.append(words)
        templates = [(f"t{k}", " ".join(s)) for k, s in enumerate(seqs)]
        rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
        got = {r.doc_id: r for r in scan(documents(spark, rows), templates=templates, base={"never here": "x"}).collect()}
        for i, words in enumerate(texts):
            cover = [best_chain(words, seqs, k) / len(s) for k, s in enumerate(seqs)]
            assert got[i].score == max(cover)
            assert got[i].labels == ",".join(f"t{k}" for k, c in enumerate(cover) if c >= P.min_cover)
            for k in range(len(seqs)):
                own = sorted((s.start, s.end) for s in got[i].spans if s.template == k)
                assert all(x[1] <= y[0] for x, y in zip(own, own[1:]))


def labels(spark, text, templates=None):
    r = scan(documents(spark, [(1, text)]), templates=templates).first()
    return r.labels, r.score


def test_a_whole_template_is_kept_where_the_text_goes_on_into_another(spark):
    both = [("a", "a1 a2 a3 a4 a5"), ("b", "a1 a2 a3 a4 a5 b1 b2 b3 b4 b5 b6 b7 b8"), ("c", "x1 a1 a2 a3 a4 a5 c1 c2 c3 c4")]
    assert labels(spark, "a1 a2 a3 a4 a5 b1 b2 zz", both) == ("a", 1.0)
    assert labels(spark, "x1 a1 a2 a3 a4 a5", both) == ("a", 1.0)


def test_repeats_of_a_piece_cover_it_once(spark):
    for piece, times in (("charge to any person obtaining", 13), ("software without restriction including without limitation", 12)):
        found, score = labels(spark, " ".join([piece] * times))
        assert found == "" and score < 0.2


def test_a_gap_inside_another_licence_is_not_bridged(spark):
    cc = "Licensed under a Creative Commons Attribution{} 4.0 International License."
    assert labels(spark, cc.format("-NonCommercial"))[0] == "cc-by-nc"
    assert labels(spark, cc.format("-ShareAlike"))[0] == "cc-by-sa"
    assert labels(spark, cc.format(""))[0] == "cc-by"


def test_clauses_and_copies(spark):
    text = dict((t, label) for label, t in licenses.TEMPLATES)
    for t, label in text.items():
        assert label in labels(spark, t)[0].split(",")
    clause = next(t for t in text if t.startswith("the software is provided as is"))
    r = scan(documents(spark, [(1, clause + " and " + clause)])).first()
    assert [(s.start, s.end, s.covered) for s in r.spans if s.label == "mit"] == \
        [(0, len(clause.split()), len(clause.split())), (len(clause.split()) + 1, 2 * len(clause.split()) + 1, len(clause.split()))]
