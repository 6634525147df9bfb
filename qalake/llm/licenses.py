"""Operator 4, licence scans: generalised suffix automaton of licence tokens.

The automaton holds the token sequences of all templates. A file's words are
streamed through it; after each word the state gives the longest run of words
ending there that stands in some template (matching statistics), and its suffix
links the shorter runs that stand elsewhere. The maximal matches of a template
are chained in the order of the template over small gaps into spans, and a span
that covers enough distinct words of its template gives the template's label.

Only runs of words of the templates can match, so runs shorter than the least
match are skipped by vectorised look-up. The templates go with the job and each
worker builds the automaton once; its size is linear in their words.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from qalake.llm.words import ALNUM, LOWER, small_batches, split_words, worker_cache

# Base phrases and their labels.
BASE_PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

# Common licence notices (public texts), by label.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction including without limitation "
            "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to "
            "permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the "
            "warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors "
            "or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or "
            "otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed "
               "on an as is basis without warranties or conditions of any kind either express or implied see the license for "
               "the specific language governing permissions and limitations under the license"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance "
               "with the license you may obtain a copy of the license at"),
    ("gpl", "licensed under the gnu general public license version 2"),
    ("gpl", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license as published by the free software foundation"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program if not see"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
            "the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following "
            "disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
            "following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "licensed under the bsd license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
            "granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("boost", "distributed under the boost software license version 1 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
]

SCAN = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, spans array<struct<label:string,template:int,start:long,end:long,covered:int>>")


@dataclass(frozen=True)
class ScanParams:
    min_match: int = 4       # least words of a match that is chained (shorter templates: their length)
    max_gap: int = 8         # words between two matches of one chain
    min_cover: float = 0.8   # share of a template that gives its label


class Automaton:
    """Generalised suffix automaton of integer sequences. ``owners[s]`` is the
    set (bit mask) of sequences that hold the strings of state s."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size, self.owners = [-1], [0], [0]
        for k, seq in enumerate(sequences):
            last = 0
            for w in seq:
                last = self._extend(last, w)
                s = last
                while s > 0 and not self.owners[s] >> k & 1:
                    self.owners[s] |= 1 << k
                    s = self.link[s]
        # a clone made later holds all that its children hold
        for s in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            if self.link[s] > 0:
                self.owners[self.link[s]] |= self.owners[s]
        self.sequences = sequences
        # (sequence, last position) of the prefixes that end in each state
        self.prefixes: list[list[tuple[int, int]]] = [[] for _ in self.size]
        self.children: list[list[int]] = [[] for _ in self.size]
        for k, seq in enumerate(sequences):
            s = 0
            for e, w in enumerate(seq):
                s = self.next[s][w]
                self.prefixes[s].append((k, e))
        for s in range(1, len(self.size)):
            self.children[self.link[s]].append(s)
        self._places: dict[int, list[tuple[int, int, int, int]]] = {}

    def ends(self, state: int) -> Iterator[tuple[int, int]]:
        """(sequence, last position) of every place of a state's strings."""
        stack = [state]
        while stack:
            s = stack.pop()
            yield from self.prefixes[s]
            stack += self.children[s]

    def places(self, state: int, least: list[int]) -> list[tuple[int, int, int, int]]:
        """(common words, sequence, last position, next word) of every place of
        a sequence that ends like the strings of a state, with at least
        ``least`` words in common; 0 common words stand for all that the state
        matched, next word -1 for the end of the sequence."""
        got = self._places.get(state)
        if got is None:
            got, seen, s = [], set(), state
            while s > 0 and self.size[s] >= min(least):
                for k, e in self.ends(s):
                    if (k, e) not in seen:
                        seen.add((k, e))
                        if self.size[s] >= least[k]:
                            seq = self.sequences[k]
                            got.append((0 if s == state else self.size[s], k, e, seq[e + 1] if e + 1 < len(seq) else -1))
                s = self.link[s]
            self._places[state] = got
        return got

    def _state(self, size: int, link: int, nxt: dict[int, int]) -> int:
        self.size.append(size)
        self.link.append(link)
        self.next.append(nxt)
        self.owners.append(0)
        return len(self.size) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """A copy of q for the strings of p followed by w."""
        copy = self._state(self.size[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:  # an earlier sequence went this way
            return q if self.size[q] == self.size[last] + 1 else self._split(last, w, q)
        new = self._state(self.size[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, w, q)
        return new

    def statistics(self, seq: list[int]) -> list[tuple[int, int]]:
        """(length, state) of the longest match that ends at each position."""
        out, s, n = [], 0, 0
        nxt, link, size = self.next, self.link, self.size
        for w in seq:
            while s and w not in nxt[s]:
                s = link[s]
                n = size[s]
            s = nxt[s].get(w, 0)
            n = n + 1 if s else 0
            out.append((n, s))
        return out


def tokens_of(text: str) -> list[str]:
    """Words of a short text, as the scan takes them (A-Z lower-cased first)."""
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


class Scanner:
    """Templates, vocabulary and automaton, ready to scan columns of text."""

    def __init__(self, templates: tuple, base: dict[str, str], params: ScanParams):
        self.p = params
        self.labels = [a for a, _ in templates]
        seqs = [tokens_of(t) for _, t in templates]
        self.lengths = [len(s) for s in seqs]
        self.longest = max(self.lengths)
        self.least = [min(params.min_match, n) for n in self.lengths]
        self.least_of_all = min(self.least)
        phrases = [tokens_of(t) for t in base]
        self.base_labels = list(base.values())
        vocab = sorted({w for s in seqs + phrases for w in s})
        ids = {w: i for i, w in enumerate(vocab)}
        hashes = split_words(pa.array(vocab), ALNUM, LOWER).hash
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order
        self.base = [np.array([ids[w] for w in s]) for s in phrases]
        self.automaton = Automaton([[ids[w] for w in s] for s in seqs])

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.ids[at], -1)

    def base_places(self, ids: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, phrase) of every place of a base phrase."""
        at, which = [], []
        for k, phrase in enumerate(self.base):
            n = len(ids) - len(phrase) + 1
            if n <= 0:
                continue
            hit = row[:n] == row[len(phrase) - 1:]
            for j, w in enumerate(phrase):
                hit &= ids[j:j + n] == w
            found = np.flatnonzero(hit)
            at.append(found)
            which.append(np.full(len(found), k))
        if not at:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at, which = np.concatenate(at), np.concatenate(which)
        order = np.lexsort((which, at))
        return at[order], which[order]

    def runs(self, ids: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, int]]:
        """Runs of template words long enough to hold a match."""
        if not len(ids):
            return
        least = self.least_of_all
        known = ids >= 0
        edge = np.empty(len(ids), bool)
        edge[0] = True
        edge[1:] = (known[1:] != known[:-1]) | (row[1:] != row[:-1])
        a = np.flatnonzero(edge)
        z = np.append(a[1:], len(ids))
        keep = known[a] & (z - a >= least)
        yield from zip(a[keep].tolist(), z[keep].tolist())

    def matches(self, ids: np.ndarray, a: int, z: int) -> Iterator[tuple[int, int, int, int]]:
        """(template, start, end, start in the template) of every match in
        ids[a:z] that can be continued neither to the left nor to the right at
        that place of its template."""
        words = ids[a:z].tolist()
        stats = self.automaton.statistics(words)
        words.append(-2)
        for i, (n, state) in enumerate(stats):
            if n < self.least_of_all:
                continue
            for common, k, e, after in self.automaton.places(state, self.least):
                m = common or n
                if after != words[i + 1] and m >= self.least[k]:
                    yield k, a + i + 1 - m, a + i + 1, e + 1 - m

    def _crossed(self, strong: list[tuple[int, int, int]], k: int, x: int, y: int) -> bool:
        """Whether a match that alone gives another template's label goes on
        from before x to after y."""
        j = bisect_left(strong, (x, 0, 0)) - 1
        while j >= 0 and strong[j][0] + self.longest > y:
            if strong[j][1] > y and strong[j][2] != k:
                return True
            j -= 1
        return False

    def spans(self, found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Chains (template, start, end, covered words) of one row's matches.

        A chain goes forward in the text and in its template, with at most
        ``max_gap`` words of text between two matches; overlaps count once on
        both sides, so ``covered`` counts distinct words of the template. It
        does not bridge a place that another template's match, long enough to
        give that label alone, goes across: those words are the other's. For
        each match the best chain that ends there is kept (ties: the latest
        start); of a template's chains those that cover most are taken first
        (ties: the shorter, then the earlier), and none that overlaps one taken.
        """
        strong = sorted({(a, z, k) for k, a, z, _ in found if z - a >= self.p.min_cover * self.lengths[k]})
        by: dict[int, list[tuple[int, int, int]]] = {}
        for k, a, z, t in found:
            by.setdefault(k, []).append((a, z, t))
        out = []
        for k, own in sorted(by.items()):
            own.sort()
            best: list[tuple[int, int]] = []  # (covered, start) of the best chain that ends with each match
            reach = 0
            for j, (a, z, t) in enumerate(own):
                got = (z - a, a)
                while own[reach][0] + self.lengths[k] + self.p.max_gap < a:
                    reach += 1
                for i in range(reach, j):
                    a0, z0, t0 = own[i]
                    gain = min(z - max(a, z0), t + z - a - max(t, t0 + z0 - a0))
                    if gain <= 0 or a0 >= a or t0 >= t or a - z0 > self.p.max_gap:
                        continue
                    new = (best[i][0] + gain, best[i][1])
                    if new > got and not self._crossed(strong, k, min(z0, a), max(z0, a)):
                        got = new
                best.append(got)
            taken: list[tuple[int, int]] = []
            for _, size, start, covered in sorted((-c, own[j][1] - s, s, c) for j, (c, s) in enumerate(best)):
                end = start + size
                at = bisect_left(taken, (start, end))
                if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or taken[at][0] >= end):
                    taken.insert(at, (start, end))
                    out.append((k, start, end, covered))
        return sorted(out)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         templates: list[tuple[str, str]] | None = None, base: dict[str, str] | None = None,
         params: ScanParams = ScanParams()) -> DataFrame:
    """Licence findings of every document.

    One row per document: ``n_words``; ``n_base`` places of base phrases,
    ``first_word`` / ``last_word`` the smallest and largest start (null if
    none); ``base_labels`` and ``labels`` (base and chained labels), each
    distinct, sorted, comma-joined; ``score``: the largest covered share of a
    template by one chain, 1 if a base phrase stands there; ``spans``: the
    chains that gave labels (word positions, end exclusive).

    ``templates`` are (label, text) pairs of any length, so whole licence texts
    may be given; they go with the job and must fit a worker.

    Null or empty text has no words: counts 0, empty labels, score 0. Very
    long texts are scanned whole. Repeated or null ids: each row is judged
    alone. Ties between templates keep all labels. Empty table: no rows. Other
    columns are not read.
    """
    given = (tuple(templates or TEMPLATES), tuple((base or BASE_PHRASES).items()), params)
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    span = pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("start", pa.int64()),
                               ("end", pa.int64()), ("covered", pa.int32())]))
    types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), span]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # built once in each worker: the automaton is linear in the templates' words
        sc = worker_cache(("licences", repr(given)), lambda: Scanner(given[0], dict(given[1]), given[2]))
        for b in small_batches(batches, "text"):
            w = split_words(b.column(1), ALNUM, LOWER)
            ids, row = sc.word_ids(w.hash), w.row()
            n = b.num_rows
            n_base, firsts, lasts = [0] * n, [None] * n, [None] * n
            labels: list[set] = [set() for _ in range(n)]
            for at, k in zip(*(x.tolist() for x in sc.base_places(ids, row))):
                r = int(row[at])
                pos = at - int(w.first[r])
                n_base[r] += 1
                firsts[r] = pos if firsts[r] is None else firsts[r]
                lasts[r] = pos
                labels[r].add(sc.base_labels[k])
            base_labels = [",".join(sorted(x)) for x in labels]
            score = [1.0 if x else 0.0 for x in n_base]
            found: dict[int, list] = {}
            for a, z in sc.runs(ids, row):
                r = int(row[a])
                shift = int(w.first[r])
                for k, s, e, t in sc.matches(ids, a, z):
                    found.setdefault(r, []).append((k, s - shift, e - shift, t))
            spans: list[list] = [[] for _ in range(n)]
            for r, places in found.items():
                for k, s, e, covered in sc.spans(places):
                    share = covered / sc.lengths[k]
                    score[r] = max(score[r], share)
                    if share >= sc.p.min_cover:
                        labels[r].add(sc.labels[k])
                        spans[r].append({"label": sc.labels[k], "template": k, "start": s, "end": e,
                                         "covered": covered})
            cols = [b.column(0), w.counts, n_base, firsts, lasts, base_labels,
                    [",".join(sorted(x)) for x in labels], score, spans]
            yield pa.record_batch([pa.array(c, t) if not isinstance(c, pa.Array) else c.cast(t)
                                   for c, t in zip(cols, types)], names=names)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")) \
        .mapInArrow(run, SCAN)
