"""Porter stemmer (Porter, 1980, "An algorithm for suffix stripping").

A small per-term helper: the library applies it once per *distinct* term
(``operators.textops.stem_terms``) and joins the result back, so the Python
cost grows with the vocabulary, not with the corpus.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VOWELS = "aeiou"

# The published suffix rules, (suffix, replacement) per step,
# in the order they are tried (a matched suffix ends the search for its step,
# whether or not its measure condition then holds).
STEP2_RULES = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
STEP3_RULES = [
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
    ("ful", ""), ("ness", ""),
]
STEP4_SUFFIXES = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion",
    "ou", "ism", "ate", "iti", "ous", "ive", "ize",
]


def _cons(w: str, i: int) -> bool:
    c = w[i]
    if c != "y":
        return c not in _VOWELS
    first = i  # a y counts by the letter before it: along a run of them the kind alternates
    while first > 0 and w[first - 1] == "y":
        first -= 1
    starts = first == 0 or w[first - 1] in _VOWELS
    return starts == ((i - first) % 2 == 0)


def _measure(stem: str) -> int:
    m, i, n = 0, 0, len(stem)
    while i < n and _cons(stem, i):
        i += 1
    while i < n:
        while i < n and not _cons(stem, i):
            i += 1
        if i >= n:
            break
        while i < n and _cons(stem, i):
            i += 1
        m += 1
    return m


def _has_vowel(stem: str) -> bool:
    return any(not _cons(stem, i) for i in range(len(stem)))


def _double_cons(w: str) -> bool:
    return len(w) >= 2 and w[-1] == w[-2] and _cons(w, len(w) - 1)


def _cvc(w: str) -> bool:
    if len(w) < 3:
        return False
    return (_cons(w, len(w) - 3) and not _cons(w, len(w) - 2) and _cons(w, len(w) - 1)
            and w[-1] not in "wxy")


def _by_longest(rules):
    # Within a step, the longest matching suffix is the one tried.
    return sorted(rules, key=lambda r: -len(r[0]))


_S2 = _by_longest(STEP2_RULES)
_S3 = _by_longest(STEP3_RULES)
_S4 = sorted(STEP4_SUFFIXES, key=len, reverse=True)


def porter_stem(word: str) -> str:
    if word is None:
        return None
    w = word.lower()
    if len(w) <= 2:
        return w
    # step 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("ss"):
        pass
    elif w.endswith("s"):
        w = w[:-1]
    # step 1b
    extra = False
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        w, extra = w[:-2], True
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        w, extra = w[:-3], True
    if extra:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double_cons(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    # step 1c
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    # step 2 / 3
    for rules in (_S2, _S3):
        for suf, rep in rules:
            if w.endswith(suf):
                if _measure(w[:-len(suf)]) > 0:
                    w = w[:-len(suf)] + rep
                break
    # step 4
    for suf in _S4:
        if w.endswith(suf):
            stem = w[:-len(suf)]
            if _measure(stem) > 1 and (suf != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    # step 5a
    if w.endswith("e"):
        stem = w[:-1]
        m = _measure(stem)
        if m > 1 or (m == 1 and not _cvc(stem)):
            w = stem
    # step 5b
    if _measure(w) > 1 and _double_cons(w) and w.endswith("l"):
        w = w[:-1]
    return w


@F.pandas_udf(T.StringType())
def porter_stem_udf(terms: pd.Series) -> pd.Series:
    """Arrow-batched: one call per batch of distinct terms."""
    return terms.map(porter_stem)
