"""F3 clean chain (C15), fused tokenizer equivalence, stemmer, ids."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from qalake.functions import ids
from qalake.functions.stem import porter_stem
from qalake.functions.text import DEFAULT_STOPWORDS, tokens

PUNCT = set('!"#$%&\'()*+,-./:;<=>?@[\\]^_`{|}~')
STOP = set(DEFAULT_STOPWORDS)


def _literal_chain(s):
    """The clean chain step by step, in plain Python (steps 1-7)."""
    s = s.lower()
    s = re.sub(r"<([^>]+)>", "", s)
    s = "".join(" " if c in PUNCT else c for c in s)
    s = re.sub(r"[ \t\n\r\f\x0b]+", " ", s)
    s = re.sub(r"[0-9]+", "", s)
    toks = [t for t in re.split(r"[ \t\n\r\f\x0b]+", s) if t]
    return [t for t in toks if t not in STOP and len(t) >= 3]


def test_c15_chain(spark):
    text = "<b>The</b> p53 protein, isn't it? Über-naïve  genes\tAND 12ab cd"
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(tokens("t").alias("x")).first().x
    assert got == _literal_chain(text)
    assert "über" in got and "naïve" in got and "protein" in got
    assert "the" not in got and "cd" not in got


_alphabet = st.sampled_from(list("abcXYZé 12.,<>-'\t\nthe and"))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=_alphabet, max_size=40), min_size=1, max_size=8))
def test_fused_tokenizer_equals_literal_chain(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.x for r in df.select("i", tokens("t").alias("x")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == _literal_chain(t)


def test_porter_examples():
    for w, s in [("caresses", "caress"), ("ponies", "poni"), ("motoring", "motor"),
                 ("hopping", "hop"), ("filing", "file"), ("relational", "relat"),
                 ("generalization", "gener"), ("cement", "cement"), ("at", "at")]:
        assert porter_stem(w) == s


def test_c2_links(spark):
    links = ["http://www.ncbi.nlm.nih.gov/pubmed/123", "http://x/pubmed/456/", "http://x/abc",
             "http://x/12/34"]
    df = spark.createDataFrame([(u,) for u in links], "u string")
    r = df.select(ids.id_from_url_last("u").alias("a"), ids.id_from_url_digits("u").alias("b")).collect()
    assert [x.a for x in r] == ["123", "", "abc", "34"]
    assert [x.b for x in r] == ["123", "456", None, "12"]
    assert df.select(ids.url_from_id(F.lit(7)).alias("u")).first().u.endswith("/pubmed/7")
