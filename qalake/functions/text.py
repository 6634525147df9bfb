"""Text expressions (F1-F13, F21, T1-T3 tokenisation).

All of them are native Catalyst expressions, so they run inside whole-stage
codegen; only the Porter stemmer (``qalake.functions.stem``) is Python, and it
runs once per distinct term.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spark's default English stop-word list
# (StopWordsRemover.loadDefaultStopWords("english"), 181 words), in its order.
DEFAULT_STOPWORDS_TEXT = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself "
    "she her hers herself it its itself they them their theirs themselves what which who whom this "
    "that these those am is are was were be been being have has had having do does did doing a an "
    "the and but if or because as until while of at by for with about against between into through "
    "during before after above below to from up down in out on off over under again further then "
    "once here there when where why how all any both each few more most other some such no nor not "
    "only own same so than too very s t can will just don should now i'll you'll he'll she'll we'll "
    "they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've "
    "you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't "
    "wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's "
    "there's what's when's where's who's why's would"
)
DEFAULT_STOPWORDS = DEFAULT_STOPWORDS_TEXT.split(" ")

# Fixed patterns of the clean chain (F3). Character classes are spelled out so
# that Java regex (Spark) and RE2 (DuckDB oracle) read them identically.
TAG_RE = "<([^>]+)>"
PUNCT_RE = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""
WS_CLASS = "[ \\t\\n\\r\\f\\x0B]"
WS_RE = WS_CLASS + "+"
DIGITS_RE = "[0-9]+"
MIN_TOKEN_LEN = 3


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def clean_text(col: Column | str) -> Column:
    """F3 steps 1-5: lower, strip tags, punctuation -> space, squeeze
    whitespace, drop digit runs."""
    t = F.lower(_c(col))
    t = F.regexp_replace(t, TAG_RE, "")
    t = F.regexp_replace(t, PUNCT_RE, " ")
    t = F.regexp_replace(t, WS_RE, " ")
    return F.regexp_replace(t, DIGITS_RE, "")


# Token separators: whitespace or ASCII punctuation (steps 3-4 fused into the split).
SEP_RE = "[" + WS_CLASS[1:-1] + PUNCT_RE[1:-1] + "]+"


def tokens(col: Column | str, stopwords: list[str] | None = None,
           min_len: int = MIN_TOKEN_LEN) -> Column:
    """F3 steps 1-7 as ``array<string>`` (stemming is a separate vocabulary job).

    Same tokens as the literal chain with three regex passes instead of five:
    punctuation-to-space and whitespace squeezing only matter as separators,
    and deleting digits commutes with them (digits are neither punctuation
    nor whitespace)."""
    stop = DEFAULT_STOPWORDS if stopwords is None else stopwords
    t = F.regexp_replace(F.regexp_replace(F.lower(_c(col)), TAG_RE, ""), DIGITS_RE, "")
    toks = F.split(t, SEP_RE)
    if not stop:
        return F.filter(toks, lambda x: F.length(x) >= min_len)
    # ``isin`` over many literals is rewritten to a hash-set lookup (InSet).
    return F.filter(toks, lambda x: (F.length(x) >= min_len) & ~x.isin(*stop))


def ws_tokens(col: Column | str) -> Column:
    """Whitespace tokens, empty strings removed."""
    return F.filter(F.split(_c(col), WS_RE), lambda x: x != "")


def ltrim_ws(col: Column | str) -> Column:
    """left trim of the whitespace set."""
    return F.regexp_replace(_c(col), "^" + WS_RE, "")


def char_slice(text: Column, start: Column, end: Column) -> Column:
    """F8: ``text[start:end]`` with 0-based char offsets."""
    return F.substr(text, start + 1, end - start)


def find0(text: Column, needle: Column, case_insensitive: bool = True) -> Column:
    """0-based position of ``needle`` in ``text``, -1 when absent."""
    if case_insensitive:
        text, needle = F.lower(text), F.lower(needle)
    return F.instr(text, needle) - 1
