"""Field extraction from raw HTML held in a table.

Regex expressions only (JVM side, codegen'd): scripts, styles and comments are
removed first so that a ``</p>`` inside a script cannot end a paragraph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns (dot-all, non-greedy) used by both Spark and the oracle.
NOISE_RE = "(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->"
TITLE_RE = "(?s)<title[^>]*>(.*?)</title>"
H1_RE = "(?s)<h1[^>]*>(.*?)</h1>"
LANG_RE = '<html[^>]*lang="([^"]*)"'
PARA_RE = "(?s)<p(?: [^>]*)?>(.*?)</p>"
TAG_RE = "<[^>]*>"
# The entities decoded, in decoding order (&amp; last).
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def unescape(c: Column) -> Column:
    for k, v in ENTITIES:
        c = F.replace(c, F.lit(k), F.lit(v))
    return c


def text_of(c: Column) -> Column:
    """Tag-stripped, entity-decoded, trimmed text."""
    return F.trim(unescape(F.regexp_replace(c, TAG_RE, "")))


def html_fields(pages: DataFrame, html: str = "html") -> DataFrame:
    """title, h1, lang, paragraph count and paragraph text (joined by newline)."""
    clean = F.regexp_replace(F.col(html), NOISE_RE, "")
    paras = F.regexp_extract_all(clean, F.lit(PARA_RE), 1)
    texts = F.filter(F.transform(paras, text_of), lambda x: x != "")
    return pages.select(
        "*",
        text_of(F.regexp_extract(clean, TITLE_RE, 1)).alias("title"),
        text_of(F.regexp_extract(clean, H1_RE, 1)).alias("h1"),
        F.regexp_extract(F.col(html), LANG_RE, 1).alias("page_lang"),
        F.size(texts).alias("n_paragraphs"),
        F.array_join(texts, "\n").alias("body_text"),
    ).drop(html)
