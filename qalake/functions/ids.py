"""Identifier expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the URL prefix used to rebuild a document link from its id.
PUBMED_PREFIX = "http://www.ncbi.nlm.nih.gov/pubmed/"


def _c(col):
    return F.col(col) if isinstance(col, str) else col


def id_from_url_last(url: Column | str) -> Column:
    """Last '/'-separated segment (``link.split('/')[-1]``)."""
    return F.element_at(F.split(_c(url), "/"), -1)


def id_from_url_digits(url: Column | str) -> Column:
    """First ``/digits`` run; null (not an exception) when there is none (Q6)."""
    v = F.regexp_extract(_c(url), "/([0-9]+)", 1)
    return F.when(v != "", v)


def ids_from_links(links: Column | str, extractor=id_from_url_last) -> Column:
    """Apply an extractor to every element of an array of links."""
    return F.transform(_c(links), lambda x: extractor(x))


def url_from_id(pid: Column | str, prefix: str = PUBMED_PREFIX) -> Column:
    """Rebuild a link from an id."""
    return F.concat(F.lit(prefix), _c(pid).cast("string"))


def composite_key(*cols: Column | str, sep: str = "_") -> Column:
    """``f"{a}_{b}"``."""
    return F.concat_ws(sep, *[_c(c).cast("string") for c in cols])
