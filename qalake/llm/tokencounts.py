"""Operator 8, token counts: offset-mapped attribution.

Each document is encoded once as a whole. Byte-level ids spell the text, so a
running sum of token byte lengths gives every token's span, and counting the
UTF-8 lead bytes turns it into characters. Sections are intervals of the text;
token spans are joined to them by a sorted interval search. A token that
crosses a section boundary is given to one section by ``rule``:

* ``start``: the section that holds its first byte;
* ``end``: the section that holds its last byte;
* ``most``: the section that holds most of its bytes (ties: the earlier one).

Counts of a document's sections always add up to the tokens of the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from qalake.llm.tokens import encoder

SECTIONS = ("doc_id long, section int, start_char long, n_chars long, n_tokens long, "
            "n_crossing long, doc_tokens long")
_TYPES = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
_NAMES = [c.split()[0] for c in SECTIONS.split(", ")]
_FLUSH = 200_000


def line_starts(raw: np.ndarray) -> np.ndarray:
    """Byte positions where a section starts: 0 and after each newline that
    something follows."""
    at = np.flatnonzero(raw == 0x0A) + 1
    return np.concatenate([[0], at[at < len(raw)]])


def attribute(starts: np.ndarray, n: int, sizes: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of each section, tokens that cross into the next one).

    ``starts``: ascending first bytes of the sections of a text of ``n``
    bytes; ``sizes``: byte lengths of its tokens."""
    ends = np.cumsum(sizes)
    begins = ends - sizes
    first = np.searchsorted(starts, begins, side="right") - 1
    last = np.searchsorted(starts, np.maximum(ends - 1, begins), side="right") - 1
    crossing = np.bincount(first[last > first], minlength=len(starts))
    if rule == "start":
        owner = first
    elif rule == "end":
        owner = last
    elif rule == "most":
        owner = first.copy()
        stops = np.append(starts[1:], n)
        for i in np.flatnonzero(last > first):  # the few crossing tokens
            own = np.arange(first[i], last[i] + 1)
            held = np.minimum(stops[own], ends[i]) - np.maximum(starts[own], begins[i])
            owner[i] = own[np.argmax(held)]
    else:
        raise ValueError(f"rule {rule!r}: start, end or most")
    return np.bincount(owner, minlength=len(starts)), crossing


def section_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: str = "start",
                   ranks_path: str | None = None) -> DataFrame:
    """Token counts of every section (line) of every document.

    One row per section: ``doc_id``, ``section`` (from 0), ``start_char``,
    ``n_chars`` (its newline included), ``n_tokens`` by ``rule``,
    ``n_crossing`` (tokens that start in it and end in a later one),
    ``doc_tokens``. Null or empty text has one empty section without tokens.
    Repeated or null ids: each row is its own document. Very long texts are
    encoded whole. Other columns are not read; an empty table has no rows.
    """
    if rule not in ("start", "end", "most"):
        raise ValueError(f"rule {rule!r}: start, end or most")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path)
        for b in batches:
            parts, held = [], 0
            for doc_id, cell in zip(b.column(0).to_pylist(), b.column(1)):
                text = cell.as_py() or ""
                raw = np.frombuffer(text.encode(), np.uint8)
                starts = line_starts(raw)
                ids = enc.ids(text)
                counts, crossing = attribute(starts, len(raw), enc.n_bytes[ids], rule)
                chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                at = chars[starts]
                n = len(starts)
                parts.append([[doc_id] * n, np.arange(n), at, np.diff(np.append(at, chars[-1])), counts,
                              crossing, np.full(n, len(ids))])
                held += n
                if held >= _FLUSH:
                    yield _batch(parts)
                    parts, held = [], 0
            if parts:
                yield _batch(parts)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")) \
        .mapInArrow(run, SECTIONS)


def _batch(parts) -> pa.RecordBatch:
    ids = [i for p in parts for i in p[0]]
    cols = [pa.array(ids, _TYPES[0])] + [pa.array(np.concatenate([p[k] for p in parts]), _TYPES[k])
                                         for k in range(1, len(_TYPES))]
    return pa.record_batch(cols, names=_NAMES)
