"""Operator 10, substring dedup: windows of ``width`` words that an earlier
document holds too are removed.

A suffix automaton of the reference is not broadcast here: the reference is
the corpus itself, so it has no size bound (see README). Instead, matching is
done by content-chosen anchors, exactly and in shuffles whose size follows
what is repeated:

1. Each window's anchor is the least hash among its ``gram``-word shingles, so
   equal windows have equal anchors. Successive windows of one anchor form a
   passage; (anchor, passage hash, document) rows are aggregated by anchor.
2. An anchor in one document only is dropped. If all its passages are equal,
   its windows are equal everywhere: the smallest document keeps them.
3. For the other shared anchors, the windows themselves are hashed and
   aggregated the same way. A bounded Bloom filter of these anchors picks the
   windows; false positives are only more rows.
4. Documents with marks (again by a bounded filter) are joined to them and
   lose the covered words.

Hashes have 64 bits; words are compared unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qalake.llm.store import bloom_filter, may_hold, written
from qalake.llm.words import NON_SPACE, Words, grams, mix, signed, sliding_min, small_batches, split_words, unsigned

REMOVED = "doc_id long, n_words long, n_removed long, kept_sha256 string"


@dataclass(frozen=True)
class SubstringParams:
    width: int = 50          # words of a window
    gram: int = 8            # words of an anchor shingle
    bloom_log_words: int = 19


def windows(w: Words, p: SubstringParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, anchor, hash) of every window that lies in one row."""
    own = grams(w.hash, p.width)
    anchor = sliding_min(grams(w.hash, p.gram), p.width - p.gram + 1)
    at = np.flatnonzero(np.arange(len(own)) + p.width <= w.row_end()[:len(own)])
    return at, anchor[at], own[at]


def passages(at: np.ndarray, anchor: np.ndarray, own: np.ndarray, row: np.ndarray):
    """(row, anchor, passage hash): runs of successive windows of one anchor."""
    if not len(at):
        return row[:0], anchor, own
    edge = np.ones(len(at), bool)
    edge[1:] = (anchor[1:] != anchor[:-1]) | (row[at[1:]] != row[at[:-1]]) | (at[1:] != at[:-1] + 1)
    start = np.flatnonzero(edge)
    size = np.diff(np.append(start, len(at))).astype(np.uint64)
    return row[at[start]], anchor[start], mix(np.add.reduceat(mix(own), start) + size)


def _distinct(*cols: np.ndarray) -> np.ndarray:
    """Positions of the first of equal tuples."""
    order = np.lexsort(cols[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([c[order][1:] != c[order][:-1] for c in cols], axis=0)
    return order[new]


def _rows(id_col: str, text_col: str, docs: DataFrame) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def marks(docs: DataFrame, params: SubstringParams = SubstringParams()) -> DataFrame:
    """(doc_id, key): anchors and window hashes whose windows a smaller
    document holds too. ``docs``: doc_id, text."""
    p = params
    known = docs.where("doc_id is not null")

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text"):
            ids = b.column(0).to_numpy()
            w = split_words(b.column(1), NON_SPACE)
            row, anchor, passage = passages(*windows(w, p), w.row())
            first = _distinct(row, anchor, passage)
            yield pa.record_batch([pa.array(signed(anchor[first])), pa.array(signed(passage[first])),
                                   pa.array(ids[row[first]])], names=["anchor", "passage", "doc_id"])

    rows = written(known.mapInArrow(anchored, "anchor long, passage long, doc_id long"), "anchors")
    shared = rows.groupBy("anchor").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"),
                                        F.min("passage").alias("p1"), F.max("passage").alias("p2")).where("least < most")
    shared = written(shared.select("anchor", "least", (F.col("p1") == F.col("p2")).alias("same")), "shared")
    whole = rows.select("anchor", "doc_id").join(shared.where("same").select("anchor", "least"), "anchor") \
        .where("doc_id > least").select("doc_id", F.col("anchor").alias("key"))
    picked = docs.sparkSession.sparkContext.broadcast(bloom_filter(shared.where("not same"), "anchor", p.bloom_log_words))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = picked.value
        for b in small_batches(batches, "text"):
            ids = b.column(0).to_numpy()
            w = split_words(b.column(1), NON_SPACE)
            at, anchor, own = windows(w, p)
            hit = may_hold(bloom, anchor)
            row, own = w.row()[at[hit]], own[hit]
            first = _distinct(row, own)
            yield pa.record_batch([pa.array(signed(own[first])), pa.array(ids[row[first]])], names=["window", "doc_id"])

    rows2 = written(known.mapInArrow(hashed, "window long, doc_id long"), "windows")
    least = rows2.groupBy("window").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    single = rows2.join(least.select("window", "least"), "window").where("doc_id > least") \
        .select("doc_id", F.col("window").alias("key"))
    return whole.unionByName(single).distinct()


def _result(ids, counts, removed, digests, texts=None) -> pa.RecordBatch:
    cols = [pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
            pa.array(digests, pa.string())]
    names = [c.split()[0] for c in REMOVED.split(", ")]
    if texts is not None:
        cols.append(pa.array(texts, pa.string()))
        names.append("text")
    return pa.record_batch(cols, names=names)


def covered(w: Words, key: np.ndarray, p: SubstringParams) -> np.ndarray:
    """Which words lie in a window whose anchor or hash is in ``key``."""
    at, anchor, own = windows(w, p)
    hit = at[np.isin(anchor, key) | np.isin(own, key)]
    n = len(w.hash)
    step = np.bincount(hit, minlength=n + 1) - np.bincount(hit + p.width, minlength=n + 1)[:n + 1]
    return np.cumsum(step)[:n] > 0


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          params: SubstringParams = SubstringParams()) -> DataFrame:
    """One row per document: ``n_words``, ``n_removed`` and the SHA-256 of
    its kept words joined by one space.

    Windows are judged on the input. Null or empty text has no words (digest
    of the empty string). Equal ids are one document, so they never remove
    each other's words; a document with a null id neither removes nor loses
    words. Very long texts are taken whole. Ties: of equal windows, all
    documents but the smallest id lose them. Empty table: no rows. Other
    columns are not read.
    """
    p = params
    rows = _rows(id_col, text_col, docs)
    lists = written(marks(rows, p).groupBy("doc_id").agg(F.collect_list("key").alias("keys")), "marks")
    spark = docs.sparkSession
    marked = spark.sparkContext.broadcast(bloom_filter(lists.select(F.xxhash64("doc_id").alias("h")), "h", p.bloom_log_words))

    def unmarked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = marked.value
        for b in small_batches(batches, "text"):
            hit = may_hold(bloom, unsigned(b.column("h").to_numpy()))
            counts, digests, texts = [], [], []
            for may, cell in zip(hit.tolist(), b.column("text")):
                text = cell.as_py()
                if may and text:
                    counts.append(None)
                    digests.append(None)
                    texts.append(text)
                else:
                    words = (text or "").encode().split()
                    counts.append(len(words))
                    digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                    texts.append(None)
            yield _result(b.column("doc_id"), counts, [None if t else 0 for t in texts], digests, texts)

    # texts go on only for documents that may have marks
    first = rows.select("doc_id", F.xxhash64("doc_id").alias("h"), "text").mapInArrow(unmarked, REMOVED + ", text string")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text"):
            ids, counts, removed, digests = (b.column(i).to_pylist() for i in range(4))
            for i in range(b.num_rows):
                if counts[i] is not None:
                    continue
                w = split_words(b.column("text").slice(i, 1), NON_SPACE)
                words = b.column("text")[i].as_py().encode().split()
                keys = b.column("keys")[i].values
                gone = np.zeros(len(words), bool) if keys is None else \
                    covered(w, unsigned(keys.to_numpy(zero_copy_only=False).astype(np.int64)), p)
                counts[i], removed[i] = len(words), int(gone.sum())
                kept = [x for x, g in zip(words, gone.tolist()) if not g]
                digests[i] = hashlib.sha256(b" ".join(kept)).hexdigest()
            yield _result(ids, counts, removed, digests)

    return first.join(lists, "doc_id", "left").select(*[c.split()[0] for c in REMOVED.split(", ")], "text", "keys") \
        .mapInArrow(cut, REMOVED)
