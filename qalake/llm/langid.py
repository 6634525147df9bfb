"""Operator 7, language ID: multinomial naive Bayes over hashed character n-grams.

Training counts (language, n-gram bucket) are summed inside each task and then
by a partial aggregation; the model is a log-probability matrix of languages x
``buckets``, whose size is bounded by the parameters and the number of
languages. It is broadcast, and texts are scored in numpy by batches: each text
is counted into (bucket, count) entries, slice by slice, and the sparse matrix
of texts x buckets is multiplied with the log-probabilities in bounded pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qalake.llm.words import mix, small_batches

UNKNOWN = "und"
PREDICTIONS = "doc_id long, lang_pred string, score double"


@dataclass(frozen=True)
class LangParams:
    orders: tuple[int, ...] = (1, 2, 3)   # n-gram lengths in characters
    buckets: int = 1 << 15
    alpha: float = 0.5                    # additive smoothing
    max_languages: int = 512              # bound of the broadcast matrix
    temperature: float = 12.0             # n-grams that count as one observation: they overlap


SLICE = 1 << 16      # characters counted at once
PRODUCT = 1 << 21    # doubles of a piece of the product


def features(text: str, p: LangParams) -> np.ndarray:
    """Bucket of every character n-gram of a lower-cased text."""
    c = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    out = []
    key = None
    for n in range(1, max(p.orders) + 1):
        if len(c) < n:
            break
        key = c if n == 1 else (key[:-1] << np.uint64(21)) | c[n - 1:]
        if n in p.orders:
            out.append(mix(key + np.uint64(n << 60 if n < 8 else n)) & np.uint64(p.buckets - 1))
    return np.concatenate(out).astype(np.int64) if out else np.empty(0, np.int64)


def bucket_counts(text: str, p: LangParams, size: int = SLICE) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, count) of all n-grams of a text, ascending. Long texts are
    counted slice by slice; the n-grams of the overlap of two slices, which
    both hold, are taken off once."""
    text, over = text.lower(), max(p.orders) - 1
    if len(text) <= size:
        return np.unique(features(text, p), return_counts=True)
    sums = np.zeros(p.buckets, np.int64)
    for at in range(0, len(text), size):
        sums += np.bincount(features(text[max(0, at - over):at + size], p), minlength=p.buckets)
        if at:
            sums -= np.bincount(features(text[max(0, at - over):at], p), minlength=p.buckets)
    at = np.flatnonzero(sums)
    return at, sums[at]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _counts(labelled: DataFrame, p: LangParams) -> DataFrame:
    """(lang, bucket, n) over all rows of (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in small_batches(batches, "text"):
            for lang, cell in zip(b.column(0).to_pylist(), b.column(1)):
                text = cell.as_py()
                if lang is not None and has_letter(text):
                    at, n = bucket_counts(text, p)
                    if lang not in sums:
                        sums[lang] = np.zeros(p.buckets, np.int64)
                    sums[lang][at] += n
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()),
                                   pa.array(n[at], pa.int64())], names=["lang", "bucket", "n"])

    return labelled.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    languages: list[str]
    log_prob: np.ndarray  # buckets x languages, float32
    params: LangParams

    def totals(self, texts: list[str], piece: int = PRODUCT) -> np.ndarray:
        """Log-likelihoods, texts x languages: the sparse count matrix times
        ``log_prob``, at most ``piece`` products at a time."""
        out = np.zeros((len(texts), len(self.languages)))
        step = max(1, piece // max(1, len(self.languages)))
        held: list[tuple[int, np.ndarray, np.ndarray]] = []

        def multiply() -> None:
            if not held:
                return
            at = np.concatenate([x for _, x, _ in held])
            n = np.concatenate([x for _, _, x in held]).astype(np.float64)
            first = np.cumsum([0] + [len(x) for _, x, _ in held[:-1]])
            # a text stands at most once among the held entries
            out[[i for i, _, _ in held]] += np.add.reduceat(self.log_prob[at] * n[:, None], first, axis=0)
            held.clear()

        size = 0
        for i, text in enumerate(texts):
            at, n = bucket_counts(text, self.params)
            for a in range(0, len(at), step):
                part = len(at[a:a + step])
                if a or size + part > step:
                    multiply()
                    size = 0
                held.append((i, at[a:a + step], n[a:a + step]))
                size += part
        multiply()
        return out

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, its posterior) of each text; ties go to the language first by name."""
        got = [(UNKNOWN, 0.0)] * len(texts)
        judged = [i for i, t in enumerate(texts) if self.languages and has_letter(t)]
        total = self.totals([texts[i] for i in judged]) / self.params.temperature
        for i, row in zip(judged, total):
            best = int(np.argmax(row))
            got[i] = (self.languages[best], float(1.0 / np.exp(row - row[best]).sum()))
        return got

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_all([text])[0]


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", params: LangParams = LangParams()) -> Model:
    """Model of all rows with a language and a letter in their text.

    Null languages and texts teach nothing. Raises when there are more
    languages than ``max_languages`` (the matrix is broadcast). Priors are
    equal: how often a language stands in the table is no evidence about a text.
    """
    p = params
    rows = _counts(labelled.select(labelled[lang_col].cast("string").alias("lang"),
                                   labelled[text_col].cast("string").alias("text")), p)
    packed = rows.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("c"))
    got = packed.limit(p.max_languages + 1).collect()  # one row of at most `buckets` counts per language
    if len(got) > p.max_languages:
        raise ValueError(f"more than {p.max_languages} languages")
    got.sort(key=lambda r: r["lang"])
    counts = np.zeros((p.buckets, len(got)))
    for j, r in enumerate(got):
        for bucket, n in r["c"]:
            counts[bucket, j] = n
    log_prob = np.log((counts + p.alpha) / (counts.sum(0) + p.alpha * p.buckets)) if got else counts
    return Model([r["lang"] for r in got], log_prob.astype(np.float32), p)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
            keep: list[str] | None = None) -> DataFrame:
    """Prediction for every document, or, with ``keep``, those columns of
    ``docs`` together with ``lang_pred`` and ``score``.

    ``lang_pred`` is a learned language, or ``und`` (score 0) if the text is
    null, empty or without a letter, or nothing was learned. ``score`` is the
    posterior in 0..1, tempered because overlapping n-grams are no independent
    observations. Whole texts are scored, very long ones too; repeated or null
    ids are judged row by row; an empty table has no rows; other columns are
    not read, and kept ones named ``lang_pred`` or ``score`` are replaced.
    """
    p = model.params
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.log_prob))
    if keep is None:
        docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
        keep, text_col, schema = ["doc_id"], "text", PREDICTIONS
    else:
        docs = docs.select(*dict.fromkeys([*keep, text_col]))
        keep = [c for c in keep if c not in ("lang_pred", "score")]
        from pyspark.sql import types as T
        schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("lang_pred", T.StringType()),
                                                                T.StructField("score", T.DoubleType())])
    kept, text_name = list(keep), text_col

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value, p)
        for b in small_batches(batches, text_name):
            got = m.predict_all(b.column(text_name).to_pylist())
            yield pa.record_batch([*(b.column(c) for c in kept), pa.array([x for x, _ in got], pa.string()),
                                   pa.array([x for _, x in got], pa.float64())], names=[*kept, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 4 (null ids: null)."""
    return F.crc32(id_col.cast("string").cast("binary")) % 4
