"""Operator 11, phrase collocation mining: SON partitioning.

Documents are dealt into ``shards`` by a hash of id and text. A phrase that
stands ``support`` times in a language stands, in at least one shard, as often
as ``support`` times that shard's share of the language (shares add up to one).
So each shard is mined completely at its lowered support; the union of what is
locally frequent holds every frequent phrase and is counted once more, exactly,
over all documents.

A shard is no task: it is mined by Spark over many tasks, which send only
counted (shard, phrase hash) rows, and level by level. A phrase of three or
four words is looked at only where all its word pairs are frequent in its
shard. The sets of one step reach the next as Bloom filters of a fixed size:
a full one lets more through, never less. Hashes choose candidates only (two
phrases that share one are both kept); the last count is by the words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qalake.llm import words as W
from qalake.llm.store import bloom_filter, may_hold, written

_ALL = np.arange(256)
#: `[.,;:!?\x0A-\x0D]` ends a piece, `[^\x20\x09]+` are its words
PIECE_END = np.isin(_ALL, [0x2E, 0x2C, 0x3B, 0x3A, 0x21, 0x3F, 0x0A, 0x0B, 0x0C, 0x0D])
WORD = ~(PIECE_END | (_ALL == 0x20) | (_ALL == 0x09))
_ODD = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class PhraseParams:
    support: int = 30
    longest: int = 4
    cover: int = 80          # per cent of a phrase's places that a longer one must hold to replace it
    scale: int = 2_000_000
    top: int = 2000
    shards: int = 4
    log_filter: int = 20     # Bloom filters of 2**20 words (8 MB)
    salts: int = 32
    slice_bytes: int = 3 << 20


class _Slice:
    """Words of some documents with the places of their phrases."""

    def __init__(self, batch: pa.RecordBatch):
        text = batch.column("text")
        self.w = W.split_words(text, WORD, W.LOWER)
        self.raw, _ = W.text_bytes(text)
        cut = np.cumsum(PIECE_END[self.raw], dtype=np.int32)
        row = self.w.row()
        self.lang = batch.column("lh").to_numpy().astype(np.int64, copy=False).view(np.uint64)[row]
        self.shard = batch.column("shard").to_numpy().astype(np.uint64)[row]
        at = cut[self.w.start]
        new = np.ones(len(row), bool)
        new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
        self.piece = np.cumsum(new, dtype=np.int32)

    def places(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(first words, hashes with the language) of the phrases of k words."""
        g = W.grams(self.w.hash, k)
        at = np.flatnonzero(self.piece[:len(g)] == self.piece[k - 1:]) if len(g) else np.empty(0, np.int64)
        return at, W.mix(g[at] + self.lang[at] * _ODD)

    def cells(self, at: np.ndarray, gram: np.ndarray) -> np.ndarray:
        return gram ^ (self.shard[at] << np.uint64(40))

    def phrases(self, at: np.ndarray, k: int) -> pa.Array:
        """The phrases of k words that start at words ``at``, joined by one space."""
        start, last = self.w.start[at], at + k - 1
        size = self.w.start[last] + self.w.length[last] - start
        plain = np.full(len(at), k - 1)
        for i in range(k):
            plain += self.w.length[at + i]
        flat = W.LOWER[self.raw]
        flat[flat == 0x09] = 0x20
        if (plain == size).all():
            offsets = np.zeros(len(at) + 1, np.int64)
            np.cumsum(size, out=offsets[1:])
            data = flat[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])]
            return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))
        out = [b" ".join(flat[s:s + n].tobytes().split(b" ")) if p == n else b" ".join(flat[s:s + n].tobytes().split())
               for s, n, p in zip(start.tolist(), size.tolist(), plain.tolist())]
        return pa.array([x.decode() for x in out], pa.large_string())


def _keyed(docs: DataFrame, text_col: str, id_col: str, lang_col: str, p: PhraseParams) -> DataFrame:
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    lang = F.coalesce(docs[lang_col].cast("string"), F.lit("und"))
    return docs.select(text.alias("text"), lang.alias("lang"), F.xxhash64(lang).alias("lh"),
                       F.pmod(F.xxhash64(docs[id_col].cast("string"), text), F.lit(p.shards)).cast("int").alias("shard"))


def _least(keyed: DataFrame, p: PhraseParams) -> DataFrame:
    """(lh, shard, salt, least): the support of each shard, lowered by its share of the language's bytes."""
    size = keyed.groupBy("lh", "shard").agg(F.sum(F.octet_length("text").cast("long")).alias("b"))
    size = size.withColumn("total", F.sum("b").over(Window.partitionBy("lh")))
    least = F.expr(f"case when total > 0 then greatest((b * {p.support} + total - 1) div total, 1) end")  # rounded up
    return size.select("lh", "shard", F.coalesce(least, F.lit(1)).alias("least"),
                       F.explode(F.sequence(F.lit(0), F.lit(p.salts - 1))).alias("salt"))


def _mined(keyed: DataFrame, least: DataFrame, p: PhraseParams, pairs: np.ndarray | None) -> DataFrame:
    """(gram, shard) of the phrases frequent in their shard: pairs of words, or
    with the filter ``pairs`` of those, the longer phrases."""
    spark = keyed.sparkSession
    held = None if pairs is None else spark.sparkContext.broadcast(pairs)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.small_batches(batches, "text", p.slice_bytes):
            s = _Slice(b)
            at, gram = s.places(2)
            if held is None:
                found = [(at, gram)]
            else:
                ok = np.zeros(len(s.piece) + 1, bool)
                ok[at] = may_hold(held.value, s.cells(at, gram))
                run, found = ok.copy(), []
                for k in range(3, p.longest + 1):
                    run = run[:-1] & ok[k - 2:]          # all pairs of the k words are frequent
                    at, gram = s.places(k)
                    keep = run[at]
                    found.append((at[keep], gram[keep]))
            for at, gram in found:
                if not len(at):
                    continue
                _, first, n = np.unique(s.cells(at, gram), return_index=True, return_counts=True)
                yield pa.record_batch([pa.array(W.signed(gram[first])), pa.array(s.shard[at[first]].astype(np.int32)),
                                       pa.array(W.signed(s.lang[at[first]])), pa.array(n)], names=["gram", "shard", "lh", "n"])
    local = (keyed.select("text", "lh", "shard").mapInArrow(counts, "gram long, shard int, lh long, n long")
             .groupBy("gram", "shard").agg(F.sum("n").alias("n"), F.min("lh").alias("lh")))
    salt = F.pmod("gram", F.lit(p.salts)).cast("int")
    return (local.withColumn("salt", salt).join(least, ["lh", "shard", "salt"])
            .where("n >= least").select("gram", "shard"))


def _counted(keyed: DataFrame, wanted: np.ndarray, p: PhraseParams) -> DataFrame:
    """(lang, k, phrase, n): how often each word and each phrase of the filter
    ``wanted`` stands in its language; k = 0 without phrase: all words."""
    held = keyed.sparkSession.sparkContext.broadcast(wanted)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(langs, k, phrase, n):
            return pa.record_batch([langs.cast(pa.string()), pa.array(np.full(len(n), k, np.int32)), phrase.cast(pa.string()),
                                    pa.array(n.astype(np.int64))], names=["lang", "k", "phrase", "n"])
        for b in W.small_batches(batches, "text", p.slice_bytes):
            s, lang = _Slice(b), b.column("lang")
            row = s.w.row()
            codes = lang.dictionary_encode()
            yield out(codes.dictionary, 0, pa.nulls(len(codes.dictionary), pa.string()),
                      np.bincount(codes.indices.to_numpy(), s.w.counts, len(codes.dictionary)))
            for k in range(1, p.longest + 1):
                at, gram = s.places(k)
                if k > 1:
                    keep = may_hold(held.value, gram)
                    at, gram = at[keep], gram[keep]
                if len(at):
                    _, first, n = np.unique(gram, return_index=True, return_counts=True)
                    yield out(lang.take(pa.array(row[at[first]])), k, s.phrases(at[first], k), n)
    return (keyed.select("text", "lang", "lh", "shard").mapInArrow(counts, "lang string, k int, phrase string, n long")
            .groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n")))


def _parts(phrase: Column, a: Column, n: Column) -> Column:
    """n words from word a (0-based) of a phrase."""
    return F.array_join(F.slice(F.split(phrase, " ", -1), a + 1, n), " ")


def frequent(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang",
             params: PhraseParams = PhraseParams()) -> DataFrame:
    """(lang, k, phrase, n) of every phrase of up to ``longest`` words with
    ``support`` places or more, and a row k = 0 with all words of a language."""
    p = params
    keyed = _keyed(docs, text_col, id_col, lang_col, p)
    least = written(_least(keyed, p), "phrase-support")
    pairs = written(_mined(keyed, least, p, None), "phrase-pairs")
    cell = F.col("gram").bitwiseXOR(F.shiftleft(F.col("shard").cast("long"), 40))
    seen = bloom_filter(pairs.select(cell.alias("cell")), "cell", p.log_filter)
    longer = written(_mined(keyed, least, p, seen), "phrase-longer")
    wanted = bloom_filter(pairs.select("gram").unionByName(longer.select("gram")), "gram", p.log_filter)
    return _counted(keyed, wanted, p).where((F.col("k") == 0) | (F.col("n") >= p.support))


def mine(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang",
         params: PhraseParams = PhraseParams()) -> DataFrame:
    """Per language the first ``top`` phrases of 2 to ``longest`` words: lang,
    rank, phrase, a (places), l and r (places of the two parts of the cut of
    least score), n (all words of the language), score.

    Null text is empty, null language is ``und``; an empty text, an empty table
    or a language without a frequent phrase gives no row. Repeated rows count
    each; ids only deal the shards and may be null or repeated. Very long texts
    are counted whole. Ties in score and places go by the phrase's bytes, ties
    between cuts to the earliest. Other columns are not read.
    """
    p = params
    known = written(frequent(docs, text_col, id_col, lang_col, p), "phrases")
    # every part of a frequent phrase is as frequent, so both parts of each cut are here
    of = known.where("k > 0").select("lang", "phrase", "n")
    many = known.where("k > 1").select("lang", "k", "phrase", F.col("n").alias("a"))
    cut = many.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("at"))
    cut = cut.select("*", _parts(F.col("phrase"), F.lit(0), F.col("at")).alias("head"),
                     _parts(F.col("phrase"), F.col("at"), F.col("k") - F.col("at")).alias("tail"))
    cut = (cut.join(of.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"])
           .join(of.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r")), ["lang", "tail"]))
    wide = "decimal(20,0)"
    score = F.expr(f"cast(a as {wide}) * {p.scale} div (cast(l as {wide}) + cast(r as {wide}))")
    cut = cut.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct(score.alias("score"), "at", "l", "r")).alias("c"))
    # the most frequent longer phrase around each phrase
    inner = many.where("k > 2").select("lang", "k", "phrase", "a", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("m"))
    inner = inner.select("lang", "a", "phrase", "m", F.explode(F.sequence(F.lit(0), F.col("k") - F.col("m"))).alias("from"))
    around = (inner.select("lang", _parts(F.col("phrase"), F.col("from"), F.col("m")).alias("phrase"), "a")
              .groupBy("lang", "phrase").agg(F.max("a").alias("around")))
    kept = cut.join(around, ["lang", "phrase"], "left").where(
        F.expr(f"coalesce(100 * cast(around as {wide}) < {p.cover} * cast(a as {wide}), true)"))
    best = Window.partitionBy("lang").orderBy(F.desc("c.score"), F.desc("a"), "phrase")
    top = kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= p.top)
    return (top.join(known.where("k = 0").select("lang", F.col("n").alias("n")), "lang")
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "c.l", "c.r", "n",
                    F.col("c.score").cast("long").alias("score")))
