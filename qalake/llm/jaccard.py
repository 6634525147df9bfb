"""Operator 3, n-gram Jaccard join: prefix-filtered set join (no sparse product).

Documents are rows, shingles columns of a 0/1 matrix M; overlaps are entries
of M M'. With similarity s = num/den, two sets of sizes a >= b can only link
if b*den >= a*num, and then share at least t = ceil(num*(a+b)/(num+den)).
If both are sorted by one global order, their first l common shingles stand in
the first n - t + l of each, so a prefix of n - ceil(num*n/den) + 1 columns of
every row is enough, and a pair must share at least

    l(a, b) = t - ceil(num*a/den) + 1        (a the larger size)

columns of the two prefixes. The product is formed over prefixes only: a
column held by one distinct set is dropped, the entries of the others are
joined by column (where their positions allow a link), the overlap of the two
prefixes is counted for each pair met, pairs below the bound are discarded,
and what is left is verified on whole sets.

* Equal sets are one row (keyed by a hash of the set), so a group of copies
  costs no more than one document.
* The order is rare-first. Frequencies come from shingles repeated inside a
  scan chunk, summed over all chunks; the ``hints`` most frequent are
  broadcast (size fixed by the parameter). Any order is exact; a good one only
  makes columns short.
* Large near-copy groups: first every column links its members to a few
  pivots (stars), these links are verified and merged into components; only
  then are pairs formed, between different components of a column.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qalake.llm.graph import components
from qalake.llm.store import bloom_filter, may_hold, written
from qalake.llm.words import LOWER, NON_SPACE, grams, signed, small_batches, split_words, unsigned


@dataclass(frozen=True)
class JaccardParams:
    words: int = 5             # words of a shingle
    num: int = 80              # similarity at least num / den
    den: int = 100
    hints: int = 1 << 18       # most frequent shingles whose frequency orders columns
    hint_least: int = 4        # least count of such a shingle
    hint_chunk: int = 1 << 21  # shingles of a scan chunk in which repeats are counted
    bloom_log_words: int = 19


def shingle_sets(col, p: JaccardParams) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every row; a row with fewer words has
    its whole sequence as one shingle, a row without words none."""
    w = split_words(col, NON_SPACE, LOWER)
    all_grams = grams(w.hash, p.words)
    out = []
    for a, z in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if z - a >= p.words:
            out.append(np.unique(all_grams[a:z - p.words + 1]))
        else:
            out.append(grams(w.hash[a:z], z - a))
    return out


def set_id(s: np.ndarray) -> int:
    """Signed 64-bit hash of a set."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _sets(docs: DataFrame, p: JaccardParams, more: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, rid, n) of all documents, and rows (gram, cnt) of
    shingles repeated in a chunk (doc_id and rid null, n null). ``more``: long
    columns of ``docs`` after the text that are carried along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        size = 0

        def repeats():
            g, c = np.unique(np.concatenate(list(held.values())), return_counts=True)
            g, c = g[c > 1], c[c > 1]
            none = [None] * len(g)
            return pa.record_batch([pa.array(none, pa.int64()), pa.array(none, pa.int64()), pa.array(none, pa.int32()),
                                    pa.array(signed(g)), pa.array(c, pa.int64()), *[pa.array(none, pa.int64()) for _ in more]],
                                   names=["doc_id", "rid", "n", "gram", "cnt", *more])

        for b in small_batches(batches, "text"):
            sets = shingle_sets(b.column(1), p)
            rid = [set_id(s) if len(s) else None for s in sets]
            none = [None] * len(sets)
            yield pa.record_batch([b.column(0), pa.array(rid, pa.int64()), pa.array([len(s) for s in sets], pa.int32()),
                                   pa.array(none, pa.int64()), pa.array(none, pa.int64()), *(b.column(c) for c in more)],
                                  names=["doc_id", "rid", "n", "gram", "cnt", *more])
            for r, s in zip(rid, sets):
                if r is not None and r not in held:
                    held[r] = s
                    size += len(s)
                if size >= p.hint_chunk:
                    yield repeats()
                    held, size = {}, 0
        if held:
            yield repeats()

    return docs.mapInArrow(run, ", ".join(["doc_id long, rid long, n int, gram long, cnt long", *(f"{c} long" for c in more)]))


def _hints(sets: DataFrame, p: JaccardParams) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingles, frequency) of the most frequent shingles."""
    got = (sets.where("gram is not null").groupBy("gram").agg(F.sum("cnt").alias("c"))
           .where(F.col("c") >= p.hint_least).orderBy(F.desc("c"), "gram").limit(p.hints).toArrow())
    g, c = unsigned(got.column("gram").to_numpy()), got.column("c").to_numpy()
    order = np.argsort(g)
    return g[order], c[order]


def _prefixes(docs: DataFrame, hints, p: JaccardParams) -> DataFrame:
    """(gram, rid, n, pos): the prefix columns of every distinct set of a task,
    pos counting from 1 in the global order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, freq = hints.value
        seen: set[int] = set()
        for b in small_batches(batches, "text"):
            cols, rids, sizes = [], [], []
            for s in shingle_sets(b.column(1), p):
                n = len(s)
                if not n or (rid := set_id(s)) in seen:
                    continue
                seen.add(rid)
                keep = n + (-p.num * n // p.den) + 1  # n - ceil(num*n/den) + 1
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    f = np.where(known[at] == s, freq[at], 0)
                    often = np.flatnonzero(f)
                    if len(often):  # s is sorted: rare ones first as they are, then by frequency
                        order = often[np.lexsort((s[often], f[often]))]
                        s = np.concatenate([s[f == 0], s[order]])
                cols.append(s[:keep])
                rids.append(rid)
                sizes.append(n)
            if cols:
                lens = [len(c) for c in cols]
                yield pa.record_batch([pa.array(signed(np.concatenate(cols))), pa.array(np.repeat(rids, lens), pa.int64()),
                                       pa.array(np.repeat(sizes, lens), pa.int32()),
                                       pa.array(np.concatenate([np.arange(1, k + 1) for k in lens]), pa.int32())],
                                      names=["gram", "rid", "n", "pos"])

    return docs.mapInArrow(run, "gram long, rid long, n int, pos int")


def _whole_sets(docs: DataFrame, wanted, p: JaccardParams) -> DataFrame:
    """(rid, items): the sets that the filter ``wanted`` may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = wanted.value
        seen: set[int] = set()
        for b in small_batches(batches, "text"):
            rids, items = [], []
            sets = [s for s in shingle_sets(b.column(1), p) if len(s)]
            ids = [set_id(s) for s in sets]
            hit = may_hold(bloom, unsigned(np.array(ids, np.int64)))
            for r, s, h in zip(ids, sets, hit.tolist()):
                if h and r not in seen:
                    seen.add(r)
                    rids.append(r)
                    items.append(s.tobytes())
            yield pa.record_batch([pa.array(rids, pa.int64()), pa.array(items, pa.binary())], names=["rid", "items"])

    return docs.mapInArrow(run, "rid long, items binary").dropDuplicates(["rid"])


def _bounds(a: Column, b: Column, p: JaccardParams) -> tuple[Column, Column, Column]:
    """(sizes may link, least overlap t, least number of common prefix columns)."""
    big, small = F.greatest(a, b).cast("long"), F.least(a, b).cast("long")
    t = F.ceil(p.num * (big + small) / F.lit(p.num + p.den))
    return small * p.den >= big * p.num, t, t - F.ceil(p.num * big / F.lit(p.den)) + 1


def _verified(docs: DataFrame, pairs: DataFrame, p: JaccardParams) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""
    pairs = written(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("rid")).unionByName(pairs.select(F.col("b").alias("rid")))
    wanted = docs.sparkSession.sparkContext.broadcast(bloom_filter(ids, "rid", p.bloom_log_words))
    sets = written(_whole_sets(docs, wanted, p), "sets")
    left = pairs.join(sets.select(F.col("rid").alias("a"), F.col("items").alias("x")), "a")
    both = left.join(sets.select(F.col("rid").alias("b"), F.col("items").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("x"), b.column("y")):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = int((v[np.minimum(np.searchsorted(v, u), len(v) - 1)] == u).sum())
                keep.append(common * p.den >= p.num * (len(u) + len(v) - common))
            yield pa.record_batch([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return written(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "links")


def links(docs: DataFrame, sets: DataFrame, p: JaccardParams) -> DataFrame:
    """(node, root) of every set that links with another one. ``docs``: id and
    text; ``sets``: the written rows of ``_sets``."""
    spark = docs.sparkSession
    hints = spark.sparkContext.broadcast(_hints(sets, p))
    rows = written(_prefixes(docs, hints, p), "prefixes")
    shared = rows.groupBy("gram").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi")).where("lo < hi").select("gram")
    entries = written(rows.join(shared, "gram").dropDuplicates(["gram", "rid"]), "entries")  # columns of two sets or more
    mixed = F.xxhash64("rid")
    by = entries.groupBy("gram").agg(F.array_distinct(F.array(F.min("rid"), F.max("rid"), F.min_by("rid", mixed),
                                                              F.max_by("rid", mixed))).alias("pivots"))
    held = written(entries.groupBy("rid").agg(F.first("n").alias("n"), F.collect_list("gram").alias("grams")), "rows")

    def fitting(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose prefixes overlap enough."""
        x = held.select(F.col("rid").alias("a"), F.col("n").alias("na"), F.col("grams").alias("ga"))
        y = held.select(F.col("rid").alias("b"), F.col("n").alias("nb"), F.col("grams").alias("gb"))
        sizes, _, least = _bounds(F.col("na"), F.col("nb"), p)
        return pairs.join(x, "a").join(y, "b").where(sizes) \
            .where(F.size(F.array_intersect("ga", "gb")) >= least).select("a", "b")

    stars = entries.join(by, "gram").select(F.explode("pivots").alias("p"), "rid").where("rid <> p") \
        .select(F.least("p", "rid").alias("a"), F.greatest("p", "rid").alias("b")).distinct()
    found = _verified(docs, fitting(stars), p)
    roots = written(components(found), "roots")

    # pairs between different components of a column. The first common column of a linked pair stands at most
    # n - t + 1 from the start of both rows, and the pair is met there only: no column before it is common
    own = entries.join(roots.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    mixed = own.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("gram")
    open_ = written(own.join(mixed, "gram"), "open")
    lists = open_.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("pos", "gram"))).alias("cols"))
    open_ = open_.join(lists, "rid").withColumn("before", F.size(F.filter("cols", lambda c: c["pos"] < F.col("pos")))) \
        .withColumn("cols", F.col("cols.gram"))
    x = open_.select("gram", F.col("before").alias("xs"), F.col("cols").alias("xc"), F.col("rid").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"), F.col("pos").alias("pa"))
    y = open_.select("gram", F.col("before").alias("ys"), F.col("cols").alias("yc"), F.col("rid").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"), F.col("pos").alias("pb"))
    sizes, t, least = _bounds(F.col("na"), F.col("nb"), p)
    near = (F.col("pa") <= F.col("na") - t + 1) & (F.col("pb") <= F.col("nb") - t + 1)
    first = ~F.arrays_overlap(F.slice("xc", F.lit(1), F.col("xs")), F.slice("yc", F.lit(1), F.col("ys")))
    enough = F.size(F.array_intersect("xc", "yc")) >= least  # all their common columns are open: the roots differ
    pairs = x.join(y, "gram").where("a < b").where("ra <> rb").where(sizes & near & first & enough).select("a", "b")
    more = _verified(docs, pairs, p)
    if more.isEmpty():
        return roots
    return components(found.unionByName(more))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: JaccardParams = JaccardParams()) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles`` and ``component_id``,
    the smallest id reachable over links of similarity num/den or more.

    Null or empty text, or text without words: no shingles, linked with
    nothing, its own component. Repeated ids: each row is linked by its own
    text. A null id stays null, and its component is the smallest id among
    the others (its own, null, if there is none). Very long texts are taken
    whole; ties need no rule, as links are symmetric. Empty table: no rows.
    Other columns are not read.
    """
    p = params
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    sets = written(_sets(docs, p), "documents")
    own = sets.where("n is not null")
    roots = links(docs, sets, p)
    reps = own.where("rid is not null").groupBy("rid").agg(F.min("doc_id").alias("least"))
    linked = reps.join(roots.withColumnRenamed("node", "rid"), "rid")
    least = linked.groupBy("root").agg(F.min("least").alias("component"))
    linked = linked.join(least, "root").select("rid", "component")
    reps = reps.join(linked, "rid", "left").select("rid", F.coalesce("component", "least").alias("component"))
    return own.join(reps, "rid", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               params: JaccardParams = JaccardParams()) -> DataFrame:
    """``docs`` with one document of each group of links: its smallest id.

    Rows that repeat an id are one document, of which one row stays; rows with
    a null id and rows without shingles stay. Only rows that a bounded filter
    of the ids to drop may hold are shuffled with their texts."""
    found = written(join(docs, id_col, text_col, params), "components")
    gone = found.where("component_id < doc_id").select(F.col("doc_id").alias("__id")).distinct()
    again = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("__id"))
    touched = gone.unionByName(again).select(F.xxhash64("__id").alias("h"))
    bloom = docs.sparkSession.sparkContext.broadcast(bloom_filter(touched, "h", params.bloom_log_words))

    @F.pandas_udf("boolean")
    def may(h: pd.Series) -> pd.Series:
        return pd.Series(may_hold(bloom.value, h.to_numpy().view(np.uint64)))

    key = F.col(id_col).cast("long")
    rows = docs.withColumn("__may", may(F.xxhash64(key)) & key.isNotNull())
    sure = rows.where(~F.col("__may")).drop("__may")
    asked = rows.where("__may").drop("__may").withColumn("__id", key)
    kept = asked.join(gone, "__id", "left_anti").dropDuplicates(["__id"]).drop("__id")
    return sure.unionByName(kept)


def keep_first_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    params: JaccardParams = JaccardParams()) -> DataFrame:
    """``docs`` with one row of each group of links, judged row by row: the row
    of the smallest id, a null id being the largest.

    Rows that repeat an id are told apart by their texts (64-bit hash of id and
    text); of rows that repeat both, one stays. Rows without shingles all stay.
    Only rows that a bounded filter of the rows to drop may hold are shuffled
    with their texts."""
    p = params
    key = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    texts = docs.select(key.alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("long").alias("id"))
    sets = written(_sets(texts, p, ("id",)), "documents")
    own = sets.where("rid is not null").select(F.col("doc_id").alias("k"), "id", "rid")
    roots = links(texts.select("doc_id", "text"), sets, p)
    # equal sets first, then the sets of a component
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("k").alias("k"))
    reps = own.groupBy("rid").agg(F.min(order).alias("least"), F.count("*").alias("n"))
    reps = reps.join(roots.withColumnRenamed("node", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    first = reps.groupBy("root").agg(F.min("least").alias("first"), F.sum("n").alias("n")).where("n > 1")
    first = reps.select("rid", "root").join(first, "root").select("rid", F.col("first.k").alias("first"))
    grouped = own.join(first, "rid").select("k", (F.col("k") == F.col("first")).alias("stays"))
    # per row key: false for rows to drop, true for a row that stays once; rows alone have no entry
    marks = written(grouped.groupBy("k").agg(F.first("stays").alias("stays"), F.count("*").alias("n"))
                    .where("not stays or n > 1").select("k", "stays"), "marks")
    bloom = docs.sparkSession.sparkContext.broadcast(bloom_filter(marks, "k", p.bloom_log_words))

    @F.pandas_udf("boolean")
    def may(k: pd.Series) -> pd.Series:
        return pd.Series(may_hold(bloom.value, k.to_numpy().view(np.uint64)))

    rows = docs.withColumn("__k", key).withColumn("__may", may("__k"))
    sure = rows.where(~F.col("__may")).drop("__k", "__may")
    asked = rows.where("__may").drop("__may").join(marks.select(F.col("k").alias("__k"), F.col("stays").alias("__stays")), "__k", "left")
    alone = asked.where("__stays is null").drop("__k", "__stays")
    once = asked.where("__stays").dropDuplicates(["__k"]).drop("__k", "__stays")
    return sure.unionByName(alone).unionByName(once)
