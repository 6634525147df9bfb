"""Operator 9, nearest neighbours: randomly rotated one-bit codes.

Every unit vector o is rotated by a random orthogonal matrix and kept as the
signs of its coordinates (packed bits) and one correction scalar
c = <x, o>, where x is the sign vector over sqrt(d). For a unit query q,
<x, q> / c estimates <o, q>, with an error below
width * sqrt((1 - c*c) / (c*c * (d - 1))) except with a small probability.

Search: the query set is dealt into blocks, the candidates into blocks, and
each pair of blocks is one task. There the estimates of all candidates come
from the codes; the best few by estimate give an exact threshold; every
candidate whose upper bound reaches it is reranked with its exact cosine.

Equal vectors are searched once: only the k+1 smallest ids of each distinct
vector can be among anyone's k nearest, so a vector that a third of the rows
share costs no more than any other.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qalake.llm.store import written
from qalake.llm.words import worker_cache

RESULT = "query_id long, rank int, vec_id long, score double"


@dataclass(frozen=True)
class AnnParams:
    k: int = 5
    width: float = 2.5          # error bound in standard deviations
    seed: int = 7               # of the rotation
    query_block: int = 1024     # rows of a block, about
    candidate_block: int = 4096


def rotation(d: int, seed: int) -> np.ndarray:
    """Random orthogonal d x d matrix, the same for one seed everywhere."""
    def make():
        q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
        return q * np.sign(np.diag(r))
    return worker_cache(("rotation", d, seed), make)


def encode(vectors: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(packed sign bits, correction scalars) of non-zero rows."""
    d = vectors.shape[1]
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    turned = unit @ rotation(d, seed)
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(1) / np.sqrt(d)


def search_block(queries: np.ndarray, cands: np.ndarray, codes: np.ndarray, scale: np.ndarray, ids: np.ndarray,
                 p: AnnParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, cosine) of the k+1 best candidates of each
    query in one block; ties go to the smaller id. At least all whose upper
    bound reaches the exact threshold are reranked."""
    d, want = queries.shape[1], min(p.k + 1, len(cands))
    qn, cn = np.sqrt((queries * queries).sum(1)), np.sqrt((cands * cands).sum(1))
    turned = ((queries / qn[:, None]) @ rotation(d, p.seed)).astype(np.float32)
    signs = np.unpackbits(codes, axis=1, count=d).astype(np.float32) * np.float32(2) - np.float32(1)
    est = turned @ signs.T
    est /= (np.sqrt(d) * scale).astype(np.float32)
    err = p.width * np.sqrt(np.maximum(0.0, 1 - scale * scale) / (scale * scale * max(d - 1, 1)))
    rows, cols, scores = [], [], []
    for i in range(len(queries)):
        def exact(at):
            return (cands[at] * queries[i]).sum(1) / (cn[at] * qn[i])
        top = np.argpartition(-est[i], want - 1)[:want]
        least = exact(top).min()
        at = np.flatnonzero(est[i] + err >= least - 1e-6)
        at = np.union1d(at, top)
        s = exact(at)
        best = np.lexsort((ids[at], -s))[:want]
        rows.append(np.full(len(best), i))
        cols.append(at[best])
        scores.append(s[best])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(scores)


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    col = col.combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1).astype(np.float64)


def usable(vec: Column) -> Column:
    """Vectors that take part: not null, no null or non-finite component, not zero."""
    inf = float("inf")
    return (vec.isNotNull() & (F.size(vec) > 0)
            & F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)), F.lit(False))
            & F.coalesce(F.exists(vec, lambda x: x != 0), F.lit(False)))


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding",
            params: AnnParams = AnnParams()) -> DataFrame:
    """The k nearest rows (largest cosine) of every row where ``is_query``
    holds, among all rows but itself: ``query_id``, ``rank`` from 1,
    ``vec_id``, ``score`` (exact cosine of the original vectors, in double).

    Ties go to the smaller id; equal vectors are candidates each under its own
    id. Vectors that are null, zero, or hold null or non-finite components,
    and rows with a null id, take no part. Only vectors of one dimension are
    compared. Rows that repeat an id are one row if their vectors are equal.
    Fewer than k candidates give fewer rows; an empty table none. Other
    columns are not read.
    """
    p = params
    v = (vectors.where(usable(vectors[vec_col]) & vectors[id_col].isNotNull())
         .select(vectors[id_col].cast("long").alias("id"), vectors[vec_col].cast("array<double>").alias("vec"),
                 F.coalesce(is_query, F.lit(False)).alias("q")).distinct())
    some = v.withColumn("r", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("r") <= p.k + 1)
    distinct = some.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    distinct = distinct.select(F.element_at("ids", 1).alias("rep"), "ids", "vec", F.size("vec").alias("dim"))

    def coded(batches):
        for b in batches:
            by_dim: dict[int, list[int]] = {}
            for i, d in enumerate(b.column("dim").to_pylist()):
                by_dim.setdefault(d, []).append(i)
            for at in by_dim.values():
                part = pa.Table.from_batches([b]).take(at)
                code, scale = encode(_matrix(part.column("vec")), p.seed)
                yield from part.append_column("code", pa.array([c.tobytes() for c in code], pa.binary())) \
                    .append_column("scale", pa.array(scale)).to_batches()

    index = written(distinct.mapInArrow(coded, "rep long, ids array<long>, vec array<double>, dim int, code binary, "
                                               "scale double"), "codes")
    asked = v.where("q").select(F.col("id").alias("query_id"), "vec").join(index.select("vec", "rep"), "vec") \
        .select("query_id", "rep")
    asked = written(asked, "asked")
    queries = index.toDF(*index.columns).join(asked.select("rep").distinct(), "rep", "left_semi") \
        .select(F.col("rep").alias("qrep"), F.col("vec").alias("qvec"), F.col("dim").alias("dim"))
    n_q = -(-asked.count() // p.query_block) or 1
    n_c = -(-index.count() // p.candidate_block) or 1
    by = ["dim", "qb", "cb"]
    # fresh columns on both sides: they come from one table
    left = queries.select("qrep", "qvec", "dim", F.pmod(F.xxhash64("qrep"), F.lit(n_q)).cast("int").alias("qb"),
                          F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))).alias("cb"))
    right = index.select("rep", "vec", "dim", "code", "scale", F.pmod(F.xxhash64("rep"), F.lit(n_c)).cast("int").alias("cb"),
                         F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("qb"))

    def search(q: pa.Table, c: pa.Table) -> pa.Table:
        if not q.num_rows or not c.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "c": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        qid, cid = q.column("qrep").to_numpy(), c.column("rep").to_numpy()
        codes = np.frombuffer(b"".join(c.column("code").to_pylist()), np.uint8).reshape(c.num_rows, -1)
        rows, cols, s = search_block(_matrix(q.column("qvec")), _matrix(c.column("vec")), codes,
                                     c.column("scale").to_numpy(), cid, p)
        return pa.table({"q": qid[rows], "c": cid[cols], "score": s})

    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(search, "q long, c long, score double")
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "c"))) \
        .where(F.col("r") <= p.k + 1)
    # every query id with the ids of its best vectors: at most (k+1) * (k+1) of them
    lists = best.join(index.select(F.col("rep").alias("c"), "ids"), "c").groupBy("q") \
        .agg(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("s"), i.alias("id")))))
             .alias("l"))
    mine = asked.join(lists, asked["rep"] == lists["q"]).select(
        "query_id", F.slice(F.array_sort(F.filter("l", lambda x: x["id"] != F.col("query_id"))), 1, p.k).alias("l"))
    return mine.select("query_id", F.posexplode("l").alias("i", "x")).select(
        "query_id", (F.col("i") + 1).alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.s")).alias("score"))
