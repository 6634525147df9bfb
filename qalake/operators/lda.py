"""LDA as variational Bayes on long tables.

The model is a table ``(term, lam)`` with one array of k weights per term of
the whole training vocabulary; every pass reads every document. Nothing of
size k x V or of the corpus reaches the driver: only the k topic totals do.

A bag is stored once as blocks of documents with small integers for the block's
terms (``blocks``). A pass: each block gets the weights of its own terms and runs
the numpy E-step over batches of documents of about one length; one partial sum
per (block, term) goes to the term's home, which adds them up (the M-step) and
sends the new weights back to the same blocks. So a pass moves each (block, term)
pair twice, many pairs to a row, and the entries of the bag only in their packed
form. Terms travel as 64-bit hashes that are checked to be distinct. Weights are
seeded by hashes of term and topic, so a fit does not depend on partitioning
beyond the order of floating-point sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qalake.llm.store import drop, written
from qalake.operators.textops import term_counts
from qalake.operators.topics import MIN_PROBABILITY

#: Entries x k of a block: what one task holds packed, about 70 bytes an entry in a pass.
BLOCK_VALUES = 30_000_000
#: Entries x k of a tile, a stored stretch of documents, and of the documents that one E-step runs over (1.6 MB a matrix).
TILE_VALUES = 200_000
#: Weights that one M-step task adds up (32 MB).
HOME_VALUES = 4_000_000
#: Weights of one row on its way between blocks and homes (0.8 MB).
ROW_VALUES = 100_000
#: E-step: most iterations, and the mean change of a document's weights that ends it.
MAX_STEPS = 50
TOLERANCE = 1e-3
#: Documents of a batch are at most this much longer than its shortest, and it is packed anew when fewer than this share still move.
LONGER, STILL_MOVING = 1.15, 0.7


@dataclass(frozen=True)
class LdaModel:
    topics: DataFrame      # (term string, lam array<double> of k)
    totals: list[float]    # sum of lam per topic
    alpha: list[float]     # document concentration per topic
    placed: tuple[Blocks, DataFrame] | None = field(default=None, repr=False, compare=False)   # the weights as blocks hold them

    @property
    def k(self) -> int:
        return len(self.totals)


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of log-gamma for positive ``x``: six steps of the recurrence, two to a fraction, then the asymptotic series."""
    x = np.asarray(x, dtype=float)
    pair = x * (x + 5)
    with np.errstate(divide="ignore"):
        shift = 1 / pair
    shift += 1 / (pair + 4)
    shift += 1 / (pair + 6)
    shift *= 2 * x + 5
    y = x + 6
    r = 1 / (y * y)
    return np.log(y) - 0.5 / y - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132)))) - shift


def _expected(gamma: np.ndarray) -> np.ndarray:
    """exp(E[log theta]) per row."""
    d = digamma(np.concatenate([gamma, gamma.sum(axis=1, keepdims=True)], axis=1))
    return np.exp(d[:, :-1] - d[:, -1:])


def batches(size: np.ndarray, entries: int) -> Iterator[np.ndarray]:
    """The documents dealt into batches of about one size, of ``entries`` or one document each."""
    order = np.argsort(size, kind="stable")
    s, i = size[order], 0
    while i < len(s):
        like = int(np.searchsorted(s, max(s[i] * LONGER, s[i] + 8), side="right"))
        fits = int(np.searchsorted(s[i:like] * np.arange(1, like - i + 1), entries, side="right"))
        yield order[i:i + max(1, fits)]
        i += max(1, fits)


def _settle(n: np.ndarray, beta: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """Weights (documents x k) of one batch, padded with counts of 0 (``n``: documents x length,
    ``beta``: documents x k x length). Each document stops when it has converged, whatever its neighbours do."""
    gamma = alpha + n.sum(axis=1, keepdims=True) / len(alpha)
    out, at, moving = np.empty_like(gamma), np.arange(len(n)), np.ones(len(n), bool)
    for _ in range(MAX_STEPS):
        theta = _expected(gamma)
        share = np.matmul(theta[:, None, :], beta)[:, 0, :]
        share += 1e-100
        np.divide(n, share, out=share)
        new = np.matmul(beta, share[:, :, None])[:, :, 0]
        new *= theta
        new += alpha
        new[~moving] = gamma[~moving]
        moving &= np.abs(new - gamma).mean(axis=1) > TOLERANCE
        gamma, left = new, np.count_nonzero(moving)
        if not left:
            break
        if left < STILL_MOVING * len(moving):
            out[at] = gamma
            at, gamma, n, beta, moving = at[moving], gamma[moving], n[moving], beta[moving], np.ones(left, bool)
    out[at] = gamma
    return out


def e_step(size: np.ndarray, code: np.ndarray, n: np.ndarray, beta: np.ndarray,
           alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents of ``size`` entries each, one after the other (``code``: place of the term in ``beta``, which is
    exp(E[log beta]) per term; ``n``: count): their weights, exp(E[log theta]) of those, and per entry its count
    over the weight that the document's mix gives the term."""
    start, gamma, share = np.cumsum(size) - size, np.empty((len(size), len(alpha))), np.empty(len(n))
    theta = np.empty_like(gamma)
    for docs in batches(size, max(1, TILE_VALUES // len(alpha))):
        at = start[docs][:, None] + np.arange(size[docs].max())
        own = np.arange(at.shape[1]) < size[docs][:, None]
        at[~own] = 0
        held = np.where(own, n[at], 0.0)
        b = np.ascontiguousarray(beta[code[at]].transpose(0, 2, 1))
        gamma[docs] = _settle(held, b, alpha)
        theta[docs] = _expected(gamma[docs])
        share[at[own]] = (held / (np.matmul(theta[docs][:, None, :], b)[:, 0, :] + 1e-100))[own]
    return gamma, theta, share


def by_term(size: np.ndarray, code: np.ndarray, share: np.ndarray, theta: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """The counts shared out to the topics (``e_step``), summed per term: terms x k."""
    return beta * np.stack([np.bincount(code, share * np.repeat(theta[:, i], size), minlength=len(beta))
                            for i in range(beta.shape[1])], axis=1)


def add_by_code(into: np.ndarray, code: np.ndarray, rows: np.ndarray) -> None:
    """``into[c] += rows`` of code c, each code once."""
    order = np.argsort(code, kind="stable")
    code = code[order]
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    into[code[first]] += np.add.reduceat(rows[order], first, axis=0)


def matrix(column: pa.ChunkedArray, k: int) -> np.ndarray:
    """A column of arrays of k doubles as rows x k."""
    return np.concatenate([np.empty(0)] + [c.flatten().to_numpy() for c in column.chunks]).reshape(-1, k)


def arrays(rows: np.ndarray) -> pa.Array:
    """The reverse of ``matrix``."""
    n, k = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(rows.ravel()))


# ---- the bag by blocks -------------------------------------------------------------
TILES = "block long, tile int, docs array<long>, sizes array<int>, codes array<int>, n array<double>, terms array<long>"
LINE_TILES = TILES.replace("terms array<long>", "names array<string>, rows array<long>, cf array<double>")
#: A block's terms on the way to a home: codes (int32), ids (int64) and sums (k doubles each), packed.
SENT = "home long, at long, code binary, id binary, stat binary"
#: Weights (k doubles each, packed) of a block's terms by code, or without a block of terms by id, with their sums.
WEIGHTS = "at long, code binary, id binary, lam binary, sums array<double>"


@dataclass(frozen=True)
class Blocks:
    """A stored bag (``blocks``)."""

    tiles: DataFrame   # TILES: a stretch of a block's documents; codes are places in the terms of the block's tile 0
    terms: DataFrame   # (term string, n long, cf double, id long): every term with its rows in the bag and the sum of its counts
    pairs: int         # (block, term) pairs


def _tiles(block: int, docs: pa.Array, size: np.ndarray, code: np.ndarray, n: np.ndarray, entries: int) -> dict[str, pa.Array]:
    """Columns of the tiles of one block (but ``terms``) from its documents, one after the other; ``entries`` of a tile."""
    start = np.cumsum(size) - size
    tile = start // entries
    cut = np.flatnonzero(np.append(True, tile[1:] != tile[:-1]))[1:]
    at, ends = start[cut], np.append(cut, len(start))
    return {
        "block": pa.array([block] * len(ends), pa.int64()),
        "tile": pa.array(range(len(ends)), pa.int32()),
        "docs": pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), docs),
        "sizes": pa.array(np.split(size.astype(np.int32), cut), pa.list_(pa.int32())),
        "codes": pa.array(np.split(code.astype(np.int32), at), pa.list_(pa.int32())),
        "n": pa.array(np.split(n, at), pa.list_(pa.float64()))}


def _by_document(docs: pa.Array, code: np.ndarray, n: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(documents, entries of each, codes, counts) of rows. Rows without a document are one document each."""
    none = docs.is_null().to_numpy(zero_copy_only=False)
    ids = docs.fill_null(0).to_numpy()
    order = np.lexsort((code, ids, none))
    ids, none = ids[order], none[order]
    start = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | none[1:])[:len(ids)])
    return docs.take(pa.array(order[start])), np.diff(np.append(start, len(ids))), code[order], n[order]


def pack(t: pa.Table, tile_entries: int) -> pa.Table:
    """The tiles of one block from its rows (block, doc_id, id, tf)."""
    terms, code = np.unique(t.column("id").to_numpy(), return_inverse=True)
    tiles = _tiles(t.column("block")[0].as_py(), *_by_document(t.column("doc_id").combine_chunks(), code, t.column("tf").to_numpy()), tile_entries)
    return pa.table(tiles | {"terms": pa.array([terms] + [None] * (len(tiles["tile"]) - 1), pa.list_(pa.int64()))})


def pack_lines(t: pa.Table, tile_entries: int) -> pa.Table:
    """The tiles of one block from its rows (block, doc_id, line, tf): with ``tf``, ``line`` is a term of a document;
    without, it is the terms of a whole document with blanks between them, which are counted here. Beside the tiles,
    the first row has the block's terms, the rows of each and the sum of its counts."""
    doc, line, tf = (t.column(c).combine_chunks() for c in ("doc_id", "line", "tf"))
    whole = pc.and_(tf.is_null(), line.is_valid())
    words = pc.split_pattern(line.filter(whole), " ")
    named = pa.concat_arrays([words.flatten(), line.filter(tf.is_valid())]).dictionary_encode()
    names, code = named.dictionary, named.indices.to_numpy().astype(np.int64)
    lengths = words.value_lengths().to_numpy().astype(np.int64)
    ids, place = np.unique(doc.filter(whole).to_numpy(), return_inverse=True)
    code, single = code[:lengths.sum()], code[lengths.sum():]
    key = np.repeat(place, lengths) * len(names) + code
    word = pc.not_equal(names, "").to_numpy(zero_copy_only=False)
    key, n = np.unique(key if word.all() else key[word[code]], return_counts=True)
    place, code = np.divmod(key, max(1, len(names)))
    held, size = np.unique(place, return_counts=True)
    docs, sizes, single, counts = _by_document(doc.filter(tf.is_valid()), single, tf.drop_null().to_numpy())
    used, code = np.unique(np.append(code, single), return_inverse=True)   # an empty name of a line is not used
    n = np.append(n.astype(float), counts)
    tiles = _tiles(t.column("block")[0].as_py(), pa.concat_arrays([pa.array(ids[held], pa.int64()), docs]), np.append(size, sizes),
                   code, n, tile_entries)
    first = pa.array(np.append(0, np.full(len(tiles["tile"]), len(used))), pa.int32())
    return pa.table(tiles | {name: pa.ListArray.from_arrays(first, values) for name, values in (
        ("names", names.take(pa.array(used))), ("rows", pa.array(np.bincount(code), pa.int64())),
        ("cf", pa.array(np.bincount(code, n), pa.float64())))})


def hashed_terms(counts: DataFrame) -> tuple[DataFrame, int]:
    """``counts`` (term, ...) with id, stored, and the salt of the hash:
    the first with which no two terms share an id."""
    counts = written(counts, "lda-terms")
    for salt in range(1, 9):
        terms = counts.withColumn("id", F.xxhash64("term", F.lit(salt)))
        if terms.groupBy("id").count().where("count > 1").limit(1).count() == 0:
            return terms, salt
    raise ValueError("no salt tells the terms apart")


def even_ids(spark: SparkSession, n: int) -> list[int]:
    """``n`` keys that a shuffle deals evenly to its tasks (plain numbers where they are many for its tasks)."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if n > 4 * parts or parts > 2000:
        return list(range(n))
    at: dict[int, list[int]] = {}
    for r in spark.range(20 * parts).select("id", F.pmod(F.hash("id"), F.lit(parts)).alias("at")).collect():
        at.setdefault(r["at"], []).append(r["id"])
    dealt = sorted((i, key) for keys in at.values() for i, key in enumerate(keys))   # the first key of each task, then the second
    return sorted(key for _, key in dealt[:n])


def _blocks(rows: DataFrame, n_rows: int, k: int) -> Blocks:
    """Rows (doc_id, line, tf) (``pack_lines``), ``n_rows`` entries or a little less, by blocks of documents."""
    spark = rows.sparkSession
    keys = even_ids(spark, max(spark.sparkContext.defaultParallelism, math.ceil(n_rows * k / BLOCK_VALUES)))
    at = F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("line")).otherwise(F.xxhash64("doc_id")), F.lit(len(keys)))
    rows = rows.select(F.element_at(F.array(*[F.lit(key).cast("long") for key in keys]), (at + 1).cast("int")).alias("block"),
                       F.col("doc_id").cast("long").alias("doc_id"), "line", F.col("tf").cast("double").alias("tf"))
    entries = max(1, TILE_VALUES // k)
    packed = rows.groupBy("block").applyInArrow(lambda t: pack_lines(t, entries), LINE_TILES)
    columns = [f.split()[0] for f in TILES.split(", ")]

    def hashed(tiles: DataFrame, salt: int) -> DataFrame:
        return written(tiles.withColumn("terms", F.transform("names", lambda x: F.xxhash64(x, F.lit(salt)))), "lda-tiles")
    tiles = hashed(packed, 1)
    each = tiles.where("tile = 0").select("names", "rows", "cf").mapInArrow(
        lambda tables: (pa.record_batch([c.flatten() for c in t.columns], t.schema.names) for t in tables), "names string, rows long, cf double")
    terms, salt = hashed_terms(each.groupBy(F.col("names").alias("term")).agg(F.sum("rows").alias("n"), F.sum("cf").alias("cf")))
    if salt != 1:
        tiles = hashed(tiles, salt)
    pairs = tiles.where("tile = 0").agg(F.sum(F.size("rows"))).first()[0] or 0
    return Blocks(tiles.select(*columns), terms, pairs)


def blocks(bag: DataFrame, k: int) -> Blocks:
    """``bag`` (doc_id, term, tf), which is read twice, by blocks of documents."""
    bag = bag.where(F.col("term").isNotNull())
    tf = F.coalesce(F.col("tf").cast("double"), F.lit(float("nan")))
    return _blocks(bag.select("doc_id", F.col("term").alias("line"), tf.alias("tf")), bag.count(), k)


def line_blocks(lines: DataFrame, k: int) -> Blocks:
    """The bag of ``lines`` (doc_id, len, line: the document's ``len`` terms with blanks between them), which is read
    twice, by blocks of documents. The rows of a document that has several, or no id, are counted together before."""
    ids = lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    again = written(ids.select(F.col("doc_id").alias("again")), "lda-again")
    single, n_rows = lines, lines.agg(F.sum("len")).first()[0] or 0
    if not again.isEmpty():
        same = F.col("doc_id").eqNullSafe(F.col("again"))
        single = lines.join(again, same, "left_anti")
        many = lines.join(again, same, "left_semi").select("doc_id", F.split("line", " ").alias("toks"))
        many = term_counts(many).where("term != ''").select("doc_id", F.col("term").alias("line"), F.col("tf").cast("double").alias("tf"))
    single = single.select("doc_id", "line", F.lit(None).cast("double").alias("tf"))
    return _blocks(single if again.isEmpty() else single.unionByName(many), n_rows, k)


def _homes(b: Blocks, k: int) -> int:
    return max(b.tiles.sparkSession.sparkContext.defaultParallelism, math.ceil(b.pairs * k / HOME_VALUES))


def _weights(b: Blocks, topics: DataFrame, k: int) -> DataFrame:
    """WEIGHTS of each block's terms, as far as ``topics`` (id, lam) has them."""
    homes = _homes(b, k)

    def own(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tables:
            for block, ids in zip(t.column("block").to_pylist(), t.column("terms")):
                ids = ids.values.to_numpy()
                yield from _sent(block, np.arange(len(ids)), ids, None, k, homes).to_batches()
    asked = b.tiles.where("tile = 0").select("block", "terms").mapInArrow(own, SENT)
    held = topics.select(F.pmod("id", F.lit(homes)).alias("home"), "id", "lam")
    return asked.groupBy("home").cogroup(held.groupBy("home")).applyInArrow(_place(k), WEIGHTS)


# ---- E-step and M-step -------------------------------------------------------------
def entries_of(t: pa.Table, known: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(documents, entries of each, codes, counts) of a block's tiles; unknown terms and documents without another are left out."""
    docs = pa.chunked_array([x.values for x in t.column("docs")], pa.int64()).combine_chunks()
    size, code, n = (np.concatenate([np.empty(0, kind), *(x.values.to_numpy() for x in t.column(c))])
                     for c, kind in (("sizes", np.int32), ("codes", np.int32), ("n", float)))
    if not known.all():
        held = known[code]
        size = np.add.reduceat(held.astype(np.int64), np.cumsum(size) - size) if len(size) else size
        docs, size, code, n = docs.filter(pa.array(size > 0)), size[size > 0], code[held], n[held]
    return docs, size.astype(np.int64), code, n


def tile_terms(t: pa.Table) -> np.ndarray:
    """Ids of the block's terms, by code."""
    at = np.flatnonzero(t.column("tile").to_numpy() == 0)
    return t.column("terms")[int(at[0])].values.to_numpy() if len(at) else np.empty(0, np.int64)


def _numbers(column: pa.ChunkedArray, dtype: type) -> list[np.ndarray]:
    """A column of packed numbers, row by row."""
    return [np.frombuffer(x.as_buffer(), dtype) for x in column]


def _sent(block: int, code: np.ndarray, ids: np.ndarray, stat: np.ndarray | None, k: int, homes: int) -> pa.Table:
    """SENT rows of a block's terms, ordered by home and cut at ROW_VALUES."""
    home = ids % homes
    order = np.argsort(home, kind="stable")
    home, most = home[order], max(1, ROW_VALUES // k)
    first = np.flatnonzero(np.append(True, home[1:] != home[:-1])[:len(home)])
    cuts = [(i, min(i + most, e)) for s, e in zip(first, np.append(first, len(home))[1:]) for i in range(s, e, most)]
    rows = [order[i:j] for i, j in cuts]
    return pa.table({
        "home": pa.array([home[i] for i, _ in cuts], pa.int64()), "at": pa.array([block] * len(cuts), pa.int64()),
        "code": pa.array([code[r].astype(np.int32).tobytes() for r in rows], pa.binary()),
        "id": pa.array([ids[r].tobytes() for r in rows], pa.binary()),
        "stat": pa.array([None if stat is None else stat[r].tobytes() for r in rows], pa.binary())})


def _block_step(alpha: list[float], totals: list[float], homes: int):
    """cogroup function: (tiles of a block, weights of its terms) -> partial
    sums per term for their homes, or without homes the topic mix per document."""
    a = np.array(alpha)
    base = digamma(np.array(totals))

    def step(tiles: pa.Table, weights: pa.Table) -> pa.Table:
        terms = tile_terms(tiles)
        beta, known = np.zeros((len(terms), len(a))), np.zeros(len(terms), bool)
        for code, lam in zip(_numbers(weights.column("code"), np.int32), _numbers(weights.column("lam"), float)):
            beta[code], known[code] = np.exp(digamma(lam.reshape(-1, len(a))) - base), True
        docs, size, code, n = entries_of(tiles, known)
        gamma, theta, share = e_step(size, code, n, beta, a)
        if not homes:
            return pa.table({"doc_id": docs, "vec": arrays(gamma / gamma.sum(axis=1, keepdims=True))})
        own = np.flatnonzero(known)
        return _sent(tiles.column("block")[0].as_py() if len(own) else 0, own, terms[own],
                     by_term(size, code, share, theta, beta)[own], len(a), homes)
    return step


def _placed(at: list, code: list, lam: list) -> dict[str, pa.Array]:
    """WEIGHTS rows for blocks: block, codes, weights."""
    return {"at": pa.array(at, pa.int64()), "code": pa.array([c.tobytes() for c in code], pa.binary()),
            "id": pa.nulls(len(at), pa.binary()), "lam": pa.array([x.tobytes() for x in lam], pa.binary()),
            "sums": pa.nulls(len(at), pa.list_(pa.float64()))}


def _place(k: int):
    """cogroup function of a home: (terms of blocks, weights of terms) -> the weights for each block."""
    def step(asked: pa.Table, topics: pa.Table) -> pa.Table:
        ids = topics.column("id").to_numpy()
        order = np.argsort(ids)
        ids, lam = ids[order], matrix(topics.column("lam"), k)[order]
        out = []
        for at, code, own in zip(asked.column("at").to_pylist(), _numbers(asked.column("code"), np.int32), _numbers(asked.column("id"), np.int64)):
            place = np.searchsorted(ids, own)
            known = np.append(ids, 0)[place] == own
            known &= place < len(ids)
            out.append((at, code[known], lam[place[known]]))
        return pa.table(_placed(*([list(x) for x in zip(*out)] or ([], [], []))))
    return step


def _home_step(k: int, eta: float):
    """Group function: a home's partial sums -> the new weights for each block that has
    the term, and once more by term with their sums."""
    def step(t: pa.Table) -> pa.Table:
        ids = _numbers(t.column("id"), np.int64)
        cuts = np.cumsum([len(x) for x in ids])[:-1]
        ids, place = np.unique(np.concatenate(ids), return_inverse=True)
        lam = np.full((len(ids), k), eta)
        add_by_code(lam, place, np.concatenate(_numbers(t.column("stat"), float)).reshape(-1, k))
        to = _placed(t.column("at").to_pylist(), _numbers(t.column("code"), np.int32), [lam[p] for p in np.split(place, cuts)])
        most = max(1, ROW_VALUES // k)
        own = [slice(i, i + most) for i in range(0, len(ids), most)]
        kept = {"at": pa.nulls(len(own), pa.int64()), "code": pa.nulls(len(own), pa.binary()),
                "id": pa.array([ids[i].tobytes() for i in own], pa.binary()), "lam": pa.array([lam[i].tobytes() for i in own], pa.binary()),
                "sums": arrays(np.stack([lam[i].sum(axis=0) for i in own]))}
        return pa.concat_tables([pa.table(to), pa.table(kept)])
    return step


def _by_id(weights: DataFrame, k: int) -> DataFrame:
    """(id, lam) of each term in WEIGHTS."""
    def unpack(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tables:
            for ids, lam in zip(_numbers(t.column("id"), np.int64), _numbers(t.column("lam"), float)):
                yield pa.record_batch({"id": pa.array(ids), "lam": arrays(lam.reshape(-1, k))})
    return weights.where("at is null").select("id", "lam").mapInArrow(unpack, "id long, lam array<double>")


def _step(b: Blocks, weights: DataFrame, model: LdaModel, homes: int) -> DataFrame:
    return b.tiles.groupBy("block").cogroup(weights.where("at is not null").select("at", "code", "lam").groupBy("at")).applyInArrow(
        _block_step(model.alpha, model.totals, homes), SENT if homes else "doc_id long, vec array<double>")


def _totals(rows: DataFrame, k: int) -> list[float]:
    """Sum of ``rows`` (an array column of k)."""
    # grouped by a constant: without a term there is no group, and all totals are 0
    got = rows.select(F.lit(0).alias("all"), array_to_vector(rows.columns[0]).alias("v")).groupBy("all") \
        .agg(Summarizer.sum(F.col("v")).alias("s")).first()
    return [0.0] * k if got is None else got.s.toArray().tolist()


def passes(bag: DataFrame | Blocks, k: int, n: int, alpha: list[float] | None = None, eta: float | None = None,
           seed: int = 1) -> Iterator[LdaModel]:
    """The model after each of ``n`` passes over every document of ``bag``
    (doc_id, term, tf), or of its ``blocks``. Concentrations default to 1/k."""
    alpha, eta = list(alpha or [1.0 / k] * k), 1.0 / k if eta is None else eta
    b = bag if isinstance(bag, Blocks) else blocks(bag, k)
    # exponential start values: -ln of a uniform hash in (0, 1)
    start = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.lit(eta) - F.ln(
        (F.pmod(F.xxhash64("term", i, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)))
    first = b.terms.select("id", "term", start.alias("lam"))
    model = LdaModel(first.select("term", "lam"), _totals(first.select("lam"), k), alpha)
    weights = _weights(b, first, k)
    for _ in range(n):
        weights = written(_step(b, weights, model, _homes(b, k)).groupBy("home").applyInArrow(_home_step(k, eta), WEIGHTS), "lda-weights")
        topics = _by_id(weights, k).join(b.terms, "id").select("term", "lam")
        model = LdaModel(topics, _totals(weights.where("at is null").select("sums"), k), alpha, (b, weights))
        yield model


def fit(bag: DataFrame | Blocks, k: int, n_passes: int = 5, **kwargs) -> LdaModel:
    """T4: the model after ``n_passes`` full passes; see ``passes``."""
    if n_passes < 1:
        raise ValueError("n_passes must be at least 1")
    model = None
    for following in passes(bag, k, n_passes, **kwargs):
        if model:
            drop(model.placed[1])   # nothing reads the weights of an earlier pass again
            model.topics.sparkSession._jvm.System.gc()   # Spark deletes a finished pass's shuffle files when the driver's heap is collected
        model = following
    return model


def topic_vectors(model: LdaModel, docs: DataFrame, bag: DataFrame | Blocks,
                  min_probability: float = MIN_PROBABILITY) -> DataFrame:
    """T5: (doc_id, vec) for every row of ``docs`` (doc_id), weights below
    ``min_probability`` as 0. Terms the model does not hold are ignored; a
    document without a known term has the prior's mix."""
    b = bag if isinstance(bag, Blocks) else blocks(bag, model.k)
    if model.placed and model.placed[0] is b:
        weights = model.placed[1]
    else:
        weights = _weights(b, b.terms.select("term", "id").join(model.topics, "term").select("id", "lam"), model.k)
    total = sum(model.alpha)
    prior = F.array(*[F.lit(a / total) for a in model.alpha])
    return (docs.select("doc_id").join(_step(b, weights, model, 0), "doc_id", "left")
            .select("doc_id", F.transform(F.coalesce("vec", prior), lambda x: F.when(x >= min_probability, x)
                                          .otherwise(F.lit(0.0))).alias("vec"))
            .checkpoint())  # read several times by what follows


def topic_terms(model: LdaModel) -> DataFrame:
    """Phi as ``(topic, term, phi)``, k x V rows that stay distributed."""
    share = F.transform("lam", lambda x, i: x / F.element_at(F.array(*map(F.lit, model.totals)), i + 1))
    return model.topics.select("term", F.posexplode(share).alias("topic", "phi")).select("topic", "term", "phi")


def _leading(values: np.ndarray, n: int, slack: float = 0.0) -> np.ndarray:
    """Per column, the rows that are not below its ``n``-th largest value less ``slack``."""
    if len(values) <= n:
        return np.ones(values.shape, bool)
    return ~(values < np.partition(values, len(values) - n, axis=0)[-n] - slack)


def best_terms(model: LdaModel, n: int) -> DataFrame:
    """The rows of ``topic_terms`` with the ``n`` largest phi of each topic, and some more, without one row for each topic and term."""
    totals = np.array(model.totals)

    def best(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tables:
            packed = pa.types.is_binary(t.schema.field("lam").type)
            for key, lam in zip(_numbers(t.column("key"), np.int64), _numbers(t.column("lam"), float)) if packed else [
                    (t.column("key"), matrix(pa.chunked_array([t.column("lam")]), len(totals)))]:
                phi = lam.reshape(-1, len(totals)) / totals
                row, topic = np.nonzero(_leading(phi, n))
                yield pa.record_batch({"topic": pa.array(topic, pa.int32()), "key": pa.array(key).take(pa.array(row)), "phi": pa.array(phi[row, topic])})
    if not model.placed:
        return model.topics.select(F.col("term").alias("key"), "lam").mapInArrow(best, "topic int, key string, phi double") \
            .select("topic", F.col("key").alias("term"), "phi")
    b, weights = model.placed
    rows = weights.where("at is null").select(F.col("id").alias("key"), "lam").mapInArrow(best, "topic int, key long, phi double")
    return rows.join(b.terms, F.col("key") == F.col("id")).select("topic", "term", "phi")


def relevant_terms(model: LdaModel, term_prob: DataFrame, weight: float, n: int) -> DataFrame:
    """The rows of ``topic_terms`` with the ``n`` largest relevances (``topics.term_relevance``) of each topic, and some
    more, without one row for each topic and term; ``term_prob``: (term, p)."""
    totals = np.array(model.totals)

    def best(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in tables:
            phi = matrix(pa.chunked_array([t.column("lam")]), len(totals)) / totals
            relevance = np.log(phi) - (1 - weight) * np.log(t.column("p").to_numpy())[:, None]
            # what another logarithm's last digit might lift stays
            row, topic = np.nonzero(_leading(relevance, n, 1e-9))
            yield pa.record_batch({"topic": pa.array(topic, pa.int32()), "term": t.column("term").take(pa.array(row)),
                                   "phi": pa.array(phi[row, topic])})
    return model.topics.join(term_prob, "term").select("term", "lam", "p").mapInArrow(best, "topic int, term string, phi double")


def describe_topics(model: LdaModel, n: int = 5) -> DataFrame:
    """Top ``n`` terms per topic as ``(topic, rank, term, weight)``, ties by term."""
    w = Window.partitionBy("topic").orderBy(F.desc("phi"), F.asc("term"))
    return (best_terms(model, n).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
            .select("topic", "rank", "term", F.col("phi").alias("weight")))


def save(model: LdaModel, path: str) -> None:
    """The term table and one row of parameters as Parquet under ``path``."""
    model.topics.write.mode("overwrite").parquet(f"{path}/topics")
    model.topics.sparkSession.createDataFrame([(model.totals, model.alpha)], "totals array<double>, alpha array<double>") \
        .write.mode("overwrite").parquet(f"{path}/params")


def load(spark: SparkSession, path: str) -> LdaModel:
    p = spark.read.parquet(f"{path}/params").first()
    return LdaModel(spark.read.parquet(f"{path}/topics"), list(p.totals), list(p.alpha))
