"""Online LDA on long tables (T4): chunks, decay, offset, learned alpha; resumable by pass.

Stochastic variational Bayes. With N documents, a chunk of n of them moves the
weights of every term by ``lam = (1 - rho) lam + rho (eta + N / n stat)`` with
``rho = (offset + pass + chunks seen in the first pass) ** -decay``. Only the
chunk's own terms get new statistics; all others merely decay towards eta. So
the table keeps ``lam - eta`` as of a term's last update with the logarithm of
the decay until then, and a chunk reads and writes its own terms alone. Topic
totals decay as sums, so they never need the vocabulary. ``alpha="auto"`` takes
a Newton step from the distributed sums of E[log theta] after each chunk.

All state is tables below one folder of the shared store: the bag by row and
packed by chunk and block (``lda.pack``), new weights by update, and after each pass the whole model. A model counts once
its parameters, written last, are complete: a killed fit goes on after the
last such pass. Each document is read once in every pass.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qalake.operators.lda import (HOME_VALUES, TILE_VALUES, TILES, LdaModel, add_by_code, arrays, by_term, digamma, e_step, entries_of,
                                  hashed_terms, matrix, pack, tile_terms)
from qalake.sources.questions import path_exists

#: What is left of old weights counts at least this much (rho may be 1).
LEAST_LEFT = 1e-12
_MIXES, _TOTALS, _DOCS = 0, 1, 2  # rows of a chunk's sums that belong to no term; their home is -1
_SUMS = "home long, id long, stat array<double>"


@dataclass(frozen=True)
class OnlineParams:
    k: int
    chunk_docs: int = 2000
    passes: int = 1
    decay: float = 0.5
    offset: float = 1.0
    alpha: str | tuple[float, ...] = "symmetric"   # or "auto", or one value per topic
    eta: float | None = None
    seed: int = 1
    block_values: int = 16_000_000   # entries x k of one task
    compact_every: int = 8           # updates between two compactions of the weights


@dataclass(frozen=True)
class _State:
    """Everything of the model that is not per term."""

    alpha: tuple[float, ...]
    totals: tuple[float, ...]   # sum of lam - eta per topic
    log_left: float             # logarithm of the product of all (1 - rho)
    updates: int
    seen: float                 # chunks of the first pass done, in chunk sizes


def trigamma(x: np.ndarray) -> np.ndarray:
    """Second derivative of log-gamma for positive ``x``: recurrence up to 6, then the asymptotic series."""
    x, shift = np.array(x, dtype=float), np.zeros_like(x, dtype=float)
    for _ in range(6):
        low = x < 6
        shift[low] += 1 / (x[low] * x[low])
        x[low] += 1
    r = 1 / (x * x)
    return shift + 1 / x + r / 2 + r / x * (1 / 6 - r * (1 / 30 - r * (1 / 42 - r / 30)))


def newton_alpha(alpha: np.ndarray, mean_log: np.ndarray, n: float, rho: float) -> np.ndarray:
    """One damped Newton step of the Dirichlet likelihood of ``n`` documents
    with mean E[log theta]; the Hessian is a diagonal plus a constant, so the
    step is linear in k. A step that leaves the positive values is not taken."""
    slope = n * (digamma(alpha.sum()[None])[0] - digamma(alpha) + mean_log)
    diagonal, constant = -n * trigamma(alpha), n * trigamma(alpha.sum()[None])[0]
    level = (slope / diagonal).sum() / (1 / constant + (1 / diagonal).sum())
    new = alpha - rho * (slope - level) / diagonal
    return new if np.isfinite(new).all() and (new > 0).all() else alpha


def _chunk_step(alpha: tuple[float, ...], base: np.ndarray, eta: float, homes: int):
    a = np.array(alpha)

    def step(tiles: pa.Table, weights: pa.Table) -> pa.Table:
        terms, code = tile_terms(tiles), weights.column("code").to_numpy()
        beta, known = np.zeros((len(terms), len(a))), np.zeros(len(terms), bool)
        beta[code], known[code] = np.exp(digamma(eta + matrix(weights.column("e"), len(a))) - base), True
        _, size, code, n = entries_of(tiles, known)
        gamma, theta, share = e_step(size, code, n, beta, a)
        stat, whole = by_term(size, code, share, theta, beta), np.zeros((3, len(a)))
        whole[_MIXES] = (digamma(gamma) - digamma(gamma.sum(axis=1, keepdims=True))).sum(axis=0)
        whole[_TOTALS] = stat.sum(axis=0)
        whole[_DOCS, 0] = len(size)
        own = np.flatnonzero(known)
        return pa.table({"home": pa.array(np.append(terms[own] % homes, [-1, -1, -1]), pa.int64()),
                         "id": pa.array(np.append(terms[own], [_MIXES, _TOTALS, _DOCS]), pa.int64()),
                         "stat": arrays(np.concatenate([stat[own], whole]))})
    return step


def _sum_home(t: pa.Table) -> pa.Table:
    """Sum per id of one home."""
    ids, code = np.unique(t.column("id").to_numpy(), return_inverse=True)
    rows = matrix(t.column("stat"), len(t.column("stat")[0]))
    stat = np.zeros((len(ids), rows.shape[1]))
    add_by_code(stat, code, rows)
    return pa.table({"home": pa.array([t.column("home")[0].as_py()] * len(ids), pa.int64()), "id": pa.array(ids), "stat": arrays(stat)})


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id").agg(vector_to_array(Summarizer.sum(array_to_vector("stat"))).alias("stat"))


class OnlineLda:
    """A fit below ``path``; ``bag`` (doc_id, term, tf) is stored there once."""

    def __init__(self, spark: SparkSession, path: str, params: OnlineParams):
        self.spark, self.path, self.p = spark, path.rstrip("/"), params
        self.eta = 1.0 / params.k if params.eta is None else params.eta

    def _done(self, table: str) -> bool:
        return path_exists(self.spark, f"{self.path}/{table}/_SUCCESS")

    def _read(self, *tables: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{t}" for t in tables])

    def _bag(self) -> DataFrame:
        """The stored rows with term ids, chunk and block."""
        _, chunks = self._read("meta").first()
        return self._placed(chunks, *self._read("sizes").first())

    def _placed(self, chunks: int, blocks: int, salt: int) -> DataFrame:
        # with its schema: an empty bag has no file to read one from
        rows = self.spark.read.schema("doc_id long, term string, tf double").parquet(f"{self.path}/rows")
        return rows.select("doc_id", F.xxhash64("term", F.lit(salt)).alias("id"), "tf",
                           F.pmod(F.xxhash64("doc_id", F.lit("block")), F.lit(blocks)).cast("long").alias("block"),
                           F.pmod(F.xxhash64("doc_id", F.lit(self.p.seed)), F.lit(chunks)).cast("int").alias("chunk"))

    def _tiles(self) -> DataFrame:
        return self.spark.read.schema(f"{TILES}, chunk int").parquet(f"{self.path}/tiles")

    def _write(self, df: DataFrame, table: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{table}")
        return self._read(table)

    def _start(self) -> Column:
        """lam - eta of a term that no chunk has touched: exponential, from a hash of term and topic."""
        return F.transform(F.sequence(F.lit(0), F.lit(self.p.k - 1)), lambda i: -F.ln(
            (F.pmod(F.xxhash64("term", i, F.lit(self.p.seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)))

    def prepare(self, bag: DataFrame) -> None:
        """Terms with ids and start weights, and the bag by chunk and block. Does nothing where they are stored."""
        if self._done("meta"):
            return
        p = self.p
        rows = bag.where(F.col("term").isNotNull() & (F.col("tf") > 0)).select("doc_id", "term", F.col("tf").cast("double").alias("tf"))
        if not self._done("rows"):
            self._write(rows.withColumn("doc_id", F.col("doc_id").cast("long")), "rows")   # the bag is computed once
        rows = self.spark.read.schema("doc_id long, term string, tf double").parquet(f"{self.path}/rows")
        terms, salt = hashed_terms(rows.groupBy("term").agg(F.count(F.lit(1)).alias("n")))
        self._write(terms.select("term", "id", self._start().alias("e")), "terms")
        n_docs, n_rows = rows.agg(F.count_distinct("doc_id"), F.count("*")).first()
        chunks = max(1, math.ceil(n_docs / p.chunk_docs))
        # bounded by a task's memory, and enough for the cores there are
        blocks = max(math.ceil(n_rows / chunks * p.k / p.block_values), min(self.spark.sparkContext.defaultParallelism, p.chunk_docs))
        self._write(self.spark.createDataFrame([(blocks, salt)], "blocks int, salt int"), "sizes")
        entries = max(1, TILE_VALUES // p.k)

        def packed(t: pa.Table) -> pa.Table:
            tiles = pack(t, entries)
            return tiles.append_column("chunk", pa.array([t.column("chunk")[0].as_py()] * tiles.num_rows, pa.int32()))
        (self._placed(chunks, blocks, salt).groupBy("chunk", "block")
         .applyInArrow(packed, f"{TILES}, chunk int")
         .write.mode("overwrite").partitionBy("chunk").parquet(f"{self.path}/tiles"))
        self._write(self.spark.createDataFrame([(n_docs, chunks)], "docs long, chunks int"), "meta")

    def last_pass(self) -> int:
        """Passes that are stored whole."""
        n = 0
        while self._done(f"pass-{n + 1}/params"):
            n += 1
        return n

    def _first_state(self) -> _State:
        total = self._read("terms").select(F.lit(0).cast("long").alias("id"), F.col("e").alias("stat"))
        got = _summed(total).first()
        a = self.p.alpha
        alpha = (1.0 / self.p.k,) * self.p.k if isinstance(a, str) else tuple(map(float, a))
        return _State(alpha, (0.0,) * self.p.k if got is None else tuple(got.stat), 0.0, 0, 0.0)

    def _state(self, n: int) -> _State:
        if not n:
            return self._first_state()
        d = json.loads(self._read(f"pass-{n}/params").first().state)
        return _State(tuple(d["alpha"]), tuple(d["totals"]), d["log_left"], d["updates"], d["seen"])

    def model(self, n: int | None = None) -> LdaModel:
        """The model after pass ``n`` (default: the last stored one; 0: the start)."""
        n = self.last_pass() if n is None else n
        state = self._state(n)
        rows = self._read("terms")
        if n:
            held = self._read(f"pass-{n}/weights").select("id", F.col("e").alias("own"), "at")
            rows = rows.join(held, "id", "left").withColumn("e", F.when(F.col("own").isNull(), self._decayed(F.col("e"), F.lit(0.0), state))
                                                            .otherwise(self._decayed(F.col("own"), F.col("at"), state)))
        size = self._read("terms").count()
        return LdaModel(rows.select("term", F.transform("e", lambda x: x + F.lit(self.eta)).alias("lam")),
                        [t + size * self.eta for t in state.totals], list(state.alpha))

    def _decayed(self, e: Column, at: Column, s: _State) -> Column:
        return F.transform(e, lambda x: x * F.exp(F.lit(s.log_left) - at))

    def run(self) -> Iterator[tuple[int, LdaModel]]:
        """(pass, model) of each pass that is not stored yet, up to ``passes``."""
        docs, chunks = self._read("meta").first()
        self.terms = self._read("terms").count()
        for n in range(self.last_pass() + 1, self.p.passes + 1):
            state = self._state(n - 1)
            weights = [f"pass-{n - 1}/weights"] if n > 1 else []
            scratch = f"tmp-{uuid.uuid4().hex}"   # what a killed pass left is never read
            for chunk in range(chunks):
                state, new = self._update(state, chunk, n, weights, f"{scratch}/{chunk}", docs)
                weights += [new] if new else []
                if len(weights) > self.p.compact_every:
                    self._write(self._latest(weights), f"{scratch}/{chunk}/all")
                    weights = [f"{scratch}/{chunk}/all"]
            self._write(self._latest(weights) if weights else self.spark.createDataFrame(
                [], "id long, e array<double>, at double, t int"), f"pass-{n}/weights")
            said = json.dumps({"alpha": state.alpha, "totals": state.totals, "log_left": state.log_left,
                               "updates": state.updates, "seen": state.seen})
            self._write(self.spark.createDataFrame([(said,)], "state string"), f"pass-{n}/params")
            yield n, self.model(n)

    def _latest(self, weights: list[str]) -> DataFrame:
        return (self._read(*weights).groupBy("id").agg(F.max_by(F.struct("e", "at"), "t").alias("w"), F.max("t").alias("t"))
                .select("id", "w.e", "w.at", "t"))

    def _update(self, s: _State, chunk: int, n: int, weights: list[str], to: str, docs: int) -> tuple[_State, str | None]:
        """One chunk: its terms' weights now, the E-step by blocks, new weights."""
        p = self.p
        tiles = self._tiles().where(F.col("chunk") == chunk).drop("chunk")
        need = tiles.where("tile = 0").select(F.col("block").alias("part"), F.posexplode("terms").alias("code", "id"))
        mine = need.select("id").distinct()
        now = self._read("terms").join(mine, "id", "left_semi").select("id", F.col("e").alias("first"))
        if weights:
            held = self._read(*weights).join(mine, "id", "left_semi").groupBy("id").agg(F.max_by(F.struct("e", "at"), "t").alias("w"))
            now = now.join(held, "id", "left")
        else:
            now = now.withColumn("w", F.lit(None).cast("struct<e:array<double>,at:double>"))
        e = F.when(F.col("w").isNull(), self._decayed(F.col("first"), F.lit(0.0), s)).otherwise(self._decayed(F.col("w.e"), F.col("w.at"), s))
        now = self._write(now.select("id", e.alias("e")), f"{to}/now")
        base = digamma(np.array(s.totals) + self.terms * self.eta)
        held = need.join(now, "id").select("part", "code", "e")
        homes = max(self.spark.sparkContext.defaultParallelism, math.ceil(need.count() * p.k / HOME_VALUES))
        sums = self._write(tiles.groupBy("block").cogroup(held.groupBy("part")).applyInArrow(
            _chunk_step(s.alpha, base, self.eta, homes), _SUMS).groupBy("home").applyInArrow(_sum_home, _SUMS), f"{to}/sums")
        whole = {r.id: np.array(r.stat) for r in sums.where("home < 0").collect()}  # three rows
        if not whole:
            return s, None
        size = whole[_DOCS][0]
        rho = (p.offset + (n - 1) + s.seen) ** -p.decay
        left, gain = max(1 - rho, LEAST_LEFT), rho * docs / size
        log_left = s.log_left + math.log(left)
        new = sums.where("home >= 0").join(now, "id").select(
            "id", F.zip_with("e", "stat", lambda a, b: a * F.lit(left) + b * F.lit(gain)).alias("e"),
            F.lit(log_left).alias("at"), F.lit(s.updates + 1).alias("t"))
        self._write(new, f"{to}/new")
        alpha = np.array(s.alpha)
        if p.alpha == "auto":
            alpha = newton_alpha(alpha, whole[_MIXES] / size, size, rho)
        return replace(s, alpha=tuple(alpha.tolist()), totals=tuple((np.array(s.totals) * left + gain * whole[_TOTALS]).tolist()),
                       log_left=log_left, updates=s.updates + 1, seen=s.seen + (size / p.chunk_docs if n == 1 else 0.0)), f"{to}/new"


def fit_online(bag: DataFrame, path: str, params: OnlineParams) -> LdaModel:
    """T4: prepares or resumes the fit below ``path`` and returns its last model."""
    job = OnlineLda(bag.sparkSession, path, params)
    job.prepare(bag)
    for _ in job.run():
        pass
    return job.model()
