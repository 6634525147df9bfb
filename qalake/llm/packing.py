"""Operator 1, packing: order-preserving dynamic programming over cut points.

Each input partition is one token stream (its documents in the order they
arrive, each closed by an end id). Candidate cuts are document ends, sentence
ends and, inside pieces without either, positions ``forced_gap`` apart. With
f(c) the least cost of a stream cut at c,

    f(c) = penalty(c) + window_cost + min( min over b in [c-L, c) of f(b) + L - (c - b),
                                           min over k of f(c - 2^k) )

where lengths below ``least_window`` are left out but near the stream's end.
The first minimum is a sliding-window minimum of f(b) + b, kept in a monotone
queue; the second holds the lengths that need no padding. The DP runs on
chunks of a bounded number of tokens; the windows near a chunk's end are left
to the next chunk. No shuffle; memory is a chunk plus the longest document.
A partition's result depends on that partition alone, so a lost task can be
run again at any time.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from qalake.llm.tokens import encoder

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, sequence_length long")


@dataclass(frozen=True)
class PackParams:
    sequence: int = 2048
    end_id: int = 1
    sentence_penalty: int = 6     # cost of a cut at a sentence end, in padding tokens
    forced_penalty: int = 24      # cost of a cut inside a sentence
    window_cost: int = 16         # cost of each window, so that short ones stay rare
    least_window: int = 64        # shorter windows only within the last `sequence` tokens of a stream
    forced_gap: int = 96
    chunk_tokens: int = 1 << 18
    ranks_path: str | None = None


def candidate_cuts(ids: np.ndarray, doc_end: np.ndarray, enc, p: PackParams, final: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ascending cut positions (1..len(ids)) and their penalties; len(ids) is
    always one. ``doc_end``: positions just past an end id. ``final``: the
    stream ends here, so its last window may be cut anywhere."""
    n = len(ids)
    kind = np.full(n + 1, -1, np.int64)
    if n > 1:
        at = enc.ends_line[ids[:-1]] | (enc.ends_sentence[ids[:-1]] & enc.starts_space[ids[1:]])
        kind[1:n][at] = p.sentence_penalty
    kind[doc_end] = 0
    kind[n] = max(kind[n], 0)
    kind[0] = -1
    cuts = np.flatnonzero(kind >= 0)
    gaps = np.diff(np.concatenate([[0], cuts]))
    step = min(p.forced_gap, p.sequence // 2)
    wide = np.flatnonzero(gaps > step)
    if len(wide):
        extra = np.concatenate([np.arange(cuts[i] - gaps[i] + step, cuts[i], step) for i in wide])
        kind[extra] = p.forced_penalty
    if final:
        tail = kind[max(1, n - p.sequence):]
        tail[tail < 0] = p.forced_penalty
    cuts = np.flatnonzero(kind >= 0)
    return cuts, kind[cuts]


def best_cuts(cuts: np.ndarray, penalties: np.ndarray, p: PackParams) -> list[int]:
    """Window ends (a subset of ``cuts``, the last one included) of least cost."""
    size, fixed, n = p.sequence, p.window_cost, int(cuts[-1])
    powers = [1 << k for k in range(size.bit_length() - 1)]  # `size` itself needs no padding anyway
    long_ones = [s for s in powers if s >= p.least_window]  # shorter windows only near the end
    none = 1 << 62
    cost = [none] * (size + n + 1)  # shifted by `size`, so that c - 2^k may fall before the start
    back = [0] * (n + 1)
    cost[size] = 0
    queue = deque([(0, 0)])  # (f(b) + b, b), ascending in both
    for c, pen in zip(cuts.tolist(), penalties.tolist()):
        while queue[0][1] < c - size:
            queue.popleft()
        key, b = queue[0]
        best = key + size - c
        at = c + size
        for s in long_ones if c < n - size else powers:
            if cost[at - s] < best:
                best, b = cost[at - s], c - s
        best += pen + fixed
        cost[at] = best
        back[c] = b
        key = best + c
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, c))
    ends, c = [], n
    while c > 0:
        ends.append(c)
        c = back[c]
    return ends[::-1]


class _Stream:
    """Token stream of one partition; emits pieces as windows get settled."""

    def __init__(self, partition: int, p: PackParams, enc):
        self.p, self.enc, self.next_sequence = p, enc, partition << 33
        self.parts: list[np.ndarray] = []
        self.n = 0                       # tokens held
        self.docs: list[tuple] = []      # (doc_id, position of its first token, tokens); position may be negative

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.n, len(ids)))
        self.parts.append(ids)
        self.n += len(ids)

    def flush(self, final: bool) -> list[tuple]:
        if not self.n:
            return []
        p = self.p
        ids = np.concatenate(self.parts)
        ends = np.array([s + t for _, s, t in self.docs])
        cuts, pen = candidate_cuts(ids, ends[ends > 0], self.enc, p, final)
        stops = best_cuts(cuts, pen, p)
        if not final:  # the end of the chunk is no real end: leave the last windows open
            stops = [s for s in stops if s <= self.n - 4 * p.sequence]
        rows = self._pieces(ids, np.array([0] + stops, np.int64))
        done = stops[-1] if stops else 0
        self.parts, self.n = [ids[done:]], self.n - done
        self.docs = [(d, s - done, t) for d, s, t in self.docs if s + t > done]
        return rows

    def _pieces(self, ids: np.ndarray, bounds: np.ndarray) -> list[tuple]:
        if len(bounds) < 2:
            return []
        first = np.array([s for _, s, _ in self.docs], np.int64)
        edges = np.unique(np.concatenate([bounds, first[(first > 0) & (first < bounds[-1])]]))
        doc = np.searchsorted(first, edges[:-1], side="right") - 1
        win = np.searchsorted(bounds, edges[:-1], side="right") - 1
        rows = []
        for a, z, d, w in zip(edges[:-1].tolist(), edges[1:].tolist(), doc.tolist(), win.tolist()):
            doc_id, s, t = self.docs[d]
            rows.append((doc_id, a - s, z - a, zlib.crc32(ids[a:z]), t, self.next_sequence + w,
                         a - int(bounds[w]), int(bounds[w + 1] - bounds[w])))
        self.next_sequence += len(bounds) - 1
        return rows


def _to_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in PIECES.split(", ")]
    cols = list(zip(*rows))
    return pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=names)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: PackParams = PackParams()) -> DataFrame:
    """Packed pieces of every document of ``docs``.

    One row per piece: ``doc_id``, ``start`` (the document's ids before it),
    ``length``, ``ids_crc32`` (little-endian unsigned 32-bit ids),
    ``doc_tokens``, ``sequence_id``, ``offset`` (there), ``sequence_length``.

    Null or empty text is a document of the end id alone; a null or repeated
    id is kept as it is (each row is its own document); very long texts run
    over several chunks; an empty table has no rows; other columns, whatever
    their names, are not read. Ties between plans: the earlier-found cut wins,
    so a partition's result is a function of its rows in their order.
    """
    p = params

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        enc = encoder(p.ranks_path)
        end = np.array([p.end_id], "<u4")
        stream = _Stream(TaskContext.get().partitionId(), p, enc)
        for b in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                stream.add(doc_id, np.concatenate([enc.ids(text.as_py()), end]))
                if stream.n >= p.chunk_tokens:
                    rows += stream.flush(final=False)
            if rows:
                yield _to_batch(rows)
        rows = stream.flush(final=True)
        if rows:
            yield _to_batch(rows)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")) \
        .mapInArrow(run, PIECES)
