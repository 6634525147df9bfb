"""Operator 13, conversation structure repair: depth-first branch-and-bound.

A conversation's rows are edited at least cost until their role initials read
``(s?(ua)+)?``. A node is (rows done, automaton state); an edge is one edit:
Keep, Rerole, Delete, Insert. The search walks them with an explicit stack and

* a lower bound of what the rows still to come cost: the least cost of each
  row alone, and 2 for every disjoint pair of neighbours that cannot both stand;
* an incumbent (cost, audit) for each end state: a prefix that cannot beat one is cut;
* a dominance table for each node: a prefix is cut unless it is cheaper, or as
  cheap with a smaller audit. Two prefixes of one node and one cost never
  extend each other (an edit's cost follows from its letter and its row), so
  the smaller one stays smaller whatever follows. The table also compares
  states: each can take over any plan of another for two inserts and a delete
  at most (from after-s to a plan that keeps an s), so prefixes dearer than the
  cheapest of their row by more than that are cut.

Spark deals the rows by conversation and sorts them; a task streams its
conversations. Long ones are searched in windows: the prefixes that survive at
a window's end, one for each state, are the roots of the next window's search.
What all survivors share is settled, goes into the digest and is let go, so a
task holds a window of rows, the undecided edits and one short fingerprint per
distinct row of the conversation, not its texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
# states: nothing yet, after s (u must follow), after u (a must follow), after a
START, AFTER_S, AFTER_U, AFTER_A = range(4)
ENDS = (START, AFTER_A)
#: state -> {initial: next state}
STEPS = ({"s": AFTER_S, "u": AFTER_U}, {"u": AFTER_U}, {"a": AFTER_A}, {"u": AFTER_U})
STEPS_OF_ALL = ("s", "u", "a")
LEGAL = ("su", "ua", "au")
REPAIRS = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
           "audit string, repaired_sha256 string")
_SPACE = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class RepairParams:
    window: int = 48     # rows searched at once
    keep: int = 0
    rerole: int = 2
    delete: int = 3
    insert: int = 2
    truncated: int = 1   # added to an undeleted truncated row


def fault(text: str, seen: bool) -> int:
    """First fault of a row; ``seen``: its role and text stood earlier."""
    ink = text.rstrip(_SPACE)
    if not ink:
        return BLANK
    if seen:
        return DUPLICATE
    return 0 if ink[-1] in ".!?" else TRUNCATED


def bounds(rows: list[tuple[str, int]], p: RepairParams) -> list[int]:
    """``out[i]``: what rows i and later cost at least. ``rows``: (initial, fault)."""
    out, own, pairs = [0] * (len(rows) + 1), 0, 0
    after = None  # initial of the next row that can stand, unless a pair has it already
    for i in range(len(rows) - 1, -1, -1):
        c, f = rows[i]
        if f in (BLANK, DUPLICATE):
            own += p.delete  # its neighbours meet
        else:
            extra = p.truncated if f == TRUNCATED else 0
            if c not in STEPS_OF_ALL:
                own += min(p.rerole + extra, p.delete)
                after = None  # once rerolled, it may part its neighbours
            else:
                own += p.keep + extra
                if after is not None and c + after not in LEGAL:
                    pairs += min(p.rerole, p.insert, p.delete - p.truncated)
                    after = None
                else:
                    after = c
        out[i] = own + pairs
    return out


def search(rows: list[tuple[str, int]], roots: dict[int, tuple[int, str]], final: bool,
           p: RepairParams = RepairParams()) -> dict[int, tuple[int, str]]:
    """Best (cost, audit) for each state after all ``rows``, from the prefixes
    ``roots`` (state -> (cost, audit)), proved optimal: if ``final``, the best
    accepted end, else each state that can still matter."""
    n, lower, take_over = len(rows), bounds(rows, p), 2 * p.insert + p.delete
    best: list[dict[int, tuple[int, str]]] = [{} for _ in range(n + 1)]   # dominance tables; those of n: the incumbents
    cheapest = [1 << 60] * (n + 1)
    limit = 1 << 60
    stack = [(0, s, c, a) for s, (c, a) in sorted(roots.items(), key=lambda x: (-x[1][0], x[0]))]
    while stack:
        i, state, cost, audit = stack.pop()
        if cost > cheapest[i] + take_over or cost + lower[i] > limit:
            continue
        had = best[i].get(state)
        if had is not None and had <= (cost, audit):
            continue
        best[i][state] = (cost, audit)
        cheapest[i] = min(cheapest[i], cost)
        if i == n:
            if not final:
                limit = min(limit, cost + take_over)
            elif state in ENDS:
                limit = min(limit, cost)
        nxt = [(i, STEPS[state][c], cost + p.insert, audit + "I") for c in "ua" if c in STEPS[state]]
        if i < n:
            c, f = rows[i]
            nxt.append((i + 1, state, cost + p.delete, audit + "D"))
            if f not in (BLANK, DUPLICATE):
                extra = p.truncated if f == TRUNCATED else 0
                nxt += [(i + 1, STEPS[state][r], cost + p.rerole + extra, audit + "R") for r in "ua" if r in STEPS[state]]
                if c in STEPS[state]:
                    nxt.append((i + 1, STEPS[state][c], cost + p.keep + extra, audit + "K"))
        # the most promising, then the smallest audit, is taken first
        nxt.sort(key=lambda x: (x[2] + lower[x[0]], x[3]), reverse=True)
        stack += nxt
    return {s: v for s, v in best[n].items() if not final or s in ENDS}


def _shared(audits: list[str]) -> int:
    """Length of the common prefix."""
    a, z = min(audits), max(audits)
    k = 0
    while k < len(a) and a[k] == z[k]:
        k += 1
    return k


@dataclass
class Conversation:
    """Rows of one conversation in order, repaired as they come."""

    conv_id: int | None
    p: RepairParams
    counts: list[int] = field(default_factory=lambda: [0, 0, 0, 0])
    seen: set[bytes] = field(default_factory=set)
    rows: list[tuple[str, int]] = field(default_factory=list)      # window not searched yet
    held: list[tuple[str, str]] = field(default_factory=list)      # (role, text) of rows without a settled edit
    roots: dict[int, tuple[int, str]] = field(default_factory=lambda: {START: (0, "")})
    settled: list[str] = field(default_factory=list)               # pieces of the audit
    digest: object = field(default_factory=hashlib.sha256)
    out: int = 0                                                   # rows written to the digest
    system: bool = False                                           # the first of them is an s
    last: str | None = None
    illegal: int = 0
    turns: list[int | None] = field(default_factory=lambda: [None, None, 0])  # least, most, distinct

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None and turn != self.turns[1]:   # rows come by turn, nulls first
            self.turns = [turn if self.turns[0] is None else self.turns[0], turn, self.turns[2] + 1]
        key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
        f = fault(text, key in self.seen)
        self.seen.add(key)
        self.counts[f] += 1
        c = role[:1]
        if self.last is not None and self.last + c not in LEGAL:
            self.illegal += 1
        self.last = c
        self.rows.append((c, f))
        self.held.append((role, "" if f in (BLANK, DUPLICATE) else text))  # these are deleted: the text is not needed
        if len(self.rows) >= 2 * self.p.window:
            self._search(self.p.window, final=False)

    def _search(self, n: int, final: bool) -> None:
        self.roots = search(self.rows[:n], self.roots, final, self.p)
        self.rows = self.rows[n:]
        self._settle(_shared([a for _, a in self.roots.values()]))

    def _settle(self, n: int) -> None:
        """The first ``n`` open edits are certain."""
        edits = next(iter(self.roots.values()))[1][:n]
        done = 0
        for e in edits:
            role, text = "", ""
            if e != "I":
                role, text = self.held[done]
                done += 1
            if e == "D":
                continue
            if e == "K":
                self.system |= not self.out and role[:1] == "s"
            else:  # the state tells which: u and a take turns, after the s if there is one
                role = ("user", "assistant")[(self.out - self.system) % 2]
            if e == "I":
                text = ""
            self.digest.update(("\n" if self.out else "").encode() + f"{role}:{text}".encode("utf-8", "surrogatepass"))
            self.out += 1
        self.held = self.held[done:]
        self.settled.append(edits)
        self.roots = {s: (c, a[n:]) for s, (c, a) in self.roots.items()}

    def finish(self) -> tuple:
        self._search(len(self.rows), final=True)
        cost, audit = min(self.roots.values())
        self.roots = {START: (cost, audit)}
        self._settle(len(audit))
        low, high, distinct = self.turns
        gaps = 0 if low is None else high - low + 1 - distinct
        return (self.conv_id, gaps, self.counts[BLANK], self.counts[DUPLICATE], self.counts[TRUNCATED], self.illegal, cost,
                "".join(self.settled), self.digest.hexdigest())


def damage(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` (nulls of role and text: one space),
    damaged by crc32(``conv_id:turn``) % 20: 0 drops the row, 1 empties its
    text, 2 removes its ``[.!?]``, 3 repeats it, 4 makes its role user. A
    dropped row stays as a mark (role null), so that no conversation is lost."""
    def part(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"),
                       (F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20).alias("kind"))
    kind = F.col("kind")
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).when(kind == 0, F.lit(None)).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").when(kind == 0, F.lit(None)).otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"),
                       F.when(kind == 3, 2).otherwise(1).alias("times"))


def repair(rows: DataFrame, params: RepairParams = RepairParams()) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text, times;
    role null: a mark without a row; ``times``: how often the row stands):
    gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A null conv_id is a conversation of its own. Rows go by turn (null first),
    ties by role and text, so repeated rows stand together. Null turns count in no gap.
    An empty role has no initial and is rerolled or deleted. Empty texts are
    blank; long ones are read whole. A conversation without rows: zeros, empty
    audit, digest of the empty string. No rows: no rows. Further columns are
    not read.
    """
    p = params

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*done))
            kinds = [pa.string() if c.endswith("string") else pa.int64() for c in REPAIRS.split(", ")]
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds)], names=[c.split()[0] for c in REPAIRS.split(", ")])
        for b in batches:
            for conv, turn, role, text, times in zip(*(b.column(i).to_pylist() for i in range(5))):
                if now is None or now.conv_id != conv:
                    if now is not None:
                        done.append(now.finish())
                    now = Conversation(conv, p)
                if role is not None:
                    for _ in range(times):
                        now.add(turn, role, text)
            if len(done) >= 1000:
                yield batch()
                done = []
        if now is not None:
            done.append(now.finish())
        if done:
            yield batch()

    keys = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    return (rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"),
                        F.col("text").cast("string"), F.col("times").cast("int"))
            .repartition("conv_id").sortWithinPartitions(*keys).mapInArrow(run, REPAIRS))
