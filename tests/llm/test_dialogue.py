"""Operator 13 against an exhaustive dynamic programme written apart from it."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import types as T

from qalake.llm import dialogue

ROWS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                     T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
GOOD = re.compile(r"(s?(ua)+)?\Z")


def plain_faults(rows):
    out, seen = [], set()
    for role, text in rows:
        ink = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not ink else "duplicate" if (role, text) in seen else "" if ink[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def plain_best(rows, faults):
    """Forward table over (initials so far as a state of the pattern), whole conversation, every edit."""
    states = {"": (0, "", ())}
    nxt = {"": "su", "s": "u", "u": "a", "a": "u"}

    def inserts(table):
        for _ in range(3):
            for st, (c, a, o) in list(table.items()):
                for r in nxt[st]:
                    if r != "s":
                        new = (c + 2, a + "I", o + ((("user" if r == "u" else "assistant"), ""),))
                        if r not in table or new[:2] < table[r][:2]:
                            table[r] = new
        return table
    states = inserts(states)
    for (role, text), f in zip(rows, faults):
        out = {}
        for st, (c, a, o) in states.items():
            moves = [(st, c + 3, a + "D", o)]
            if f not in ("blank", "duplicate"):
                e = f == "truncated"
                for r in nxt[st]:
                    if r != "s":
                        moves.append((r, c + 2 + e, a + "R", o + ((("user" if r == "u" else "assistant"), text),)))
                    if role[:1] == r:
                        moves.append((r, c + e, a + "K", o + ((role, text),)))
            for s2, *v in moves:
                if s2 not in out or tuple(v[:2]) < out[s2][:2]:
                    out[s2] = tuple(v)
        states = inserts(out)
    return min(v for s, v in states.items() if s in ("", "a"))


def plain_repair(rows):
    """``rows``: (conv_id, turn, role, text) as they stand in the table."""
    convs = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        k = zlib.crc32(key.encode()) % 20
        own = convs.setdefault(conv, [])
        if k == 1:
            text = ""
        elif k == 2:
            text = re.sub("[.!?]", "", text)
        elif k == 4:
            role = "user"
        own += [] if k == 0 else [(turn, role, text)] * (2 if k == 3 else 1)
    out = []
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        said = [r[1:] for r in own]
        faults = plain_faults(said)
        cost, audit, kept = plain_best(said, faults)
        turns = [t for t, *_ in own if t is not None]
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"),
                    faults.count("duplicate"), faults.count("truncated"),
                    sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:])), cost, audit,
                    hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()))
    return out


def exhaustive(rows):
    """Cheapest (cost, audit) over every choice for up to four rows, two inserts before, between and after."""
    best = (10 ** 9, "")
    slots = [list(itertools.chain.from_iterable(itertools.product("ua", repeat=n) for n in range(3)))] * (len(rows) + 1)
    for ins in itertools.product(*slots):
        for edits in itertools.product("DUAK", repeat=len(rows)):
            s, cost, audit = "", 0, ""
            for (c, f), e, i in zip([*rows, ("", None)], [*edits, None], ins):
                s, cost, audit = s + "".join(i), cost + 2 * len(i), audit + "I" * len(i)
                if e is None:
                    break
                if e != "D" and f in (dialogue.BLANK, dialogue.DUPLICATE):
                    cost = 10 ** 6
                s += {"D": "", "U": "u", "A": "a", "K": c}[e]
                cost += {"D": 3, "U": 2, "A": 2, "K": 0}[e] + (e != "D" and f == dialogue.TRUNCATED)
                audit += {"D": "D", "U": "R", "A": "R", "K": "K"}[e]
            if cost < best[0] + 1 and GOOD.match(s) and (cost, audit) < best:
                best = (cost, audit)
    return best


def made(seed, convs=120, longest=14):
    rng = random.Random(seed)
    rows = []
    for c in [*range(convs), None]:
        n = rng.choice([0, 1, 2, 3, rng.randrange(1, longest)]) if c != 7 else 260
        for t in range(n):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "User"])
            if rng.random() < 0.6:
                role = ("user", "assistant")[t % 2]
            text = rng.choice(["Yes.", "no", "What now?", "", "  \t\n", None, "Fine! \n", "é ", f"row {rng.randrange(9)}."])
            rows.append((c, None if rng.random() < 0.05 else t * rng.choice([1, 1, 1, 2]), role, text))
    rows += rows[5:8] + [(500, 10 ** 12, "user", "x" * 300000), (500, -5, "assistant", "Ok.")]
    rng.shuffle(rows)
    return rows


def test_search_against_every_choice():
    rng = random.Random(3)
    for _ in range(60):
        rows = [(rng.choice("suaat"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randrange(0, 4))]
        got = min(dialogue.search(rows, {dialogue.START: (0, "")}, True).values())
        assert got == exhaustive(rows), rows


@pytest.mark.parametrize("window", [1, 3, 48])
def test_windows_do_not_change_the_plan(window):
    rng = random.Random(window)
    for n in (0, 1, 5, 40, 150):
        conv = dialogue.Conversation(1, dialogue.RepairParams(window=window))
        rows = [(rng.choice(["user", "assistant", "system", "x"]), rng.choice(["a.", "b", "", f"{rng.randrange(60)}!"])) for _ in range(n)]
        for i, (role, text) in enumerate(rows):
            conv.add(i, role, text)
        cost, audit, kept = plain_best(rows, plain_faults(rows))
        got = conv.finish()
        assert got[6:8] == (cost, audit)
        assert got[8] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()


def test_lower_bound_holds():
    rng = random.Random(9)
    for _ in range(200):
        rows = [(rng.choice("suaut"), rng.choice([0, 0, 1, 2, 3])) for _ in range(rng.randrange(1, 9))]
        best = min(dialogue.search(rows, {dialogue.START: (0, "")}, True).values())[0]
        assert dialogue.bounds(rows, dialogue.RepairParams())[0] <= best


def test_settled_rows_are_let_go():
    conv = dialogue.Conversation(1, dialogue.RepairParams(window=16))
    for i in range(2000):
        conv.add(i, ("user", "assistant")[i % 2], f"{i}.")
        assert len(conv.held) <= 64 and all(len(a) <= 64 for _, a in conv.roots.values())
    assert conv.finish()[7] == "K" * 2000


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_against_plain(spark, seed):
    rows = made(seed)
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, ROWS).withColumn("times", F.lit("clash")).withColumn("kind", F.lit(1)).withColumn("audit", F.lit("x"))
    got = sorted((tuple(r) for r in dialogue.repair(dialogue.damage(df)).collect()), key=repr)
    assert got == sorted(plain_repair(rows), key=repr)


def test_no_rows(spark):
    assert dialogue.repair(dialogue.damage(spark.createDataFrame([], ROWS))).collect() == []


def test_all_dropped(spark):
    turn = next(t for t in range(1000) if zlib.crc32(f"3:{t}".encode()) % 20 == 0)
    got = dialogue.repair(dialogue.damage(spark.createDataFrame([(3, turn, "user", "Hi.")], ROWS))).collect()
    assert [tuple(r) for r in got] == [(3, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
