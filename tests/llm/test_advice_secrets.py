"""Secret scans (5): single short keys among many structured runs."""

import random
import time

from pyspark.sql import functions as F

from qalake.llm.secrets import ENCODINGS, redact, scan

WORDS = ("the data river model under station paper green window market field simple letter number garden after people water "
         "history system general public small order house").split()


def structured(rng, enc, n):
    w = [rng.choice(WORDS) for _ in range(12)]
    if enc == "base32":
        return "".join(w).upper()[:n - 1] + rng.choice("234567")
    if enc == "base36":
        return "".join(w)[:n - 3] + str(rng.randrange(100, 1000))
    kinds = ["-".join(w), "/".join(w[:2]) + "/" + str(rng.randrange(2000, 2030)) + "/" + "-".join(w[2:]),
             w[0] + "".join(x.title() for x in w[1:]), "_".join(w).upper()]
    return rng.choice(kinds)[:n]


def test_one_key_per_length_is_found_among_structured_runs(spark):
    rng = random.Random(11)
    rows, keys = [], {}
    for enc in ("base64", "base36", "base32"):
        rows += [(len(rows) + i, f"see {structured(rng, enc, rng.randrange(20, 45))} there") for i in range(2000)]
        for n in (20, 22, 24, 26, 28, 32, 36, 40):
            keys[len(rows)] = (enc, n)
            rows.append((len(rows), "key " + "".join(rng.choice(ENCODINGS[enc][1]) for _ in range(n)) + " end"))
    got = {r.doc_id for r in scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).where("spans like '%random%'").collect()}
    missed = [k for i, k in keys.items() if i not in got]
    assert len(missed) <= 3 and all(n < 26 for _, n in missed), missed
    assert len(got - set(keys)) <= 1


def test_plan_stays_small(spark):
    """Building the scan's plan costs the driver the same for any input."""
    df = scan(spark.createDataFrame([(1, "x")], "doc_id long, text string"))
    assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 150_000


def test_many_matches_take_linear_time(spark):
    def made(n):
        text = " ".join("%032x" % random.Random(i).getrandbits(128) for i in range(n))
        return spark.createDataFrame([(1, text)], "doc_id long, text string").cache()
    took = {}
    for n in (100, 8000, 16000):
        df = made(n)
        df.count()
        t = time.perf_counter()
        assert redact(df).first().text == " ".join(["[SECRET]"] * n)
        took[n] = time.perf_counter() - t
    assert took[16000] - took[100] < 2 * (took[8000] - took[100]) + 4


def test_spans_across_blocks_and_clashing_names(spark):
    rng = random.Random(5)
    rows = []
    for i in range(30):
        parts = ["é😀" * rng.randrange(2040, 2060)]
        for _ in range(20):
            parts += [rng.choice(["password: ", "token=", ""]) + "%032x" % rng.getrandbits(128), "w " * rng.randrange(1, 1500)]
        rows.append((i, " ".join(parts)))
    df = spark.createDataFrame([*rows, (1, None), (None, "")], "doc_id long, text string") \
        .withColumns({c: F.lit("own") for c in ("secret_spans", "__spans", "__least", "spans", "start")})
    spans = {r.doc_id: r.spans for r in scan(df.where("text is not null")).collect() if r.doc_id is not None}
    out = redact(df)
    assert out.columns == df.columns
    for r in out.collect():
        assert r.secret_spans == r["__spans"] == r["__least"] == "own"
        if r.text and r.doc_id is not None:
            text, made, upto = dict(rows)[r.doc_id], "", 0
            for _, a, z in sorted((s.split(":") for s in spans[r.doc_id].split(",")), key=lambda s: int(s[1])):
                if int(a) >= upto:
                    made += text[upto:int(a)] + "[SECRET]"
                upto = max(upto, int(z))
            assert r.text == made + text[upto:]
