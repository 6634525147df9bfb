"""Operator 5, secret scans: a randomness test battery (native).

Base findings are three patterns. The method adds spans: runs of the base64
alphabet that look random. For each run an encoding is inferred from the
characters it uses, and four tests are taken against a random string of that
alphabet: chi-squared uniformity, runs of digits and non-digits, lag-one
serial correlation, and the run's surprise, its mean bits per character under
a model of names and words (``SURPRISE``: which class of character follows
which, and how frequent a letter is). A run that fails one of them is
structured. For the rest, the p-value is the chance that a structured run is as
surprising. That null is normal; its mean and spread are those of the runs of
the stratum that failed a test, with ``prior_runs`` runs of the model itself
added, so that a stratum without structured runs has a null as well.
Discoveries are chosen by Benjamini-Hochberg within strata of encoding and
length. Surprise is counted in bins, so null and control need one small
aggregate whatever the number of runs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The base patterns. Matches of `access` (20+ characters) and `hex` (24+) are maximal runs,
# so the least length can stand in the pattern; `assign` drops matches by the length of its value.
ASSIGN = (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
          r"""([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
RUN = r"[A-Za-z0-9+/_=-]{%d,}"
KINDS = ("assign", "access", "hex", "random")

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# encoding: (pattern, alphabet)
ENCODINGS = {
    "decimal": (r"^[0-9]+$", _DIGITS),
    "hex": (r"^[0-9a-f]+$", _DIGITS + "abcdef"),
    "hexupper": (r"^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    "lower": (r"^[a-z]+$", _LOWER),
    "upper": (r"^[A-Z]+$", _UPPER),
    "letters": (r"^[A-Za-z]+$", _LOWER + _UPPER),
    "base32": (r"^[A-Z2-7]+=*$", _UPPER + "234567"),
    "base36": (r"^[0-9a-z]+$", _DIGITS + _LOWER),
    "base64": (r"", _DIGITS + _LOWER + _UPPER + "+/_-"),
}

_MARKS = "+/_-="
_PLACES = _DIGITS + _LOWER + _UPPER + _MARKS
# letters per thousand in running text of western languages, a to z
_SHARES = dict(zip(_LOWER, [82, 15, 30, 40, 125, 20, 20, 45, 70, 2, 8, 42, 26, 70, 72, 22, 2, 62, 66, 88, 30, 10, 20, 2, 17, 2]))
# class of a character -> class of the next one: digit, lower vowel and consonant, upper vowel and consonant, mark
_NEXT = {
    "d": {"d": 0.70, "v": 0.04, "c": 0.06, "V": 0.02, "C": 0.03, "m": 0.15},
    "v": {"d": 0.02, "v": 0.12, "c": 0.73, "V": 0.01, "C": 0.02, "m": 0.10},
    "c": {"d": 0.02, "v": 0.45, "c": 0.40, "V": 0.01, "C": 0.02, "m": 0.10},
    "V": {"d": 0.04, "v": 0.08, "c": 0.40, "V": 0.06, "C": 0.34, "m": 0.08},
    "C": {"d": 0.04, "v": 0.30, "c": 0.18, "V": 0.20, "C": 0.20, "m": 0.08},
    "m": {"d": 0.15, "v": 0.20, "c": 0.35, "V": 0.07, "C": 0.13, "m": 0.10},
}


def _class(c: str) -> str:
    if not c.isalpha():
        return "d" if c.isdigit() else "m"
    return ("V" if c.isupper() else "v") if c.lower() in "aeiou" else ("C" if c.isupper() else "c")


def _model() -> np.ndarray:
    """Chance of each character (column) after each one (row) in structured text."""
    share = np.array([_SHARES.get(c.lower(), 1.0) for c in _PLACES])
    kind = np.array([_class(c) for c in _PLACES])
    out = np.zeros((len(_PLACES),) * 2)
    for a, row in _NEXT.items():
        for b, chance in row.items():
            out[np.ix_(kind == a, kind == b)] = chance * share[kind == b] / share[kind == b].sum()
    return out


#: Bits of each character after each one.
SURPRISE = -np.log2(_model())
_CLASSES = "".join(sorted(_NEXT))
_CLASS_OF = "".join(_class(c) for c in _PLACES)


def _bits() -> tuple[list[float], list[float]]:
    """The same bits in two parts: of the class after a class, and of the character within its class."""
    at = [_CLASS_OF.index(c) for c in _CLASSES]
    within = [float(SURPRISE[0, i] + math.log2(_NEXT[_CLASS_OF[0]][_CLASS_OF[i]])) for i in range(len(_PLACES))]
    return [float(SURPRISE[i, j] - within[j]) for i in at for j in at], within


def _expected(alphabet: str) -> tuple[float, float, float, float]:
    """(mean, spread of one step) of the surprise of random strings of an
    alphabet, and of strings of the model within it; steps are dependent, so
    the spread holds the covariances of neighbouring ones."""
    at = [_PLACES.index(c) for c in alphabet]
    bits = SURPRISE[np.ix_(at, at)]
    chance = _model()[np.ix_(at, at)]
    out = []
    for step in (np.full(bits.shape, 1 / len(at)), chance / chance.sum(1, keepdims=True)):
        start = np.linalg.matrix_power(step, 64)[0]
        mean = float(start @ (step * bits).sum(1))
        off = bits - mean
        var = float(start @ (step * off ** 2).sum(1)) + 2 * float((start[:, None] * step * off).sum(0) @ (step * off).sum(1))
        out += [mean, math.sqrt(max(var, 1e-6))]
    return tuple(out)


EXPECTED = {k: _expected(v[1]) for k, v in ENCODINGS.items()}


@dataclass(frozen=True)
class SecretParams:
    run_least: int = 20        # characters of a run that is tested
    value_least: int = 6       # characters of an assigned value
    battery: float = 0.001     # a randomness test below this p-value fails the run
    fdr: float = 0.01          # false-discovery rate within a stratum
    bins: int = 1000           # bins of the surprise
    bin_bits: float = 0.02     # bits per character of a bin
    prior_runs: int = 50       # structured runs that the model counts for in each stratum
    prior_spread: float = 0.4  # bits per character: spread of the mean surprise between kinds of structured runs


def _normal(z: Column) -> Column:
    """Standard normal distribution function (a published rational formula, error below 1e-7)."""
    x = F.least(F.abs(z), F.lit(37.0))
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-x * x / 2) * 0.3989422804014327 * poly
    return F.when(z < 0, upper).otherwise(1 - upper)


_LONGS = "array<bigint>"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often the body
    names it (neighbouring projections may be merged, lambdas are not)."""
    return F.get(F.transform(F.array(value), body), 0)


def _running(values: Column, op, block: int = 256) -> Column:
    """Running ``op`` (plus, or greatest) of an array of longs from 0 or more,
    each place without its own value. Blocks keep the copies of the growing
    array short: the work is linear for any text that fits a row."""
    def one(arr: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_LONGS).alias("out"))
        return F.aggregate(arr, start, lambda acc, x: F.struct(op(acc["at"], x).cast("bigint").alias("at"),
                                                              F.concat(acc["out"], F.array(acc["at"])).alias("out")))
    cuts = F.when(F.size(values) > 0, F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int"))).otherwise(F.array().cast("array<int>"))
    parts = F.transform(cuts, lambda i: one(F.slice(values, i * block + 1, F.lit(block))))
    return _let(parts, lambda ps: F.flatten(F.zip_with(
        ps, one(F.transform(ps, lambda x: x["at"]))["out"], lambda x, base: F.transform(x["out"], lambda o: op(o, base).cast("bigint")))))


def _plus(a: Column, b: Column) -> Column:
    return a + b


def _before(spans: Column, value: Column, field: str) -> Column:
    """How many of ``spans`` (ascending by ``field``) lie below ``value``: binary search."""
    start = F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        below = F.get(spans, mid)[field] < value
        return F.when(acc["lo"] >= acc["hi"], acc).when(below, F.struct((mid + 1).alias("lo"), acc["hi"].alias("hi"))) \
            .otherwise(F.struct(acc["lo"].alias("lo"), mid.alias("hi")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(31)), start, halve, lambda acc: acc["lo"])


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start,end,s>> of the leftmost non-overlapping matches
    (code points): splitting and extracting walk the same matches, and a
    match starts after all that was skipped or matched before it."""
    none = F.array().cast("array<struct<start:int,end:int,s:string>>")
    both = F.struct(F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("bigint")).alias("skip"),
                    F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("got"))

    def found(x: Column) -> Column:
        return F.struct(x["skip"].alias("skip"), x["got"].alias("got"), _running(F.zip_with(
            F.slice(x["skip"], F.lit(1), F.size(x["got"])), x["got"], lambda n, s: n + F.length(s)), _plus).alias("at"))

    def placed(x: Column) -> Column:
        return F.zip_with(F.zip_with(F.slice(x["skip"], F.lit(1), F.size(x["got"])), x["at"], lambda n, at: (at + n).cast("int")), x["got"],
                          lambda start, s: F.struct(start.alias("start"), (start + F.length(s)).alias("end"), s.alias("s")))
    return F.when(text.rlike(pattern), _let(both, lambda x: _let(found(x), placed))).otherwise(none)


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("no"),
                                                 x["end"].alias("end"), F.lit(kind).alias("kind")))


def base_spans(text: Column, p: SecretParams) -> Column:
    assigned = F.filter(matches(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["s"], ASSIGN, 1)) >= p.value_least)
    return F.array_sort(F.concat(_spans(assigned, "assign"), _spans(matches(text, ACCESS), "access"),
                                 _spans(matches(text, HEX), "hex")))


def _pick(no: Column, values: list) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), no)


def _named(x: Column) -> Column:
    """Adds length, inferred encoding (the narrowest that holds the run) and alphabet."""
    s, names = x["s"], list(ENCODINGS)
    no = F.lit(names.index("base64"))
    for k, (pattern, *_) in reversed(list(ENCODINGS.items())):
        if pattern:
            no = F.when(s.rlike(pattern), F.lit(names.index(k))).otherwise(no)
    return F.struct(x["start"].alias("start"), x["end"].alias("end"), s.alias("s"), F.length(s).cast("double").alias("n"), no.alias("enc"))


def _lettered(x: Column) -> Column:
    alphabet = _pick(x["enc"], [v[1] for v in ENCODINGS.values()])
    letters = F.regexp_extract_all(x["s"], F.lit("."), F.lit(0))
    return F.struct(*[x[c].alias(c) for c in ("start", "end", "s", "n", "enc")], alphabet.alias("alphabet"), letters.alias("letters"),
                    F.regexp_extract_all(F.translate(x["s"], _PLACES, _CLASS_OF), F.lit("."), F.lit(0)).alias("classes"))


def _stats(x: Column) -> Column:
    """Adds the sums of the tests: squares of letter counts, digits, runs, the
    letters' places for the serial correlation, and the surprise."""
    squares = F.aggregate(F.regexp_extract_all(x["alphabet"], F.lit("."), F.lit(0)), F.lit(0.0), lambda a, c: a + F.pow(
        x["n"] - F.length(F.replace(x["s"], c, F.lit(""))), F.lit(2.0)))
    place = F.transform(x["letters"], lambda c: F.instr(x["alphabet"], c).cast("double"))
    size = x["n"].cast("int")
    between, within = (F.array(*[F.lit(v) for v in part]) for part in _bits())
    steps = F.aggregate(F.zip_with(F.slice(x["classes"], F.lit(1), size - 1), F.slice(x["classes"], F.lit(2), size - 1), lambda u, w: F.get(
        between, (F.instr(F.lit(_CLASSES), u) - 1) * len(_CLASSES) + F.instr(F.lit(_CLASSES), w) - 1)), F.lit(0.0), lambda a, v: a + v)
    own = F.aggregate(F.slice(x["letters"], F.lit(2), size - 1), F.lit(0.0), lambda a, c: a + F.get(within, F.instr(F.lit(_PLACES), c) - 1))
    return F.struct(*[x[c].alias(c) for c in ("start", "end", "n", "enc")], F.length(x["alphabet"]).cast("double").alias("k"),
                    squares.alias("squares"), place.alias("place"),
                    F.aggregate(place, F.lit(0.0), lambda a, v: a + v).alias("total"),
                    F.length(F.regexp_replace(x["s"], "[^0-9]", "")).cast("double").alias("digits"),
                    F.size(F.regexp_extract_all(x["s"], F.lit("[0-9]+|[^0-9]+"), F.lit(0))).cast("double").alias("runs"),
                    ((steps + own) / (x["n"] - 1)).alias("surprise"))


def _centred(x: Column) -> Column:
    """Adds the spread of the runs test and the places less their mean."""
    n, a, b = x["n"], x["digits"], x["n"] - x["digits"]
    return F.struct(*[x[c].alias(c) for c in ("start", "end", "n", "enc", "k", "squares", "runs", "surprise")],
                    (1 + 2 * a * b / n).alias("mean"), (2 * a * b * (2 * a * b - n) / (n * n * (n - 1))).alias("spread"),
                    F.transform(x["place"], lambda y: y - x["total"] / n).alias("centred"))


def _scored(x: Column) -> Column:
    """Adds the standard scores of the four tests (null: the test has no say; serial of equal letters: far out)."""
    n, k, size = x["n"], x["k"], x["n"].cast("int")
    chi = k / n * x["squares"] - n
    # Wilson-Hilferty: the cube root of chi-squared over its degrees of freedom is nearly normal
    v = 2.0 / (9.0 * (k - 1))
    z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / (k - 1), F.lit(1 / 3)) - (1 - v)) / F.sqrt(v)
    z_runs = F.when(x["spread"] > 0, F.abs((x["runs"] - x["mean"]) / F.sqrt(F.greatest(x["spread"], F.lit(1e-9)))))
    top = F.aggregate(F.zip_with(F.slice(x["centred"], F.lit(1), size - 1), F.slice(x["centred"], F.lit(2), size - 1), lambda u, w: u * w),
                      F.lit(0.0), lambda s, y: s + y)
    below = F.aggregate(x["centred"], F.lit(0.0), lambda s, y: s + y * y)
    mean, spread = (_pick(x["enc"], [EXPECTED[e][i] for e in ENCODINGS]) for i in (0, 1))
    return F.struct(*[x[c].alias(c) for c in ("start", "end", "n", "enc", "surprise")], z_chi.alias("z_chi"), z_runs.alias("z_runs"),
                    top.alias("top"), below.alias("below"), mean.alias("mean"),
                    ((x["surprise"] - mean) / (spread / F.sqrt(n - 1))).alias("z_surprise"))


def _judged(x: Column, p: SecretParams) -> Column:
    """struct<start, end, stratum, bin, fails> of one run: bin of its surprise, and
    whether a test tells it from a random string."""
    n = x["n"]
    z_serial = F.abs((x["top"] / F.greatest(x["below"], F.lit(1e-9)) + 1 / n) * F.sqrt(n))
    p_serial = F.when(x["below"] > 0, 2 * (1 - _normal(z_serial))).otherwise(F.lit(0.0))
    p_runs = F.when(x["z_runs"].isNotNull(), 2 * (1 - _normal(x["z_runs"]))).otherwise(F.lit(1.0))
    fails = (F.least(1 - _normal(x["z_chi"]), p_runs, p_serial, _normal(x["z_surprise"])) * 4 < p.battery) \
        | (x["enc"] == list(ENCODINGS).index("decimal"))
    binned = F.least(F.floor(F.least(x["surprise"], x["mean"]) / p.bin_bits).cast("int"), F.lit(p.bins))
    length = F.when(n < 28, "short").when(n < 48, "middle").otherwise("long")
    return F.struct(x["start"].alias("start"), x["end"].alias("end"), F.concat_ws("/", _pick(x["enc"], list(ENCODINGS)), length).alias("stratum"),
                    F.greatest(binned, F.lit(0)).alias("bin"), fails.alias("fails"))


def tested_runs(text: Column, p: SecretParams) -> Column:
    """array<struct<start,end,stratum,bin,fails>> of all runs of a text. Each
    step binds what the next one reads more than once."""
    out = matches(text, RUN % p.run_least)
    for step in (_named, _lettered, _stats, _centred, _scored):
        out = F.transform(out, step)
    return F.transform(out, lambda x: _judged(x, p))


def thresholds(runs: DataFrame, p: SecretParams) -> DataFrame:
    """(stratum, least bin) of the discoveries; ``runs``: stratum, bin, fails.
    A bin's p-values count at its upper edge, so the rate holds.

    Runs that fail give the null; random strings fail as well, at the rate
    ``battery`` of each test, so failures count only beyond ten times that rate
    of the other runs."""
    bins = runs.groupBy("stratum", "bin", "fails").agg(F.count("*").alias("n"))  # a few strata times ``bins`` rows
    enc = F.split("stratum", "/")[0]
    length = F.split("stratum", "/")[1]
    least_n = F.when(length == "middle", 28).when(length == "long", 48).otherwise(p.run_least) - 1
    no = F.array_position(F.array(*[F.lit(e) for e in ENCODINGS]), enc).cast("int") - 1
    prior = _pick(no, [EXPECTED[e][2] for e in ENCODINGS])
    spread = F.pow(_pick(no, [EXPECTED[e][3] for e in ENCODINGS]), F.lit(2.0)) / least_n + p.prior_spread ** 2
    at, all_ = (F.col("bin") + 0.5) * p.bin_bits, Window.partitionBy("stratum")
    failed = F.when(F.col("fails"), F.col("n")).otherwise(0)
    null = bins.select("*", F.sum("n").over(all_).alias("m"), F.sum(failed).over(all_).alias("f"),
                       F.sum(failed * at).over(all_).alias("s1"), F.sum(failed * at * at).over(all_).alias("s2"))
    weight = F.greatest(F.col("f") - 10 * p.battery * (F.col("m") - F.col("f")), F.lit(0.0)) / F.greatest(F.col("f"), F.lit(1))
    total = weight * F.col("f") + p.prior_runs
    mean = (weight * F.col("s1") + p.prior_runs * prior) / total
    var = (weight * F.col("s2") + p.prior_runs * (prior * prior + spread)) / total - mean * mean
    value = _normal((mean - F.col("bin") * p.bin_bits) / F.sqrt(F.greatest(var, F.lit(1e-4))))
    above = Window.partitionBy("stratum").orderBy(F.desc("bin"))
    ok = null.where(~F.col("fails")).select("stratum", "bin", "m", value.alias("value"), F.sum("n").over(above).alias("c"))
    return ok.where(F.col("value") <= p.fdr * F.col("c") / F.col("m")).groupBy("stratum").agg(F.min("bin").alias("least"))


def _free(docs: DataFrame, name: str) -> str:
    """``name``, or the first longer one that no column has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def findings(docs: DataFrame, text_col: str = "text", params: SecretParams = SecretParams(), spans_col: str = "secret_spans") -> DataFrame:
    """``docs`` with a column ``spans_col`` (which ``docs`` must not have):
    array<struct<start, no, end, kind>> sorted by start and kind (base findings
    and the method's; code points, end exclusive). A run that overlaps a base
    finding is not repeated. Null text: no spans."""
    p = params
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    limits = thresholds(docs.select(F.explode(tested_runs(text, p)).alias("r")).select("r.stratum", "r.bin", "r.fails"), p)
    limits = limits.agg(F.coalesce(F.map_from_entries(F.collect_list(F.struct("stratum", "least"))), F.create_map().cast("map<string,int>")))
    least = _free(docs, "__least")
    rows = docs.withColumn(least, limits.scalar())

    def chosen(base: Column, ends: Column) -> Column:
        return F.filter(tested_runs(text, p), lambda r: ~r["fails"] & (r["bin"] >= F.col(least)[r["stratum"]])
                        & (F.get(ends, _before(base, r["end"], "start")) <= r["start"]))
    spans = _let(base_spans(text, p), lambda base: _let(_furthest(base), lambda ends: F.array_sort(
        F.concat(base, _spans(chosen(base, ends), "random")))))
    return rows.withColumn(spans_col, spans).drop(least)


def _furthest(spans: Column) -> Column:
    """For each of ``spans`` the furthest end before it, and that of all."""
    far = F.transform(spans, lambda x: x["end"].cast("bigint"))
    return _running(F.concat(far, F.array(F.lit(0).cast("bigint"))), F.greatest)


def digest(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: SecretParams = SecretParams()) -> DataFrame:
    """One row per document: ``n_assign``, ``n_access``, ``n_hex``,
    ``base_sha256`` (SHA-256 of the base spans as kind:start:end, comma-joined)
    and ``spans`` (all spans, joined likewise).

    Null and empty texts have no spans (digest of the empty string). Repeated
    or null ids: each row is judged alone. Very long texts are scanned whole.
    Spans that start together stand in the order of the kinds. Empty table: no
    rows. Other columns are not read.
    """
    rows = findings(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), "text", params)

    def of(kind):
        return F.filter("secret_spans", lambda x: x["kind"] == kind)
    base = F.filter("secret_spans", lambda x: x["kind"] != "random")
    return rows.select("doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
                       F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("secret_spans")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", params: SecretParams = SecretParams(), mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span of the text replaced by ``mark``;
    overlapping spans become one. All columns stay, whatever their names.

    Null text stays null, a text without spans as it is. Each row is judged
    alone, whatever its id. Very long texts are written block by block, each
    from the spans that touch it. Empty table: no rows.
    """
    name, text, size = _free(docs, "__spans"), F.col(text_col), 4096
    rows = findings(docs, text_col, params, name)

    def block_text(block: Column, no: Column, spans: Column, ends: Column) -> Column:
        at = (no * size).cast("bigint")
        return _let(F.struct(at.alias("at"), _before(spans, at, "start").alias("lo"),
                             _before(spans, at + F.length(block), "start").alias("hi")), lambda b: F.aggregate(
            F.slice(spans, b["lo"] + 1, b["hi"] - b["lo"]),
            F.struct(F.greatest(b["at"], F.get(ends, b["lo"])).alias("upto"), F.lit("").alias("out")),  # upto: what earlier spans cover
            lambda acc, x: F.struct(
                F.greatest(acc["upto"], x["end"].cast("bigint")).alias("upto"),
                F.when(x["start"] < acc["upto"], acc["out"]).otherwise(F.concat(
                    acc["out"], F.substring(block, (acc["upto"] - b["at"] + 1).cast("int"), (x["start"] - acc["upto"]).cast("int")),
                    F.lit(mark))).alias("out")),
            lambda acc: F.concat(acc["out"], F.substring(block, F.least(acc["upto"] - b["at"] + 1, F.lit(size + 1)).cast("int"), F.lit(size)))))
    blocks = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % size), F.lit(0))
    clean = _let(F.col(name), lambda spans: _let(_furthest(spans), lambda ends: F.array_join(
        F.transform(blocks, lambda block, no: block_text(block, no, spans, ends)), "")))
    return rows.withColumn(text_col, F.when(F.size(name) > 0, clean).otherwise(text)).drop(name)
