"""Small awkward documents, shared by the tests of the operators."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])
#: names that operators use inside
CLASHING = ["row", "words", "n", "h", "rid", "gram", "key", "keys", "token", "pos", "w", "win", "items", "at", "a", "b",
            "anchor", "score", "lang_pred", "rank", "rep", "vec", "ids", "code", "bad", "host", "path", "rule", "spans",
            "secret_spans", "component_id", "start", "length"]


def prose(rng, n, vocab=400):
    return " ".join(rng.choice(["w%d", "Q%d", "é%d"]) % rng.randrange(vocab) + rng.choice(["", "", ".", ",", "\n"]) for _ in range(n))


def awkward(seed=0):
    """Rows (id, text): nulls, empties, copies, near copies, shared passages, a
    long text, repeated ids, words only, white space only."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randrange(1, 220)) for _ in range(40)]
    rows = list(enumerate(base))
    nxt = len(rows)

    def add(text):
        nonlocal nxt
        rows.append((nxt, text))
        nxt += 1
    for i in (0, 3, 3, 7, 7, 7):
        add(base[i])                                    # exact copies
    for i in range(10, 22):                             # near copies
        words = base[i].split()
        words[rng.randrange(len(words))] = "changed"
        add(" ".join(words))
    passage = prose(rng, 70, 5000)
    for i in range(6):                                  # a passage in several documents
        add(prose(rng, 30) + " " + passage + " " + prose(rng, 20))
    add(prose(rng, 6000, 50000))                        # long
    add(" ".join(["same"] * 300))                       # one word again and again
    add(" ".join(["same"] * 180))
    for t in (None, "", "   \n\t ", "one", "one two three four", "ONE two three four", "a b c d e", "  lead  and  trail  ",
              "nbsp\u00a0word \u2028 line", "...", "1234567890", "日本語 テキスト。 次の文。"):
        add(t)
    rows.append((5, "a second row of id five " + prose(rng, 80)))  # repeated id
    rows.append((6, base[6]))                                       # repeated row
    rows.append((None, base[8]))                                    # null id
    rows.append((None, None))
    rng.shuffle(rows)
    return rows


def documents(spark, rows, clashing=True, parts=3):
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    if clashing:
        from pyspark.sql import functions as F
        df = df.withColumns({c: F.lit("x") for c in CLASHING})
    return df.repartition(parts) if parts else df


def empty(spark):
    return spark.createDataFrame([], DOCS)
