"""Operator 2, benchmark decontamination: prefix-filtered set join (native).

Every benchmark window (item-sized: ``width`` words, or the whole item if it
is shorter) must be contained as a whole, so the necessary prefix of its words
under a rare-first order is one word: its rarest one, by document frequency in
the corpus. Documents keep the places of such words with their surroundings
(a slice of 2*width - 1 words); they are joined to the windows by that word,
bounded by position and length, and verified word by word. Only DataFrame
functions run; document texts are never shuffled.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class DecontamParams:
    width: int = 10
    literal_words: int = 50_000      # up to so many benchmark words, documents are pre-filtered by a literal set
    broadcast_windows: int = 200_000  # up to so many windows, the window table is broadcast


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; null has none."""
    folded = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(folded, SEPARATORS, -1), "")


def item_windows(benchmark: DataFrame, id_col: str, text_col: str, p: DecontamParams) -> DataFrame:
    """(item_id, win): the windows of every item with an id and a word."""
    items = benchmark.select(benchmark[id_col].cast("string").alias("item_id"), words_of(benchmark[text_col]).alias("w"))
    items = items.where("item_id is not null").where(F.size("w") > 0)
    last = F.greatest(F.size("w") - p.width, F.lit(0))
    return items.select("item_id", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("w", i + 1, p.width)))
                        .alias("win")).distinct()


def _places(words: Column, wanted: list[str] | None) -> Column:
    """Positions (from 0) of the words in ``wanted``; None: of all words."""
    at = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.array().cast("array<int>"))
    return at if wanted is None else F.filter(at, lambda i: F.get(words, i).isin(wanted))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text",
                  params: DecontamParams = DecontamParams()) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``,
    ``n_hit`` (words inside any occurrence of a benchmark window), ``n_items``,
    ``items_sha256`` (SHA-256 of the ids of those items as strings, sorted and
    comma-joined), ``contaminated`` (n_hit > 0).

    Null and empty texts have no words and are clean. Repeated or null
    document ids: each row is judged alone. Benchmark rows with a null id or
    without words have no windows; rows of one id are one item. Very long
    texts are scanned whole. With an empty benchmark all is clean; an empty
    document table gives no rows. Other columns are not read.
    """
    p = params
    windows = item_windows(benchmark, item_col, item_text_col, p).groupBy("win") \
        .agg(F.collect_set("item_id").alias("items")).persist()
    n_windows = windows.count()
    vocabulary = windows.select(F.explode("win").alias("w")).distinct()
    few = vocabulary.limit(p.literal_words + 1).collect()
    known = [r["w"] for r in few] if len(few) <= p.literal_words else None

    # document frequency of the benchmark's words over the whole corpus
    texts = docs.select(words_of(docs[text_col]).alias("words"))
    in_docs = texts.select(F.array_distinct(F.filter("words", lambda w: w.isin(known)) if known is not None
                                            else F.col("words")).alias("words"))
    freq = in_docs.select(F.explode("words").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    if known is None:
        freq = freq.join(vocabulary.withColumnRenamed("w", "token"), "token", "left_semi")

    # the rarest word of each window, and where it stands there
    placed = windows.select("win", "items", F.posexplode("win").alias("off", "token"))
    rarest = placed.join(freq, "token", "left").groupBy("win").agg(
        F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token", "off")).alias("x"), F.first("items").alias("items"))
    by_token = rarest.groupBy(F.col("x.token").alias("token")).agg(
        F.collect_list(F.struct(F.col("x.off").alias("off"), "win", "items")).alias("wins")).persist()
    few = by_token.select("token").limit(p.literal_words + 1).collect() if known is not None else []
    tokens = [r["token"] for r in few] if known is not None else None
    small = n_windows <= p.broadcast_windows

    # a row's number is only used inside this one job, after the scan that gave it
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), words_of(docs[text_col]).alias("words")) \
        .withColumn("row", F.monotonically_increasing_id())
    around = p.width - 1
    found = rows.select("row", "doc_id", F.size("words").alias("n"), F.explode_outer(F.transform(
        _places(F.col("words"), tokens), lambda i: F.struct(
            i.alias("pos"), F.get(F.col("words"), i).alias("token"), F.least(i, F.lit(around)).alias("before"),
            F.slice(F.col("words"), F.greatest(i - around, F.lit(0)) + 1, 2 * around + 1).alias("near")))).alias("c"))
    found = found.select("row", "doc_id", "n", F.col("c.token").alias("token"), F.col("c.pos").alias("pos"),
                         F.col("c.before").alias("before"), F.col("c.near").alias("near"))
    joined = found.join(F.broadcast(by_token) if small else by_token, "token", "left")
    fits = F.filter("wins", lambda x: (x["off"] <= F.col("before"))
                    & (F.slice(F.col("near"), F.greatest(F.col("before") - x["off"], F.lit(0)) + 1, F.size(x["win"])) == x["win"]))
    hits = joined.select("row", "doc_id", "n", F.coalesce(F.transform(fits, lambda x: F.struct(
        (F.col("pos") - x["off"]).alias("start"), (F.col("pos") - x["off"] + F.size(x["win"])).alias("end"))),
        F.array().cast("array<struct<start:int,end:int>>")).alias("at"),
        F.array_distinct(F.flatten(F.transform(fits, lambda x: x["items"]))).alias("items"))

    def merged(c):
        return F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.size("at") > 0, F.col(c))))))

    per_doc = hits.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n").alias("n"),
                                      merged("at").alias("at"), merged("items").alias("items"))
    covered = F.aggregate("at", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto")), lambda acc, x: F.struct(
        (acc["n"] + F.greatest(x["end"] - F.greatest(x["start"], acc["upto"]), F.lit(0))).alias("n"),
        F.greatest(x["end"], acc["upto"]).alias("upto")), lambda acc: acc["n"])
    return per_doc.select("doc_id", F.col("n").cast("long").alias("n_words"), covered.alias("n_hit"),
                          F.size("items").cast("long").alias("n_items"),
                          F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("at") > 0).alias("contaminated"))
