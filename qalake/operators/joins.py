"""The anchored containment join (J12): equi joins on token / character grams,
texts verified where they stand, a broadcast of a counted size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qalake.functions.text import WS_RE

def _tok(col: str):
    return F.filter(F.split(F.col(col), WS_RE), lambda x: x != "")


def _gram_hashes(toks, first: int, last: int):
    """xxhash64 of each token trigram starting at 1-based positions first..last."""
    def lit(v):
        return F.lit(v) if isinstance(v, int) else v
    return F.transform(
        F.sequence(lit(first), lit(last)),
        lambda i: F.xxhash64(F.element_at(toks, i), F.element_at(toks, i + 1), F.element_at(toks, i + 2)))


def _char_grams(text: Column, q: int) -> Column:
    """Hashes of the character q-grams of a text (null when shorter than q)."""
    return F.when(F.length(text) >= q, F.transform(
        F.sequence(F.lit(1), F.length(text) - q + 1), lambda i: F.xxhash64(F.lit(q), F.substr(text, i, F.lit(q)))))


def _needle_anchors(n: DataFrame) -> DataFrame:
    """(item_id, ntext, g): every non-empty needle with one of its grams, the
    one that fewest needles hold (ties: the least hash)."""
    tokens, short = F.col("t"), F.least(F.length("ntext"), F.lit(3))
    interior = F.when(F.size(tokens) >= 5, _gram_hashes(tokens, 2, F.size(tokens) - 3))
    chars = F.coalesce(*(F.when(short == q, _char_grams(F.col("ntext"), q)) for q in (1, 2, 3)))
    keyed = n.withColumn("nk", F.sha2(F.concat_ws(" ", F.col("item_id").cast("string"), "ntext"), 256))
    grams = (keyed.select("nk", "ntext", _tok("ntext").alias("t"))
             .select("nk", F.explode_outer(F.array_distinct(F.coalesce(interior, chars))).alias("g"))
             .where(F.col("g").isNotNull()))
    uses = grams.groupBy("g").agg(F.count(F.lit(1)).alias("uses"))
    anchor = (grams.join(uses, "g").groupBy("nk").agg(F.min(F.struct("uses", "g")).alias("a"))
              .select("nk", F.col("a.g").alias("g")))
    return keyed.join(anchor, "nk").select("item_id", "ntext", "g")


def containment_join(docs: DataFrame, needles: DataFrame, *, doc_id: str = "doc_id",
                     doc_text: str = "text", needle_id: str = "item_id",
                     needle_text: str = "text", max_broadcast_keys: int = 1_000_000,
                     max_broadcast_bytes: int = 64 << 20) -> DataFrame:
    """All distinct (doc_id, needle_id) with ``needle_text`` a substring of ``doc_text``.

    Exact, with equi joins only. A needle's *interior* whitespace tokens (all
    but its first and last) are whole, consecutive tokens of any document that
    contains it, so a needle with at least five tokens is anchored on one of
    its interior token trigrams. Shorter needles are anchored on one of their
    character q-grams (q = 3, or the whole needle when it is shorter);
    documents emit their character q-grams only when such needles exist. Of a
    needle's grams the one that fewest needles hold is taken, so what many
    needles share (a common opening) is no anchor where anything else is left.

    Documents are read once and their text stays on its row: the distinct
    grams of a row are probed against the broadcast anchors and each hit is
    verified there with ``instr``; only ids leave the stage. The needles are
    broadcast while they are at most ``max_broadcast_keys`` rows and
    ``max_broadcast_bytes`` bytes of text, both counted first. Beyond that,
    grams and anchors meet by a shuffle of ids and hashes, and the texts of
    the candidates, and of no other document, are joined to be verified.

    Rows with a null id or text and empty needles match nothing; rows that
    repeat an id are each verified.
    """
    d = (docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("dtext"))
         .where(F.col("doc_id").isNotNull() & F.col("dtext").isNotNull()))
    n = (needles.select(F.col(needle_id).alias("item_id"), F.col(needle_text).alias("ntext"))
         .where(F.col("item_id").isNotNull() & (F.length("ntext") > 0)))

    few = F.size(_tok("ntext")) < 5
    size = n.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("ntext")).alias("bytes"),
                 F.collect_set(F.when(few, F.least(F.length("ntext"), F.lit(3)))).alias("q")).first()  # q: at most {1, 2, 3}
    anchors = _needle_anchors(n)
    tokens = F.col("t")
    parts = [F.when(F.size(tokens) >= 3, _gram_hashes(tokens, 1, F.size(tokens) - 2))]
    parts += [_char_grams(F.col("dtext"), q) for q in sorted(size["q"])]
    none = F.array().cast("array<bigint>")
    # explode_outer + null filter: no inferred size() filter that would tokenise every document twice
    grams = (d.select("doc_id", "dtext", _tok("dtext").alias("t"))
             .select("doc_id", "dtext", F.array_distinct(F.concat(*(F.coalesce(x, none) for x in parts))).alias("gs"))
             .select("doc_id", "dtext", F.explode_outer("gs").alias("g")))
    holds = F.instr(F.col("dtext"), F.col("ntext")) > 0
    if size["rows"] <= max_broadcast_keys and (size["bytes"] or 0) <= max_broadcast_bytes:
        return grams.join(F.broadcast(anchors), "g").where(holds).select("doc_id", "item_id").distinct()
    cand = (grams.select("doc_id", "g").where(F.col("g").isNotNull())
            .join(anchors.select("item_id", "g"), "g").select("doc_id", "item_id").distinct())
    return (cand.join(d, "doc_id").join(n, "item_id").where(holds)
            .select("doc_id", "item_id").distinct())
