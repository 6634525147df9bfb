"""Domain views over the driver tables.

* embeddings = topic vectors of questions and documents; a vector's gold
  documents are the other vectors with the same ``label``; ``label`` is the
  batch of a question.
* benchmark = questions, documents = corpus; gold links are the documents that
  contain a question's text (J12).
* conversations = typed turns (role = question type), pages = raw HTML,
  events = leaderboard rows (system = event_type, batch = day).
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qalake.operators.retrieve import cosine_topk
from qalake.operators.topics import MIN_PROBABILITY
from qalake.sources.tables import Tables


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(
        "vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


def embedding_ranked(t: Tables, k: int = 10) -> DataFrame:
    """Every vector retrieves its top-k nearest other vectors (exact cosine)."""
    v = vectors(t)
    return cosine_topk(v.select(F.col("vec_id").alias("q_id"), "vec"),
                       v.select(F.col("vec_id").alias("doc_id"), "vec"),
                       k=k, exclude_self=True)


def label_sizes(t: Tables) -> DataFrame:
    return t.embeddings.groupBy("label").agg(F.count(F.lit(1)).alias("label_n"))


def embedding_judged(t: Tables, k: int = 10) -> DataFrame:
    """Ranked rows with hit flags; |T| = size of the query's label minus itself.

    Gold sets are never materialised: a label holding a third of all vectors
    costs one count, not a third of all pairs.
    """
    lab = t.embeddings.select("vec_id", "label")
    ranked = embedding_ranked(t, k)
    return (ranked
            .join(lab.select(F.col("vec_id").alias("q_id"), F.col("label").alias("batch")), "q_id")
            .join(lab.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("d_label")), "doc_id")
            .join(label_sizes(t).select(F.col("label").alias("batch"), "label_n"), "batch")
            .withColumn("hit", F.col("batch") == F.col("d_label"))
            .withColumn("n_rel", (F.col("label_n") - 1).cast("long")))


def gold_links(t: Tables, materialize: bool = False) -> DataFrame:
    """(doc_id, item_id): documents containing a question's text.

    ``materialize`` writes the (small) link table to the cluster's checkpoint
    folder, cutting lineage when a plan reads it several times."""
    from qalake.operators.joins import containment_join
    from qalake.session import ensure_checkpoint_dir
    g = containment_join(t.documents, t.benchmark)
    if materialize:
        ensure_checkpoint_dir(t.spark)
        g = g.checkpoint(eager=True)
    return g


def doc_tokens(t: Tables, docs: DataFrame | None = None) -> DataFrame:
    """(doc_id, toks) with the F3 chain (no stemming)."""
    from qalake.functions.text import tokens
    d = docs if docs is not None else t.documents
    return d.select("doc_id", tokens("text").alias("toks"))


def label_answer(col: str = "label", prefix: str = "label "):
    return F.concat(F.lit(prefix), F.col(col).cast("string"))


def embedding_predictions(t: Tables, k: int) -> DataFrame:
    """Predicted answers of a question = labels of its top-k neighbours, in
    rank order (repeats kept): ``(qid, rank, answer)``."""
    lab = t.embeddings.select(F.col("vec_id").alias("doc_id"), "label")
    return (embedding_ranked(t, k).join(lab, "doc_id")
            .select(F.col("q_id").alias("qid"), "rank", label_answer().alias("answer")))


def embedding_gold(t: Tables) -> DataFrame:
    """Gold answer of a question: one group (its own label) with two
    synonyms spelled differently from the predictions: ``(qid, grp, synonym)``."""
    e = t.embeddings
    a = e.select(F.col("vec_id").alias("qid"), F.lit(0).alias("grp"),
                 label_answer(prefix="Label ").alias("synonym"))
    b = e.select(F.col("vec_id").alias("qid"), F.lit(0).alias("grp"),
                 label_answer(prefix="class ").alias("synonym"))
    return a.unionByName(b)


def question_batches(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("qid"), F.col("label").alias("batch"))


def turn_pairs(t: Tables) -> DataFrame:
    """SQuAD stand-in: an assistant turn is a prediction, the user turns
    right before and after it are its golds (bounded: at most two)."""
    c = t.conversations
    a = c.where(F.col("role") == "assistant").select(
        "conv_id", "turn", F.col("text").alias("prediction"))
    g = c.where(F.col("role") == "user").select(
        "conv_id", F.col("turn").alias("gold_id"), F.col("text").alias("gold"))
    before = a.join(g.withColumn("turn", F.col("gold_id") + 1), ["conv_id", "turn"])
    after = a.join(g.withColumn("turn", F.col("gold_id") - 1), ["conv_id", "turn"])
    return before.unionByName(after)


SENTENCE_SPLIT = "[.!?][ \\t\\n\\r\\f\\x0B]+"


def squad_inputs(t: Tables, materialize: bool = False):
    """(pairs, answers) for SQuAD rows: gold (document, question) pairs with
    the document as context; the answers are the question's sentences."""
    g = gold_links(t, materialize)
    pairs = (g.join(t.documents.select("doc_id", F.col("text").alias("context"),
                                       F.col("source").alias("title")), "doc_id")
             .join(t.benchmark.select("item_id", F.col("text").alias("question")), "item_id"))
    answers = t.benchmark.select(
        "item_id", F.posexplode_outer(F.split("text", SENTENCE_SPLIT)).alias("answer_idx", "answer")) \
        .where(F.col("answer").isNotNull())
    return pairs, answers


def qa_turns(t: Tables) -> DataFrame:
    """A user turn (question) with the assistant turn that follows it (context)."""
    c = t.conversations
    u = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    a = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("context"))
    return u.join(a, ["conv_id", "turn"])


def logits(t: Tables) -> DataFrame:
    """Stand-in logits: start = the embedding, end = the reversed embedding."""
    s = F.transform("embedding", lambda x: x.cast("double"))
    return t.embeddings.select("vec_id", "label", s.alias("start_logits"),
                               F.reverse(s).alias("end_logits"))


def leaderboard(t: Tables) -> DataFrame:
    """System x batch scores: system = event type, batch = day."""
    e = t.events
    return (e.groupBy(F.col("event_type").alias("system"),
                      F.date_format("ts", "yyyy-MM-dd").alias("batch"))
            # value has 2 decimals: the rounded sum is exact, so the mean is one
            # correctly rounded division -- identical in any engine.
            .agg((F.round(F.sum("value"), 2) / F.count(F.lit(1))).alias("mean_value"),
                 F.count(F.lit(1)).alias("n_events"),
                 F.countDistinct("user_id").alias("n_users")))


def window_features(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Stand-in windows, four to a question: with n a quarter of the vectors,
    vector v is window v div n of question (document) v mod n; token 0 is no
    context, token i covers five characters from 9 * (40 window + i)."""
    docs = t.documents.select(F.col("doc_id").alias("question_id"), F.col("text").alias("context"))
    n = max(1, -(-t.embeddings.count() // 4))
    lg = logits(t).select((F.col("vec_id") % n).alias("question_id"), F.floor(F.col("vec_id") / n).cast("long").alias("window"),
                          "start_logits", "end_logits")
    size = docs.select("question_id", F.length("context").alias("size"))
    at = (F.col("window") * 40).cast("int")
    lg = lg.join(size, "question_id").withColumn("offsets", F.transform("start_logits", lambda x, i: F.when(
        (i > 0) & ((at + i) * 9 + 5 <= F.col("size")), F.struct(((at + i) * 9).alias("s"), ((at + i) * 9 + 5).alias("e")))))
    return lg.drop("size"), docs


def trials(t: Tables) -> DataFrame:
    """Trial table stand-in: study = event type, trial = event, param k from
    the JSON props, score = value."""
    return t.events.select(
        F.col("event_type").alias("study"), F.col("event_id").alias("trial_id"),
        F.get_json_object("props", "$.k").cast("int").alias("k"), F.col("value").alias("score"))


def embedding_topic_mix(t: Tables) -> DataFrame:
    """Topic mixture of each vector: |x_i| / sum |x| -- long, unfiltered."""
    absv = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    tot = F.aggregate(absv, F.lit(0.0), lambda a, x: a + x)
    mix = F.transform(absv, lambda x: F.coalesce(F.try_divide(x, tot), F.lit(0.0)))
    return t.embeddings.select(F.col("vec_id").alias("doc_id"),
                               F.posexplode_outer(mix).alias("topic", "w")).where(F.col("w").isNotNull())


def top_terms_by_group(t: Tables, group: str = "lang", n: int = 10) -> DataFrame:
    """A fixed word list per group derived from data: the n terms with the
    highest document frequency in the group's documents (ties: term)."""
    from pyspark.sql import Window
    from qalake.functions.text import tokens
    d = t.documents.select("doc_id", group, tokens("text").alias("toks"))
    dt = (d.select("doc_id", group, F.explode_outer(F.array_distinct("toks")).alias("term"))
          .where(F.col("term").isNotNull()))
    df = dt.groupBy(group, "term").agg(F.count(F.lit(1)).alias("df"))
    w = Window.partitionBy(group).orderBy(F.desc("df"), F.asc("term"))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n) \
        .select(group, "rank", "term")


def tokens_long(t: Tables, keep: list[str] | None = None, persist: bool = False) -> DataFrame:
    """(doc_id, [keep...], last, pos, term) over every document (F3 tokens, 0-based
    pos; last: the document's last pos). ``persist`` keeps it for plans that
    read it more than once."""
    from qalake.functions.text import tokens
    docs = t.documents.select("doc_id", *(keep or []), tokens("text").alias("toks"))
    out = (docs.select("doc_id", *(keep or []), (F.size("toks") - 1).alias("last"), F.posexplode_outer("toks").alias("pos", "term"))
           .where(F.col("term").isNotNull()))
    return out.persist(StorageLevel.MEMORY_AND_DISK) if persist else out


class LdaFit:
    """LDA on the F3 tokens of every document, whole vocabulary, ``n_passes``
    full passes; documents without a token stay."""

    def __init__(self, t: Tables, k: int = 10, n_passes: int = 5, seed: int = 1):
        from qalake.functions.text import tokens
        from qalake.llm.store import written
        from qalake.operators import lda
        toks = t.documents.select("doc_id", tokens("text").alias("toks"))
        # texts are cut into tokens once; F3 tokens hold no blank
        self.docs = written(toks.select("doc_id", F.greatest(F.size("toks"), F.lit(0)).alias("len"), F.array_join("toks", " ").alias("line")),
                            "lda-docs")
        self.lengths = self.docs.select("doc_id", "len")
        self.blocks = lda.line_blocks(self.docs, k)
        self.model = lda.fit(self.blocks, k, n_passes, seed=seed)

    def doc_vectors(self, min_probability: float = MIN_PROBABILITY) -> DataFrame:
        from qalake.operators import lda
        return lda.topic_vectors(self.model, self.docs, self.blocks, min_probability)
