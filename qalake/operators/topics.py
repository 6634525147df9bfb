"""Topic models and their analyses.

LDA is Spark ML's online variational Bayes (``pyspark.ml.clustering.LDA``).
Size bound to know: the k x vocabulary topic matrix lives on the driver and is
broadcast each iteration (k=2000 x 20 000 terms x 8 B = 320 MB), so the
vocabulary is capped (``vocab_size``) and k is a parameter the caller sizes.

All analyses run on long tables -- ``(doc_id, topic, w)`` topic mixes,
``(topic, rank, term, weight)`` top words -- with joins and grouped
aggregates; nothing is collected.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml.clustering import LDA, LocalLDAModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_PROBABILITY = 0.01
EPSILON = 1e-12


# ---- T4 parameter mapping ---------------------------------------------------------
@dataclass
class LdaParams:
    k: int = 10
    max_iter: int = 10
    subsampling_rate: float = 0.05
    learning_decay: float = 0.5
    learning_offset: float = 1.0
    optimize_doc_concentration: bool = False
    doc_concentration: list[float] | None = None
    seed: int = 1


def lda_params_from_reference(num_topics: int, chunksize: int, passes: int, n_docs: int,
                              update_every: int = 1, decay: float = 0.5, offset: float = 1.0,
                              alpha: str = "symmetric", random_state: int = 1) -> LdaParams:
    """Map the reference's online-LDA arguments onto Spark's LDA.

    subsamplingRate = chunksize / N (1.0 in batch mode, update_every=0),
    maxIter = ceil(passes * N / chunksize); alpha 'auto' optimises the
    document concentration, 'asymmetric' gives 1/(i + sqrt(k)) normalised."""
    rate = 1.0 if update_every == 0 else min(1.0, chunksize / max(n_docs, 1))
    iters = passes if update_every == 0 else max(1, math.ceil(passes * n_docs / max(chunksize, 1)))
    conc = None
    if alpha == "asymmetric":
        raw = [1.0 / (i + math.sqrt(num_topics)) for i in range(num_topics)]
        s = sum(raw)
        conc = [r / s for r in raw]
    return LdaParams(k=num_topics, max_iter=iters, subsampling_rate=rate, learning_decay=decay,
                     learning_offset=offset, optimize_doc_concentration=(alpha == "auto"),
                     doc_concentration=conc, seed=random_state)


# ---- T2/T3 vectors ---------------------------------------------------------------
def count_vectors(train_toks: DataFrame, col: str = "toks", vocab_size: int = 5000,
                  min_df: int = 1, doc_id: str = "doc_id") -> CountVectorizerModel:
    """Vocabulary of the training corpus -- the ``vocab_size`` most frequent
    terms (collection frequency desc, term asc) with ``df >= min_df``.

    Term statistics are DataFrame aggregates (partial, map-side combined); only
    the capped term list reaches the driver, where the topic model keeps its
    k x vocabulary matrix anyway."""
    from qalake.operators.textops import term_stats
    top = (term_stats(train_toks, doc_id, col).where(F.col("df") >= min_df)
           .orderBy(F.desc("cf"), F.asc("term")).limit(vocab_size))
    vocab = [r.term for r in top.select("term").collect()]  # bounded by vocab_size
    return CountVectorizerModel.from_vocabulary(vocab, inputCol=col, outputCol="features")


def count_vectors_ml(train_toks: DataFrame, col: str = "toks", vocab_size: int = 5000,
                     min_df: float = 1.0) -> CountVectorizerModel:
    """The same with Spark ML's ``CountVectorizer`` estimator (RDD-based counting)."""
    return CountVectorizer(inputCol=col, outputCol="features", vocabSize=vocab_size,
                           minDF=min_df).fit(train_toks)


def vocabulary_table(cv: CountVectorizerModel) -> DataFrame:
    """(term_id, term) as a DataFrame, so later lookups are joins."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    vocab = cv.vocabulary  # already on the driver (capped)
    return spark.createDataFrame(list(enumerate(vocab)), "term_id int, term string")


# ---- T4/T5 -------------------------------------------------------------------------
def fit_lda(vectors: DataFrame, p: LdaParams, features: str = "features") -> LocalLDAModel:
    lda = (LDA(k=p.k, maxIter=p.max_iter, optimizer="online", seed=p.seed,
               subsamplingRate=p.subsampling_rate, learningDecay=p.learning_decay,
               learningOffset=p.learning_offset,
               optimizeDocConcentration=p.optimize_doc_concentration,
               featuresCol=features))
    if p.doc_concentration is not None:
        lda = lda.setDocConcentration(p.doc_concentration)
    return lda.fit(vectors)


def topic_mix(model, vectors: DataFrame, key: str = "doc_id",
              min_probability: float = MIN_PROBABILITY) -> DataFrame:
    """T5: long ``(key, topic, w)`` topic mixture, entries below
    ``min_probability`` dropped, no re-normalisation."""
    td = model.transform(vectors).select(key, vector_to_array("topicDistribution").alias("td"))
    # posexplode_outer: a plain posexplode lets Catalyst infer a size() filter
    # that would run the model's inference twice per document.
    return (td.select(key, F.posexplode_outer("td").alias("topic", "w"))
            .where(F.col("w") >= min_probability))


def topic_vectors(model, vectors: DataFrame, key: str = "doc_id",
                  min_probability: float = MIN_PROBABILITY) -> DataFrame:
    """Dense ``(key, vec)`` topic vectors with small entries zeroed (T5 + T6 input)."""
    td = model.transform(vectors).select(key, vector_to_array("topicDistribution").alias("td"))
    return td.select(key, F.transform("td", lambda x: F.when(x >= min_probability, x)
                                      .otherwise(F.lit(0.0))).alias("vec"))


def describe_topics(model, vocab: DataFrame, n: int = 5) -> DataFrame:
    """Top-n terms per topic as ``(topic, rank, term, weight)``."""
    d = model.describeTopics(n)
    long = d.select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("r", "z"))
    return (long.select("topic", (F.col("r") + 1).alias("rank"), F.col("z.termIndices").alias("term_id"),
                        F.col("z.termWeights").alias("weight"))
            .join(vocab, "term_id").select("topic", "rank", "term", "weight"))


def topic_labels(top: DataFrame, n: int = 5) -> DataFrame:
    """``'w1, w2, ...'`` per topic."""
    return (top.where(F.col("rank") <= n).groupBy("topic")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))),
                                          lambda x: x["term"]), ", ").alias("label")))


# ---- A17 / A18 / O3 ----------------------------------------------------------------
def topic_sizes(mix_all: DataFrame, min_probability: float = MIN_PROBABILITY) -> DataFrame:
    """Documents per topic counting every topic with ``w >= min_probability``;
    topics no document reaches stay at 0 (counted from the un-filtered mix,
    so no ``range(k)`` is needed)."""
    return mix_all.groupBy("topic").agg(
        F.count(F.when(F.col("w") >= min_probability, 1)).alias("n_docs"))


def ordered_topics(sizes: DataFrame) -> DataFrame:
    """O3: topics by size, reversed-argsort tie order (higher topic first)."""
    return sizes.orderBy(F.desc("n_docs"), F.desc("topic"))


# ---- T10 coherence -----------------------------------------------------------------
def coherence_umass(top: DataFrame, doc_terms: DataFrame, eps: float = EPSILON,
                    group: str = "topic") -> DataFrame:
    """u_mass per topic: mean over ordered pairs (m after l by rank) of
    ln((D(wm, wl)/D + eps) / (D(wl)/D)) on document co-occurrence.

    ``doc_terms`` is ``(doc_id, term)`` (any multiplicity). Documents are
    semi-joined to the top-word list first; pairs are built per document from
    top words only (at most n^2 per document)."""
    dt = doc_terms.select("doc_id", "term").distinct().persist(StorageLevel.MEMORY_AND_DISK)
    n_docs = dt.select("doc_id").distinct().agg(F.count(F.lit(1)).alias("D"))
    top = top.select(group, "rank", "term").persist(StorageLevel.MEMORY_AND_DISK)
    hit = dt.join(top, "term").persist(StorageLevel.MEMORY_AND_DISK)
    single = hit.groupBy(group, "rank").agg(F.count(F.lit(1)).alias("dl"))
    a = hit.select("doc_id", group, F.col("rank").alias("rm"))
    b = hit.select("doc_id", group, F.col("rank").alias("rl"))
    pair = (a.join(b, ["doc_id", group]).where(F.col("rl") < F.col("rm"))
            .groupBy(group, "rm", "rl").agg(F.count(F.lit(1)).alias("dml")))
    ranks = top.select(group, "rank")
    all_pairs = (ranks.select(group, F.col("rank").alias("rm"))
                 .join(ranks.select(group, F.col("rank").alias("rl")), group)
                 .where(F.col("rl") < F.col("rm")))
    scored = (all_pairs.join(pair, [group, "rm", "rl"], "left")
              .join(single.select(group, F.col("rank").alias("rl"), "dl"), [group, "rl"], "left"))
    D = n_docs.scalar()  # scalar subquery, evaluated once
    val = F.ln((F.coalesce(F.col("dml"), F.lit(0)) / D + F.lit(eps)) / (F.col("dl") / D))
    return scored.groupBy(group).agg(F.avg(val).alias("u_mass"))


def window_occurrences(tokens_long: DataFrame, top: DataFrame, window: int,
                       group: str = "topic") -> DataFrame:
    """Sliding windows of ``window`` tokens: ``(doc_id, start, group, rank)``
    for every window that contains a top word. Tokens are semi-joined to the
    top words first; each occurrence at position p lies in windows
    ``max(0, p-window+1) .. min(p, n_windows-1)`` (a document shorter than
    the window is one window)."""
    n = tokens_long.groupBy("doc_id").agg(F.max("pos").alias("last"))
    hit = (tokens_long.join(top.select(group, "rank", "term"), "term")
           .join(n, "doc_id"))
    nwin = F.greatest(F.col("last") + 1 - F.lit(window) + 1, F.lit(1))
    lo = F.greatest(F.col("pos") - F.lit(window - 1), F.lit(0))
    hi = F.least(F.col("pos"), nwin - 1)
    return (hit.select("doc_id", group, "rank", nwin.alias("nwin"),
                       F.explode(F.sequence(lo, hi)).alias("start")).distinct())


#: Words of a topic that share one long of a window mask.
MASK_BITS = 60


def _kept(top: DataFrame, group: str) -> DataFrame:
    """The (small) word list, computed once: every branch reads it."""
    return top if top.is_cached else top.select(group, "rank", "term").persist(StorageLevel.MEMORY_AND_DISK)


def window_counts(tokens_long: DataFrame, top: DataFrame, window: int,
                  group: str = "topic") -> tuple[DataFrame, DataFrame, Column]:
    """Boolean sliding-window counts without enumerating windows.

    Returns ``(p1, p2, W)``: windows containing each top word
    ``(group, rank, c1)``, windows containing both words of each pair
    ``(group, ra, rb, c2)`` and the total number of windows (a scalar
    subquery). An occurrence at p lies in windows ``[max(0, p-w+1),
    min(p, nwin-1)]``; the windows holding a word are the union of its
    occurrences' intervals, made disjoint in one ``lag`` pass over the sorted
    occurrences (starts and ends both grow with p). Their starts and ends cut a
    document into stretches of windows with the same words: a running sum of
    the words' bits. Lengths are added up per set of words, and words and pairs
    are counted on these sums. So each occurrence gives two rows, whatever the
    number of words.

    Where ``tokens_long`` has a column ``last`` (a document's last position),
    it is read once; else twice."""
    top = _kept(top, group)
    by_rank = Window.partitionBy(group).orderBy("rank")
    coded = top.withColumn("code", (F.dense_rank().over(by_rank) - 1).cast("int"))
    hit = F.broadcast(coded.withColumn("hit", F.lit(True)))
    if "last" in tokens_long.columns:
        kept = (tokens_long.join(hit, "term", "left").where(F.col("hit") | (F.col("pos") == F.col("last")))
                .select("doc_id", "last", group, "code", "pos", "hit").persist(StorageLevel.MEMORY_AND_DISK))
        n, occ = kept.groupBy("doc_id").agg(F.max("last").alias("last")), kept.where("hit").drop("last")
    else:
        n, occ = tokens_long.groupBy("doc_id").agg(F.max("pos").alias("last")), tokens_long.join(hit, "term")
    nwin = F.greatest(F.col("last") + 1 - F.lit(window) + 1, F.lit(1))
    W = n.agg(F.sum(nwin)).scalar()
    occ = occ.join(n, "doc_id").select(
        "doc_id", group, "code", "pos", F.greatest(F.col("pos") - F.lit(window - 1), F.lit(0)).alias("lo"),
        F.least(F.col("pos"), nwin - 1).alias("hi"))

    own = Window.partitionBy("doc_id", group, "code").orderBy("pos")
    lo = F.greatest(F.col("lo"), F.coalesce(F.lag("hi").over(own) + 1, F.col("lo")))
    bounds = occ.withColumn("lo", lo).where(F.col("lo") <= F.col("hi")).select(
        "doc_id", group, "code", F.explode(F.array(
            F.struct(F.col("lo").alias("at"), F.lit(1).cast("long").alias("sign")),
            F.struct((F.col("hi") + 1).alias("at"), F.lit(-1).cast("long").alias("sign")))).alias("b"))
    words = (coded.agg(F.max("code")).first()[0] or 0) // MASK_BITS + 1
    run = Window.partitionBy("doc_id", group).orderBy("at")
    bit = F.expr(f"b.sign * shiftleft(1L, code % {MASK_BITS})")
    masks = [F.sum(F.when(F.expr(f"code div {MASK_BITS} = {j}"), bit).otherwise(F.lit(0).cast("long"))).over(run) for j in range(words)]
    sets = (bounds.select("doc_id", group, "code", "b", F.col("b.at").alias("at"))
            .select(group, F.array(*masks).alias("words"), (F.lead("at").over(run) - F.col("at")).cast("long").alias("len"))
            .where("len > 0").groupBy(group, "words").agg(F.sum("len").alias("len")).persist(StorageLevel.MEMORY_AND_DISK))

    def holds(code: str) -> Column:
        return F.expr(f"shiftright(words[cast({code} div {MASK_BITS} as int)], {code} % {MASK_BITS}) & 1 = 1")
    one = coded.select(F.col(group).alias("_g"), "rank", "code").distinct()
    p1 = (sets.join(F.broadcast(one), F.col(group).eqNullSafe(F.col("_g"))).where(holds("code"))
          .groupBy(group, "rank").agg(F.sum("len").alias("c1")))
    a, b = (one.select("_g", F.col("rank").alias(r), F.col("code").alias(c)) for r, c in (("ra", "ca"), ("rb", "cb")))
    p2 = (sets.join(F.broadcast(a.join(b, "_g").where("ca < cb")), F.col(group) == F.col("_g")).where(holds("ca") & holds("cb"))
          .groupBy(group, "ra", "rb").agg(F.sum("len").alias("c2")))
    return p1, p2, W


def coherence_windowed(tokens_long: DataFrame, top: DataFrame, window: int = 10,
                       measure: str = "c_npmi", eps: float = EPSILON,
                       group: str = "topic") -> DataFrame:
    """c_uci / c_npmi per topic on sliding windows (Roeder et al. 2015):
    P = share of windows containing the word(s); pairs a<b by rank."""
    top = _kept(top, group)
    p1, p2, W = window_counts(tokens_long, top, window, group)
    ranks = top.select(group, "rank")
    pairs = (ranks.select(group, F.col("rank").alias("ra"))
             .join(ranks.select(group, F.col("rank").alias("rb")), group)
             .where(F.col("ra") < F.col("rb")))
    s = (pairs.join(p2, [group, "ra", "rb"], "left")
         .join(p1.select(group, F.col("rank").alias("ra"), F.col("c1").alias("ca")), [group, "ra"], "left")
         .join(p1.select(group, F.col("rank").alias("rb"), F.col("c1").alias("cb")), [group, "rb"], "left"))
    pab = F.coalesce(F.col("c2"), F.lit(0)) / W
    pa = F.coalesce(F.col("ca"), F.lit(0)) / W
    pb = F.coalesce(F.col("cb"), F.lit(0)) / W
    pmi = F.ln((pab + F.lit(eps)) / (pa * pb))
    if measure == "c_uci":
        val = pmi
    elif measure == "c_npmi":
        val = pmi / (-F.ln(pab + F.lit(eps)))
    else:
        raise ValueError("measure must be c_uci or c_npmi")
    return s.groupBy(group).agg(F.avg(val).alias(measure))


def coherence_cv(tokens_long: DataFrame, top: DataFrame, window: int = 110,
                 eps: float = EPSILON, group: str = "topic") -> DataFrame:
    """c_v per topic: NPMI context vectors over boolean sliding windows; each
    word's vector v_i = [NPMI(w_i, w_j)]_j (diagonal included) is compared by
    cosine with the topic's set vector sum_k v_k; mean over words."""
    top = _kept(top, group)
    p1, p2, W = window_counts(tokens_long, top, window, group)
    ranks = top.select(group, "rank")
    allp = (ranks.select(group, F.col("rank").alias("i"))
            .join(ranks.select(group, F.col("rank").alias("j")), group))
    m = (allp.withColumn("ra", F.least("i", "j")).withColumn("rb", F.greatest("i", "j"))
         .join(p2, [group, "ra", "rb"], "left")
         .join(p1.select(group, F.col("rank").alias("i"), F.col("c1").alias("ci")), [group, "i"], "left")
         .join(p1.select(group, F.col("rank").alias("j"), F.col("c1").alias("cj")), [group, "j"], "left"))
    pab = F.when(F.col("i") == F.col("j"), F.col("ci")).otherwise(F.coalesce(F.col("c2"), F.lit(0))) / W
    pa, pb = F.col("ci") / W, F.col("cj") / W
    v = m.select(group, "i", "j", (F.ln((pab + F.lit(eps)) / (pa * pb)) / (-F.ln(pab + F.lit(eps)))).alias("npmi"))
    sv = v.groupBy(group, "j").agg(F.sum("npmi").alias("sj"))
    c = (v.join(sv, [group, "j"]).groupBy(group, "i")
         .agg((F.sum(F.col("npmi") * F.col("sj"))
               / (F.sqrt(F.sum(F.col("npmi") * F.col("npmi"))) * F.sqrt(F.sum(F.col("sj") * F.col("sj")))))
              .alias("cs")))
    return c.groupBy(group).agg(F.avg("cs").alias("c_v"))


# ---- T13 ---------------------------------------------------------------------------
def topic_term_table(model, vocab: DataFrame) -> DataFrame:
    """phi(t, w) as a long table ``(topic, term, phi)`` (k x V rows)."""
    d = model.describeTopics(model.vocabSize())
    long = d.select("topic", F.explode(F.arrays_zip("termIndices", "termWeights")).alias("z"))
    return (long.select("topic", F.col("z.termIndices").alias("term_id"),
                        F.col("z.termWeights").alias("phi")).join(vocab, "term_id"))


def term_relevance(phi: DataFrame, term_prob: DataFrame, lam: float = 0.6, n: int = 5) -> DataFrame:
    """relevance = lam*ln(phi) + (1-lam)*ln(phi/p(w)); top n per topic."""
    r = (phi.join(term_prob, "term")
         .withColumn("relevance", F.lit(lam) * F.ln("phi")
                     + F.lit(1 - lam) * F.ln(F.col("phi") / F.col("p"))))
    w = Window.partitionBy("topic").orderBy(F.desc("relevance"), F.asc("term"))
    return r.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n) \
        .select("topic", "rank", "term", "relevance")


def topic_prevalence(mix: DataFrame, doc_len: DataFrame, key: str = "doc_id") -> DataFrame:
    """prevalence(t) = sum_d theta(d,t)*len(d) / sum_d len(d)."""
    total = doc_len.agg(F.sum("len").alias("L")).scalar()
    return (mix.join(doc_len, key).groupBy("topic")
            .agg(F.sum(F.col("w") * F.col("len")).alias("tw"))
            .select("topic", (F.col("tw") / total).alias("prevalence")))


# ---- S11 ---------------------------------------------------------------------------
def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> LocalLDAModel:
    return LocalLDAModel.load(path)
