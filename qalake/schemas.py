"""Explicit schemas. Nothing in the library relies on schema inference."""

from pyspark.sql import types as T

# ---- driver tables (/root/testdata/sf*/<name>.parquet) ----------------------
DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])
BENCHMARK = T.StructType([
    T.StructField("item_id", T.LongType()),
    T.StructField("text", T.StringType()),
])
LABELS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("quality", T.IntegerType()),
    T.StructField("toxic", T.IntegerType()),
])
PAGES = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])
CONVERSATIONS = T.StructType([
    T.StructField("conv_id", T.LongType()),
    T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()),
])
EMBEDDINGS = T.StructType([
    T.StructField("vec_id", T.LongType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("label", T.IntegerType()),
])
EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])

DRIVER_TABLES = {
    "documents": DOCUMENTS,
    "benchmark": BENCHMARK,
    "labels": LABELS,
    "pages": PAGES,
    "conversations": CONVERSATIONS,
    "embeddings": EMBEDDINGS,
    "events": EVENTS,
}

# ---- reference data model (question batches, documents, judged CSVs) --------
SNIPPET = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("document", T.StringType()),
    T.StructField("offsetInBeginSection", T.LongType()),
    T.StructField("offsetInEndSection", T.LongType()),
])

# exact_answer is ragged in the raw files (a string or a list per element), so
# it is read as a JSON string and normalised by functions.lists.normalise_answers.
QUESTION = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("documents", T.ArrayType(T.StringType())),
    T.StructField("snippets", T.ArrayType(SNIPPET)),
    T.StructField("exact_answer", T.StringType()),
    T.StructField("ideal_answer", T.ArrayType(T.StringType())),
])
QUESTION_FILE = T.StructType([T.StructField("questions", T.ArrayType(QUESTION))])

ARTICLE = T.StructType([
    T.StructField("pmid", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("abstractText", T.StringType()),
    T.StructField("journal", T.StringType()),
    T.StructField("meshMajor", T.ArrayType(T.StringType())),
    T.StructField("year", T.StringType()),
])

FACTOID_JUDGED = T.StructType([
    T.StructField("body", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("exact_answer", T.StringType()),
    T.StructField("predicted_answers", T.StringType()),
    T.StructField("predicted_answer_pos", T.StringType()),
])
LIST_JUDGED = T.StructType([
    T.StructField("body", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("exact_answer", T.StringType()),
    T.StructField("predicted_answers", T.StringType()),
    T.StructField("TP", T.StringType()),
    T.StructField("FP", T.StringType()),
    T.StructField("FN", T.StringType()),
])

TRIAL = T.StructType([
    T.StructField("study", T.StringType()),
    T.StructField("trial_id", T.LongType()),
    T.StructField("params", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("score", T.DoubleType()),
    T.StructField("state", T.StringType()),
    T.StructField("started", T.TimestampType()),
    T.StructField("finished", T.TimestampType()),
])

OFFSET = T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())])
