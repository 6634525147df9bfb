"""Registered queries of the subpackage: name -> f(spark, sf_dir), and their
DuckDB twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qalake.llm import (ann, decontam, dialogue, jaccard, langid, licenses, packing, pages, phrases, secrets, substring,
                        tokencounts, urls)
from qalake.sources.tables import read_table

#: Rules of the page query: (verdict, host and path).
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
             ("block", "net/es/"), ("block", "net/fr/")]


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents")


def op1_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(_documents(spark, sf))


def op2_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontam.contamination(_documents(spark, sf), read_table(spark, sf, "benchmark"))


def op3_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.join(_documents(spark, sf))


def op4_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf)).drop("spans")


def op5_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.scan(_documents(spark, sf))


def op6_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return urls.judge(read_table(spark, sf, "pages"), URL_RULES)


def op7_language_id(spark: SparkSession, sf: str) -> DataFrame:
    """Learns from the documents whose fold is not 2 and judges all of them."""
    docs = _documents(spark, sf)
    model = langid.fit(docs.where(langid.fold(F.col("doc_id")) != 2))
    held = F.coalesce(langid.fold(F.col("doc_id")) == 2, F.lit(False))
    return langid.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op8_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return tokencounts.section_tokens(_documents(spark, sf))


def op9_nearest_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substring.dedup(_documents(spark, sf))


def op11_phrase_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.mine(_documents(spark, sf))


def op12_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return pages.main_text(read_table(spark, sf, "pages"))


def op13_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    return dialogue.repair(dialogue.damage(read_table(spark, sf, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_decontamination, op3_ngram_jaccard, op4_license_scan, op5_secret_scan,
                                    op6_url_filter, op7_language_id, op8_token_counts, op9_nearest_vectors,
                                    op10_substring_dedup, op11_phrase_collocations, op12_html_extraction, op13_conversation_repair)}


_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_FOLD = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP2 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_FOLD.format('text')}, '{_ALNUM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_FOLD.format('text')}, '{_ALNUM}') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(10, len(w)) AS n, array_to_string(w[i + 1:i + least(10, len(w))], ' ') AS s
       FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, i, n, array_to_string(w[i + 1:i + n], ' ') AS s
       FROM (SELECT r, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d JOIN (SELECT DISTINCT n FROM bw) ON len(w) >= n)),
h AS (SELECT r, i, dw.n AS n, item FROM dw JOIN bw ON dw.s = bw.s AND dw.n = bw.n),
hit AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS pos FROM h) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS l FROM h GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""

_OP6 = """
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
v AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, CASE WHEN ('.' || host) LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
                     WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
                     WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
                     WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
                     WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/') THEN 'com/' END AS rule FROM v),
x AS (SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS ruled FROM r),
h AS (SELECT host, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS domain, list_extract(string_split(host, '.'), -1) AS suffix,
             CAST(count(ruled) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE ruled = 'block') AS DOUBLE) AS k FROM x GROUP BY ALL),
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY ALL),
g AS (SELECT (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2) AS m0 FROM s),
l AS (SELECT 's' AS level, n, k FROM s WHERE n > 0 UNION ALL SELECT 'd', n, k FROM d WHERE n > 0 UNION ALL SELECT 'h', n, k FROM h WHERE n > 0),
t AS (SELECT level, count(*) AS g, sum(n) AS nn, sum(k) / sum(n) AS m, sum(n * n) AS n2, sum(k * k / n) AS k2n FROM l GROUP BY level),
c AS (SELECT level, 1 / least(greatest(coalesce(CASE WHEN m > 0 AND m < 1 AND nn - n2 / nn - (g - 1) <> 0
             THEN ((k2n - nn * m * m) / (m * (1 - m)) - (g - 1)) / (nn - n2 / nn - (g - 1)) END, 0.5), 0.01), 0.99) - 1 AS c FROM t),
k AS (SELECT coalesce(max(c) FILTER (WHERE level = 's'), 1) AS cs, coalesce(max(c) FILTER (WHERE level = 'd'), 1) AS cd,
             coalesce(max(c) FILTER (WHERE level = 'h'), 1) AS ch FROM c),
ps AS (SELECT suffix, (s.k + cs * m0) / (n + cs) AS ms FROM s, g, k),
pd AS (SELECT domain, (d.k + cd * ms) / (n + cd) AS md FROM d JOIN ps USING (suffix), k),
ph AS (SELECT host, (h.k + ch * md) / (n + ch) AS share, n + ch + 1 AS w FROM h JOIN pd USING (domain), k)
SELECT page_id, x.host, path, rule,
       coalesce(ruled, CASE WHEN share - 1.64 * sqrt(share * (1 - share) / w) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM x LEFT JOIN ph USING (host)
"""

_OP10 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, doc_id, i, md5(array_to_string(w[i + 1:i + 50], ' ')) AS s
      FROM (SELECT r, doc_id, w, unnest(range(0, len(w) - 49)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT s, min(doc_id) AS least FROM g GROUP BY s HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS pos FROM g JOIN f USING (s) WHERE doc_id > least),
lost AS (SELECT r, list(pos) AS pos, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE
           list_transform(list_filter(list_zip(w, range(0, len(w))), lambda x: NOT list_contains(pos, x[2])), lambda x: x[1]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN lost USING (r)
"""


_OP11 = rf"""
WITH w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w
           FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_FOLD.format('text')}, '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
f AS (SELECT lang, k, array_to_string(w[i + 1:i + k], ' ') AS phrase, count(*) AS n
      FROM (SELECT lang, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM w, (VALUES (1), (2), (3), (4)) AS v(k) WHERE len(w) >= k)
      GROUP BY ALL HAVING count(*) >= 30),
t AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS s FROM f WHERE k > 1),
cuts AS (SELECT lang, k, phrase, a, x, array_to_string(s[1:x], ' ') AS head, array_to_string(s[x + 1:k], ' ') AS tail
         FROM (SELECT *, unnest(range(1, k)) AS x FROM c)),
scored AS (SELECT cuts.lang, cuts.phrase, a, h.n AS l, t.n AS r, x, (2000000::HUGEINT * a) // (h.n::HUGEINT + t.n) AS score
           FROM cuts JOIN f h ON h.lang = cuts.lang AND h.phrase = head JOIN f t ON t.lang = cuts.lang AND t.phrase = tail),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, x) AS o FROM scored) WHERE o = 1),
inside AS (SELECT lang, array_to_string(s[i + 1:i + m], ' ') AS phrase, max(a) AS around
           FROM (SELECT lang, s, a, m, unnest(range(0, k - m + 1)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c)) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN inside USING (lang, phrase) WHERE around IS NULL OR 100::HUGEINT * around < 80::HUGEINT * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, CAST(t.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked JOIN t USING (lang) WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": _OP2, "op6_url_filter": _OP6, "op10_substring_dedup": _OP10, "op11_phrase_collocations": _OP11}
