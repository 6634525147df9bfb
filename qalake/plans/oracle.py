"""DuckDB oracle SQL for the registered queries (same names, same columns)."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

# Ranked neighbours of every embedding: cosine on doubles (12 places, so equal
# vectors tie), ties to the lower id, self excluded; rounded to 6 places after ranking.
_RANKED = """
v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT a.vec_id AS q_id, b.vec_id AS doc_id,
             round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 12) AS raw
      FROM v a JOIN v b ON a.vec_id <> b.vec_id),
ranked AS (SELECT q_id, CAST(row_number() OVER (PARTITION BY q_id ORDER BY raw DESC, doc_id) AS INTEGER) AS rank, doc_id, round(raw, 6) AS sim
           FROM s QUALIFY rank <= {k})
"""

_JUDGED = _RANKED + """,
lc AS (SELECT label, count(*) AS label_n FROM embeddings GROUP BY label),
judged AS (SELECT r.*, q.label AS batch, d.label = q.label AS hit, lc.label_n - 1 AS n_rel
           FROM ranked r JOIN v q ON q.vec_id = r.q_id JOIN v d ON d.vec_id = r.doc_id
           JOIN lc ON lc.label = q.label),
cum AS (SELECT *, sum(CAST(hit AS BIGINT)) OVER (PARTITION BY q_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_hits FROM judged),
pq0 AS (SELECT q_id, batch, count(DISTINCT doc_id) AS n_ret,
               count(DISTINCT CASE WHEN hit THEN doc_id END) AS hits, max(n_rel) AS n_rel,
               sum(CASE WHEN hit THEN cum_hits / rank ELSE 0.0 END) AS ap_sum
        FROM cum GROUP BY q_id, batch),
pq1 AS (SELECT *, coalesce(CAST(hits AS DOUBLE) / nullif(n_ret, 0), 0) AS precision,
               coalesce(CAST(hits AS DOUBLE) / nullif(n_rel, 0), 0) AS recall FROM pq0),
pq AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1,
              recall * precision + (1 - recall) * coalesce(CAST(n_rel AS DOUBLE) / nullif(n_rel + n_ret - hits, 0), 0) AS ap,
              coalesce(ap_sum / nullif(least(n_ret, 10), 0), 0) + 0.0001 AS rank_ap
       FROM pq1)
"""


def _summary(ap: str) -> str:
    return f"""count(*) AS n_questions,
       round(avg(precision), 6) AS mean_precision, round(avg(recall), 6) AS mean_recall,
       round(avg(f1), 6) AS mean_f1, round(avg({ap}), 6) AS MAP,
       round(CASE WHEN min({ap}) <= 0 THEN 0.0 ELSE exp(avg(ln({ap}))) END, 6) AS GMAP"""


ORACLE["retrieve_topk_cosine"] = "WITH " + _RANKED.format(k=10) + "SELECT * FROM ranked"

ORACLE["retrieve_eval_by_batch"] = ("WITH " + _JUDGED.format(k=10)
                                    + f"SELECT batch, {_summary('ap')} FROM pq GROUP BY batch")

ORACLE["retrieve_eval_rank_ap"] = ("WITH " + _JUDGED.format(k=10)
                                   + f"SELECT batch, {_summary('rank_ap')} FROM pq GROUP BY batch")

ORACLE["retrieve_eval_min_relevant"] = ("WITH " + _JUDGED.format(k=10) + """,
pm AS (SELECT *, coalesce(ap_sum / nullif(least(n_rel, 10), 0), 0) AS ap_m FROM pq)
SELECT batch, count(*) AS n_questions, round(avg(precision), 6) AS mean_precision,
       round(avg(recall), 6) AS mean_recall, round(avg(f1), 6) AS mean_f1, round(avg(ap_m), 6) AS MAP,
       round(exp(avg(ln(ap_m + 0.01))), 6) AS GMAP
FROM pm GROUP BY batch""")

ORACLE["eval_rollup"] = ("WITH " + _JUDGED.format(k=10)
                         + f"SELECT batch, {_summary('ap')} FROM pq GROUP BY ROLLUP (batch)")


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_GOLD = "gold AS (SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text))"

ORACLE["gold_pairs_contains"] = "WITH " + _GOLD + " SELECT doc_id, item_id FROM gold"
ORACLE["pmid_from_url_last"] = "SELECT page_id, string_split(url, '/')[-1] AS pmid FROM pages"
ORACLE["pmid_from_url_regex"] = ("SELECT page_id, nullif(regexp_extract(url, '/([0-9]+)', 1), '') AS pmid "
                                 "FROM pages")
ORACLE["corpus_semi"] = ("WITH " + _GOLD + " SELECT doc_id, lang, source, n_chars FROM documents "
                         "WHERE doc_id IN (SELECT doc_id FROM gold)")
ORACLE["ingest_anti"] = ("SELECT doc_id, lang FROM documents d "
                         "WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
ORACLE["found_filter"] = ("WITH " + _GOLD + " SELECT item_id, doc_id FROM gold "
                          "WHERE doc_id IN (SELECT doc_id FROM labels)")
ORACLE["docs_per_query"] = ("WITH " + _GOLD + """, per AS (SELECT item_id, count(*) AS n FROM gold GROUP BY item_id)
SELECT count(*) AS n_questions, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_links,
       round(CAST(coalesce(sum(n), 0) AS DOUBLE) / count(*), 6) AS docs_per_query
FROM benchmark b LEFT JOIN per USING (item_id)""")
ORACLE["distinct_docs"] = ("WITH " + _GOLD
                           + " SELECT count(*) AS n_links, count(DISTINCT doc_id) AS n_distinct_docs FROM gold")
ORACLE["dataset_profile"] = """SELECT conv_id, count(*) AS n_queries,
  count(*) FILTER (WHERE role = 'assistant') AS assistant,
  count(*) FILTER (WHERE role = 'system') AS system,
  count(*) FILTER (WHERE role = 'user') AS "user"
FROM conversations GROUP BY conv_id"""
ORACLE["null_backfill"] = """SELECT d.doc_id, d.lang, l.quality, l.toxic, l.quality IS NULL AS missing
FROM documents d LEFT JOIN labels l USING (doc_id)"""
ORACLE["dup_texts"] = """SELECT doc_id, n_copies FROM (
  SELECT doc_id, count(*) OVER (PARTITION BY text) AS n_copies FROM documents) WHERE n_copies > 1"""
ORACLE["first_per_key"] = """SELECT doc_id, lang FROM documents
QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1"""


def _tokens_cte(source: str = "documents", id_col: str = "doc_id", text: str = "text",
                name: str = "tk") -> str:
    from qalake.functions.text import (DEFAULT_STOPWORDS, DIGITS_RE, MIN_TOKEN_LEN, PUNCT_RE,
                                       TAG_RE, WS_RE)
    stop = "[" + ", ".join(sql_str(w) for w in DEFAULT_STOPWORDS) + "]"
    clean = f"lower({text})"
    clean = f"regexp_replace({clean}, {sql_str(TAG_RE)}, '', 'g')"
    clean = f"regexp_replace({clean}, {sql_str(PUNCT_RE)}, ' ', 'g')"
    clean = f"regexp_replace({clean}, {sql_str(WS_RE)}, ' ', 'g')"
    clean = f"regexp_replace({clean}, {sql_str(DIGITS_RE)}, '', 'g')"
    return (f"{name} AS (SELECT {id_col}, list_filter(regexp_split_to_array({clean}, {sql_str(WS_RE)}), "
            f"lambda x: length(x) >= {MIN_TOKEN_LEN} AND NOT list_contains({stop}, x)) AS toks FROM {source})")


_TK = _tokens_cte()
_TF = "tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM tk) GROUP BY doc_id, term)"

ORACLE["clean_tokens"] = ("WITH " + _TK + " SELECT doc_id, CAST(len(toks) AS INTEGER) AS n_tokens, "
                          "array_to_string(toks, ' ') AS tokens FROM tk")
ORACLE["term_stats"] = ("WITH " + _TK + ", " + _TF
                        + " SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY term")
ORACLE["bow"] = ("WITH " + _TK + ", " + _TF + """,
vocab AS (SELECT DISTINCT term FROM tf WHERE doc_id IN (SELECT doc_id FROM labels))
SELECT doc_id, term, tf FROM tf WHERE term IN (SELECT term FROM vocab)""")


_PREDS = """,
preds AS (SELECT r.q_id, r.rank, 'label ' || CAST(d.label AS VARCHAR) AS answer
          FROM ranked r JOIN embeddings d ON d.vec_id = r.doc_id),
gold AS (SELECT vec_id AS q_id, 'Label ' || CAST(label AS VARCHAR) AS synonym FROM embeddings
         UNION ALL SELECT vec_id, 'class ' || CAST(label AS VARCHAR) FROM embeddings)
"""

_POS = "WITH " + _RANKED.format(k=5) + _PREDS + """,
hit AS (SELECT p.q_id, min(p.rank) AS pos FROM preds p JOIN gold g
        ON g.q_id = p.q_id AND lower(trim(g.synonym)) = lower(trim(p.answer)) GROUP BY p.q_id),
pos AS (SELECT e.vec_id AS q_id, e.label AS batch, CAST(coalesce(h.pos, 0) AS INTEGER) AS pos
        FROM embeddings e LEFT JOIN hit h ON h.q_id = e.vec_id)
"""
ORACLE["answer_position"] = _POS + "SELECT q_id, batch, pos FROM pos"
ORACLE["strict_lenient_mrr"] = _POS + """SELECT batch, count(*) AS n,
  round(avg(CAST(pos = 1 AS DOUBLE)), 6) AS strict, round(avg(CAST(pos > 0 AS DOUBLE)), 6) AS lenient,
  round(sum(CASE WHEN pos > 0 THEN 1.0 / pos ELSE 0.0 END) / count(*), 6) AS mrr
FROM pos GROUP BY batch"""

ORACLE["list_prf"] = "WITH " + _RANKED.format(k=10) + _PREDS + """,
dp AS (SELECT DISTINCT q_id, answer FROM preds),
m AS (SELECT dp.q_id, max(CASE WHEN g.q_id IS NOT NULL THEN 1 ELSE 0 END) AS hit
      FROM dp LEFT JOIN gold g ON g.q_id = dp.q_id AND lower(trim(g.synonym)) = lower(trim(dp.answer))
      GROUP BY dp.q_id, dp.answer),
c AS (SELECT q_id, max(hit) AS tp, sum(1 - hit) AS fp, 1 - max(hit) AS fn FROM m GROUP BY q_id),
pr AS (SELECT q_id, CAST(tp AS DOUBLE) / nullif(tp + fp, 0) AS p, CAST(tp AS DOUBLE) / nullif(tp + fn, 0) AS r FROM c),
prf AS (SELECT q_id, p, r, 2 * p * r / nullif(p + r, 0) AS f FROM pr)
SELECT e.label AS batch, count(*) AS n, round(avg(p), 6) AS mean_precision, round(avg(r), 6) AS mean_recall,
       round(avg(f), 6) AS mean_f_measure
FROM prf JOIN embeddings e ON e.vec_id = prf.q_id GROUP BY e.label"""

ORACLE["answers_dedup"] = "WITH " + _RANKED.format(k=10) + _PREDS + """,
f AS (SELECT q_id, answer, min(rank) AS fr FROM preds GROUP BY q_id, answer)
SELECT q_id, CAST(row_number() OVER (PARTITION BY q_id ORDER BY fr) AS INTEGER) AS rank, answer FROM f"""


def _squad_tokens(col: str) -> str:
    from qalake.operators.metrics import ASCII_PUNCT_CLASS, WS_CLASS
    return (f"list_filter(regexp_split_to_array(regexp_replace(lower({col}), {sql_str(ASCII_PUNCT_CLASS)}, '', 'g'), "
            f"{sql_str(WS_CLASS + '+')}), lambda x: x <> '' AND x NOT IN ('a', 'an', 'the'))")


ORACLE["squad_em_f1"] = f"""WITH pairs AS (
  SELECT a.conv_id, a.turn, g.turn AS gold_id, a.text AS prediction, g.text AS gold
  FROM conversations a JOIN conversations g
    ON g.conv_id = a.conv_id AND g.role = 'user' AND (g.turn = a.turn - 1 OR g.turn = a.turn + 1)
  WHERE a.role = 'assistant'),
tok AS (SELECT conv_id, turn, gold_id, {_squad_tokens('prediction')} AS pt, {_squad_tokens('gold')} AS gt FROM pairs),
lens AS (SELECT conv_id, turn, gold_id, len(pt) AS np, len(gt) AS ng,
                array_to_string(pt, ' ') = array_to_string(gt, ' ') AS em FROM tok),
pc AS (SELECT conv_id, turn, gold_id, t, count(*) AS cp FROM (SELECT conv_id, turn, gold_id, unnest(pt) AS t FROM tok) GROUP BY ALL),
gc AS (SELECT conv_id, turn, gold_id, t, count(*) AS cg FROM (SELECT conv_id, turn, gold_id, unnest(gt) AS t FROM tok) GROUP BY ALL),
cm AS (SELECT conv_id, turn, gold_id, sum(least(cp, cg)) AS common FROM pc JOIN gc USING (conv_id, turn, gold_id, t) GROUP BY ALL),
sc AS (SELECT l.*, coalesce(cm.common, 0) AS common FROM lens l LEFT JOIN cm USING (conv_id, turn, gold_id)),
f AS (SELECT conv_id, turn, CAST(em AS DOUBLE) AS em,
        CASE WHEN np = 0 OR ng = 0 THEN CAST(np = ng AS DOUBLE) WHEN common = 0 THEN 0.0
             ELSE 2 * (CAST(common AS DOUBLE) / np) * (CAST(common AS DOUBLE) / ng)
                  / ((CAST(common AS DOUBLE) / np) + (CAST(common AS DOUBLE) / ng)) END AS f1 FROM sc),
pt AS (SELECT conv_id, turn, max(em) AS em, max(f1) AS f1 FROM f GROUP BY conv_id, turn)
SELECT conv_id, count(*) AS n, round(avg(em) * 100, 6) AS exact_match, round(avg(f1) * 100, 6) AS f1
FROM pt GROUP BY conv_id"""

ORACLE["dup_question_report"] = """SELECT source AS batch, md5(text) AS body_md5, count(*) AS n
FROM documents GROUP BY source, md5(text) HAVING count(*) > 1"""


def _ws_count(col: str) -> str:
    from qalake.functions.text import WS_RE
    return f"len(list_filter(regexp_split_to_array({col}, {sql_str(WS_RE)}), lambda x: x <> ''))"


def _squad_ctes() -> str:
    from qalake.plans.standins import SENTENCE_SPLIT
    sp = sql_str(SENTENCE_SPLIT)
    return _GOLD + f""",
pairs AS (SELECT g.doc_id, g.item_id, d.text AS context, d.source AS title, b.text AS question
          FROM gold g JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id)),
ans AS (SELECT item_id, unnest(regexp_split_to_array(text, {sp})) AS answer,
               unnest(generate_series(0, len(regexp_split_to_array(text, {sp})) - 1)) AS answer_idx FROM benchmark),
j AS (SELECT p.*, a.answer_idx, a.answer, instr(lower(p.context), lower(a.answer)) - 1 AS answer_start
      FROM pairs p JOIN ans a USING (item_id) WHERE a.answer IS NOT NULL AND a.answer <> ''),
rows AS (SELECT * FROM j WHERE answer_start >= 0)"""


ORACLE["squad_rows"] = "WITH " + _squad_ctes() + """
SELECT CAST(doc_id AS VARCHAR) || '_' || CAST(item_id AS VARCHAR) AS id, doc_id, item_id, title, question, context,
       CAST(answer_idx AS INTEGER) AS answer_idx, substr(context, answer_start + 1, length(answer)) AS answer_text,
       CAST(answer_start AS INTEGER) AS answer_start FROM rows"""


def _windows_sql(src: str, key: str, extra: str = "") -> str:
    return f"""b AS (SELECT {key}, {_ws_count('question')} AS nq, {_ws_count('context')} AS n_tokens{extra} FROM {src}),
b2 AS (SELECT *, greatest(384 - nq - 3, 129) AS budget FROM b),
w0 AS (SELECT *, unnest(generate_series(0, greatest(n_tokens - 128, 1) - 1, budget - 128)) AS start_tok FROM b2),
w AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY start_tok) - 1 AS window_idx,
             least(start_tok + budget, n_tokens) AS end_tok FROM w0)"""


ORACLE["token_windows"] = """WITH qa AS (
  SELECT u.conv_id, u.turn, u.text AS question, a.text AS context FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user'),
""" + _windows_sql("qa", "conv_id, turn") + """
SELECT conv_id, turn, CAST(nq AS INTEGER) AS nq, CAST(n_tokens AS INTEGER) AS n_tokens, CAST(budget AS INTEGER) AS budget,
       CAST(window_idx AS INTEGER) AS window_idx, CAST(start_tok AS INTEGER) AS start_tok, CAST(end_tok AS INTEGER) AS end_tok
FROM w"""


def _window_labels_sql() -> str:
    from qalake.functions.text import WS_CLASS, WS_RE
    ws, sep = sql_str(WS_RE), sql_str("(" + WS_CLASS + "+)")
    return "WITH " + _squad_ctes() + ",\n" + _windows_sql(
        "rows", "doc_id, item_id, answer_idx",
        ", answer_start AS c, answer_start + length(answer) AS ce") + f""",
ctx AS (SELECT DISTINCT doc_id, context FROM rows),
pz AS (SELECT doc_id, unnest(regexp_split_to_array(context, {ws})) AS p, unnest(regexp_extract_all(context, {sep}, 1)) AS sp,
              unnest(generate_series(0, len(regexp_split_to_array(context, {ws})) - 1)) AS i FROM ctx),
pz2 AS (SELECT doc_id, i, length(p) AS lp,
               coalesce(sum(length(p) + coalesce(length(sp), 0)) OVER (PARTITION BY doc_id ORDER BY i
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM pz),
offs AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS tok_idx, s, s + lp AS e
         FROM pz2 WHERE lp > 0),
around AS (SELECT b.doc_id, b.item_id, b.answer_idx, max(CASE WHEN o.s <= b.c THEN o.tok_idx END) AS t_c,
                  min(CASE WHEN o.e >= b.ce THEN o.tok_idx END) AS t_e
           FROM b JOIN offs o USING (doc_id) GROUP BY ALL),
lab AS (SELECT w.*, a.t_c, a.t_e, f.s AS ws_s, l.e AS we_e FROM w JOIN around a USING (doc_id, item_id, answer_idx)
        LEFT JOIN offs f ON f.doc_id = w.doc_id AND f.tok_idx = w.start_tok
        LEFT JOIN offs l ON l.doc_id = w.doc_id AND l.tok_idx + 1 = w.end_tok)
SELECT doc_id, item_id, CAST(answer_idx AS INTEGER) AS answer_idx, CAST(window_idx AS INTEGER) AS window_idx,
       CAST(start_tok AS INTEGER) AS start_tok, CAST(end_tok AS INTEGER) AS end_tok,
       CAST(CASE WHEN ws_s <= c AND we_e >= ce THEN nq + 2 - start_tok + least(t_c, end_tok - 1) ELSE 0 END AS INTEGER) AS start_position,
       CAST(CASE WHEN ws_s <= c AND we_e >= ce THEN nq + 2 - start_tok + greatest(t_e, start_tok) ELSE 0 END AS INTEGER) AS end_position
FROM lab"""


ORACLE["window_labels"] = _window_labels_sql()

_SPANS = """l AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS s, list_reverse(CAST(embedding AS DOUBLE[])) AS e FROM embeddings),
sx AS (SELECT vec_id, unnest(s) AS logit, unnest(generate_series(0, len(s) - 1)) AS idx FROM l),
ex AS (SELECT vec_id, unnest(e) AS logit, unnest(generate_series(0, len(e) - 1)) AS idx FROM l),
sb AS (SELECT * FROM sx WHERE idx >= 1 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, idx) <= 20),
eb AS (SELECT * FROM ex WHERE idx >= 1 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, idx) <= 20),
c AS (SELECT sb.vec_id, sb.idx AS i, eb.idx AS j, sb.logit + eb.logit AS score FROM sb JOIN eb
      ON sb.vec_id = eb.vec_id AND eb.idx >= sb.idx AND eb.idx - sb.idx + 1 <= 30),
best AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, i, j) = 1),
spans AS (SELECT l.vec_id, l.label, l.s[1] + l.e[1] AS null_s, CAST(coalesce(i, -1) AS INTEGER) AS start_idx,
                 CAST(coalesce(j, -1) AS INTEGER) AS end_idx, coalesce(score, 0.0) AS score
          FROM l LEFT JOIN best USING (vec_id))"""

ORACLE["nbest_spans"] = "WITH " + _SPANS + " SELECT vec_id, start_idx, end_idx, round(score, 6) AS score FROM spans"
ORACLE["null_score"] = "WITH " + _SPANS + """ SELECT label AS batch, round(min(null_s), 6) AS null_score,
  round(max(CASE WHEN start_idx >= 0 THEN score END), 6) AS best_score,
  coalesce(max(CASE WHEN start_idx >= 0 THEN score END) > min(null_s), false) AS answerable
FROM spans GROUP BY label"""


_ANSWERS = """n AS (SELECT CAST(ceil(count(*) / 4.0) AS BIGINT) AS m FROM embeddings),
l AS (SELECT vec_id % m AS q, vec_id // m AS w, CAST(embedding AS DOUBLE[]) AS s, list_reverse(CAST(embedding AS DOUBLE[])) AS e,
             length(text) AS size, text FROM embeddings, n, documents WHERE doc_id = vec_id % m),
sx AS (SELECT q, w, size, unnest(s) AS logit, unnest(generate_series(0, len(s) - 1)) AS idx FROM l),
ex AS (SELECT q, w, size, unnest(e) AS logit, unnest(generate_series(0, len(e) - 1)) AS idx FROM l),
sb AS (SELECT * FROM sx QUALIFY row_number() OVER (PARTITION BY q, w ORDER BY logit DESC, idx) <= 20),
eb AS (SELECT * FROM ex QUALIFY row_number() OVER (PARTITION BY q, w ORDER BY logit DESC, idx) <= 20),
c AS (SELECT sb.q, sb.w, sb.idx AS i, eb.idx AS j, sb.logit + eb.logit AS score,
             CAST((40 * sb.w + sb.idx) * 9 AS INTEGER) AS start_char, CAST((40 * sb.w + eb.idx) * 9 + 5 AS INTEGER) AS end_char
      FROM sb JOIN eb ON sb.q = eb.q AND sb.w = eb.w AND eb.idx >= sb.idx AND eb.idx - sb.idx < 30
      WHERE sb.idx > 0 AND (40 * sb.w + eb.idx) * 9 + 5 <= sb.size)"""

ORACLE["answer_text"] = "WITH " + _ANSWERS + """,
best AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, w, i, j) = 1),
nulls AS (SELECT q, min(s[1] + e[1]) AS null_score FROM l GROUP BY q)
SELECT doc_id AS question_id, CASE WHEN i IS NULL THEN '' ELSE substr(text, start_char + 1, end_char - start_char) END AS text,
       start_char, end_char, round(coalesce(score, 0.0), 6) AS score, round(null_score, 6) AS null_score,
       coalesce(score > null_score, false) AS answerable
FROM documents LEFT JOIN best ON best.q = doc_id LEFT JOIN nulls ON nulls.q = doc_id"""
ORACLE["answer_nbest"] = "WITH " + _ANSWERS + """,
spans AS (SELECT q, start_char, end_char, max(score) AS score FROM c GROUP BY ALL),
top AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, start_char, end_char) AS INTEGER) AS rank FROM spans)
SELECT q AS question_id, rank, substr(text, start_char + 1, end_char - start_char) AS text, start_char, end_char, round(score, 6) AS score
FROM top JOIN documents ON doc_id = q WHERE rank <= 5"""


_LB = """lb AS (SELECT event_type AS system, strftime(ts, '%Y-%m-%d') AS batch, round(sum(value), 2) / count(*) AS mean_value,
                count(*) AS n_events, count(DISTINCT user_id) AS n_users FROM events GROUP BY ALL)"""

ORACLE["metrics_long"] = "WITH " + _LB + """
SELECT system, batch, 'mean_value' AS metric, mean_value AS value FROM lb
UNION ALL SELECT system, batch, 'n_events', CAST(n_events AS DOUBLE) FROM lb
UNION ALL SELECT system, batch, 'n_users', CAST(n_users AS DOUBLE) FROM lb"""
ORACLE["system_means"] = "WITH " + _LB + """
SELECT system, round(avg(mean_value), 6) AS mean_value, round(avg(n_events), 6) AS n_events,
       round(avg(n_users), 6) AS n_users FROM lb GROUP BY system"""
ORACLE["top_per_batch"] = "WITH " + _LB + """
SELECT batch, CAST(row_number() OVER (PARTITION BY batch ORDER BY mean_value DESC, system) AS INTEGER) AS rank,
       system, mean_value FROM lb QUALIFY rank <= 3"""
ORACLE["top3_trend"] = "WITH " + _LB + """,
top AS (SELECT system FROM lb GROUP BY system ORDER BY avg(mean_value) DESC, system LIMIT 3)
SELECT batch, system, round(avg(mean_value), 6) AS mean_value FROM lb WHERE system IN (SELECT system FROM top)
GROUP BY batch, system"""
ORACLE["top5_logs"] = "WITH " + _LB + """
SELECT system, batch, mean_value FROM lb ORDER BY mean_value DESC, system, batch LIMIT 5"""
ORACLE["other_systems"] = "WITH " + _LB + """
SELECT system, batch, n_events FROM lb WHERE system IS DISTINCT FROM 'view'"""
ORACLE["best_trial"] = """SELECT study, trial_id, score, k FROM (
  SELECT event_type AS study, event_id AS trial_id, value AS score,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
QUALIFY row_number() OVER (PARTITION BY study ORDER BY score DESC, trial_id) = 1"""
ORACLE["pending_trials"] = """SELECT DISTINCT user_id AS study, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
FROM events e WHERE event_type = 'view' AND NOT EXISTS (
  SELECT 1 FROM events d WHERE d.event_type = 'purchase' AND d.user_id = e.user_id
    AND CAST(json_extract_string(d.props, '$.k') AS INTEGER) = CAST(json_extract_string(e.props, '$.k') AS INTEGER))"""


ORACLE["trial_passes"] = """WITH l AS (
  SELECT CAST(user_id AS VARCHAR) AS study, event_id AS trial_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
         CAST(((CAST(floor(value) AS BIGINT) % 5) + 5) % 5 AS INTEGER) AS pass, value AS score, event_type <> 'error' AS ok
  FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL AND value IS NOT NULL)
SELECT study, k, pass, arg_max(score, trial_id) FILTER (WHERE ok) AS score, max(trial_id) FILTER (WHERE ok) AS trial_id,
       count(*) FILTER (WHERE NOT ok) AS failed
FROM l GROUP BY study, k, pass"""


def _html_sql() -> str:
    from qalake.sources.html import ENTITIES, H1_RE, LANG_RE, NOISE_RE, PARA_RE, TAG_RE, TITLE_RE

    def text_of(x: str) -> str:
        x = f"regexp_replace({x}, {sql_str(TAG_RE)}, '', 'g')"
        for k, v in ENTITIES:
            x = f"replace({x}, {sql_str(k)}, {sql_str(v)})"
        return f"trim({x})"
    return f"""WITH c AS (SELECT page_id, url, html, regexp_replace(html, {sql_str(NOISE_RE)}, '', 'g') AS clean FROM pages),
p AS (SELECT *, list_filter(list_transform(regexp_extract_all(clean, {sql_str(PARA_RE)}, 1), lambda x: {text_of('x')}),
                            lambda x: x <> '') AS texts FROM c)
SELECT page_id, {text_of(f"regexp_extract(clean, {sql_str(TITLE_RE)}, 1)")} AS title,
       {text_of(f"regexp_extract(clean, {sql_str(H1_RE)}, 1)")} AS h1,
       regexp_extract(html, {sql_str(LANG_RE)}, 1) AS page_lang,
       CAST(len(texts) AS INTEGER) AS n_paragraphs, array_to_string(texts, chr(10)) AS body_text FROM p"""


ORACLE["html_fields"] = _html_sql()
def _decoded(x: str) -> str:
    return (f"replace(replace(replace(replace(replace({x}, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), "
            "'&amp;', '&')")


def _between(x: str, a: str, z: str) -> str:
    return f"split_part(split_part({x}, '{a}', 2), '{z}', 1)"


_LINKS = "string_split(nav, '<a href=\"')[2:]"
ORACLE["page_elements"] = f"""WITH p AS (SELECT page_id, html, {_between('html', '<head>', '</head>')} AS head,
  {_between('html', '<nav>', '</nav>')} AS nav, {_between('html', '<article>', '</article>')} AS art FROM pages),
t AS (SELECT *, CASE WHEN contains(head, '<title>') THEN trim({_decoded(_between('head', '<title>', '</title>'))}) END AS title,
  list_transform({_LINKS}, lambda x: split_part(x, '"', 1)) AS hrefs,
  list_transform({_LINKS}, lambda x: split_part(split_part(x, '>', 2), '<', 1)) AS names FROM p)
SELECT page_id, {_between('html', '<html lang="', '"')} AS page_lang, title, left(title, 4) AS start,
  CASE WHEN contains(art, '<h1>') THEN trim({_decoded(_between('art', '<h1>', '</h1>'))}) END AS heading,
  lower({_decoded("coalesce(array_to_string(names, '|'), '')")}) AS menu,
  {_decoded("coalesce(array_to_string(hrefs, '|'), '')")} AS links FROM t"""
ORACLE["report_pivot"] = """SELECT user_id AS batch,
  max(value) FILTER (WHERE event_type = 'click') AS click, max(value) FILTER (WHERE event_type = 'error') AS error,
  max(value) FILTER (WHERE event_type = 'purchase') AS purchase, max(value) FILTER (WHERE event_type = 'signup') AS signup,
  max(value) FILTER (WHERE event_type = 'view') AS "view"
FROM events GROUP BY user_id"""
ORACLE["union_aligned"] = """SELECT doc_id, lang, NULL::INTEGER AS quality FROM documents
UNION ALL SELECT doc_id, NULL::VARCHAR AS lang, quality FROM labels"""


_MIX = """e AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: abs(x)) AS a FROM embeddings),
m AS (SELECT vec_id, unnest(a) AS x, unnest(generate_series(0, len(a) - 1)) AS topic, list_sum(a) AS tot FROM e),
mix AS (SELECT vec_id, CAST(topic AS INTEGER) AS topic, coalesce(x / nullif(tot, 0), 0) AS w FROM m)"""
ORACLE["topic_sizes"] = "WITH " + _MIX + " SELECT topic, count(*) FILTER (WHERE w >= 0.01) AS n_docs FROM mix GROUP BY topic"
ORACLE["doc_topic_indicator"] = "WITH " + _MIX + " SELECT vec_id, topic FROM mix WHERE w >= 0.01"

_TOP = _TK + """,
dt AS (SELECT DISTINCT * FROM (SELECT tk.doc_id, d.lang, unnest(tk.toks) AS term FROM tk JOIN documents d USING (doc_id))),
dfl AS (SELECT lang, term, count(*) AS df FROM dt GROUP BY lang, term),
top AS (SELECT lang, term, row_number() OVER (PARTITION BY lang ORDER BY df DESC, term) AS rank FROM dfl QUALIFY rank <= 10),
tl AS (SELECT doc_id, unnest(toks) AS term, unnest(generate_series(0, len(toks) - 1)) AS pos FROM tk)"""

ORACLE["coherence_umass"] = "WITH " + _TOP + """,
alldt AS (SELECT DISTINCT doc_id, term FROM tl),
nd AS (SELECT count(DISTINCT doc_id) AS D FROM alldt),
hit AS (SELECT a.doc_id, t.lang, t.rank FROM alldt a JOIN top t USING (term)),
single AS (SELECT lang, rank, count(*) AS dl FROM hit GROUP BY lang, rank),
pair AS (SELECT a.lang, a.rank AS rm, b.rank AS rl, count(*) AS dml FROM hit a JOIN hit b
         ON a.doc_id = b.doc_id AND a.lang = b.lang AND b.rank < a.rank GROUP BY ALL),
allp AS (SELECT a.lang, a.rank AS rm, b.rank AS rl FROM top a JOIN top b ON a.lang = b.lang AND b.rank < a.rank)
SELECT allp.lang, round(avg(ln((coalesce(dml, 0) / nd.D + 1e-12) / (dl / nd.D))), 6) AS u_mass
FROM allp LEFT JOIN pair USING (lang, rm, rl) LEFT JOIN single s ON s.lang = allp.lang AND s.rank = allp.rl
CROSS JOIN nd GROUP BY allp.lang"""

ORACLE["coherence_npmi"] = "WITH " + _TOP + """,
n AS (SELECT doc_id, greatest(max(pos) + 1 - 10 + 1, 1) AS nwin FROM tl GROUP BY doc_id),
tw AS (SELECT sum(nwin) AS W FROM n),
occ AS (SELECT DISTINCT * FROM (SELECT h.doc_id, t.lang, t.rank,
          unnest(generate_series(greatest(h.pos - 9, 0), least(h.pos, n.nwin - 1))) AS start
        FROM tl h JOIN top t USING (term) JOIN n USING (doc_id))),
p1 AS (SELECT lang, rank, count(*) AS c1 FROM occ GROUP BY ALL),
p2 AS (SELECT a.lang, a.rank AS ra, b.rank AS rb, count(*) AS c2 FROM occ a JOIN occ b
       ON a.doc_id = b.doc_id AND a.start = b.start AND a.lang = b.lang AND a.rank < b.rank GROUP BY ALL),
pairs AS (SELECT a.lang, a.rank AS ra, b.rank AS rb FROM top a JOIN top b ON a.lang = b.lang AND a.rank < b.rank),
sc AS (SELECT pairs.lang, coalesce(c2, 0) / tw.W AS pab, coalesce(x.c1, 0) / tw.W AS pa, coalesce(y.c1, 0) / tw.W AS pb
       FROM pairs LEFT JOIN p2 USING (lang, ra, rb)
       LEFT JOIN p1 x ON x.lang = pairs.lang AND x.rank = pairs.ra
       LEFT JOIN p1 y ON y.lang = pairs.lang AND y.rank = pairs.rb CROSS JOIN tw)
SELECT lang, round(avg(ln((pab + 1e-12) / (pa * pb)) / (-ln(pab + 1e-12))), 6) AS c_npmi FROM sc GROUP BY lang"""

ORACLE["coherence_uci"] = ORACLE["coherence_npmi"].replace(" / (-ln(pab + 1e-12))), 6) AS c_npmi", "), 6) AS c_uci")
ORACLE["dataset_documents"] = "WITH " + _GOLD + """,
l AS (SELECT g.item_id, g.doc_id, d.source, d.lang FROM gold g JOIN documents d USING (doc_id)),
q AS (SELECT DISTINCT source, item_id, lang FROM l)
SELECT q.source, count(*) AS n_queries, (SELECT count(DISTINCT doc_id) FROM l WHERE l.source = q.source) AS n_docs,
  count(*) FILTER (WHERE lang = 'de') AS de, count(*) FILTER (WHERE lang = 'en') AS en,
  count(*) FILTER (WHERE lang = 'es') AS es, count(*) FILTER (WHERE lang = 'fr') AS fr FROM q GROUP BY q.source"""
ORACLE["retry_trials"] = """WITH e AS (SELECT user_id % 50 AS study, CAST(json_extract_string(props, '$.k') AS INTEGER) % 10 AS k,
  event_type, value FROM events),
p AS (SELECT DISTINCT study, k FROM e WHERE event_type = 'view'),
gone AS (SELECT study, k FROM e WHERE event_type = 'purchase' AND value > 90
  UNION SELECT study, k FROM e WHERE event_type = 'error' GROUP BY study, k HAVING count(*) >= 3)
SELECT p.study, p.k FROM p WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.study = p.study AND g.k = p.k)"""

ORACLE["prepare_profile"] = "WITH " + _GOLD + """,
ll AS (SELECT item_id AS id, doc_id AS pos, string_split('http://www.ncbi.nlm.nih.gov/pubmed/' || CAST(doc_id AS VARCHAR), '/')[-1] AS pmid FROM gold),
found AS (SELECT * FROM ll WHERE pmid IN (SELECT CAST(doc_id AS VARCHAR) FROM labels))
SELECT (SELECT count(*) FROM benchmark) AS n_questions,
       (SELECT count(DISTINCT pmid) FROM ll) AS n_distinct_docs,
       (SELECT count(DISTINCT pmid) FROM found) AS n_docs_found,
       (SELECT count(DISTINCT id) FROM found) AS n_answerable,
       (SELECT count(*) FROM found) AS n_found_links,
       round((SELECT count(*) FROM found) / nullif((SELECT count(DISTINCT id) FROM found), 0), 6) AS docs_per_query"""

ORACLE["type_counts"] = "SELECT role AS type, count(*) AS n FROM conversations GROUP BY role"

ORACLE["coherence_cv"] = "WITH " + _TOP + """,
n AS (SELECT doc_id, greatest(max(pos) + 1 - 110 + 1, 1) AS nwin FROM tl GROUP BY doc_id),
tw AS (SELECT sum(nwin) AS W FROM n),
occ AS (SELECT DISTINCT * FROM (SELECT h.doc_id, t.lang, t.rank,
          unnest(generate_series(greatest(h.pos - 109, 0), least(h.pos, n.nwin - 1))) AS start
        FROM tl h JOIN top t USING (term) JOIN n USING (doc_id))),
p1 AS (SELECT lang, rank, count(*) AS c1 FROM occ GROUP BY ALL),
p2 AS (SELECT a.lang, a.rank AS ra, b.rank AS rb, count(*) AS c2 FROM occ a JOIN occ b
       ON a.doc_id = b.doc_id AND a.start = b.start AND a.lang = b.lang AND a.rank < b.rank GROUP BY ALL),
allp AS (SELECT a.lang, a.rank AS i, b.rank AS j FROM top a JOIN top b ON a.lang = b.lang),
m AS (SELECT allp.lang, i, j,
             CASE WHEN i = j THEN x.c1 ELSE coalesce(p2.c2, 0) END / tw.W AS pab, x.c1 / tw.W AS pa, y.c1 / tw.W AS pb
      FROM allp LEFT JOIN p2 ON p2.lang = allp.lang AND p2.ra = least(i, j) AND p2.rb = greatest(i, j)
      LEFT JOIN p1 x ON x.lang = allp.lang AND x.rank = i
      LEFT JOIN p1 y ON y.lang = allp.lang AND y.rank = j CROSS JOIN tw),
v AS (SELECT lang, i, j, ln((pab + 1e-12) / (pa * pb)) / (-ln(pab + 1e-12)) AS npmi FROM m),
sv AS (SELECT lang, j, sum(npmi) AS sj FROM v GROUP BY lang, j),
c AS (SELECT v.lang, v.i, sum(v.npmi * sv.sj) / (sqrt(sum(v.npmi * v.npmi)) * sqrt(sum(sv.sj * sv.sj))) AS cs
      FROM v JOIN sv USING (lang, j) GROUP BY v.lang, v.i)
SELECT lang, round(avg(cs), 6) AS c_v FROM c GROUP BY lang"""


ORACLE["chart_means"] = "WITH " + _LB + """,
long AS (SELECT system, 'mean_value' AS metric, mean_value AS value FROM lb
         UNION ALL SELECT system, 'n_events', CAST(n_events AS DOUBLE) FROM lb
         UNION ALL SELECT system, 'n_users', CAST(n_users AS DOUBLE) FROM lb)
SELECT system, metric, round(avg(value), 6) AS value FROM long GROUP BY system, metric"""

ORACLE["link_keys"] = "WITH " + _GOLD + """
SELECT doc_id, item_id, 'http://www.ncbi.nlm.nih.gov/pubmed/' || CAST(doc_id AS VARCHAR) AS link,
       CAST(doc_id AS VARCHAR) || '_' || CAST(item_id AS VARCHAR) AS example_id FROM gold"""

ORACLE["label_indicators"] = "WITH " + _RANKED.format(k=10) + _PREDS + """,
u AS (SELECT DISTINCT q_id, answer AS label FROM preds
      UNION SELECT vec_id AS q_id, 'label ' || CAST(label AS VARCHAR) FROM embeddings)
SELECT u.q_id, u.label,
       CAST(u.label = 'label ' || CAST(e.label AS VARCHAR) AS INTEGER) AS y_true,
       CAST(EXISTS (SELECT 1 FROM preds p WHERE p.q_id = u.q_id AND p.answer = u.label) AS INTEGER) AS y_pred
FROM u JOIN embeddings e ON e.vec_id = u.q_id"""


ORACLE["gold_contexts"] = ("WITH " + _GOLD + """
SELECT g.item_id AS id, g.doc_id AS ctx_pos, CAST(length(d.text) AS INTEGER) AS context_chars
FROM gold g JOIN documents d USING (doc_id) WHERE d.text IS NOT NULL""")
ORACLE["new_keys_except"] = "SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels"


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
