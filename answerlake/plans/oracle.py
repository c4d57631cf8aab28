"""SQL oracles (DuckDB dialect) for the named queries.

Each entry recomputes a query from the raw test tables with plain SQL, so it
checks the Spark operators independently.  The regular expressions are the
same fixed patterns as in ``functions/text.py`` (they are values that must be
equal for equal results, not logic).
"""

from __future__ import annotations

from answerlake.functions.text import JS_NOT_NL, JS_WS, PY_WS, TERM_PATTERN, TOKEN_PATTERN
from answerlake.plans.corpus import CHUNK_CHARS, PACK_TOKENS, THRESHOLD, TOP_K

ORACLE: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    ORACLE[name] = sql.strip()


def _strip(expr: str, ws: str = PY_WS) -> str:
    return f"regexp_replace({expr}, '^[{ws}]+|[{ws}]+$', '', 'g')"


# --- shared CTEs --------------------------------------------------------------

RAW_PARAS = """
raw_paras AS (
  SELECT doc_id, source,
         unnest(range(len(string_split(text, chr(10))))) AS para_idx,
         unnest(string_split(text, chr(10))) AS text
  FROM documents)"""

PARAS = RAW_PARAS + f""",
paras AS (
  SELECT doc_id, source, para_idx,
         lower(regexp_replace(text, '[{PY_WS}]+', ' ', 'g')) AS text
  FROM raw_paras)"""

CHUNKS = PARAS + f""",
chunk_idx AS (
  SELECT doc_id, source, para_idx, text,
         unnest(range(CAST(ceil(length(text) / {CHUNK_CHARS}.0) AS BIGINT))) AS piece_idx
  FROM paras WHERE length(text) > 0),
chunks AS (
  SELECT doc_id, source, para_idx, piece_idx,
         substring(text, piece_idx * {CHUNK_CHARS} + 1, {CHUNK_CHARS}) AS text
  FROM chunk_idx)"""


def tfidf_ctes(units: str, keys: list[str], prefix: str) -> str:
    """CTEs ``{prefix}_tf``, ``{prefix}_idf`` and ``{prefix}_post`` over a unit CTE."""
    k = ", ".join(keys)
    part = ", ".join(keys)
    return f""",
{prefix}_tok AS (
  SELECT {k}, unnest(regexp_extract_all(lower(text), '{TERM_PATTERN}')) AS term FROM {units}),
{prefix}_tf AS (SELECT {k}, term, count(*) AS tf FROM {prefix}_tok GROUP BY ALL),
{prefix}_n AS (SELECT count(*) AS n FROM {units} WHERE {_strip('text')} <> ''),
{prefix}_idf AS (
  SELECT term, count(*) AS df,
         ln((1.0 + (SELECT n FROM {prefix}_n)) / (1.0 + count(*))) + 1.0 AS idf
  FROM {prefix}_tf GROUP BY term),
{prefix}_w AS (
  SELECT {k}, term, tf, tf * idf AS w FROM {prefix}_tf JOIN {prefix}_idf USING (term)),
{prefix}_post AS (
  SELECT {k}, term, tf, w / sqrt(sum(w * w) OVER (PARTITION BY {part})) AS weight FROM {prefix}_w)"""


def question_ctes(prefix: str) -> str:
    """Question vectors ``q_post(item_id, term, qweight)`` against ``{prefix}_idf``."""
    return f""",
q_tok AS (
  SELECT item_id, unnest(regexp_extract_all(lower(text), '{TERM_PATTERN}')) AS term FROM benchmark),
q_tf AS (SELECT item_id, term, count(*) AS tf FROM q_tok GROUP BY ALL),
q_w AS (SELECT item_id, term, tf * idf AS w FROM q_tf JOIN {prefix}_idf USING (term)),
q_post AS (
  SELECT item_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS qweight FROM q_w)"""


def scores_cte(prefix: str, keys: list[str]) -> str:
    k = ", ".join(f"p.{c}" for c in keys)
    return f""",
scores AS (
  SELECT q.item_id, {k}, sum(q.qweight * p.weight) AS score
  FROM q_post q JOIN {prefix}_post p USING (term) GROUP BY ALL)"""


# --- paragraphs ---------------------------------------------------------------

oracle("paragraphs", f"""
WITH {RAW_PARAS}
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(para_idx AS BIGINT) AS para_idx,
       CAST(length(text) AS BIGINT) AS n_chars, text
FROM raw_paras""")

oracle("paragraph_counts", f"""
WITH {PARAS}
SELECT source, count(DISTINCT doc_id) AS n_docs, count(*) AS n_paragraphs,
       CAST(sum(CASE WHEN {_strip('text')} = '' THEN 1 ELSE 0 END) AS BIGINT) AS n_blank
FROM paras GROUP BY source""")

oracle("normalize_text", f"""
WITH {PARAS}
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(para_idx AS BIGINT) AS para_idx, text,
       CAST(CASE WHEN {_strip('text')} = '' THEN 1 ELSE 0 END AS BIGINT) AS is_blank
FROM paras""")

# --- chunking -----------------------------------------------------------------

oracle("chunk_chars", f"""
WITH {CHUNKS}
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(para_idx AS BIGINT) AS para_idx,
       CAST(piece_idx AS BIGINT) AS piece_idx, CAST(length(text) AS BIGINT) AS n_chars, text
FROM chunks""")

oracle("chunk_chars_drop_exact", f"""
WITH {PARAS},
chunk_idx AS (
  SELECT doc_id, para_idx, text,
         unnest(range(CAST(ceil(length(text) / {CHUNK_CHARS}.0) AS BIGINT)
                      - CASE WHEN length(text) % {CHUNK_CHARS} = 0 THEN 1 ELSE 0 END)) AS piece_idx
  FROM paras WHERE length(text) > 0)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(para_idx AS BIGINT) AS para_idx,
       CAST(piece_idx AS BIGINT) AS piece_idx,
       CAST(length(substring(text, piece_idx * {CHUNK_CHARS} + 1, {CHUNK_CHARS})) AS BIGINT) AS n_chars,
       substring(text, piece_idx * {CHUNK_CHARS} + 1, {CHUNK_CHARS}) AS text
FROM chunk_idx""")

TOKEN_PARAS = PARAS + f""",
tpar AS (
  SELECT doc_id, para_idx,
         CAST(len(regexp_extract_all(text, '{TOKEN_PATTERN}')) AS BIGINT) AS n_tokens
  FROM paras)"""

# Greedy packing as a recursive walk over each document's paragraphs.
GREEDY_PACKS = f"""
WITH RECURSIVE {TOKEN_PARAS.strip()},
walk(doc_id, para_idx, cur, pack_id) AS (
  SELECT doc_id, para_idx, n_tokens, CAST(0 AS BIGINT) FROM tpar WHERE para_idx = 0
  UNION ALL
  SELECT t.doc_id, t.para_idx,
         CASE WHEN w.cur + t.n_tokens > {PACK_TOKENS} THEN t.n_tokens ELSE w.cur + t.n_tokens END,
         CASE WHEN w.cur + t.n_tokens > {PACK_TOKENS} THEN w.pack_id + 1 ELSE w.pack_id END
  FROM walk w JOIN tpar t ON t.doc_id = w.doc_id AND t.para_idx = w.para_idx + 1)"""

oracle("chunk_tokens_greedy", GREEDY_PACKS + """
SELECT CAST(w.doc_id AS BIGINT) AS doc_id, CAST(w.pack_id AS BIGINT) AS pack_id,
       count(*) AS n_paragraphs, CAST(sum(t.n_tokens) AS BIGINT) AS n_tokens
FROM walk w JOIN tpar t USING (doc_id, para_idx) GROUP BY ALL""")

oracle("chunk_tokens_prefix", f"""
WITH {TOKEN_PARAS},
cum AS (
  SELECT doc_id, para_idx, n_tokens,
         sum(n_tokens) OVER (PARTITION BY doc_id ORDER BY para_idx
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c
  FROM tpar)
SELECT CAST(doc_id AS BIGINT) AS doc_id,
       CAST(greatest(floor((c - 1) / {PACK_TOKENS}), 0) AS BIGINT) AS pack_id,
       count(*) AS n_paragraphs, CAST(sum(n_tokens) AS BIGINT) AS n_tokens
FROM cum GROUP BY ALL""")

# --- tf-idf -------------------------------------------------------------------

CHUNK_KEYS = ["doc_id", "para_idx", "piece_idx"]
PARA_KEYS = ["doc_id", "para_idx"]

oracle("token_stats", f"""
WITH {CHUNKS},
tok AS (SELECT doc_id, para_idx, piece_idx,
               unnest(regexp_extract_all(lower(text), '{TERM_PATTERN}')) AS term FROM chunks),
per AS (SELECT doc_id, para_idx, piece_idx, count(*) AS n_total, count(DISTINCT term) AS n_distinct
        FROM tok GROUP BY ALL)
SELECT CAST(c.doc_id AS BIGINT) AS doc_id, CAST(c.para_idx AS BIGINT) AS para_idx,
       CAST(c.piece_idx AS BIGINT) AS piece_idx,
       CAST(len(regexp_extract_all(c.text, '{TOKEN_PATTERN}')) AS BIGINT) AS n_tokens,
       CAST(coalesce(p.n_total, 0) AS BIGINT) AS n_terms_total,
       CAST(coalesce(p.n_distinct, 0) AS BIGINT) AS n_terms_distinct
FROM chunks c LEFT JOIN per p USING (doc_id, para_idx, piece_idx)""")

CHUNK_TFIDF = CHUNKS + tfidf_ctes("chunks", CHUNK_KEYS, "c")
PARA_TFIDF = PARAS + tfidf_ctes("paras", PARA_KEYS, "p")

oracle("tfidf_idf", f"""
WITH {CHUNK_TFIDF}
SELECT term, CAST(df AS BIGINT) AS df, round(idf, 6) AS idf FROM c_idf""")

oracle("tfidf_postings", f"""
WITH {CHUNK_TFIDF}
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(para_idx AS BIGINT) AS para_idx,
       CAST(piece_idx AS BIGINT) AS piece_idx, term, CAST(tf AS BIGINT) AS tf,
       round(weight, 6) AS weight
FROM c_post""")

# --- retrieval ----------------------------------------------------------------

TOP1_BASE = PARA_TFIDF + question_ctes("p") + scores_cte("p", PARA_KEYS) + """,
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id
                               ORDER BY round(score, 9) DESC, doc_id, para_idx) AS rn
  FROM scores),
best AS (SELECT item_id, doc_id, para_idx, score FROM ranked WHERE rn = 1)"""

TOP1_SELECT = """
SELECT CAST(b.item_id AS BIGINT) AS item_id, CAST(h.doc_id AS BIGINT) AS doc_id,
       CAST(h.para_idx AS BIGINT) AS para_idx, round(h.score, 6) AS score,
       CASE WHEN h.score IS NULL THEN 'N/A'
            ELSE h.source || '/' || CAST(h.doc_id AS VARCHAR) || '.txt' END AS filename,
       h.text AS retrieved_text,
       CASE WHEN h.score IS NULL THEN 'No suitable chunk found.' END AS response
FROM benchmark b LEFT JOIN hits h USING (item_id)"""

oracle("retrieve_top1", f"""
WITH {TOP1_BASE},
hits AS (
  SELECT b.item_id, b.doc_id, b.para_idx, b.score, p.source, p.text
  FROM best b JOIN paras p USING (doc_id, para_idx))
{TOP1_SELECT}""")

oracle("retrieve_top1_allow_zero", f"""
WITH {TOP1_BASE},
first_para AS (SELECT doc_id, para_idx FROM paras ORDER BY doc_id, para_idx LIMIT 1),
zero AS (
  SELECT q.item_id, f.doc_id, f.para_idx, 0.0 AS score
  FROM benchmark q, first_para f WHERE q.item_id NOT IN (SELECT item_id FROM best)),
hits AS (
  SELECT b.item_id, b.doc_id, b.para_idx, b.score, p.source, p.text
  FROM (SELECT * FROM best UNION ALL SELECT * FROM zero) b
  JOIN paras p USING (doc_id, para_idx) WHERE p.text <> '')
{TOP1_SELECT}""")

oracle("retrieve_threshold", f"""
WITH {CHUNK_TFIDF}{question_ctes("c")}{scores_cte("c", CHUNK_KEYS)}
SELECT CAST(item_id AS BIGINT) AS item_id, CAST(doc_id AS BIGINT) AS doc_id,
       CAST(para_idx AS BIGINT) AS para_idx, CAST(piece_idx AS BIGINT) AS piece_idx,
       round(score, 6) AS score
FROM scores WHERE score > {THRESHOLD}""")

oracle("retrieve_best_per_pack", GREEDY_PACKS + tfidf_ctes("paras", PARA_KEYS, "p")
       + question_ctes("p") + scores_cte("p", PARA_KEYS) + """,
ranked AS (
  SELECT s.item_id, s.doc_id, w.pack_id, s.para_idx, s.score,
         row_number() OVER (PARTITION BY s.item_id, s.doc_id, w.pack_id
                            ORDER BY round(s.score, 9) DESC, s.para_idx) AS rn
  FROM scores s JOIN walk w USING (doc_id, para_idx))
SELECT CAST(item_id AS BIGINT) AS item_id, CAST(doc_id AS BIGINT) AS doc_id,
       CAST(pack_id AS BIGINT) AS pack_id, CAST(para_idx AS BIGINT) AS para_idx,
       round(score, 6) AS score
FROM ranked WHERE rn = 1""")

# --- dense --------------------------------------------------------------------

DENSE_BASE = """
q AS (SELECT b.item_id, CAST(e.embedding AS DOUBLE[]) AS qv
      FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id WHERE e.embedding IS NOT NULL),
v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS ev FROM embeddings),
d AS (SELECT q.item_id, v.vec_id,
             1.0 - list_dot_product(q.qv, v.ev)
                   / nullif(sqrt(list_dot_product(q.qv, q.qv)) * sqrt(list_dot_product(v.ev, v.ev)), 0) AS distance
      FROM q CROSS JOIN v)"""

oracle("dense_topk_nearest", f"""
WITH {DENSE_BASE},
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(distance, 9), vec_id) AS rn
      FROM d WHERE distance IS NOT NULL)
SELECT CAST(item_id AS BIGINT) AS item_id, CAST(vec_id AS BIGINT) AS vec_id, CAST(rn AS BIGINT) AS rank,
       round(distance, 6) + 0.0 AS distance
FROM r WHERE rn <= {TOP_K}""")

oracle("dense_topk_farthest", f"""
WITH {DENSE_BASE},
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(distance, 9) DESC, vec_id) AS rn
      FROM d WHERE distance > 0)
SELECT CAST(item_id AS BIGINT) AS item_id, CAST(vec_id AS BIGINT) AS vec_id, CAST(rn AS BIGINT) AS rank,
       round(distance, 6) + 0.0 AS distance
FROM r WHERE rn <= {TOP_K}""")

oracle("embed_join_filter", """
SELECT CAST(b.item_id AS BIGINT) AS item_id, CAST(length(b.text) AS BIGINT) AS n_chars,
       CAST(len(e.embedding) AS BIGINT) AS dim
FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id WHERE e.embedding IS NOT NULL""")

# --- votes --------------------------------------------------------------------

VOTES = """
votes AS (
  SELECT o_orderpriority AS category,
         CASE o_orderstatus WHEN 'F' THEN 'trump' WHEN 'O' THEN 'biden' END AS vote
  FROM orders),
piv AS (
  SELECT category, count(*) FILTER (WHERE vote = 'trump') AS trump,
         count(*) FILTER (WHERE vote = 'biden') AS biden
  FROM votes WHERE vote IS NOT NULL AND category IS NOT NULL GROUP BY category)"""

oracle("vote_counts", f"""
WITH {VOTES}
SELECT vote, count(*) AS n FROM votes WHERE vote IS NOT NULL GROUP BY vote""")

oracle("vote_pivot", f"""
WITH {VOTES}
SELECT category, trump, biden, trump + biden AS total FROM piv""")

oracle("vote_percent", f"""
WITH {VOTES},
pct AS (SELECT category, round_even(100.0 * trump / (trump + biden), 2) AS trump_pct,
               round_even(100.0 * biden / (trump + biden), 2) AS biden_pct FROM piv)
SELECT category, trump_pct, biden_pct, printf('%.2f%%', trump_pct) AS trump_label,
       printf('%.2f%%', biden_pct) AS biden_label
FROM pct""")

oracle("top_categories", f"""
WITH {VOTES}
SELECT category, trump + biden AS total, printf('%.0f', CAST(trump + biden AS DOUBLE)) AS label
FROM piv ORDER BY total, category""")

# --- engagement ---------------------------------------------------------------

EVENTS = """
ev AS (
  SELECT event_id, user_id, ts, event_type, value,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         CASE event_type WHEN 'view' THEN 'question' WHEN 'purchase' THEN 'vote'
                         WHEN 'click' THEN 'topic_click' WHEN 'signup' THEN 'quiz_answer' END AS kind
  FROM events),
quiz AS (
  SELECT *, CASE WHEN k % 2 = 0 THEN 'trump' ELSE 'biden' END AS answer,
            CASE WHEN CAST(floor(value) AS BIGINT) % 2 = 0 THEN 'trump' ELSE 'biden' END AS answer_key
  FROM ev WHERE kind = 'quiz_answer'),
mev AS (
  SELECT user_id, kind, ts, event_id FROM ev WHERE kind IN ('question', 'vote', 'topic_click')
  UNION ALL
  SELECT user_id, 'correct', ts, event_id FROM quiz WHERE lower(answer) = lower(answer_key)),
nth AS (SELECT *, row_number() OVER (PARTITION BY user_id, kind ORDER BY ts, event_id) AS n FROM mev),
rules(kind, n, badge_id) AS (VALUES
  ('question', 1, 1), ('question', 10, 4), ('question', 20, 9), ('question', 50, 14),
  ('vote', 1, 2), ('vote', 10, 5), ('vote', 20, 10), ('vote', 50, 15),
  ('correct', 1, 16), ('correct', 10, 17), ('correct', 20, 18), ('topic_click', 1, 20)),
ms AS (SELECT nth.user_id, rules.badge_id, nth.event_id, nth.ts FROM nth JOIN rules USING (kind, n)),
vdays AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM ev WHERE kind = 'vote'),
isl AS (SELECT user_id, day, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS g
        FROM vdays),
runs AS (SELECT user_id, min(day) AS start_day, max(day) AS end_day, count(*) AS length
         FROM isl GROUP BY user_id, g),
streak_rules(days, badge_id) AS (VALUES (7, 3), (30, 8), (90, 13)),
sb AS (SELECT r.user_id, s.badge_id, r.start_day + (s.days - 1) AS earned_day
       FROM runs r JOIN streak_rules s ON r.length >= s.days),
earned AS (
  SELECT user_id, badge_id, min(earned_day) AS earned_day FROM (
    SELECT user_id, badge_id, CAST(ts AS DATE) AS earned_day FROM ms
    UNION ALL SELECT user_id, badge_id, earned_day FROM sb) GROUP BY ALL)"""

oracle("milestones", f"""
WITH {EVENTS}
SELECT CAST(user_id AS BIGINT) AS user_id, CAST(badge_id AS BIGINT) AS badge_id,
       CAST(event_id AS BIGINT) AS event_id FROM ms""")

oracle("badges_earned", f"""
WITH {EVENTS}
SELECT CAST(user_id AS BIGINT) AS user_id, CAST(badge_id AS BIGINT) AS badge_id,
       strftime(earned_day, '%Y-%m-%d') AS earned_day FROM earned""")

BADGE_VALUES = ", ".join(f"({i}, '{n.replace(chr(39), chr(39) * 2)}')"
                         for i, n, _ in __import__("answerlake.sources.inline", fromlist=["BADGES"]).BADGES)

oracle("badge_names", f"""
WITH {EVENTS},
cat(badge_id, name) AS (VALUES {BADGE_VALUES})
SELECT CAST(e.user_id AS BIGINT) AS user_id, CAST(e.badge_id AS BIGINT) AS badge_id, c.name,
       CASE WHEN (row_number() OVER (PARTITION BY e.user_id ORDER BY e.earned_day, e.badge_id) - 1) % 2 = 0
            THEN 'left' ELSE 'right' END AS list_side
FROM earned e JOIN cat c USING (badge_id)""")

oracle("vote_streaks", f"""
WITH {EVENTS}
SELECT CAST(user_id AS BIGINT) AS user_id, strftime(start_day, '%Y-%m-%d') AS start_day,
       strftime(end_day, '%Y-%m-%d') AS end_day, CAST(length AS BIGINT) AS length FROM runs""")

oracle("session_counters", f"""
WITH {EVENTS},
per AS (
  SELECT user_id,
         count(*) FILTER (WHERE kind = 'question') AS n_questions,
         count(*) FILTER (WHERE kind = 'vote') AS n_votes,
         count(*) FILTER (WHERE kind = 'topic_click') AS n_topic_clicks
  FROM ev GROUP BY user_id),
qz AS (
  SELECT user_id, count(*) FILTER (WHERE lower(answer) = lower(answer_key)) AS n_correct,
         count(*) FILTER (WHERE lower(answer) <> lower(answer_key)) AS n_incorrect
  FROM quiz GROUP BY user_id),
err AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS n_failed_asks FROM events GROUP BY user_id)
SELECT CAST(err.user_id AS BIGINT) AS user_id,
       CAST(coalesce(per.n_questions, 0) AS BIGINT) AS n_questions,
       CAST(coalesce(per.n_votes, 0) AS BIGINT) AS n_votes,
       CAST(coalesce(per.n_topic_clicks, 0) AS BIGINT) AS n_topic_clicks,
       CAST(coalesce(qz.n_correct, 0) AS BIGINT) AS n_correct,
       CAST(coalesce(qz.n_incorrect, 0) AS BIGINT) AS n_incorrect,
       CAST(err.n_failed_asks AS BIGINT) AS n_failed_asks
FROM err LEFT JOIN per USING (user_id) LEFT JOIN qz USING (user_id)""")

oracle("quiz_score", f"""
WITH {EVENTS}
SELECT CAST(user_id AS BIGINT) AS user_id,
       CAST(count(*) FILTER (WHERE lower(answer) = lower(answer_key)) AS BIGINT) AS correct,
       CAST(count(*) FILTER (WHERE lower(answer) <> lower(answer_key)) AS BIGINT) AS incorrect
FROM quiz GROUP BY user_id""")

FIRST_VOTES = EVENTS + """,
qs AS (SELECT user_id, ts, event_id FROM ev WHERE kind = 'question'),
vs AS (SELECT user_id, ts, event_id, k FROM ev WHERE kind = 'vote'),
matched AS (
  SELECT v.*, (SELECT q.event_id FROM qs q
               WHERE q.user_id = v.user_id AND (q.ts < v.ts OR (q.ts = v.ts AND q.event_id < v.event_id))
               ORDER BY q.ts DESC, q.event_id DESC LIMIT 1) AS question_id
  FROM vs v),
firstv AS (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY ts, event_id) AS rn
  FROM matched WHERE question_id IS NOT NULL),
fv AS (
  SELECT question_id, user_id, event_id AS vote_id,
         CASE WHEN k % 2 = 0 THEN 'A' ELSE 'B' END AS slot,
         CASE WHEN substr(md5(CAST(question_id AS VARCHAR)), 32, 1) IN ('0','2','4','6','8','a','c','e')
              THEN 'trump' ELSE 'biden' END AS a_cand
  FROM firstv WHERE rn = 1),
fvc AS (
  SELECT *, CASE WHEN slot = 'A' THEN a_cand WHEN a_cand = 'trump' THEN 'biden' ELSE 'trump' END AS candidate
  FROM fv)"""

oracle("first_vote_per_question", f"""
WITH {FIRST_VOTES}
SELECT CAST(question_id AS BIGINT) AS question_id, CAST(user_id AS BIGINT) AS user_id,
       CAST(vote_id AS BIGINT) AS vote_id, slot, candidate FROM fvc""")

oracle("vote_tally_winner", f"""
WITH {FIRST_VOTES},
t AS (SELECT user_id, count(*) FILTER (WHERE candidate = 'trump') AS trump,
             count(*) FILTER (WHERE candidate = 'biden') AS biden FROM fvc GROUP BY user_id)
SELECT CAST(user_id AS BIGINT) AS user_id, CAST(trump AS BIGINT) AS trump, CAST(biden AS BIGINT) AS biden,
       CASE WHEN trump > biden THEN 'Donald Trump' WHEN biden > trump THEN 'Joe Biden' ELSE 'Tie' END AS winner
FROM t""")

oracle("answer_summary", f"""
WITH {FIRST_VOTES}
SELECT CAST(q.event_id AS BIGINT) AS question_id, CAST(q.user_id AS BIGINT) AS user_id,
       f.candidate AS picked,
       CASE f.candidate WHEN 'trump' THEN 'Donald Trump' WHEN 'biden' THEN 'Joe Biden' END AS picked_name
FROM qs q LEFT JOIN fvc f ON f.question_id = q.event_id""")

oracle("blind_assignment", """
WITH a AS (
  SELECT item_id, CASE WHEN substr(md5(CAST(item_id AS VARCHAR)), 32, 1) IN ('0','2','4','6','8','a','c','e')
                       THEN 'trump' ELSE 'biden' END AS a_cand FROM benchmark)
SELECT CAST(item_id AS BIGINT) AS item_id, 'A' AS slot, a_cand AS candidate FROM a
UNION ALL
SELECT CAST(item_id AS BIGINT), 'B', CASE WHEN a_cand = 'trump' THEN 'biden' ELSE 'trump' END FROM a""")

oracle("sample_questions", """
SELECT CAST(item_id AS BIGINT) AS item_id, text FROM benchmark
ORDER BY md5('debate' || CAST(item_id AS VARCHAR)), item_id LIMIT 3""")

_T = __import__("answerlake.sources.inline", fromlist=["CANDIDATE_TEMPLATES"]).CANDIDATE_TEMPLATES
TEMPLATE_VALUES = ", ".join(f"('{c}', '{t.replace(chr(39), chr(39) * 2)}')" for c, t in _T.items())

oracle("candidate_prompts", f"""
WITH a AS (
  SELECT item_id, text, CASE WHEN substr(md5(CAST(item_id AS VARCHAR)), 32, 1) IN ('0','2','4','6','8','a','c','e')
                             THEN 'trump' ELSE 'biden' END AS a_cand FROM benchmark),
s AS (
  SELECT item_id, text, 'A' AS slot, a_cand AS candidate FROM a
  UNION ALL
  SELECT item_id, text, 'B', CASE WHEN a_cand = 'trump' THEN 'biden' ELSE 'trump' END FROM a),
tpl(candidate, template) AS (VALUES {TEMPLATE_VALUES})
SELECT CAST(item_id AS BIGINT) AS item_id, slot, candidate, template || text AS prompt
FROM s JOIN tpl USING (candidate)""")

oracle("debate_day_first", f"""
WITH {EVENTS},
d AS (SELECT user_id, event_id, ts,
             date_trunc('day', ts - INTERVAL 13 HOUR) + INTERVAL 13 HOUR AS day_start
      FROM ev WHERE kind = 'vote')
SELECT CAST(user_id AS BIGINT) AS user_id, strftime(day_start, '%Y-%m-%d %H:%M:%S') AS day_start,
       CAST(arg_min(event_id, (ts, event_id)) AS BIGINT) AS first_vote_id, count(*) AS n_votes
FROM d GROUP BY user_id, day_start""")

# --- prompts ------------------------------------------------------------------

from answerlake.functions.payloads import QUIZ_QUESTION, URL_PATTERN, quiz_answer_pattern  # noqa: E402
from answerlake.functions.text import PIECE_PATTERN  # noqa: E402

NL2 = "chr(10) || chr(10)"


def _tok(expr: str) -> str:
    return f"len(regexp_extract_all({expr}, '{TOKEN_PATTERN}'))"


def _truncate(expr: str, n: str) -> str:
    return (f"CASE WHEN {_tok(expr)} <= {n} THEN {expr} WHEN {n} > 0 "
            f"THEN array_to_string(regexp_extract_all({expr}, '{PIECE_PATTERN}')[1:{n}], '') ELSE '' END")


def _prompt(ctx: str, q: str) -> str:
    return f"'Context: ' || {ctx} || {NL2} || 'Question: ' || {q} || {NL2} || 'Answer:'"


def prompt_ctes(ctx_cte: str) -> str:
    """From ``{ctx_cte}(item_id, n, context)`` build ``pr`` with the budget rule."""
    return f""",
pr0 AS (
  SELECT b.item_id, b.text AS q, c.n, c.context, {_prompt('c.context', 'b.text')} AS full_prompt,
         2000 - {_tok(f"'Question: ' || b.text || {NL2} || 'Answer:'")} AS budget
  FROM benchmark b LEFT JOIN {ctx_cte} c USING (item_id)),
pr1 AS (SELECT *, {_tok('full_prompt')} AS ptok FROM pr0),
pr AS (
  SELECT item_id, n, ptok,
         CASE WHEN n IS NULL THEN NULL WHEN ptok > 2000 THEN 1 ELSE 0 END AS truncated,
         CASE WHEN n IS NULL THEN NULL WHEN ptok > 2000 THEN {_prompt(_truncate('context', 'budget'), 'q')}
              ELSE full_prompt END AS prompt,
         CASE WHEN n IS NULL THEN 'No suitable chunk found.' END AS response
  FROM pr1)"""


CHUNK_HITS = CHUNK_TFIDF + question_ctes("c") + scores_cte("c", CHUNK_KEYS) + f""",
hits AS (
  SELECT s.item_id, s.doc_id, s.para_idx, s.piece_idx, c.text,
         c.source || '/' || CAST(c.doc_id AS VARCHAR) || '.txt' AS filename
  FROM scores s JOIN chunks c USING (doc_id, para_idx, piece_idx) WHERE s.score > {THRESHOLD}),
ctx AS (
  SELECT item_id, count(*) AS n,
         string_agg(text, ', ' ORDER BY doc_id, para_idx, piece_idx) AS context,
         first(text ORDER BY doc_id, para_idx, piece_idx) AS first_context,
         last(filename ORDER BY doc_id, para_idx, piece_idx) AS last_filename
  FROM hits GROUP BY item_id)"""

oracle("context_prompts", f"""
WITH {CHUNK_HITS}{prompt_ctes('ctx')}
SELECT CAST(item_id AS BIGINT) AS item_id, CAST(coalesce(n, 0) AS BIGINT) AS n_contexts,
       CAST(ptok AS BIGINT) AS prompt_tokens, CAST(truncated AS BIGINT) AS truncated, prompt, response
FROM pr""")

oracle("contexts_json", f"""
WITH {CHUNK_HITS}
SELECT CAST(item_id AS BIGINT) AS item_id, CAST(n AS BIGINT) AS n_contexts, first_context, last_filename
FROM ctx""")

oracle("prompt_budget", f"""
WITH {TOP1_BASE},
hits AS (
  SELECT b.item_id, 1 AS n, p.text AS context
  FROM best b JOIN paras p USING (doc_id, para_idx)){prompt_ctes('hits')}
SELECT CAST(item_id AS BIGINT) AS item_id, CAST(ptok AS BIGINT) AS prompt_tokens,
       CAST(truncated AS BIGINT) AS truncated, CAST({_tok('prompt')} AS BIGINT) AS final_tokens, response
FROM pr""")

# --- payloads -----------------------------------------------------------------

oracle("chat_requests", """
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, 'gpt-4o-mini' AS model,
       CAST(2 AS BIGINT) AS n_messages, text AS user_content, CAST(100 AS BIGINT) AS max_tokens,
       CAST(0.1 AS DOUBLE) AS temperature
FROM conversations WHERE role = 'user'""")

oracle("chat_response_parse", f"""
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn,
       CASE WHEN role = 'assistant' THEN {_strip("'  ' || text || chr(10)")} END AS content,
       CASE WHEN role = 'assistant' THEN 'ok' ELSE 'unparseable' END AS status
FROM conversations WHERE role IN ('assistant', 'system')""")

oracle("embedding_parse", """
SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(len(embedding) AS BIGINT) AS dim,
       round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm,
       round(CAST(embedding[1] AS DOUBLE), 6) AS first
FROM embeddings WHERE embedding IS NOT NULL""")

PAGE_MSG = """
m AS (
  SELECT page_id, url,
         regexp_extract(html, '<title>([^<]*)</title>', 1) || ' ' || url || ' see also ' || url || ' ' AS message
  FROM pages)"""

oracle("reference_extract", f"""
WITH {PAGE_MSG}
SELECT CAST(page_id AS BIGINT) AS page_id,
       {_strip(f"regexp_replace(message, '{URL_PATTERN}', '')", JS_WS)} AS text,
       CASE WHEN regexp_extract(message, '{URL_PATTERN}', 0) = '' THEN 'No reference provided'
            ELSE regexp_extract(message, '{URL_PATTERN}', 0) END AS reference
FROM m""")

oracle("source_basename", """
SELECT CAST(page_id AS BIGINT) AS page_id, string_split(url, '/')[-1] AS basename, url AS source FROM pages""")

_ANS = quiz_answer_pattern(["trump", "biden"])

oracle("quiz_parse", f"""
WITH m AS (
  SELECT conv_id, turn,
         'Question: ' || text || ' Answer: ' ||
         CASE length(text) % 3 WHEN 0 THEN 'Trump' WHEN 1 THEN 'biden' ELSE 'nobody' END AS message
  FROM conversations WHERE role = 'user'),
p AS (SELECT *, regexp_matches(message, '{QUIZ_QUESTION}') AND regexp_matches(message, '{_ANS}') AS ok FROM m)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn,
       CASE WHEN ok THEN {_strip(f"regexp_extract(message, '{QUIZ_QUESTION}', 1)", JS_WS)}
            ELSE 'Generating Question, Please Wait' END AS question,
       CASE WHEN ok THEN {_strip(f"regexp_extract(message, '{_ANS}', 1)", JS_WS)} ELSE 'trump' END AS answer,
       CAST(CASE WHEN ok THEN 1 ELSE 0 END AS BIGINT) AS parsed
FROM p""")

# --- logs ---------------------------------------------------------------------

QA = """
qq AS (SELECT conv_id, turn, text AS query FROM conversations WHERE role = 'user'),
aa AS (SELECT conv_id, turn - 1 AS turn, text AS response FROM conversations WHERE role = 'assistant'),
ss AS (SELECT conv_id, arg_min(text, turn) AS context FROM conversations WHERE role = 'system' GROUP BY conv_id),
qa AS (SELECT * FROM qq LEFT JOIN aa USING (conv_id, turn) LEFT JOIN ss USING (conv_id))"""

oracle("log_rows", f"""
WITH {QA}
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, query AS "Query",
       context AS "Retrieved Text", response AS "Response",
       CASE WHEN context IS NULL THEN 'N/A' ELSE 'conversation/' || CAST(conv_id AS VARCHAR) END AS "Filename"
FROM qa""")

oracle("latest_question", """
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(max(turn) AS BIGINT) AS turn, arg_max(text, turn) AS query
FROM conversations WHERE role = 'user' GROUP BY conv_id""")

oracle("response_rows", f"""
WITH {QA},
p AS (SELECT * FROM qa WHERE response IS NOT NULL),
ans_t AS (SELECT DISTINCT conv_id, turn, term FROM (
         SELECT conv_id, turn, unnest(regexp_extract_all(lower(response), '{TERM_PATTERN}')) AS term FROM p)),
ctx_t AS (SELECT DISTINCT conv_id, turn, term FROM (
         SELECT conv_id, turn, unnest(regexp_extract_all(lower(query), '{TERM_PATTERN}')) AS term FROM p)),
sup AS (SELECT a.conv_id, a.turn, count(*) AS n_terms, count(c.term) AS n_sup
        FROM ans_t a LEFT JOIN ctx_t c USING (conv_id, turn, term) GROUP BY ALL)
SELECT CAST(p.conv_id AS BIGINT) AS query_id, CAST(p.turn AS BIGINT) AS turn, CAST(1 AS BIGINT) AS candidate_id,
       p.response, CAST(0 AS BIGINT) AS user_voted, CAST(NULL AS DOUBLE) AS answer_relevancy,
       round(CAST(s.n_sup AS DOUBLE) / s.n_terms, 6) AS faithfulness
FROM p LEFT JOIN sup s USING (conv_id, turn)""")

oracle("sentinel_filter", f"""
WITH {QA}
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn FROM qa
WHERE lower(query) NOT IN ('exit', 'quit') AND query <> '' AND coalesce(response, '') <> ''""")

# --- classification -----------------------------------------------------------

from answerlake.sources.inline import TAXONOMY  # noqa: E402
from answerlake.sources.files import QUOTED_LINE  # noqa: E402

TAX_LIST = "[" + ", ".join(f"'{t}'" for t in TAXONOMY) + "]"
TAX_VALUES = ", ".join(f"({i}, '{t}')" for i, t in enumerate(TAXONOMY))

CENTROIDS = """
e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL),
cells AS (SELECT label, unnest(range(len(v))) AS d, unnest(v) AS x FROM e),
mm AS (SELECT label, d, avg(x) AS m FROM cells GROUP BY ALL),
cen AS (SELECT label, list(m ORDER BY d) AS c FROM mm GROUP BY label),
sims AS (
  SELECT e.vec_id, e.label AS own, cen.label,
         list_dot_product(e.v, cen.c) / nullif(sqrt(list_dot_product(e.v, e.v)) * sqrt(list_dot_product(cen.c, cen.c)), 0) AS score
  FROM e CROSS JOIN cen)"""

oracle("classify_centroid", f"""
WITH {CENTROIDS},
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(score, 9) DESC, label) AS rn
      FROM sims WHERE score IS NOT NULL),
b AS (SELECT * FROM r WHERE rn = 1)
SELECT CAST(e.vec_id AS BIGINT) AS vec_id,
       CASE WHEN b.score >= 0.2 AND b.label BETWEEN 0 AND {len(TAXONOMY) - 1}
            THEN {TAX_LIST}[b.label + 1] ELSE 'Other' END AS category,
       round(b.score, 6) AS score
FROM e LEFT JOIN b USING (vec_id)""")

oracle("relevancy_avg", f"""
WITH {CENTROIDS}
SELECT CAST(label AS BIGINT) AS label, count(score) AS n_generated, round(avg(score), 6) AS answer_relevancy
FROM sims WHERE own = label GROUP BY label""")

oracle("classify_terms", f"""
WITH tax(label_id, text) AS (VALUES {TAX_VALUES}){tfidf_ctes("tax", ["label_id"], "t")}{question_ctes("t")}{scores_cte("t", ["label_id"])},
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, label_id) AS rn FROM scores)
SELECT CAST(b.item_id AS BIGINT) AS item_id, coalesce(t.text, 'Other') AS category, round(r.score, 6) AS score
FROM benchmark b LEFT JOIN r ON r.item_id = b.item_id AND r.rn = 1 LEFT JOIN tax t ON t.label_id = r.label_id""")

oracle("offtaxonomy_labels", f"""
WITH w AS (SELECT regexp_extract(text, '\\p{{L}}+', 0) AS w FROM conversations WHERE role = 'assistant'),
l AS (SELECT upper(substring(w, 1, 1)) || lower(substring(w, 2, 1048576)) AS category FROM w)
SELECT category, count(*) AS n FROM l
WHERE category NOT IN (SELECT unnest({TAX_LIST[:-1]}, 'Other']))
GROUP BY category""")

oracle("stub_category", """
SELECT CAST(item_id AS BIGINT) AS item_id, text AS "Questions", 'Test' AS "Category" FROM benchmark""")

# --- evaluation ---------------------------------------------------------------

oracle("context_support", f"""
WITH {QA},
p AS (SELECT conv_id, turn, response, context FROM qa
      WHERE response IS NOT NULL AND context IS NOT NULL),
ans_t AS (SELECT DISTINCT conv_id, turn, term FROM (
            SELECT conv_id, turn, unnest(regexp_extract_all(lower(response), '{TERM_PATTERN}')) AS term FROM p)),
ctx_t AS (SELECT DISTINCT conv_id, turn, term FROM (
            SELECT conv_id, turn, unnest(regexp_extract_all(lower(context), '{TERM_PATTERN}')) AS term FROM p)),
sup AS (SELECT a.conv_id, a.turn, count(*) AS n_terms, count(c.term) AS n_sup
        FROM ans_t a LEFT JOIN ctx_t c USING (conv_id, turn, term) GROUP BY ALL)
SELECT CAST(p.conv_id AS BIGINT) AS conv_id, CAST(p.turn AS BIGINT) AS turn, CAST(coalesce(s.n_terms, 0) AS BIGINT) AS n_terms,
       CAST(coalesce(s.n_sup, 0) AS BIGINT) AS n_supported,
       round(CAST(s.n_sup AS DOUBLE) / s.n_terms, 6) AS support
FROM p LEFT JOIN sup s USING (conv_id, turn)""")

oracle("faithfulness_avg", """
SELECT d.source, count(*) AS n_claims, round(avg(CAST(l.quality AS DOUBLE)), 6) AS faithfulness
FROM labels l JOIN documents d USING (doc_id) GROUP BY d.source""")

oracle("score_by_day", """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n, round(avg(value), 6) AS avg_value
FROM events GROUP BY 1""")


#: Ten rows over .5 / .25 / .25 by largest remainder.
MIX_CASE = "CASE WHEN rank <= 5 THEN 'simple' WHEN rank <= 8 THEN 'reasoning' ELSE 'multi_context' END"


oracle("eval_set_mix", f"""
WITH {PARAS},
t AS (SELECT doc_id, para_idx FROM paras WHERE {_strip('text')} <> ''
      ORDER BY md5(concat_ws('|', 'debate', CAST(doc_id AS VARCHAR), CAST(para_idx AS VARCHAR))), doc_id, para_idx
      LIMIT 10),
r AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', 'debate', CAST(doc_id AS VARCHAR),
                                                        CAST(para_idx AS VARCHAR))), doc_id, para_idx) AS rank FROM t)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(para_idx AS BIGINT) AS para_idx, CAST(rank AS BIGINT) AS rank,
       {MIX_CASE} AS evolution
FROM r""")

oracle("eval_multi_context_pairs", f"""
WITH {CHUNK_TFIDF},
p AS (SELECT doc_id, para_idx, piece_idx, term FROM c_post WHERE term IN (SELECT term FROM c_idf WHERE df = 2))
SELECT CAST(a.doc_id AS BIGINT) AS a_doc_id, CAST(a.para_idx AS BIGINT) AS a_para_idx,
       CAST(a.piece_idx AS BIGINT) AS a_piece_idx, CAST(b.doc_id AS BIGINT) AS b_doc_id,
       CAST(b.para_idx AS BIGINT) AS b_para_idx, CAST(b.piece_idx AS BIGINT) AS b_piece_idx,
       count(*) AS n_shared
FROM p a JOIN p b ON a.term = b.term
WHERE a.doc_id < b.doc_id OR (a.doc_id = b.doc_id AND (a.para_idx < b.para_idx
      OR (a.para_idx = b.para_idx AND a.piece_idx < b.piece_idx)))
GROUP BY ALL""")

oracle("suggested_sample", f"""
WITH l AS (SELECT item_id, '"' || replace(text, chr(10), ' ') || '",' AS value FROM benchmark),
p AS (SELECT item_id, regexp_extract(value, '{QUOTED_LINE}', 1) AS text FROM l)
SELECT CAST(item_id AS BIGINT) AS item_id, text FROM p
ORDER BY md5('debate' || CAST(item_id AS VARCHAR)), item_id LIMIT 3""")

# --- sinks and round trips ----------------------------------------------------

oracle("index_roundtrip", ORACLE["tfidf_postings"])
oracle("roundtrip_tsv", ORACLE["log_rows"])

oracle("roundtrip_csv_quotes", """
SELECT CAST(item_id AS BIGINT) AS item_id, '"' || text || '",' AS prompt,
       CASE WHEN substr(md5(CAST(item_id AS VARCHAR)), 32, 1) IN ('0','2','4','6','8','a','c','e')
            THEN 'trump' ELSE 'biden' END AS vote, 'Test' AS "Category"
FROM benchmark""")

oracle("scan_txt_dir", """
SELECT source, CAST(sum(length(text) + 1) AS BIGINT) AS n_chars,
       CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS n_lines
FROM documents GROUP BY source""")

# --- streaming (same answers as the batch twins) --------------------------------

oracle("stream_scoreboard", """
WITH v AS (
  SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0 AS slot_a,
         CASE WHEN substr(md5(CAST(event_id AS VARCHAR)), 32, 1) IN ('0','2','4','6','8','a','c','e')
              THEN 'trump' ELSE 'biden' END AS a_cand
  FROM events WHERE event_type = 'purchase')
SELECT CASE WHEN slot_a THEN a_cand WHEN a_cand = 'trump' THEN 'biden' ELSE 'trump' END AS candidate,
       count(*) AS votes
FROM v GROUP BY 1""")

oracle("stream_first_vote", """
SELECT CAST(user_id AS BIGINT) AS user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS question_k,
       CAST(arg_min(event_id, (ts, event_id)) AS BIGINT) AS vote_id
FROM events WHERE event_type = 'purchase' GROUP BY 1, 2""")

oracle("stream_milestones", ORACLE["milestones"])

oracle("stream_answer", ORACLE["retrieve_top1"])
oracle("serve_top1", ORACLE["retrieve_top1"])

oracle("answer_log", f"""
WITH {PAGE_MSG},
resp AS (
  SELECT page_id, {_strip(f"regexp_replace(message, '{URL_PATTERN}', '')", JS_WS)} AS response,
         CASE WHEN regexp_extract(message, '{URL_PATTERN}', 0) = '' THEN 'No reference provided'
              ELSE regexp_extract(message, '{URL_PATTERN}', 0) END AS reference
  FROM m),
q AS (
  SELECT item_id, md5(CAST(item_id AS VARCHAR) || 'vote') AS h,
         CASE WHEN substr(md5(CAST(item_id AS VARCHAR)), 32, 1) IN ('0','2','4','6','8','a','c','e')
              THEN 'trump' ELSE 'biden' END AS a_cand
  FROM benchmark),
v AS (
  SELECT *, CASE WHEN substr(h, 1, 1) IN ('0','1','2','3') THEN NULL
                 WHEN substr(h, 32, 1) IN ('0','1','2','3','4','5','6','7') THEN 'A' ELSE 'B' END AS slot
  FROM q)
SELECT CAST(v.item_id AS BIGINT) AS item_id, ra.response AS response_a, ra.reference AS reference_a,
       rb.response AS response_b, rb.reference AS reference_b,
       CASE WHEN v.slot = 'A' THEN v.a_cand WHEN v.slot = 'B' THEN
            CASE WHEN v.a_cand = 'trump' THEN 'biden' ELSE 'trump' END END AS picked,
       CASE WHEN v.slot = 'A' THEN ra.reference WHEN v.slot = 'B' THEN rb.reference END AS picked_reference
FROM v LEFT JOIN resp ra ON ra.page_id = 2 * v.item_id LEFT JOIN resp rb ON rb.page_id = 2 * v.item_id + 1""")

# --- records, requests, dense path --------------------------------------------

oracle("truncate_tokens", f"""
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(len(regexp_extract_all(text, '{TOKEN_PATTERN}')) AS BIGINT) AS n_tokens,
       {_truncate('text', '100')} AS text
FROM documents""")

oracle("question_rows", """
WITH n AS (SELECT count(*) AS n_all, count(*) FILTER (WHERE item_id % 2 = 0) AS n_even FROM benchmark)
SELECT CAST(0 AS BIGINT) AS session_id, text AS query, (SELECT n_all FROM n) AS inserted, true AS has_time FROM benchmark
UNION ALL
SELECT 1, text, (SELECT n_even FROM n), true FROM benchmark WHERE item_id % 2 = 0""")

oracle("context_rows", f"""
WITH {CHUNK_HITS}
SELECT CAST(item_id AS BIGINT) AS item_id, CAST(doc_id AS BIGINT) AS doc_id, CAST(para_idx AS BIGINT) AS para_idx,
       CAST(piece_idx AS BIGINT) AS piece_idx, text, filename FROM hits""")

from answerlake.sources.inline import SYSTEM_CATEGORISE, SYSTEM_ENDPOINT  # noqa: E402

oracle("request_bodies", f"""
WITH p AS ({ORACLE["context_prompts"]}), c AS ({ORACLE["candidate_prompts"]})
SELECT item_id, 'endpoint' AS variant, 'gpt-4' AS model, CAST(2 AS BIGINT) AS n_messages, CAST({len(SYSTEM_ENDPOINT)} AS BIGINT) AS first_length,
       prompt AS user_content, CAST(100 AS BIGINT) AS max_tokens, CAST(0.7 AS DOUBLE) AS temperature, CAST(NULL AS DOUBLE) AS top_p
FROM p WHERE prompt IS NOT NULL
UNION ALL
SELECT CAST(item_id AS BIGINT), 'categorise', 'gpt-4o-mini', 2, {len(SYSTEM_CATEGORISE)}, text, 20, 0.0, 0.1 FROM benchmark
UNION ALL
SELECT item_id, 'candidate ' || slot, 'gpt-4o', 1, length(prompt), prompt, 150, NULL, NULL FROM c""")

oracle("debate_summary", f"""
WITH l AS ({ORACLE["answer_log"]}),
t AS (SELECT count(*) FILTER (WHERE picked = 'trump') AS a, count(*) FILTER (WHERE picked = 'biden') AS b FROM l)
SELECT CAST(q.item_id AS BIGINT) AS item_id, q.text AS question,
       CASE WHEN l.picked = 'trump' THEN 'Donald Trump' ELSE 'Joe Biden' END AS picked_name,
       (SELECT CASE WHEN a > b THEN 'Donald Trump' WHEN b > a THEN 'Joe Biden' ELSE 'Tie' END FROM t) AS winner
FROM benchmark q JOIN l ON l.item_id = q.item_id""")


def _letters(expr: str) -> str:
    return "[" + ", ".join(f"CAST(length({expr}) - length(replace({expr}, '{c}', '')) AS DOUBLE)" for c in "etaoinsr") + "]"


DENSE_CHUNKS = CHUNKS.replace(f"/ {CHUNK_CHARS}.0", "/ 300.0").replace(f"* {CHUNK_CHARS} + 1, {CHUNK_CHARS})", "* 300 + 1, 300)")
DENSE_VECTORS = DENSE_CHUNKS + f""",
dv AS (SELECT doc_id, para_idx, piece_idx, source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS filename, replace(text, chr(10), ' ') AS text FROM chunks),
dense AS (SELECT *, {_letters('text')} AS v FROM dv)"""

oracle("embed_chunks", f"""
WITH {DENSE_VECTORS}
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(para_idx AS BIGINT) AS para_idx, CAST(piece_idx AS BIGINT) AS piece_idx,
       list_aggregate([CAST(x AS VARCHAR) FOR x IN v], 'string_agg', ',') AS embedding, CAST(NULL AS VARCHAR) AS embedding_error
FROM dense""")

oracle("dense_context_prompts", f"""
WITH {DENSE_VECTORS},
asked AS (SELECT item_id, {_letters("replace(text, chr(10), ' ')")} AS q FROM benchmark),
near AS (
  SELECT item_id, filename, text, row_number() OVER (PARTITION BY item_id ORDER BY round(
           1 - list_dot_product(q, v) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(v, v))), 9), doc_id, para_idx, piece_idx) AS rank
  FROM asked CROSS JOIN dense WHERE list_dot_product(q, q) > 0 AND list_dot_product(v, v) > 0),
ctx AS (SELECT item_id, count(*) AS n, string_agg(text, ', ' ORDER BY rank) AS context, string_agg(filename, ',' ORDER BY rank) AS files
        FROM near WHERE rank <= {TOP_K} GROUP BY item_id){prompt_ctes('ctx').replace("2000 - ", "4096 - ").replace("> 2000", "> 4096")}
SELECT CAST(pr.item_id AS BIGINT) AS item_id, CAST(coalesce(pr.n, 0) AS BIGINT) AS n_contexts, coalesce(ctx.files, 'N/A') AS filenames, prompt, response
FROM pr LEFT JOIN ctx USING (item_id)""")

oracle("eval_multi_context_rows", f"""
WITH {CHUNKS},
k AS (SELECT *, source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS filename FROM chunks),
p AS ({ORACLE["eval_multi_context_pairs"]})
SELECT 'multi_context' AS evolution, a.text AS text_a, a.filename AS file_a, b.text AS text_b, b.filename AS file_b, p.n_shared
FROM p JOIN k a ON (a.doc_id, a.para_idx, a.piece_idx) = (p.a_doc_id, p.a_para_idx, p.a_piece_idx)
       JOIN k b ON (b.doc_id, b.para_idx, b.piece_idx) = (p.b_doc_id, p.b_para_idx, p.b_piece_idx)""")

oracle("answer_scores", f"""
WITH {QA},
p AS (SELECT conv_id, turn, query, response, coalesce(context, query) AS context FROM qa WHERE response IS NOT NULL),
s0 AS (SELECT conv_id, turn, query, context, regexp_split_to_array(response, '[.!?]') AS parts FROM p),
s1 AS (SELECT conv_id, turn, query, context, unnest(range(len(parts))) AS claim, unnest(parts) AS raw FROM s0),
s AS (SELECT conv_id, turn, query, context, claim, {_strip('raw')} AS text FROM s1 WHERE {_strip('raw')} <> ''),
ct AS (SELECT DISTINCT conv_id, turn, claim, term FROM (
         SELECT conv_id, turn, claim, unnest(regexp_extract_all(lower(text), '{TERM_PATTERN}')) AS term FROM s)),
xt AS (SELECT DISTINCT conv_id, turn, term, 1 AS known FROM (
         SELECT conv_id, turn, unnest(regexp_extract_all(lower(context), '{TERM_PATTERN}')) AS term FROM p)),
v AS (SELECT conv_id, turn, claim, 2 * count(known) >= count(*) AS supported FROM ct LEFT JOIN xt USING (conv_id, turn, term) GROUP BY ALL),
d AS (SELECT s.*, coalesce(v.supported, false) AS supported, {_letters('query')} AS q, {_letters('text')} AS t FROM s LEFT JOIN v USING (conv_id, turn, claim))
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, count(*) AS n_claims,
       round(avg(CAST(supported AS DOUBLE)), 6) AS faithfulness,
       round(avg(CASE WHEN list_dot_product(q, q) > 0 AND list_dot_product(t, t) > 0
                      THEN list_dot_product(q, t) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(t, t))) END), 6) AS answer_relevancy
FROM d GROUP BY ALL""")

oracle("response_records", f"""
WITH {QA}
SELECT CAST(conv_id AS BIGINT) AS query_id, CAST(turn AS BIGINT) AS turn, CAST(1 AS BIGINT) AS candidate_id, response,
       CAST(0 AS BIGINT) AS user_voted, CAST(NULL AS DOUBLE) AS answer_relevancy, coalesce(context, '') AS contexts,
       CASE WHEN context IS NULL THEN '' ELSE 'conversation/' || CAST(conv_id AS VARCHAR) END AS filenames
FROM qa WHERE response IS NOT NULL""")

oracle("dense_pruned_nearest", ORACLE["dense_topk_nearest"])
oracle("dense_pruned_farthest", ORACLE["dense_topk_farthest"])

SIMILAR_CHUNKS = CHUNKS + f""",
sets AS (
  SELECT doc_id, para_idx, piece_idx, list_sort(list_distinct(regexp_extract_all(lower(text), '{TERM_PATTERN}'))) AS s FROM chunks
  WHERE regexp_matches(lower(text), '{TERM_PATTERN}')),
cls AS (
  SELECT s, row_number() OVER () AS id, len(s) AS n, first AS rep, size FROM (
    SELECT s, min(row(doc_id, para_idx, piece_idx)) AS first, count(*) AS size FROM sets GROUP BY s)),
each AS (SELECT id, n, unnest(s) AS term FROM cls),
freq AS (SELECT term, count(*) AS df FROM each GROUP BY term),
pre AS (
  SELECT id, n, term FROM (
    SELECT id, n, term, row_number() OVER (PARTITION BY id ORDER BY df, term) AS place FROM each JOIN freq USING (term))
  WHERE place <= n - ceil(0.4 * n - 1e-9) + 1),
cand AS (SELECT DISTINCT a.id AS a, b.id AS b FROM pre a JOIN pre b ON a.term = b.term AND a.id < b.id AND 1.0 * least(a.n, b.n) / greatest(a.n, b.n) >= 0.4 - 1e-9),
shared AS (
  SELECT least(x.rep, y.rep) AS a, greatest(x.rep, y.rep) AS b, len(list_intersect(x.s, y.s)) AS k, x.n + y.n AS sizes
  FROM cand JOIN cls x ON x.id = cand.a JOIN cls y ON y.id = cand.b),
similar_pairs AS (SELECT a, b, k, 1.0 * k / (sizes - k) AS similarity FROM shared WHERE 1.0 * k / (sizes - k) >= 0.4 - 1e-9)"""


def _key(value: str, prefix: str) -> str:
    """The three parts of a chunk's key as columns."""
    return ", ".join(f"CAST({value}[{i}] AS BIGINT) AS {prefix}{k}" for i, k in enumerate(CHUNK_KEYS, 1))


oracle("similar_chunks", f"""
WITH {SIMILAR_CHUNKS}
SELECT {_key('a', 'a_')}, {_key('b', 'b_')}, CAST(k AS BIGINT) AS n_shared, round(similarity, 6) AS similarity FROM similar_pairs""")

oracle("similar_classes", f"""
WITH {SIMILAR_CHUNKS}
SELECT {_key('rep', 'rep_')}, CAST(doc_id AS BIGINT) AS doc_id, CAST(para_idx AS BIGINT) AS para_idx, CAST(piece_idx AS BIGINT) AS piece_idx, CAST(size AS BIGINT) AS size
FROM sets JOIN cls USING (s)""")

oracle("eval_test_set", f"""
WITH {SIMILAR_CHUNKS},
named AS (SELECT row(doc_id, para_idx, piece_idx) AS key, text, source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS filename,
                 md5(concat_ws('|', 'debate', CAST(doc_id AS VARCHAR), CAST(para_idx AS VARCHAR), CAST(piece_idx AS VARCHAR))) AS h FROM chunks),
one AS (SELECT key AS a, row_number() OVER (ORDER BY h, key) AS rank FROM named WHERE {_strip('text')} <> '' ORDER BY h, key LIMIT 8),
two AS (
  SELECT a, b, row_number() OVER (ORDER BY h, a, b) + 8 AS rank FROM (
    SELECT a, b, md5(concat_ws('|', 'debate', {", ".join(f"CAST({s}[{i}] AS VARCHAR)" for s in "ab" for i in (1, 2, 3))})) AS h FROM similar_pairs)
  ORDER BY h, a, b LIMIT 2),
mix AS (SELECT a, NULL AS b, rank FROM one UNION ALL SELECT a, b, rank FROM two)
SELECT rank, {MIX_CASE} AS evolution, x.text AS text_a, x.filename AS file_a, y.text AS text_b, y.filename AS file_b
FROM mix JOIN named x ON x.key = mix.a LEFT JOIN named y ON y.key = mix.b""")

oracle("alias_labels", f"""
WITH w AS (SELECT regexp_extract(text, '\\p{{L}}+', 0) AS w FROM conversations WHERE role = 'assistant'),
l AS (SELECT upper(substring(w, 1, 1)) || lower(substring(w, 2, 1048576)) AS category FROM w),
m AS (SELECT CASE WHEN category IN (SELECT unnest({TAX_LIST[:-1]}, 'Other'])) THEN category
                  ELSE ({TAX_LIST})[length(category) % {len(TAXONOMY)} + 1] END AS category FROM l)
SELECT category, count(*) AS n FROM m GROUP BY category""")

oracle("classify_hook", f"""
SELECT CAST(item_id AS BIGINT) AS item_id, CASE WHEN length(text) % 10 <> 0 THEN ({TAX_LIST})[length(text) % {len(TAXONOMY)} + 1] END AS category,
       CASE WHEN length(text) % 10 = 0 THEN 'no label' END AS error
FROM benchmark""")

oracle("token_hook", f"""
SELECT CAST(item_id AS BIGINT) AS item_id, CAST(len(string_split(text, ' ')) AS BIGINT) AS n_own,
       CAST(len(regexp_extract_all(text, '{TOKEN_PATTERN}')) AS BIGINT) AS n_tokens
FROM benchmark""")

oracle("completion_records", f"""
WITH p AS ({ORACLE["context_prompts"]})
SELECT item_id AS query_id, CAST(1 AS BIGINT) AS candidate_id, {_strip("'  Answer: ' || right(prompt, 40) || chr(10)")} AS response,
       CAST(NULL AS VARCHAR) AS error, CAST(0 AS BIGINT) AS user_voted
FROM p WHERE prompt IS NOT NULL""")

oracle("scan_paragraphs", """
WITH p AS (SELECT source, unnest(string_split(text, chr(10))) AS text FROM documents)
SELECT source, count(*) AS n_parts, CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(sum(ascii(text)) AS BIGINT) AS first_letters
FROM p WHERE text <> '' GROUP BY source""")

oracle("stream_milestones_state", ORACLE["milestones"])

oracle("pruned_threshold", ORACLE["retrieve_threshold"])
