"""DuckDB SQL for every registered query that SQL can express.

Tables are the driver's views. Regex notes: RE2's ``\\s`` lacks the vertical
tab that Java's ``\\s`` has, hence ``[,\\s\\x0b]+``.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}

LINES = r"""
lines AS (
  SELECT doc_id, i::BIGINT AS line_no, arr[i] AS value
  FROM (SELECT doc_id,
               regexp_split_to_array(regexp_replace(text, '(\r\n|\r|\n)\z', ''), '\r\n|\r|\n') AS arr
        FROM documents) d,
       range(1, len(arr) + 1) r(i)
)"""

WORDS = r"""
words AS (
  SELECT doc_id, line_no, j::BIGINT AS word_no, warr[j] AS word
  FROM (SELECT doc_id, line_no, regexp_split_to_array(value, '[,\s\x0b]+') AS warr FROM lines) l,
       range(1, len(warr) + 1) r(j)
)"""

COUNTS = "counts AS (SELECT word, count(*) AS count FROM words GROUP BY word)"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


TEXT = _with(LINES, WORDS, COUNTS)

ORACLE["text_lines"] = _with(LINES) + "SELECT doc_id, line_no, value FROM lines"
ORACLE["tokenize"] = _with(LINES, WORDS) + "SELECT doc_id, line_no, word_no, word FROM words"
ORACLE["word_count"] = TEXT + "SELECT word, count FROM counts"
ORACLE["distinct_word_count"] = TEXT + "SELECT count(*) AS distinct_words FROM counts"
ORACLE["frequent_words"] = TEXT + "SELECT word, count FROM counts WHERE count > 1000"
ORACLE["frequent_word_count"] = TEXT + "SELECT count(*) AS frequent_words FROM counts WHERE count > 1000"
ORACLE["sort_by_count"] = TEXT + "SELECT word, count FROM counts ORDER BY count DESC, word"
ORACLE["partition_report"] = TEXT + "SELECT 23 AS partitions, count(*) AS rows FROM counts"
ORACLE["top_words"] = TEXT + "SELECT word, count FROM counts ORDER BY count DESC, word LIMIT 10"

# --- messages ---------------------------------------------------------------
AGENT = r"""
agent AS (
  SELECT user_id, ts, event_id,
    CASE WHEN event_type IN ('signup', 'error') THEN 'control'
         WHEN event_type = 'purchase' AND (event_id % 2 = 1 OR event_id % 50 = 0) THEN 'tool'
         ELSE 'data' END AS kind,
    CASE WHEN event_type = 'click' THEN 'application/input_transcription'
         WHEN event_type = 'view' THEN 'text/plain'
         WHEN event_type = 'purchase' AND event_id % 2 = 0 AND event_id % 50 <> 0 THEN 'audio/pcm'
         WHEN event_type = 'purchase' THEN 'application/tool_use' END AS mime_type,
    CASE WHEN event_type = 'click' THEN 't' || event_id
         WHEN event_type = 'view' THEN 'e' || event_id
         WHEN event_type = 'purchase' AND event_id % 2 = 0 AND event_id % 50 <> 0
           THEN to_base64(encode(event_id::VARCHAR)) END AS data,
    CASE WHEN event_type = 'purchase' AND (event_id % 2 = 1 OR event_id % 50 = 0)
         THEN 'tool' || (event_id % 3) END AS tool_name,
    CASE WHEN event_type = 'signup' THEN true END AS turn_complete,
    CASE WHEN event_type = 'error' THEN true END AS interrupted
  FROM events
  WHERE NOT (event_type = 'view' AND event_id % 50 = 1)
)"""

CLIENT = r"""
client AS (
  SELECT user_id, ts, event_id,
    CASE WHEN value > 190 THEN 'x/unknown' WHEN event_type = 'click' THEN 'text/plain'
         WHEN event_type = 'view' THEN 'image/jpeg' WHEN event_type = 'purchase' THEN 'audio/pcm'
         ELSE 'application/json' END AS mime_type,
    CASE WHEN event_type = 'click' THEN 'u' || event_id
         WHEN event_type IN ('view', 'purchase') THEN to_base64(encode(event_id::VARCHAR))
         WHEN event_type = 'signup' THEN '{"event":"screen_sharing","status":"on"}'
         WHEN event_id % 10 = 0 THEN '{"event":"other","status":"off"}'
         ELSE '{"event":"screen_sharing","status":"off"}' END AS data,
    event_type, value
  FROM events
)"""

ROUTED = r"""
routed AS (
  SELECT user_id, ts, event_id,
    CASE WHEN value > 190 THEN 'error' WHEN event_type = 'click' THEN 'content'
         WHEN event_type IN ('view', 'purchase') THEN 'realtime'
         WHEN event_type = 'signup' THEN 'state'
         WHEN event_id % 10 = 0 THEN 'ignored' ELSE 'state' END AS action,
    mime_type,
    CASE WHEN value <= 190 AND event_type = 'click' THEN data END AS text,
    CASE WHEN value <= 190 AND event_type IN ('view', 'purchase')
         THEN octet_length(encode(event_id::VARCHAR))::BIGINT END AS payload_bytes,
    CASE WHEN value <= 190 AND (event_type = 'signup' OR (event_type = 'error' AND event_id % 10 <> 0))
         THEN 'screen_sharing' END AS state_key,
    CASE WHEN value <= 190 AND event_type = 'signup' THEN 'on'
         WHEN value <= 190 AND event_type = 'error' AND event_id % 10 <> 0 THEN 'off' END AS state_value,
    CASE WHEN value > 190 THEN 'unsupported_mime' END AS error
  FROM client
)"""

CUT = r"""
cut AS (
  SELECT * EXCLUDE (n_err) FROM (
    SELECT *, sum(CASE WHEN action = 'error' THEN 1 ELSE 0 END)
              OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n_err
    FROM routed) WHERE n_err = 0
)"""

ORACLE["route_agent_events"] = _with(AGENT) + "SELECT * FROM agent"
ORACLE["envelope_encode"] = _with(AGENT) + """
SELECT user_id, ts, event_id, kind,
  CASE kind WHEN 'control' THEN to_json({'turn_complete': turn_complete, 'interrupted': interrupted})
            WHEN 'tool' THEN to_json({'mime_type': mime_type, 'tool_name': tool_name})
            ELSE to_json({'mime_type': mime_type, 'data': data}) END AS message
FROM agent"""
ORACLE["envelope_decode"] = _with(CLIENT) + \
    "SELECT user_id, ts, event_id, mime_type, data, NULL::VARCHAR AS decode_error FROM client"
ORACLE["route_client_messages"] = _with(CLIENT, ROUTED) + "SELECT * FROM routed"
ORACLE["cut_at_first_error"] = _with(CLIENT, ROUTED, CUT) + "SELECT * FROM cut"

# --- sessions -------------------------------------------------------------
MSG = _with(AGENT, CLIENT, ROUTED, CUT)
W_SESS = "PARTITION BY user_id ORDER BY ts, event_id"

ORACLE["assemble_bot_messages"] = _with(AGENT) + f"""
, t AS (SELECT *, sum(CASE WHEN kind = 'control' AND coalesce(turn_complete, false) THEN 1 ELSE 0 END)
                  OVER ({W_SESS} ROWS UNBOUNDED PRECEDING) AS turn_no FROM agent)
SELECT user_id, turn_no::BIGINT AS turn_no, min(ts) AS first_ts,
       string_agg(data, '' ORDER BY ts, event_id) AS text, count(*) AS n_chunks,
       strftime(min(ts), '%H:%M') AS hhmm
FROM t WHERE mime_type = 'text/plain' GROUP BY user_id, turn_no"""

ORACLE["final_transcripts"] = _with(AGENT) + f"""
, t AS (SELECT *, sum(CASE WHEN mime_type IN ('application/tool_use', 'text/plain', 'audio/pcm') THEN 1 ELSE 0 END)
                  OVER ({W_SESS} ROWS UNBOUNDED PRECEDING) AS utterance_no FROM agent)
SELECT user_id, utterance_no::BIGINT AS utterance_no, min(ts) AS first_ts,
       first(data ORDER BY ts DESC, event_id DESC) AS text, count(*) AS n_fragments,
       strftime(min(ts), '%H:%M') AS hhmm
FROM t WHERE mime_type = 'application/input_transcription' GROUP BY user_id, utterance_no"""

ORACLE["displayed_messages"] = _with(AGENT) + f"""
, t AS (SELECT *, sum(CASE WHEN kind = 'control' AND coalesce(turn_complete, false) THEN 1 ELSE 0 END)
                  OVER ({W_SESS} ROWS UNBOUNDED PRECEDING) AS turn_no,
               sum(CASE WHEN mime_type IN ('application/tool_use', 'text/plain', 'audio/pcm') THEN 1 ELSE 0 END)
                  OVER ({W_SESS} ROWS UNBOUNDED PRECEDING) AS utterance_no FROM agent),
shown AS (
  SELECT user_id, min(ts) AS ts, first(event_id ORDER BY ts, event_id) AS event_id, 'bot' AS sender,
         string_agg(data, '' ORDER BY ts, event_id) AS text
  FROM t WHERE mime_type = 'text/plain' GROUP BY user_id, turn_no
  UNION ALL
  SELECT user_id, min(ts), first(event_id ORDER BY ts, event_id), 'user', first(data ORDER BY ts DESC, event_id DESC)
  FROM t WHERE mime_type = 'application/input_transcription' GROUP BY user_id, utterance_no
  UNION ALL
  SELECT user_id, ts, event_id, 'bot', '\U0001f6e0\ufe0f Using tool: ' || tool_name FROM t WHERE mime_type = 'application/tool_use')
SELECT user_id, row_number() OVER ({W_SESS})::BIGINT AS message_no, sender, text, ts AS first_ts, event_id AS first_event_id,
       strftime(ts, '%H:%M') AS hhmm
FROM shown"""

ORACLE["session_state_latest"] = MSG + """
SELECT user_id, state_key, state_value, ts AS updated_ts, event_id AS updated_event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, state_key ORDER BY ts DESC, event_id DESC) AS rn
  FROM cut WHERE action = 'state') WHERE rn = 1"""

ORACLE["state_as_of_event"] = MSG + f"""
SELECT *, last_value(CASE WHEN action = 'state' THEN state_value END IGNORE NULLS)
          OVER ({W_SESS} ROWS UNBOUNDED PRECEDING) AS screen_sharing
FROM cut"""

CHANGES = f"""
onoff AS (SELECT * FROM cut WHERE action = 'state' AND state_value IN ('on', 'off')),
chg AS (SELECT * FROM (SELECT *, coalesce(lag(state_value) OVER ({W_SESS}), 'off') AS prev FROM onoff)
        WHERE state_value <> prev)"""

ORACLE["screen_share_intervals"] = _with(AGENT, CLIENT, ROUTED, CUT, CHANGES) + f"""
SELECT user_id, ts AS start_ts, event_id AS start_event_id, end_ts, end_event_id FROM (
  SELECT *, lead(ts) OVER ({W_SESS}) AS end_ts, lead(event_id) OVER ({W_SESS}) AS end_event_id FROM chg)
WHERE state_value = 'on'"""

ACT = """
act AS (SELECT user_id, ts, event_id, 0 AS side FROM cut WHERE action = 'state' AND state_value = 'on'
        UNION ALL
        SELECT user_id, ts, event_id, 1 AS side FROM agent WHERE mime_type IN ('text/plain', 'audio/pcm'))"""


def _sessions_sql(gap: str) -> str:
    w = "PARTITION BY user_id ORDER BY ts, event_id, side"
    return _with(AGENT, CLIENT, ROUTED, CUT, ACT) + f"""
, g AS (SELECT *, CASE WHEN lag(ts) OVER ({w}) IS NULL OR ts > lag(ts) OVER ({w}) + {gap} THEN 1 ELSE 0 END AS new
        FROM act),
s AS (SELECT *, sum(new) OVER ({w} ROWS UNBOUNDED PRECEDING) AS session_no FROM g)
SELECT user_id, session_no::BIGINT AS session_no, min(ts) AS session_start, max(ts) + {gap} AS session_end,
       count(*) AS n_events
FROM s GROUP BY user_id, session_no"""


ORACLE["activity_sessions"] = _sessions_sql("INTERVAL 300 SECOND")
ORACLE["activity_sessions_2h"] = _sessions_sql("INTERVAL 7200 SECOND")


def _sample_sql(unit: str) -> str:
    return MSG + f"""
SELECT user_id, date_trunc('{unit}', ts) AS window_start, date_trunc('{unit}', ts) + INTERVAL 1 {unit} AS window_end,
       first(event_id ORDER BY ts DESC, event_id DESC) AS frame_event_id, count(*) AS n_frames
FROM cut WHERE action = 'realtime' AND mime_type = 'image/jpeg'
GROUP BY user_id, date_trunc('{unit}', ts)"""


ORACLE["sample_per_second"] = _sample_sql("second")
ORACLE["sample_per_hour"] = _sample_sql("hour")

ORACLE["idle_forced_stops"] = _with(AGENT, CLIENT, ROUTED, CUT, CHANGES) + """
, tl AS (
  SELECT o.user_id, o.ts, o.event_id, 0 AS side, o.state_value = 'on' AS arm,
         CASE WHEN c.event_id IS NOT NULL THEN c.state_value = 'on' END AS iv_open,
         CASE WHEN c.event_id IS NOT NULL THEN c.ts END AS iv_start
  FROM onoff o LEFT JOIN chg c ON o.user_id = c.user_id AND o.event_id = c.event_id
  UNION ALL
  SELECT user_id, ts, event_id, 1, true, NULL, NULL FROM agent WHERE mime_type IN ('text/plain', 'audio/pcm')),
sc AS (
  SELECT *, last_value(iv_open IGNORE NULLS) OVER w1 AS cur_open,
            last_value(iv_start IGNORE NULLS) OVER w1 AS cur_start,
            lead(ts) OVER w2 AS next_ts
  FROM tl
  WINDOW w1 AS (PARTITION BY user_id ORDER BY ts, event_id, side ROWS UNBOUNDED PRECEDING),
         w2 AS (PARTITION BY user_id ORDER BY ts, event_id, side)),
hz AS (SELECT user_id, max(ts) AS horizon FROM (SELECT user_id, ts FROM agent UNION ALL SELECT user_id, ts FROM cut)
       GROUP BY user_id),
f AS (
  SELECT sc.*, ts + INTERVAL 300000 MILLISECOND AS deadline FROM sc JOIN hz USING (user_id)
  WHERE arm AND coalesce(cur_open, false)
    AND CASE WHEN next_ts IS NULL THEN ts + INTERVAL 300000 MILLISECOND <= horizon
             ELSE next_ts > ts + INTERVAL 300000 MILLISECOND END)
SELECT user_id, cur_start AS interval_start, min(deadline) AS stop_ts,
       first(event_id ORDER BY deadline, event_id) AS armed_event_id
FROM f GROUP BY user_id, cur_start"""

# W5 with a ring of 4 slots: the newest 3 samples after the last flush.
ORACLE["retain_latest"] = _with(AGENT) + f"""
, flushes AS (SELECT user_id, max(ts) AS last_flush FROM agent
              WHERE kind = 'control' AND coalesce(interrupted, false) AND NOT coalesce(turn_complete, false)
              GROUP BY user_id),
chunks AS (SELECT a.user_id, a.ts, a.event_id, a.event_id::VARCHAR AS s FROM agent a
           LEFT JOIN flushes f USING (user_id)
           WHERE a.mime_type = 'audio/pcm' AND (f.last_flush IS NULL OR a.ts > f.last_flush)
             AND length(a.event_id::VARCHAR) % 2 = 0),
samples AS (SELECT user_id, ts, event_id, i::BIGINT AS sample_no,
                   ascii(substr(s, 2 * i + 1, 1)) + 256 * ascii(substr(s, 2 * i + 2, 1)) AS u
            FROM chunks, range(0, length(s) // 2) r(i)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC, sample_no DESC) AS rn
           FROM samples)
SELECT user_id, ts, event_id, sample_no, u::SMALLINT AS sample, (u / 32768.0)::FLOAT AS value
FROM ranked WHERE rn <= 3"""

# --- frames and audio samples ------------------------------------------------
SIG = """
sig AS (
  SELECT label AS stream, vec_id AS frame_id, array_to_string(
           list_transform(embedding, lambda x: CASE WHEN x::DOUBLE > mean THEN '1' ELSE '0' END), '') AS signature
  FROM (SELECT *, list_reduce(list_transform(embedding, lambda x: x::DOUBLE), lambda a, b: a + b)
                  / len(embedding) AS mean FROM embeddings))"""

ORACLE["mean_threshold_signature"] = _with(SIG) + "SELECT stream, frame_id, signature FROM sig"

ORACLE["frame_luma_signature"] = """
WITH l AS (
  SELECT vec_id, list_transform(range(0, 64), lambda i: 0.299 * embedding[i + 1]::DOUBLE
            + 0.587 * embedding[(i + 21) % 64 + 1]::DOUBLE + 0.114 * embedding[(i + 42) % 64 + 1]::DOUBLE) AS l
  FROM embeddings),
m AS (SELECT *, list_reduce(l, lambda a, b: a + b) AS luma_sum FROM l)
SELECT vec_id, luma_sum,
       array_to_string(list_transform(l, lambda x: CASE WHEN x > luma_sum / 64 THEN '1' ELSE '0' END), '') AS signature
FROM m"""

ORACLE["hamming_distance"] = _with(SIG) + """
SELECT stream, frame_id, lag(frame_id) OVER w AS prev_frame_id,
       CASE WHEN lag(signature) OVER w IS NULL THEN NULL ELSE hamming(signature, lag(signature) OVER w) END::INTEGER
         AS distance
FROM sig WINDOW w AS (PARTITION BY stream ORDER BY frame_id)"""


TIMED = """,
timed AS (SELECT *, TIMESTAMP '2024-01-01' + to_milliseconds(frame_id * 40) AS ts FROM sig),
sampled AS (
  SELECT stream, first(frame_id ORDER BY ts DESC, frame_id DESC) AS frame_id, first(signature ORDER BY ts DESC, frame_id DESC) AS signature
  FROM timed GROUP BY stream, date_trunc('second', ts))"""


def _near_dup_sql(t: int, source: str = "sig") -> str:
    return "WITH RECURSIVE " + SIG.strip() + (TIMED if source != "sig" else "") + f""",
n AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY frame_id) AS rn FROM {source}),
walk AS (
  SELECT stream, rn, frame_id, signature, signature AS last_kept, true AS kept FROM n WHERE rn = 1
  UNION ALL
  SELECT n.stream, n.rn, n.frame_id, n.signature,
         CASE WHEN hamming(n.signature, w.last_kept) > {t} THEN n.signature ELSE w.last_kept END,
         hamming(n.signature, w.last_kept) > {t}
  FROM walk w JOIN n ON n.stream = w.stream AND n.rn = w.rn + 1)
SELECT stream, frame_id, signature FROM walk WHERE kept"""


ORACLE["sampled_frames_t28"] = f"""
SELECT stream, TIMESTAMP '2024-01-01' + to_milliseconds(frame_id * 40) AS ts, frame_id, signature
FROM ({_near_dup_sql(28, 'sampled')})"""
ORACLE["suppress_near_duplicates"] = _near_dup_sql(1)
ORACLE["suppress_near_duplicates_t28"] = _near_dup_sql(28)
ORACLE["suppress_near_duplicates_t32"] = _near_dup_sql(32)

QUANT = """
qz AS (
  SELECT vec_id, list_transform(embedding, lambda x:
           ((((trunc(x::DOUBLE * 32767)::BIGINT + 32768) % 65536 + 65536) % 65536) - 32768)::SMALLINT) AS q
  FROM embeddings)"""

ORACLE["quantize_int16"] = _with(QUANT) + """
SELECT vec_id, q[1]::INTEGER AS q_first, list_min(q)::INTEGER AS q_min, list_max(q)::INTEGER AS q_max,
       list_reduce(list_transform(q, lambda x: x::BIGINT), lambda a, b: a + b) AS q_sum
FROM qz"""

ORACLE["retain_latest_chunks"] = _with(QUANT) + """
, samples AS (SELECT e.label AS user_id, z.vec_id // 250 AS event_id, z.vec_id, i, q[i] AS sample
              FROM qz z JOIN embeddings e USING (vec_id), range(1, 65) r(i)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_id ORDER BY vec_id, i) - 1 AS sample_no FROM samples
             WHERE NOT (user_id % 2 = 0 AND event_id = 0)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC, sample_no DESC) AS rn FROM numbered)
SELECT user_id, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(event_id) AS ts, event_id::BIGINT AS event_id, sample_no::BIGINT AS sample_no,
       sample, (sample::DOUBLE / 32768.0)::FLOAT AS value
FROM ranked WHERE rn <= 2000"""

ORACLE["dequantize_int16"] = _with(QUANT) + """
SELECT vec_id,
       list_reduce(list_transform(q, lambda x: (x::DOUBLE / 32768.0)::FLOAT::DOUBLE), lambda a, b: a + b) AS dq_sum,
       (q[1]::DOUBLE / 32768.0)::FLOAT::DOUBLE AS dq_first
FROM qz"""

# --- sources -------------------------------------------------------------------
ORACLE["whole_text_files"] = """
SELECT printf('page-%09d.html', page_id) AS artifact_name, length(html)::BIGINT AS n_chars,
       sha256(html) AS digest, 'ok' AS status FROM pages"""

ORACLE["binary_files"] = """
SELECT printf('item-%09d.pdf', item_id) AS artifact_name, octet_length(encode(text))::BIGINT AS length,
       sha256(text) AS digest, 'ok' AS status FROM benchmark"""

ORACLE["driver_log_text"] = """
WITH c AS (SELECT conv_id, count(*) AS n_chunks, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id)
SELECT conv_id AS job_id, n_chunks, text FROM c
UNION ALL SELECT -1 - conv_id, NULL, NULL FROM c
UNION ALL SELECT -1000003 * conv_id - 1, NULL, NULL FROM c WHERE conv_id % 10 = 1
UNION ALL SELECT conv_id + 1000000000000, 0, '' FROM c WHERE conv_id % 10 = 0"""

ORACLE["driver_log_chunks"] = """
SELECT conv_id AS job_id, printf('driveroutput.%09d', turn) AS file_name, text FROM conversations"""

KB_SQL = r"""
SELECT lang AS product, DATE '2024-01-01' + (doc_id % 365)::INTEGER AS updated_at, source AS category,
       nullif(text, '') AS explanation,
       CASE WHEN doc_id = 5 THEN NULL ELSE n_chars::VARCHAR END AS solution
FROM documents WHERE doc_id <> 7"""
ORACLE["kb_sheet_scan"] = KB_SQL
ORACLE["kb_refresh"] = KB_SQL

ORACLE["cluster_names"] = """
SELECT printf('nation-%d-page-%d', s_nationkey, s_suppkey // 100) AS listing_id, s_name AS cluster_name
FROM supplier"""

ORACLE["cluster_lookup"] = """
SELECT s_name AS request_name, 'ok' AS status,
       to_json({'clusterName': s_name, 'config': {'nationKey': s_nationkey, 'supplierKey': s_suppkey}}) AS details
FROM supplier
UNION ALL
SELECT lower(s_name), 'not found', NULL FROM supplier"""

# --- search -----------------------------------------------------------------------
TERMS = r"list_filter(regexp_split_to_array(lower({t}), '[^\p{{L}}\p{{N}}]+'), lambda w: length(w) > 0)"


def _bm25_sql(questions: str, cases: str, name: str) -> str:
    return f"""
{name}_d AS (SELECT case_id, terms, len(terms)::BIGINT AS dl FROM
             (SELECT case_id, {TERMS.format(t='text')} AS terms FROM ({cases}))),
{name}_st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM {name}_d),
{name}_p AS (SELECT term, case_id, dl, count(*) AS tf FROM
             (SELECT case_id, dl, unnest(terms) AS term FROM {name}_d) GROUP BY ALL),
{name}_q AS (SELECT DISTINCT question_id, unnest({TERMS.format(t='text')}) AS term FROM ({questions})),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_p WHERE term IN (SELECT term FROM {name}_q) GROUP BY term),
{name}_s AS (
  SELECT q.question_id, p.case_id,
         round(sum(ln(1 + (s.n - f.df + 0.5) / (f.df + 0.5)) * p.tf::DOUBLE * 2.2
                   / (p.tf::DOUBLE + 1.2 * (1 - 0.75 + 0.75 * p.dl::DOUBLE / s.avgdl))), 6) AS score
  FROM {name}_q q JOIN {name}_p p USING (term) JOIN {name}_df f USING (term) CROSS JOIN {name}_st s
  GROUP BY q.question_id, p.case_id),
{name} AS (SELECT question_id, rank, case_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, case_id) AS rank FROM {name}_s)
  WHERE rank <= 10)"""


Q_SQL = "SELECT item_id AS question_id, text FROM benchmark"
PARITY = "(regexp_extract(source, '(\\d+)$', 1)::INTEGER % 2)"

ORACLE["kb_search"] = "WITH " + _bm25_sql(Q_SQL, "SELECT doc_id AS case_id, text FROM documents", "bm").strip() + \
    "\nSELECT * FROM bm"

ORACLE["kb_search_with_fallback"] = "WITH " + _bm25_sql(
    Q_SQL, f"SELECT doc_id AS case_id, text FROM documents WHERE {PARITY} = 0", "ex").strip() + """,
answered AS (SELECT DISTINCT question_id FROM ex WHERE score >= 60.0),""" + _bm25_sql(
    f"SELECT * FROM ({Q_SQL}) WHERE question_id NOT IN (SELECT question_id FROM answered)",
    f"SELECT doc_id AS case_id, text FROM documents WHERE {PARITY} = 1", "ge") + """
SELECT question_id, 'expert' AS origin, rank, case_id, score FROM ex
WHERE question_id IN (SELECT question_id FROM answered)
UNION ALL
SELECT question_id, 'general', rank, case_id, score FROM ge"""

_CELL = "coalesce({c}, chr(0))"
_REINDEX_CASES = f"""
SELECT ('0x' || substr(sha256(concat_ws(chr(31), {', '.join(_CELL.format(c=c) for c in
        ('product', 'updated_at::DATE::VARCHAR', 'category', 'explanation', 'solution'))})), 1, 15))::BIGINT AS case_id,
       explanation AS text
FROM (SELECT DISTINCT * FROM (
  SELECT product, updated_at, category, solution,
         CASE WHEN kind = 7 THEN explanation || ' revised answer' ELSE explanation END AS explanation
  FROM kb WHERE kind <> 13
  UNION ALL SELECT 'new', updated_at, category, solution, explanation FROM kb WHERE kind = 21))"""
ORACLE["kb_reindex_search"] = f"WITH kb AS (SELECT *, coalesce(length(explanation) % 100, 0) AS kind FROM ({KB_SQL}))," + \
    _bm25_sql(Q_SQL, _REINDEX_CASES, "bm") + "\nSELECT * FROM bm"

ORACLE["config_findings"] = """
WITH facts AS (
  SELECT p_partkey AS entity, 'p_size' AS property, p_size::DOUBLE AS value FROM part
  UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part),
rules(rule_id, property, op, threshold, advice) AS (VALUES
  ('R1', 'p_size', '>', 45.0, 'size above 45: split the part'),
  ('R2', 'p_size', '<', 5.0, 'size below 5: merge with a neighbour'),
  ('R3', 'p_retailprice', '>', 990.0, 'retail price above 990: review pricing'),
  ('R4', 'p_retailprice', '<=', 905.0, 'retail price at most 905: check the margin'))
SELECT entity, property, value, rule_id, advice FROM facts JOIN rules USING (property)
WHERE CASE op WHEN '>' THEN value > threshold WHEN '<' THEN value < threshold
              WHEN '<=' THEN value <= threshold ELSE false END"""

ORACLE["log_field_filter"] = """
SELECT * FROM events WHERE json_extract_string(props, '$.k') = '7' AND event_type = 'error'"""

# --- streaming (final results equal their batch twins) ------------------------------
ORACLE["stream_route_events"] = ORACLE["route_agent_events"]
ORACLE["stream_route_messages"] = ORACLE["route_client_messages"]
CUT_COLUMNS = "user_id, ts, event_id, action, mime_type, state_key, state_value"
ORACLE["stream_cut_at_first_error"] = f"SELECT {CUT_COLUMNS} FROM ({ORACLE['cut_at_first_error']})"
ORACLE["stream_session_state"] = ORACLE["session_state_latest"]
ORACLE["stream_activity_sessions"] = (
    f"SELECT user_id, session_start, session_end, n_events FROM ({ORACLE['activity_sessions']})")
ORACLE["stream_bot_messages"] = ORACLE["assemble_bot_messages"]
ORACLE["stream_suppress_near_duplicates_t28"] = _near_dup_sql(28)
ORACLE["stream_sampled_frames_t28"] = ORACLE["sampled_frames_t28"]

ORACLE["stream_idle_stops"] = ORACLE["idle_forced_stops"]
ORACLE["stream_sample_per_second"] = ORACLE["sample_per_second"]

# S1 over files: the text writer appends one newline to every document.
ORACLE["word_count_text_source"] = _with(LINES.replace("FROM documents", "FROM (SELECT doc_id, text || chr(10) AS text FROM documents)"), WORDS, COUNTS) + \
    "SELECT word, count FROM counts"
