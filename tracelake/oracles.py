"""What the queries must return, as SQL straight over the driver's tables."""

from __future__ import annotations

EV = r"""
ev AS (
  SELECT event_id AS i, user_id AS u, event_type AS et, value, ts, CAST(regexp_extract(props, '\d+') AS BIGINT) AS k,
         strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso, 's' || user_id AS sid, '/Projects/p' || (user_id % 10) AS cwd,
         '1.0.' || (user_id % 5) AS ver, '/logs/p' || (user_id % 10) || '/s' || user_id || '.jsonl' AS path,
         lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prev, event_id % 2 = 0 AS asst,
         event_id % 2 = 1 AND event_id % 101 = 1 AS odd_type
  FROM events),
rec AS (SELECT * FROM ev WHERE NOT odd_type),
sess AS (
  SELECT sid AS session_id, min_by(cwd, i) AS project_path, min_by(iso, i) AS first_seen_at, max(iso) AS last_seen_at,
         min_by(ver, i) AS version, CAST(NULL AS VARCHAR) AS slug, 'main' AS git_branch FROM rec GROUP BY sid),
msg AS (
  SELECT 'e' || i AS uuid, sid AS session_id, CASE WHEN asst THEN 'assistant' ELSE 'user' END AS type, iso AS timestamp,
         'e' || prev AS parent_uuid, false AS is_sidechain, CASE WHEN asst THEN 'm' || (i % 3) END AS model,
         CASE WHEN asst THEN 'tool_use' END AS stop_reason, ver AS version, NOT asst AND i % 97 = 1 AS is_compact_summary,
         CASE WHEN NOT asst AND i % 89 = 1 THEN 'plan ' || et || ' ' || i END AS plan_content, i, et, ts FROM rec),
usage AS (
  SELECT 'e' || i AS message_uuid, CAST(floor(value) AS BIGINT) AS input_tokens, k AS output_tokens,
         CAST(NULL AS BIGINT) AS cache_creation_input_tokens, CASE WHEN i % 4 = 0 THEN k % 7 END AS cache_read_input_tokens
  FROM rec WHERE asst),
res AS (SELECT 't' || (i - 1) AS tool_use_id, 'res ' || i AS result_content, et = 'error' AS is_error FROM rec WHERE NOT asst AND i % 10 <> 3),
tool AS (
  SELECT 'e' || i AS message_uuid, 't' || i AS tool_use_id,
         CASE et WHEN 'purchase' THEN 'Write' WHEN 'click' THEN 'Edit' WHEN 'view' THEN 'Read' ELSE 'Bash' END AS tool_name,
         result_content, is_error, i, et, k, sid AS session_id, iso AS timestamp
  FROM rec LEFT JOIN res ON res.tool_use_id = 't' || i WHERE asst),
fop AS (
  SELECT session_id, '/src/f' || (k % 20) || '.py' AS file_path,
         CASE et WHEN 'purchase' THEN 'write' WHEN 'click' THEN 'edit' WHEN 'view' THEN 'read' ELSE 'bash_rm' END AS operation_type, timestamp,
         CASE et WHEN 'purchase' THEN 'v' || i || ' x' WHEN 'click' THEN 'x' || i END AS content,
         CASE WHEN et = 'click' THEN 'x' END AS old_content,
         CASE WHEN et = 'error' THEN 'rm /src/f' || (k % 20) || '.py' END AS command,
         CASE WHEN et = 'error' THEN 't' || i || ':bash:rm:/src/f' || (k % 20) || '.py' ELSE 't' || i END AS tool_use_id,
         message_uuid, result_content AS result_summary, coalesce(is_error, false) AS is_error
  FROM tool WHERE et <> 'signup'),
git AS (
  SELECT session_id, op AS operation_type, 'git add -A && git commit -m "c' || i || '"' AS command,
         CASE WHEN op = 'commit' THEN 'c' || i END AS commit_message, CAST(NULL AS VARCHAR) AS branch, tool_use_id, message_uuid, timestamp
  FROM tool, (VALUES ('add'), ('commit')) o(op) WHERE et = 'signup'),
files AS (
  SELECT session_id, file_path, min(timestamp) AS first_seen, max(timestamp) AS last_modified,
         count(*) FILTER (operation_type <> 'read') AS operation_count FROM fop GROUP BY ALL),
blocks AS (
  SELECT 'e' || i AS message_uuid, 0 AS block_index, 'text' AS block_type, 'did ' || et || ' ' || i AS text_content, NULL AS tool_use_id, NULL AS tool_name, NULL AS is_error FROM rec WHERE asst
  UNION ALL SELECT message_uuid, 1, 'tool_use', NULL, tool_use_id, tool_name, NULL FROM tool
  UNION ALL SELECT 'e' || i, 0, 'text', 'say ' || et || ' ' || i, NULL, NULL, NULL FROM rec WHERE NOT asst AND i % 10 = 3
  UNION ALL SELECT 'e' || i, 0, 'tool_result', 'res ' || i, 't' || (i - 1), NULL, et = 'error' FROM rec WHERE NOT asst AND i % 10 <> 3),
obs AS (
  SELECT field_name, ver AS version, iso, i,
         CASE field_name WHEN 'brandNew' THEN '{"n":' || i || '}' WHEN 'isCompactSummary' THEN 'true' ELSE '"plan ' || et || ' ' || i || '"' END AS value
  FROM rec, (VALUES ('brandNew', 50), ('isCompactSummary', 97), ('planContent', 89)) f(field_name, m) WHERE NOT asst AND i % m = 1),
drift AS (
  SELECT field_name, 'user' AS record_type, version, count(*) AS occurrence_count, min(iso) AS first_seen_at, max(iso) AS last_seen_at,
         arg_min(value, o) AS sample_value
  FROM (SELECT obs.*, row_number() OVER (ORDER BY r.path, r.i) AS o FROM obs JOIN rec r USING (i)) GROUP BY ALL),
typedrift AS (
  SELECT 'mystery' AS type_name, ver AS version, count(*) AS occurrence_count, min(iso) AS first_seen_at, max(iso) AS last_seen_at FROM ev WHERE odd_type GROUP BY ALL),
counts AS (
  SELECT s.*, coalesce(m.n, 0) AS message_count, m.model
  FROM sess s LEFT JOIN (SELECT session_id, count(*) AS n, (arg_min(model, (timestamp, uuid)) FILTER (model IS NOT NULL)) AS model FROM msg GROUP BY 1) m USING (session_id)),
proj AS (
  SELECT cwd AS project_path, 'p' || (min(u) % 10) AS display_name, min(iso) AS first_seen_at, max(iso) AS last_seen_at,
         (SELECT count(*) FROM sess WHERE sess.project_path = cwd) AS session_count FROM rec GROUP BY cwd),
agents AS (
  SELECT agent_id, arg_min(sid, o) AS session_id, arg_min(iso, o) AS first_seen_at, max(iso) AS last_seen_at
  FROM (SELECT 'g' || (u % 20) AS agent_id, sid, iso, row_number() OVER (ORDER BY path, i) AS o FROM rec WHERE i % 30 = 7) GROUP BY 1),
live AS (SELECT * FROM msg WHERE NOT is_compact_summary),
per AS (
  SELECT s.session_id, s.project_path, s.first_seen_at, coalesce(m.n, 0) AS message_count, coalesce(m.a, 0) AS input_tokens,
         coalesce(m.b, 0) AS output_tokens, coalesce(m.a + m.b, 0) AS total_tokens, coalesce(m.c, 0) AS cache_read_tokens,
         coalesce(f.n, 0) AS file_ops, coalesce(g.n, 0) AS git_ops, m.last_activity
  FROM sess s
  LEFT JOIN (SELECT session_id, count(*) AS n, sum(input_tokens) AS a, sum(output_tokens) AS b, sum(cache_read_input_tokens) AS c, max(timestamp) AS last_activity
             FROM live LEFT JOIN usage ON message_uuid = uuid GROUP BY 1) m USING (session_id)
  LEFT JOIN (SELECT session_id, count(*) AS n FROM fop GROUP BY 1) f USING (session_id)
  LEFT JOIN (SELECT session_id, count(*) AS n FROM git GROUP BY 1) g USING (session_id)),
line AS (
  SELECT session_id, timestamp, 'file_operation' AS event_type, operation_type AS name, file_path AS detail, message_uuid, tool_use_id FROM fop
  UNION ALL SELECT session_id, timestamp, 'git_operation', operation_type, coalesce(commit_message, command), message_uuid, tool_use_id FROM git
  UNION ALL SELECT session_id, timestamp, 'tool_execution', tool_name, NULL, message_uuid, tool_use_id FROM tool)
"""

PG = r"""
pg AS (
  SELECT page_id AS p, url, 'a' || page_id AS uuid, strftime(to_timestamp(1767225600 + page_id * 60) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%gZ') AS iso,
         's' || (page_id % 150) AS sid, '/Projects/p' || (page_id % 10) AS cwd, CASE WHEN page_id % 5 > 0 THEN '1.0.' || (page_id % 5) END AS ver,
         CASE WHEN page_id % 8 = 3 THEN ['system', 'summary', 'queue-operation', 'progress', 'file-history-snapshot', 'broken'][CAST(page_id // 8 % 6 AS INT) + 1] ELSE 'attachment' END AS kind,
         ['hook_success', 'hook_permission_decision', 'mcp_instructions_delta', 'skill_listing', 'edited_text_file', 'nested_memory', 'mood_ring'][CAST(page_id % 7 AS INT) + 1] AS inner_type
  FROM pages),
att AS (SELECT * FROM pg WHERE kind = 'attachment'),
psess AS (SELECT sid AS session_id, arg_min(cwd, p) AS project_path FROM pg WHERE kind IN ('attachment', 'system', 'progress') GROUP BY 1),
hooks AS (
  SELECT uuid AS attachment_uuid, CASE WHEN h THEN 'lint' END AS hook_name, CASE WHEN h THEN 'PostToolUse' ELSE 'PreToolUse' END AS hook_event, 't' || (p * 2) AS tool_use_id,
         CASE WHEN h THEN p % 3 END AS exit_code, CASE WHEN h THEN p END AS duration_ms, CASE WHEN h THEN url END AS stdout, CASE WHEN h THEN '' END AS stderr,
         CASE WHEN h THEN 'make lint' END AS command, CASE WHEN NOT h THEN CASE WHEN p % 4 = 1 THEN 'deny' ELSE 'allow' END END AS decision, iso AS timestamp, p
  FROM (SELECT *, inner_type = 'hook_success' AS h FROM att WHERE inner_type IN ('hook_success', 'hook_permission_decision'))),
adocs AS (
  SELECT uuid AS attachment_uuid, part, inner_type,
         CASE inner_type WHEN 'mcp_instructions_delta' THEN CASE part WHEN 0 THEN 'block one ' ELSE 'block two ' END || url
              WHEN 'skill_listing' THEN 'skills of page ' || p || ' at ' || url WHEN 'edited_text_file' THEN 'snippet of page ' || p ELSE 'memory of page ' || p END AS text_content
  FROM att, (VALUES (0), (1)) x(part)
  WHERE inner_type IN ('mcp_instructions_delta', 'skill_listing', 'edited_text_file', 'nested_memory') AND (part = 0 OR inner_type = 'mcp_instructions_delta')),
marks AS (SELECT page_id AS id, '/Projects/p' || (page_id % 10) AS project_path, url AS label, 'e' || (page_id * 2) AS assistant_uuid, 'tag' || (page_id % 3) AS tag FROM pages)
"""

TOKENS = r"regexp_extract_all(strip_accents(lower({0})), '[\p{{L}}\p{{N}}]+')"


def ev(sql: str) -> str:
    return f"WITH {EV} {sql}"


def pg(sql: str) -> str:
    return f"WITH {PG} {sql}"


def _phrase(docs: str, terms: list[str], key: str = "key") -> str:
    """hits (key, tf, doc_len, score, first) of a phrase over ``docs`` (key, text)."""
    agree = " AND ".join(f"list_extract(t, CAST(x + {i} AS BIGINT)) = '{w}'" for i, w in enumerate(terms))
    return f"""
tok AS (SELECT key, {TOKENS.format("coalesce(text, '')")} AS t FROM ({docs})),
st AS (SELECT count(*) AS n_docs, avg(len(t)) AS avg_len FROM tok),
m AS (SELECT key, len(t) AS doc_len, list_filter(range(1, CAST(len(t) - {len(terms) - 2} AS BIGINT)), lambda x: {agree}) AS places FROM tok),
h AS (SELECT key, doc_len, len(places) AS tf, list_min(places) - 1 AS first FROM m WHERE len(places) > 0),
hits AS (
  SELECT key, tf, doc_len, first,
         -greatest(ln((n_docs - (SELECT count(*) FROM h) + 0.5) / ((SELECT count(*) FROM h) + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len)) AS score
  FROM h, st)"""


def _near(ops: str, window: int, columns: str) -> str:
    return ev(f"""SELECT {columns} FROM {ops} o JOIN live mo ON mo.uuid = o.message_uuid
  JOIN msg ma ON ma.session_id = mo.session_id AND ma.type = 'assistant' AND ma.i % 2 = 0
   AND date_trunc('millisecond', ma.ts) <= date_trunc('millisecond', mo.ts) AND date_trunc('millisecond', ma.ts) >= date_trunc('millisecond', mo.ts) - INTERVAL {window} SECOND
  JOIN blocks b ON b.message_uuid = ma.uuid AND b.block_type = 'text' JOIN sess s ON s.session_id = o.session_id""")


OP = "session_id, file_path, operation_type, timestamp, content, old_content, command, tool_use_id, message_uuid"
SESSION = "session_id, project_path, first_seen_at, last_seen_at, version, message_count, model"
FOLD = """
muts AS (SELECT * FROM fop WHERE operation_type IN ('write', 'edit') {0}),
lastw AS (SELECT session_id, file_path, max((timestamp, tool_use_id)) AS w FROM muts WHERE operation_type = 'write' GROUP BY 1, 2),
steps AS (SELECT m.*, row_number() OVER (PARTITION BY session_id, file_path ORDER BY timestamp, tool_use_id) AS n FROM muts m JOIN lastw USING (session_id, file_path) WHERE (timestamp, tool_use_id) >= w),
fold AS (
  SELECT session_id, file_path, n, content FROM steps WHERE n = 1
  UNION ALL SELECT s.session_id, s.file_path, s.n, CASE WHEN s.operation_type = 'write' THEN s.content ELSE replace(f.content, s.old_content, s.content) END
  FROM fold f JOIN steps s ON s.session_id = f.session_id AND s.file_path = f.file_path AND s.n = f.n + 1)
SELECT DISTINCT fop.session_id, fop.file_path, f.content, CAST(coalesce(f.n, 0) AS BIGINT) AS applied
FROM fop LEFT JOIN (SELECT session_id, file_path, arg_max(content, n) AS content, max(n) AS n FROM fold GROUP BY 1, 2) f USING (session_id, file_path)"""


def rec(sql: str) -> str:
    return f"WITH RECURSIVE {EV}, {sql}"


TOK_SUM = """count(*) AS message_count, coalesce(sum(input_tokens), 0)::BIGINT AS input_tokens, coalesce(sum(output_tokens), 0)::BIGINT AS output_tokens,
  sum(cache_creation_input_tokens)::BIGINT AS cache_creation_tokens, sum(cache_read_input_tokens)::BIGINT AS cache_read_tokens"""

#: The tool inputs of the rendered assistant records as their lines have them: an object's fields in order of their names.
INPUT = r"""input AS (
  SELECT *, '/src/f' || (k % 20) || '.py' AS f, CASE et WHEN 'purchase' THEN 'Write' WHEN 'click' THEN 'Edit' WHEN 'view' THEN 'Read' ELSE 'Bash' END AS tool_name,
         CASE et WHEN 'purchase' THEN '{"content":"v' || i || ' x","file_path":"' || f || '"}' WHEN 'click' THEN '{"file_path":"' || f || '","new_string":"x' || i || '","old_string":"x"}'
              WHEN 'view' THEN '{"file_path":"' || f || '"}' WHEN 'signup' THEN '{"command":"git add -A && git commit -m \"c' || i || '\""}' ELSE '{"command":"rm ' || f || '"}' END AS input
  FROM ev)"""

ORACLES = {
    "a1_read_session_logs": ev("SELECT sid AS session_id, count(*) AS n_lines, sum(i)::BIGINT AS uuid_sum FROM ev GROUP BY 1"),
    "a2_session_id_from_path": "SELECT page_id, 's' || page_id AS session_id FROM pages",
    "a3_quarantine": pg("""SELECT p AS off, (row_number() OVER (PARTITION BY p % 150 ORDER BY p) - 1)::BIGINT AS line_number, 'malformed line: Unterminated string starting at: line 1 column 18 (char 17)' AS error, '{"type": "user", "this is broken ' || p AS preview FROM pg QUALIFY kind = 'broken'"""),
    "a4_incremental_read": ev("SELECT sid AS session_id, count(*) AS n_lines FROM ev GROUP BY 1"),
    "a5_sync_report": ev("""SELECT sid AS session_id, 'synced' AS state, count(*) AS records, 0::BIGINT AS warnings, coalesce(any_value(o.n), 0)::BIGINT AS overflow_fields FROM ev
      LEFT JOIN (SELECT sid, count(*) AS n FROM obs JOIN ev USING (i) GROUP BY 1) o USING (sid) GROUP BY 1 UNION ALL SELECT 'second run', 'skipped', 0, 0, 0"""),
    "a6_reingest": ev("SELECT sid AS session_id, CASE WHEN u % 10 = 3 THEN count(*) ELSE count(*) FILTER (asst) END AS n_lines FROM ev GROUP BY sid, u HAVING n_lines > 0"),
    "a7_upsert": "SELECT user_id, min(event_id) AS first_id, arg_min(event_type, event_id) AS first_type, max(event_id) AS last_id, arg_max(event_type, event_id) AS last_type FROM events GROUP BY 1",
    "a8_export_json": ev("""SELECT s.session_id, s.project_path, m.n AS n_messages, m.b AS n_blocks, m.first_uuid FROM sess s JOIN
      (SELECT session_id, count(*) AS n, sum(CASE WHEN type = 'assistant' THEN 2 ELSE 1 END)::BIGINT AS b, arg_min(uuid, (timestamp, uuid)) AS first_uuid FROM msg GROUP BY 1) m USING (session_id)"""),
    "a9_export_csv": ev("""SELECT uuid, session_id, type, timestamp, model, coalesce(b.text_content, '') AS content_preview, input_tokens, output_tokens
      FROM msg LEFT JOIN usage ON usage.message_uuid = uuid LEFT JOIN blocks b ON b.message_uuid = uuid AND b.block_type = 'text'"""),
    "a10_export_markdown": rec(INPUT + """, told AS (
  SELECT sid AS session_id, iso, 'e' || i AS uuid, '---' || chr(10) || '## ' || CASE WHEN asst THEN 'Assistant' ELSE 'User' END || ' (' || iso || ')' || repeat(chr(10), 2)
    || CASE WHEN asst THEN 'did ' || et || ' ' || i || repeat(chr(10), 2) || '### Tool Use: ' || tool_name || chr(10) || '**Input:** `' || substr(input, 1, 200) || '`' || repeat(chr(10), 2)
            WHEN i % 10 = 3 THEN 'say ' || et || ' ' || i || repeat(chr(10), 2) ELSE 'res ' || i || repeat(chr(10), 2) END AS body
  FROM input WHERE NOT odd_type)
SELECT session_id, '# Session: ' || session_id || chr(10) || '**Project:** ' || any_value(project_path) || chr(10) || '**Date:** ' || min(iso) || repeat(chr(10), 2) || string_agg(body, '' ORDER BY iso, uuid) AS markdown
FROM told JOIN sess USING (session_id) GROUP BY 1"""),
    "a11_read_bookmarks": "SELECT page_id AS id, '/Projects/p' || (page_id % 10) AS project_path, strftime(to_timestamp(page_id * 1000 + 978307200) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS created_at, 'tag' || (page_id % 3) || '+kept' AS tag_list FROM pages",
    "b1_dispatch": f"WITH {EV}, {PG} SELECT kind, count(*) AS n FROM pg WHERE kind <> 'broken' GROUP BY 1 UNION ALL SELECT 'events.' || CASE WHEN asst THEN 'assistant' WHEN odd_type THEN 'unknown' ELSE 'user' END AS kind, count(*) AS n FROM ev GROUP BY 1",
    "b2_sessions": ev("SELECT * FROM sess"),
    "b3_projects": ev("SELECT * FROM proj"),
    "b4_agents": ev("SELECT * FROM agents"),
    "b5_messages": ev("SELECT uuid, session_id, type, timestamp, parent_uuid, is_sidechain, model, stop_reason, version, is_compact_summary, plan_content FROM msg"),
    "b6_message_content": ev("SELECT message_uuid, block_index::BIGINT AS block_index, block_type, text_content, tool_use_id, tool_name, is_error FROM blocks"),
    "b7_token_usage": ev("SELECT * FROM usage"),
    "b8_tool_executions": ev("SELECT message_uuid, tool_use_id, tool_name, result_content, is_error FROM tool"),
    "b9_promote_user_overflow": ev("""SELECT uuid, CASE WHEN is_compact_summary THEN true END AS is_compact_summary, plan_content, CASE WHEN i % 50 = 1 THEN '{"brandNew":{"n":' || i || '}}' END AS extra_json FROM msg WHERE type = 'user'"""),
    "b10_assistant_extra_json": """SELECT 'u' || page_id AS uuid, '{"both":"m","only_message":' || page_id || ',"only_record":' || page_id || '}' AS extra_json FROM pages""",
    "b11_system_events": pg("""SELECT uuid, sid AS session_id, iso AS timestamp, 'turn_duration' AS subtype, p AS duration_ms,
      '{' || CASE WHEN p % 2 = 0 THEN '"hookCount":2,' ELSE '' END || '"retryInMs":' || p || '}' AS extra_json FROM pg WHERE kind = 'system'"""),
    "b12_summaries": pg("SELECT DISTINCT sid AS session_id, 'summary of page ' || p AS summary, 'e' || p AS leaf_uuid FROM pg WHERE kind = 'summary'"),
    "b13_attachments": pg("SELECT uuid, sid AS session_id, iso AS timestamp, ver AS version, inner_type, CASE WHEN inner_type = 'mood_ring' THEN inner_type END AS body_type, CASE WHEN inner_type = 'edited_text_file' THEN 'snippet of page ' || p END AS snippet FROM att"),
    "b14_hook_executions": pg("SELECT * EXCLUDE (p) FROM hooks"),
    "b15_plan_blocks": ev("SELECT uuid AS message_uuid, (-1)::BIGINT AS block_index, 'plan_content' AS block_type, plan_content AS text_content FROM msg WHERE plan_content IS NOT NULL"),
    "b16_drop_noise": pg("SELECT kind AS type, count(*) AS n_records, 0::BIGINT AS n_messages FROM pg WHERE kind IN ('progress', 'queue-operation', 'file-history-snapshot') GROUP BY 1"),
    "c1_write_ops": ev(f"SELECT {OP} FROM fop WHERE operation_type = 'write'"),
    "c2_edit_ops": ev(f"SELECT {OP} FROM fop WHERE operation_type = 'edit'"),
    "c3_read_ops": ev(f"SELECT {OP} FROM fop WHERE operation_type = 'read'"),
    "c4_shell_file_ops": ev(f"SELECT {OP} FROM fop WHERE operation_type = 'bash_rm'"),
    "c5_git_operations": ev("SELECT * FROM git"),
    "c6_files": ev("SELECT * FROM files"),
    "c7_enrich": ev("SELECT tool_use_id, operation_type, result_summary, is_error FROM fop"),
    "c8_mine_artifacts": ev("SELECT 'file_operations' AS artifact, session_id, count(*) AS n FROM fop GROUP BY 2 UNION ALL SELECT 'git_operations', session_id, count(*) FROM git GROUP BY 2 UNION ALL SELECT 'files', session_id, count(*) FROM files GROUP BY 2"),
    "d0_overflow": r"SELECT event_id, 'k' AS field, regexp_extract(props, '\d+') AS value FROM events",
    "d1_schema_drift": ev("SELECT *, 'overflow capture from user record v' || version AS source_context FROM drift"),
    "d1_side_schema_drift": pg("""SELECT field_name, record_type, version, count(*) AS occurrence_count FROM (
      SELECT 'oddField' AS field_name, 'attachment' AS record_type, ver AS version FROM att WHERE p % 11 = 0
      UNION ALL SELECT 'removedNames', 'attachment.mcp_instructions_delta', ver FROM att WHERE inner_type = 'mcp_instructions_delta'
      UNION ALL SELECT 'retryInMs', 'system', '1.0.' || (p % 5) FROM pg WHERE kind = 'system'
      UNION ALL SELECT 'pct', 'progress', '1.0.' || (p % 5) FROM pg WHERE kind = 'progress'
      UNION ALL SELECT 'priority', 'queue-operation', 'unknown' FROM pg WHERE kind = 'queue-operation'
      UNION ALL SELECT 'flavour', 'file-history-snapshot', 'unknown' FROM pg WHERE kind = 'file-history-snapshot') GROUP BY ALL"""),
    "d2_record_type_drift": ev("SELECT * FROM typedrift"),
    "d3_schema_drift_list": ev("SELECT field_name, record_type, version, first_seen_at FROM drift"),
    "d3_schema_drift_list_whole": pg("""SELECT field_name, record_type, version, min(iso) AS first_seen_at FROM (
      SELECT 'oddField' AS field_name, 'attachment' AS record_type, ver AS version, iso FROM att WHERE p % 11 = 0
      UNION ALL SELECT 'removedNames', 'attachment.mcp_instructions_delta', ver, iso FROM att WHERE inner_type = 'mcp_instructions_delta'
      UNION ALL SELECT 'retryInMs', 'system', '1.0.' || (p % 5), iso FROM pg WHERE kind = 'system'
      UNION ALL SELECT 'pct', 'progress', '1.0.' || (p % 5), iso FROM pg WHERE kind = 'progress'
      UNION ALL SELECT 'priority', 'queue-operation', 'unknown', iso FROM pg WHERE kind = 'queue-operation'
      UNION ALL SELECT 'flavour', 'file-history-snapshot', 'unknown', NULL FROM pg WHERE kind = 'file-history-snapshot') GROUP BY ALL"""),
    "d4_record_type_drift_list": ev("SELECT type_name, version, last_seen_at FROM typedrift ORDER BY last_seen_at DESC, 1, 2 LIMIT 3"),
    "d5_drift_by_version": ev("SELECT version, record_type, field_name, occurrence_count, 'extra_json' AS promotion_status FROM drift"),
    "d6_version_span": ev("SELECT version, min(timestamp) AS first_seen, max(timestamp) AS last_seen FROM msg GROUP BY 1"),
    "d7_version_history": ev("""SELECT version, min(first_seen_at) AS first_seen_at, max(last_seen_at) AS last_seen_at, arg_min(session_id, (first_seen_at, session_id)) AS first_session_id, count(*) AS session_count,
      (SELECT count(*) FROM (SELECT *, min(first_seen_at) OVER (PARTITION BY field_name, record_type) AS e FROM drift) d WHERE d.version = sess.version AND d.first_seen_at = d.e) AS new_fields_count FROM sess GROUP BY version"""),
    "d8_new_fields_count": ev("SELECT version, count(*) FILTER (first_seen_at = e) AS new_fields_count FROM (SELECT *, min(first_seen_at) OVER (PARTITION BY field_name, record_type) AS e FROM drift) GROUP BY 1"),
    "d9_version_diff": ev("""SELECT version, lag(version) OVER w AS previous_version, array_to_string(list_filter(f, lambda x: NOT list_contains(coalesce(lag(f) OVER w, []), x)), '+') AS new_fields,
      array_to_string(list_filter(coalesce(lag(f) OVER w, []), lambda x: NOT list_contains(f, x)), '+') AS disappeared_fields
      FROM (SELECT version, min(first_seen_at) AS fs, coalesce((SELECT list_sort(list(field_name || ':' || record_type)) FROM drift d WHERE d.version = sess.version), []) AS f FROM sess GROUP BY version) WINDOW w AS (ORDER BY fs, version)"""),
    "e1_list_sessions": ev(f"SELECT {SESSION} FROM counts WHERE contains(lower(project_path), '/projects/p3') AND session_id IN (SELECT session_id FROM msg WHERE plan_content IS NOT NULL) ORDER BY first_seen_at DESC, session_id LIMIT 50"),
    "e2_query_messages": ev("SELECT uuid, session_id, timestamp, model FROM msg WHERE type = 'assistant' AND model = 'm1' AND timestamp >= '2024-01-05' AND uuid IN (SELECT message_uuid FROM tool WHERE tool_name = 'Bash') ORDER BY timestamp DESC, uuid LIMIT 100"),
    "e3_list_attachments": pg("SELECT uuid, sid AS session_id, iso AS timestamp, project_path FROM att JOIN psess ON session_id = sid WHERE inner_type = 'skill_listing' ORDER BY iso DESC, uuid LIMIT 20"),
    "e4_list_hook_executions": pg("SELECT attachment_uuid, tool_use_id, duration_ms FROM hooks WHERE hook_event = 'PostToolUse' AND exit_code = 1 ORDER BY timestamp DESC, 1 LIMIT 20"),
    "e5_list_plans": ev("SELECT uuid, m.session_id, project_path, timestamp, length(plan_content) AS plan_length, plan_content[:200] AS preview FROM msg m JOIN sess USING (session_id) WHERE plan_content IS NOT NULL AND contains(project_path, '/p1') ORDER BY timestamp DESC, uuid LIMIT 10"),
    "e6_show_plans": ev("SELECT uuid, session_id, timestamp, plan_content FROM msg WHERE plan_content IS NOT NULL"),
    "e7_list_files": ev("SELECT f.* FROM files f JOIN sess USING (session_id) WHERE contains(file_path, 'f1') AND contains(project_path, '/Projects/p2') ORDER BY last_modified DESC, session_id, file_path LIMIT 100"),
    "e8_glob_files": ev("SELECT * FROM files WHERE file_path GLOB '*/f1?.p[xy]'"),
    "e9_file_history": ev("SELECT f.session_id, file_path, operation_type, timestamp, tool_use_id FROM fop f JOIN sess USING (session_id) WHERE contains(file_path, 'f7.py') AND contains(project_path, '/p4')"),
    "e10_git_log": ev("SELECT tool_use_id, session_id, operation_type, timestamp FROM git WHERE operation_type = 'add' ORDER BY timestamp DESC, tool_use_id LIMIT 100"),
    "e10_git_commits": ev("SELECT tool_use_id, session_id, commit_message, timestamp FROM git WHERE operation_type = 'commit' ORDER BY timestamp DESC, tool_use_id LIMIT 30"),
    "e11_list_projects": ev("SELECT * FROM proj"),
    "e12_session_agents": ev("SELECT * FROM agents"),
    "e13_list_bookmarks": pg("SELECT id, project_path FROM marks WHERE project_path = '/Projects/p4'"),
    "e14_search_bookmarks": pg("SELECT id, label FROM marks WHERE tag = 'tag2' OR contains(lower(label), 'tag2') ORDER BY id DESC LIMIT 15"),
    "e15_get_bookmark": pg("SELECT id, assistant_uuid, label FROM marks WHERE id IN (3, 7)"),
    "e16_content_like": ev("SELECT uuid, session_id, type AS message_type, timestamp, block_index::BIGINT AS block_index, block_type, text_content AS content_preview FROM msg JOIN blocks ON message_uuid = uuid WHERE contains(lower(text_content), 'purchase 1') ORDER BY timestamp DESC, uuid, block_index LIMIT 40"),
    "e17_recent_sessions": ev("SELECT session_id, project_path, last_seen_at, message_count, model FROM counts ORDER BY last_seen_at DESC, session_id LIMIT 10"),
    "f1_tokens_by_model": ev(f"SELECT coalesce(model, 'unknown') AS model, {TOK_SUM} FROM msg JOIN usage ON message_uuid = uuid GROUP BY 1"),
    "f2_tokens_by_session": ev(f"SELECT session_id, {TOK_SUM} FROM msg JOIN usage ON message_uuid = uuid GROUP BY 1"),
    "f3_tokens_by_day": ev(f"SELECT ts::DATE AS day, {TOK_SUM} FROM msg JOIN usage ON message_uuid = uuid GROUP BY 1"),
    "f4_tool_frequency": ev("SELECT tool_name, count(*) AS invocations, count(*) FILTER (is_error) AS errors FROM tool GROUP BY 1"),
    "f5_tool_usage_by_session": ev("SELECT session_id, tool_name, count(*) AS invocations, count(*) FILTER (is_error) AS errors FROM tool GROUP BY 1, 2"),
    "f6_model_breakdown": ev("SELECT model, count(*) AS message_count, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 2) AS percentage FROM msg WHERE model IS NOT NULL GROUP BY 1"),
    "f7_session_summary": ev("""SELECT s.session_id, s.project_path, m.*  EXCLUDE (session_id), coalesce(t.n, 0) AS tool_uses, coalesce(t.d, 0) AS distinct_tools, m.millis // 1000 AS duration_seconds FROM sess s
      JOIN (SELECT session_id, count(*) AS message_count, coalesce(sum(input_tokens), 0)::BIGINT AS input_tokens, coalesce(sum(output_tokens), 0)::BIGINT AS output_tokens, min(timestamp) AS first_message, max(timestamp) AS last_message,
            epoch_ms(date_trunc('millisecond', max(ts))) - epoch_ms(date_trunc('millisecond', min(ts))) AS millis FROM msg LEFT JOIN usage ON message_uuid = uuid GROUP BY 1) m USING (session_id)
      LEFT JOIN (SELECT session_id, count(*) AS n, count(DISTINCT tool_name) AS d FROM tool GROUP BY 1) t USING (session_id)""").replace("m.*  EXCLUDE (session_id)", "m.message_count, m.input_tokens, m.output_tokens, m.first_message, m.last_message"),
    "f8_session_details": ev(f"SELECT {SESSION} FROM counts"),
    "f9_project_details": ev("""SELECT p.*, proj.display_name FROM (SELECT project_path, count(*) AS session_count, sum(message_count)::BIGINT AS message_count, sum(total_tokens)::BIGINT AS total_tokens, sum(file_ops)::BIGINT AS file_operations,
      sum(git_ops)::BIGINT AS git_operations, min(first_seen_at) AS first_activity, max(last_activity) AS last_activity FROM per GROUP BY 1) p JOIN proj USING (project_path)"""),
    "g1_file_token_cost": ev("""SELECT s.project_path, f.file_path, f.operation_type, count(*) AS operation_count, coalesce(sum(input_tokens), 0)::BIGINT AS input_tokens, coalesce(sum(output_tokens), 0)::BIGINT AS output_tokens, coalesce(sum(input_tokens + output_tokens), 0)::BIGINT AS total_tokens
      FROM fop f JOIN live m ON m.uuid = f.message_uuid JOIN sess s ON s.session_id = m.session_id LEFT JOIN usage ON usage.message_uuid = m.uuid GROUP BY ALL"""),
    "g2_file_conversation_context": _near("(SELECT * FROM fop WHERE operation_type IN ('write', 'edit'))", 7200, "o.file_path, o.operation_type, o.timestamp AS operation_timestamp, o.session_id, s.project_path, ma.uuid AS assistant_message_uuid, b.text_content AS assistant_reasoning, ma.timestamp AS reasoning_timestamp, ma.model"),
    "g3_project_summary": ev("SELECT project_path, count(*) AS session_count, sum(message_count)::BIGINT AS message_count, sum(total_tokens)::BIGINT AS total_tokens, sum(file_ops)::BIGINT AS file_operations, sum(git_ops)::BIGINT AS git_operations, min(first_seen_at) AS first_activity, max(last_activity) AS last_activity FROM per GROUP BY 1"),
    "g4_file_provenance": ev("SELECT file_path, operation_type, f.timestamp, f.session_id, project_path, content, old_content, command, result_summary, is_error, message_uuid, m.type AS message_type FROM fop f JOIN live m ON m.uuid = message_uuid JOIN sess s ON s.session_id = f.session_id"),
    "g5_git_commit_context": _near("(SELECT * FROM git WHERE operation_type = 'commit')", 14400, "o.commit_message, o.branch, o.timestamp AS commit_timestamp, o.session_id, s.project_path, b.text_content AS assistant_reasoning, ma.timestamp AS reasoning_timestamp"),
    "g6_tool_errors": ev("SELECT tool_name, is_error, result_content AS error_content, message_uuid, t.session_id, project_path, t.timestamp FROM tool t JOIN live ON uuid = message_uuid JOIN sess s ON s.session_id = t.session_id WHERE is_error"),
    "g7_session_cost": ev("SELECT session_id, project_path, first_seen_at, message_count, input_tokens::BIGINT AS input_tokens, output_tokens::BIGINT AS output_tokens, cache_read_tokens::BIGINT AS cache_read_tokens, file_ops, git_ops FROM per"),
    "h1_assembled_messages": ev("SELECT uuid, b.n AS n_blocks, b.s AS blocks, input_tokens FROM msg JOIN (SELECT message_uuid, count(*) AS n, string_agg(block_type || '/' || coalesce(text_content, tool_name), '|' ORDER BY block_index) AS s FROM blocks GROUP BY 1) b ON b.message_uuid = uuid LEFT JOIN usage u ON u.message_uuid = uuid"),
    "h2_conversation": ev("SELECT session_id, position, uuid, parent_uuid, type, (CASE WHEN type = 'assistant' OR i % 10 = 3 THEN 1 ELSE 0 END)::BIGINT AS n_blocks FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY timestamp, uuid) AS position FROM msg)"),
    "h3_session_tree": ev("SELECT m.uuid, session_id, parent_uuid, type, timestamp, is_sidechain, coalesce(n, 0) AS child_count FROM msg m LEFT JOIN (SELECT parent_uuid AS uuid, count(*) AS n FROM msg WHERE parent_uuid IS NOT NULL GROUP BY 1) c USING (uuid)"),
    "h4_session_artifacts": ev("SELECT t.session_id, coalesce(f.n, 0) AS n_files, coalesce(g.n, 0) AS n_git_operations, t.n AS n_tool_runs, t.first_run FROM (SELECT session_id, count(*) AS n, arg_min(tool_use_id, (timestamp, tool_use_id)) AS first_run FROM tool GROUP BY 1) t LEFT JOIN (SELECT session_id, count(*) AS n FROM files GROUP BY 1) f USING (session_id) LEFT JOIN (SELECT session_id, count(*) AS n FROM git GROUP BY 1) g USING (session_id)"),
    "h5_session_timeline": ev("SELECT session_id, timestamp, event_type, name, message_uuid, tool_use_id, position FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY timestamp, event_type, tool_use_id, name) AS position FROM line) WHERE position <= 20"),
    "i1_tokenize": f"SELECT doc_id, len(t) AS n_tokens, t[1] AS first_token, len(list_distinct(t)) AS n_terms FROM (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents)",
    "i2_build_index": f"SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, max(tf) AS max_tf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents) GROUP BY 1, 2) GROUP BY 1",
    "i3_attachment_docs": pg("SELECT attachment_uuid, part::BIGINT AS part, inner_type, text_content FROM adocs"),
    "i4_phrase_search": f"WITH {_phrase('SELECT doc_id AS key, text FROM documents', ['of', 'the'])} SELECT key AS doc_id, tf, round(score, 6) AS score FROM hits ORDER BY round(hits.score, 9), key LIMIT 20",
    "i5_search_messages": f"WITH {EV}, {_phrase('SELECT (message_uuid, block_index) AS key, text_content AS text FROM blocks WHERE text_content IS NOT NULL UNION ALL SELECT (uuid, -1), plan_content FROM msg WHERE plan_content IS NOT NULL', ['did', 'purchase'])} SELECT m.uuid AS message_uuid, m.session_id, m.type AS message_type, 'text' AS block_type, '>>>did purchase<<< ' || m.i AS snippet, round(score, 6) AS score FROM hits JOIN msg m ON m.uuid = key[1] ORDER BY round(hits.score, 9), m.uuid LIMIT 15",
    "i6_search_attachments": f"WITH {PG}, {_phrase('SELECT (attachment_uuid, part, inner_type, text_content) AS key, text_content AS text FROM adocs', ['of', 'page'])} SELECT key[1] AS attachment_uuid, key[3] AS inner_type, 'attachment' AS source, replace(key[4], 'of page', '>>>of page<<<') AS snippet, round(score, 6) AS score FROM hits ORDER BY round(hits.score, 9), key[1], key[2] LIMIT 15",
    "i7_search_all": f"WITH {PG}, {_phrase('SELECT (attachment_uuid, part) AS key, text_content AS text FROM adocs', ['page'])} SELECT 'attachment' AS source, key[1] AS id, round(score, 6) AS score FROM hits ORDER BY round(hits.score, 9), key[1], key[2] LIMIT 10",
    "i8_search_plans": f"WITH {EV}, {_phrase('SELECT (message_uuid, block_index) AS key, text_content AS text FROM blocks WHERE text_content IS NOT NULL UNION ALL SELECT (uuid, -1), plan_content FROM msg WHERE plan_content IS NOT NULL', ['plan', 'click'])} SELECT key[1] AS message_uuid, 'plan_content' AS block_type, round(score, 6) AS score FROM hits ORDER BY round(hits.score, 9), key LIMIT 10",
    "j1_reconstruct": rec(FOLD.format("")),
    "j2_cutoff": rec(FOLD.format("AND timestamp <= (SELECT iso FROM ev WHERE i = 500)")),
    "j3_file_versions": rec("""
muts AS (SELECT *, row_number() OVER w AS n, count(*) FILTER (operation_type = 'write') OVER w AS g FROM fop WHERE operation_type IN ('write', 'edit') WINDOW w AS (PARTITION BY session_id, file_path ORDER BY timestamp, tool_use_id)),
fold AS (
  SELECT session_id, file_path, n, timestamp, tool_use_id, content FROM muts WHERE operation_type = 'write'
  UNION ALL SELECT m.session_id, m.file_path, m.n, m.timestamp, m.tool_use_id, replace(f.content, m.old_content, m.content)
  FROM fold f JOIN muts m ON m.session_id = f.session_id AND m.file_path = f.file_path AND m.n = f.n + 1 AND m.operation_type = 'edit')
SELECT session_id, file_path, (n - 1)::BIGINT AS version, timestamp, tool_use_id, content FROM fold"""),
    "i9_search_file_ops": f"WITH {EV}, fdocs AS (SELECT tool_use_id, 'content' AS field, content AS text FROM fop UNION ALL SELECT tool_use_id, 'old_content', old_content FROM fop UNION ALL SELECT tool_use_id, 'command', command FROM fop), {_phrase('SELECT (tool_use_id, field) AS key, text FROM fdocs WHERE text IS NOT NULL', ['src', 'f7'])}, " """
ol AS (SELECT key[1] AS tool_use_id, sum(len(t)) AS dl FROM tok GROUP BY 1), os AS (SELECT count(*) AS n, avg(dl) AS a FROM ol),
oh AS (SELECT key[1] AS tool_use_id, sum(tf) AS tf, min(key[2]) AS field FROM hits GROUP BY 1)
SELECT tool_use_id, field, replace(command, 'src/f7', '<b>src/f7</b>') AS snippet, round(sc, 6) AS score FROM (
  SELECT *, -greatest(ln((n - (SELECT count(*) FROM oh) + 0.5) / ((SELECT count(*) FROM oh) + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / a)) AS sc FROM oh JOIN ol USING (tool_use_id), os)
JOIN fop USING (tool_use_id) ORDER BY round(sc, 9), tool_use_id LIMIT 10""",
    "i10_snippet": f"WITH {_phrase('SELECT (doc_id, text) AS key, text FROM documents', ['of', 'the'])}, " r"""
w AS (SELECT key[1] AS doc_id, first, regexp_extract_all(key[2], '[\p{L}\p{N}]+') AS spans, regexp_split_to_array(key[2], '[\p{L}\p{N}]+') AS gaps, greatest(first - 2, 0) AS lo FROM hits),
x AS (SELECT *, least(lo + 6, len(spans)) AS hi FROM w)
SELECT doc_id, CASE WHEN lo > 0 THEN '...' ELSE gaps[1] END
  || array_to_string([CASE WHEN i = first THEN '>>>' ELSE '' END || spans[CAST(i + 1 AS BIGINT)] || CASE WHEN i = first + 1 THEN '<<<' ELSE '' END || CASE WHEN i < hi - 1 THEN gaps[CAST(i + 2 AS BIGINT)] ELSE '' END FOR i IN range(CAST(lo AS BIGINT), CAST(hi AS BIGINT))], '')
  || CASE WHEN hi < len(spans) THEN '...' ELSE gaps[len(spans) + 1] END AS snippet FROM x""",
    "k1_sql_readonly": ev("SELECT model, sum(input_tokens)::BIGINT AS input_tokens FROM msg JOIN usage ON message_uuid = uuid WHERE session_id <> 's1' GROUP BY 1"),
    "k2_run_canned": ev("SELECT tool_name, count(*) AS invocations, count(*) FILTER (is_error) AS errors FROM tool WHERE session_id = 's3' GROUP BY 1"),
    "l1_tail_session_logs": rec(INPUT + """, written AS (
  SELECT sid AS session_id, i, '{"type":"' || CASE WHEN asst THEN 'assistant' WHEN odd_type THEN 'mystery' ELSE 'user' END || '","uuid":"e' || i || '","timestamp":"' || iso || '","sessionId":"' || sid || '","version":"' || ver || '","cwd":"' || cwd
    || coalesce('","parentUuid":"e' || prev, '') || '","isSidechain":false,"userType":"external","gitBranch":"main"' || CASE WHEN i % 30 = 7 THEN ',"agentId":"g' || (u % 20) || '"' ELSE '' END
    || CASE WHEN asst THEN ',"message":{"id":"msg' || i || '","role":"assistant","model":"m' || (i % 3) || '","content":[{"type":"text","text":"did ' || et || ' ' || i || '"},{"type":"tool_use","id":"t' || i || '","name":"' || tool_name || '","input":' || input
         || '}],"stop_reason":"tool_use","usage":{"input_tokens":' || CAST(floor(value) AS BIGINT) || ',"output_tokens":' || k || CASE WHEN i % 4 = 0 THEN ',"cache_read_input_tokens":' || (k % 7) ELSE '' END || '}}}'
       ELSE ',"message":{"role":"user","content":' || CASE WHEN i % 10 = 3 THEN '"say ' || et || ' ' || i || '"' ELSE '[{"content":"res ' || i || '","is_error":' || (et = 'error') || ',"tool_use_id":"t' || (i - 1) || '","type":"tool_result"}]' END || '}'
         || CASE WHEN i % 97 = 1 THEN ',"isCompactSummary":true' ELSE '' END || CASE WHEN i % 89 = 1 THEN ',"planContent":"plan ' || et || ' ' || i || '"' ELSE '' END || CASE WHEN i % 50 = 1 THEN ',"brandNew":{"n":' || i || '}' ELSE '' END || '}' END AS line
  FROM input)
SELECT session_id, count(*) AS n_lines, CAST(sum(strlen(line) + 1) - arg_max(strlen(line) + 1, i) AS BIGINT) AS last_off FROM written GROUP BY 1"""),
    "l2_ingest_batch": ev("SELECT session_id, count(*) AS message_count FROM msg GROUP BY 1"),
    "l3_record_added": ev("SELECT 'record:added' AS type, max(sid) AS session_id, path, CAST(NULL AS VARCHAR) AS detail, count(*) AS n FROM ev GROUP BY path"),
    "l4_session_started": ev("SELECT 'session:started' AS type, max(sid) AS session_id, path FROM ev WHERE u % 10 >= 5 GROUP BY path"),
    "l5_schema_drift_event": ev("SELECT 'schema:drift' AS type, path, count(*) AS n FROM obs JOIN ev USING (i) GROUP BY path"),
    "l6_version_changed": ev("SELECT 'version:changed' AS type, session_id, b || '->' || version AS detail FROM (SELECT *, coalesce(lag(version) OVER (ORDER BY first_seen_at, session_id), '1.0.9') AS b FROM sess) WHERE version <> b"),
    "l7_artifact_events": ev("SELECT CASE operation_type WHEN 'write' THEN 'file:written' ELSE 'file:edited' END AS type, session_id, count(*) AS n FROM fop WHERE operation_type IN ('write', 'edit') GROUP BY 1, 2 UNION ALL SELECT 'git:commit', session_id, count(*) FROM git WHERE operation_type = 'commit' GROUP BY 2"),
    "l8_refresh_index": ev("SELECT message_uuid, block_index::BIGINT AS block_index, 1::BIGINT AS tf, true AS built, false AS again FROM (SELECT message_uuid, block_index, text_content FROM blocks UNION ALL SELECT uuid, -1, plan_content FROM msg) WHERE contains(text_content, 'purchase')"),
}
