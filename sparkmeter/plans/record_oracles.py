"""DuckDB SQL for the queries of ``record_queries``. Where records are JSON, the SQL works on the numbers that they were made from."""

from __future__ import annotations

from .bench_views import PRICE_SQL
from .oracles import EV, PRICED, SEG
from .record_views import CHAT_SQL, CLOUD_EVENT_SQL, FIELDS

F = f"WITH f AS (SELECT {FIELDS} FROM lineitem)"
#: What a strict reader makes of the spoiled counters: input of m 0 to 2 and output of m 3 are no counters, 1.5 is no whole number.
GOOD_IN, GOOD_OUT, GOOD_WRITE = "m NOT IN (0, 1, 2)", "m <> 3", "m <> 4"


def _usage(valid: str, input_: str, output: str, read: str, five: str, hour: str = "0", more: str = "") -> str:
    columns = ", ".join(f"CASE WHEN valid THEN CAST({x} AS BIGINT) END AS {n}" for n, x in (("input", input_), ("output", output), ("cache_read", read), ("cache_5m", five), ("cache_1h", hour)))
    return f"{F}, g AS (SELECT *, {valid} AS valid FROM f) SELECT okey, line, valid, {columns}{more} FROM g"


AGENTS = f"""{PRICED}, a AS (SELECT *, CASE WHEN output % 3 = 0 THEN 'agent-' || CAST(output % 7 AS STRING) END AS agent, CASE WHEN output % 3 = 0 THEN 'type' || CAST(output % 7 % 3 AS STRING) END AS agent_type, output % 5 AS segment FROM priced)"""
BUCKETS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("input", "output", "cache_read", "cache_5m", "cache_1h", "requests"))
COSTS = "CAST(sum(cost) AS BIGINT) AS cost, coalesce(bool_or(cost IS NULL), false) AS partial"
GEN = f"""{EV}, g AS (SELECT session, CAST(event_id // 3 AS BIGINT) AS generation, event_id % 17 AS turn, k % 2 = 0 AS flag, event_id, event_type, k AS input, k % 13 AS output, k % 7 * 9 AS cache_read, k % 3 AS cache_write FROM ev)"""
FOUR = ", ".join(f"CAST({{0}}({c}) AS BIGINT) AS {c}" for c in ("input", "output", "cache_read", "cache_write"))
CHAT = f"WITH ch AS ({CHAT_SQL.replace(chr(39) + '[^a-z]' + chr(39) + ', ' + chr(39) * 2, chr(39) + '[^a-z]' + chr(39) + ', ' + chr(39) * 2 + ', ' + chr(39) + 'g' + chr(39))})"
CLOUD = f"WITH ce AS ({CLOUD_EVENT_SQL})"


def _index(grain: str = "", calls: bool = True, first: str = "") -> str:
    keys = f"project, session{', ' + grain if grain else ''}"
    return f"{AGENTS} SELECT {keys}, {BUCKETS}, {COSTS}{', CAST(count(DISTINCT segment) AS BIGINT) AS invocations' if calls else ''}{first} FROM a GROUP BY {keys}"


def _history(grain: str, calls: str) -> str:
    return f"SELECT '{grain}' AS grain, CAST({grain} AS STRING) AS key, CAST({calls} AS BIGINT) AS calls, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(cost) AS BIGINT) AS cost, bool_or(cost IS NULL) AS partial FROM a GROUP BY {grain}"


WORD = "regexp_replace(url, '[^A-Za-z0-9]', '', 'g')"

ORACLES: dict[str, str] = {
    "claude_usage": _usage("true", "a", "CASE t WHEN 2 THEN 0 ELSE b END", "CASE t WHEN 0 THEN c ELSE 0 END", "CASE t WHEN 0 THEN d ELSE c END", "CASE t WHEN 2 THEN d ELSE 0 END"),
    "codex_usage": _usage(f"{GOOD_IN} AND {GOOD_OUT} AND {GOOD_WRITE} AND a >= c + d", "a - c - d", "b", "c", "d"),
    "gemini_usage": _usage(f"{GOOD_IN} AND {GOOD_OUT} AND {GOOD_WRITE} AND c <= a", "a - c + t", "b + d", "c", "0"),
    "antigravity_usage": _usage(f"{GOOD_IN} AND {GOOD_OUT} AND {GOOD_WRITE}", "a", "b", "c", "d"),
    "copilot_usage": _usage(f"{GOOD_IN} AND {GOOD_OUT} AND {GOOD_WRITE} AND a >= c + d", "a - c - d", "b", "c", "CASE WHEN t = 1 THEN 0 ELSE d END", "CASE WHEN t = 1 THEN d ELSE 0 END", ", t = 2 AND m <> 4 AND d > 0 AS odd_ttl"),
    "cursor_bubble_usage": _usage(
        "t < 2 AND greatest(CASE WHEN m IN (0, 1, 2) THEN 0 ELSE a END, CASE WHEN m = 3 THEN 0 ELSE b END, CASE t WHEN 0 THEN c ELSE d END) > 0",
        "CASE WHEN m IN (0, 1, 2) THEN 0 ELSE a END", "CASE WHEN m = 3 THEN 0 ELSE b END", "CASE t WHEN 0 THEN c ELSE 0 END", "CASE t WHEN 0 THEN 0 ELSE d END",
    ),
    "cursor_hook_usage": _usage("true", "CASE WHEN m = 0 THEN 0 WHEN a >= c + d THEN a - c - d ELSE a END", "CASE WHEN m = 3 THEN 0 ELSE b END", "c", "d", more=", CASE WHEN m = 0 THEN c + d = 0 ELSE a >= c + d END AS trusted"),
    "cloud_usage": _usage("m NOT IN (0, 1, 2)", "a", "b", "CASE t WHEN 0 THEN 0 ELSE c END", "CASE WHEN t = 0 THEN 0 WHEN m = 4 THEN 1 ELSE d END"),
    "bridge_usage": f"{F} SELECT okey, line, CAST(CASE WHEN t = 1 AND a >= c + d THEN a - c - d WHEN t = 1 THEN 0 ELSE a END AS BIGINT) AS input, b AS output, CASE t WHEN 2 THEN 0 ELSE c END AS cache_read, d AS cache_write FROM f",
    "bridge_payload_tokens": f"""{F} SELECT okey, line, CASE WHEN t = 0 THEN CASE WHEN m IN (0, 2) THEN NULL WHEN m = 1 THEN -5 ELSE a END ELSE a END AS input, CASE WHEN t = 0 THEN NULL ELSE b END AS output,
        CASE WHEN t = 0 THEN c END AS cache_read, CAST(NULL AS BIGINT) AS cache_write FROM f""",
    "bridge_roles": f"""{CHAT} SELECT conv_id, turn, ['user', 'assistant', 'user', 'assistant', '', 'assistant', 'user', 'tool'][form + 1] AS role, ['m1', 'm2', '', '', '', '', 'm6', ''][form + 1] AS model,
        ['t0', 't1', 't2', 't3', '', 't5', '', ''][form + 1] AS ts, CASE form WHEN 0 THEN 'r' WHEN 2 THEN 'q' || CAST(turn AS STRING) WHEN 3 THEN 'deep' ELSE '' END AS request_id,
        CASE WHEN form IN (1, 2, 3) THEN NULL ELSE form = 4 END AS skipped FROM ch""",
    "bridge_tool_calls": f"{CHAT} SELECT conv_id, turn, 'c' || CAST(conv_id AS STRING) AS id, 'shell' AS name, '{{}}' AS arguments FROM ch WHERE form = 5",
    "message_texts": f"{CHAT} SELECT conv_id, turn, CASE form WHEN 0 THEN 'plain' WHEN 1 THEN 'one' || chr(10) || 'two' WHEN 2 THEN '' END AS text FROM ch",
    "text_functions": f"""SELECT page_id, sha256(url) AS project_hash, {WORD} AS argument,
        CASE page_id % 3 WHEN 0 THEN ' ' || {WORD} || ' ' WHEN 1 THEN '<USER_REQUEST>  ' || {WORD} ELSE {WORD} END AS prompt, '/home/a b/' || {WORD} AS path,
        CASE WHEN page_id % 6 = 0 THEN NULL WHEN page_id % 2 = 0 THEN {WORD} WHEN page_id % 3 = 0 THEN url ELSE least(url, {WORD}) END AS earliest,
        CASE WHEN page_id % 2 = 0 THEN substr({WORD}, 1, 12) END AS skill,
        CASE WHEN page_id % 3 = 1 THEN {WORD} WHEN page_id % 2 = 0 THEN substr({WORD}, 1, 120) ELSE '(no activity)' END AS activity,
        CASE WHEN page_id % 4 = 0 THEN '{{}}' WHEN length({WORD}) > 30 THEN substr({WORD}, 1, 30) || '…[truncated]' ELSE {WORD} END AS bounded FROM pages""",
    "day_and_millis": f"{EV} SELECT event_id, CASE k % 10 WHEN 0 THEN 'unknown' WHEN 1 THEN 'not a time' ELSE strftime(ts, '%Y-%m-%d') END AS day, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso FROM ev",
    "sidechain_paths": "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 's' || CAST(conv_id AS STRING) ELSE '' END AS parent, CASE WHEN turn % 2 = 0 THEN 'agent-' || CAST(turn AS STRING) ELSE '' END AS agent FROM conversations",
    "json_depths": f"{EV} SELECT event_id, CAST(k % 40 + 1 AS INTEGER) AS depth FROM ev",
    "turn_markdown": """WITH n AS (SELECT *, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS turn_index FROM conversations),
        t AS (SELECT conv_id, turn_index, max(text) FILTER (role = 'user') AS prompt, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'assistant'), '') AS assistant FROM n WHERE role IN ('user', 'assistant') AND turn_index > 0 GROUP BY conv_id, turn_index),
        c AS (SELECT *, CASE WHEN length(prompt) > 20000 THEN substr(prompt, 1, 20000) || '…[truncated]' ELSE coalesce(prompt, '') END AS p, CASE WHEN length(assistant) > 20000 THEN substr(assistant, 1, 20000) || '…[truncated]' ELSE assistant END AS s FROM t)
        SELECT conv_id, turn_index, md5(concat_ws(chr(10), '# Chat turn — claude/unknown', '', '## User', p, '', '## Tools',
          CASE WHEN turn_index % 2 = 0 THEN concat_ws(chr(10), '- `read` {}', '  result: one', '  two', '- `tool` x') ELSE '(none)' END, '', '## Assistant', s, '')) AS digest FROM c""",
    "price_provider_spellings": f"""WITH p AS (SELECT DISTINCT p_brand FROM part), f AS (SELECT unnest(['', 'openrouter/', 'us.anthropic.', 'openrouter/aus.anthropic.', 'anthropic.', 'eu1.anthropic.', 'xx/yy/anthropic.', 'openai.']) AS lead),
        price AS ({PRICE_SQL}), r AS (SELECT p_brand, arg_max(key, length(key)) AS key FROM p JOIN price ON starts_with(p_brand, key) AND NOT regexp_matches(substr(p_brand, length(key) + 1, 1), '^[A-Za-z0-9]') GROUP BY p_brand)
        SELECT lead || p_brand AS model, CASE WHEN lead NOT IN ('eu1.anthropic.', 'openai.') THEN key END AS key FROM p CROSS JOIN f LEFT JOIN r USING (p_brand)""",
    "agents_by_type": f"{AGENTS} SELECT label, agent_type, CAST(count(DISTINCT CAST(session AS STRING) || agent) AS BIGINT) AS count, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(output) AS BIGINT) AS output, {COSTS} FROM a WHERE agent IS NOT NULL GROUP BY label, agent_type",
    "subagent_cost_by_label": f"{AGENTS} SELECT label, CAST(sum(cost) AS BIGINT) AS cost, CAST(coalesce(sum(cost) FILTER (agent IS NOT NULL), 0) AS BIGINT) AS agent_cost, CAST(count(DISTINCT CASE WHEN agent IS NOT NULL THEN CAST(session AS STRING) || agent END) AS BIGINT) AS subagents FROM a GROUP BY label",
    "report_order": f"""{AGENTS}, g AS (SELECT project, model, sum(CASE WHEN model <> 'Brand#35' THEN cost END) AS cost, sum(output) AS output, min(ord) AS first FROM a GROUP BY project, model)
        SELECT project, model, CAST(row_number() OVER (PARTITION BY project ORDER BY coalesce(nullif(CAST(cost AS DOUBLE) / 1e9, 0), CAST(output AS DOUBLE) / 1e6) DESC, first) AS BIGINT) AS rank FROM g""",
    "subagent_stops": f"""{EV}, s AS (SELECT session, CAST(event_id // 50 AS BIGINT) AS generation, CASE WHEN k % 5 <> 0 THEN CAST(k % 5 AS STRING) ELSE 'unknown' END AS agent, event_id, ts FROM ev WHERE event_type IN ('click', 'view'))
        SELECT session, generation, agent, event_id FROM s QUALIFY row_number() OVER (PARTITION BY session, generation, agent ORDER BY ts, event_id) = 1""",
    "index_sessions": _index(first=", strftime(min(ts), '%Y-%m-%d') AS first_ts"),
    "index_labels": _index("label"),
    "index_days": _index("day", False),
    "index_models": _index("model", False),
    "history_from_index": f"""{AGENTS} {_history("project", "count(DISTINCT session)")} UNION ALL {_history("day", "count(DISTINCT session)")} UNION ALL {_history("model", "sum(requests)")}
        UNION ALL {_history("label", "count(DISTINCT session * 100 + segment)")}""",
    "top_commands": f"""{AGENTS} SELECT CAST(row_number() OVER (ORDER BY sum(cost) DESC NULLS LAST, label) AS BIGINT) AS rank, label AS key, CAST(count(DISTINCT session) AS BIGINT) AS sessions, CAST(count(DISTINCT session * 100 + segment) AS BIGINT) AS calls,
        CAST(sum(cost) AS BIGINT) AS cost, bool_or(cost IS NULL) AS partial FROM a GROUP BY label QUALIFY rank <= 3""",
    "project_baseline": f"{AGENTS}, s AS (SELECT project, session, CAST(sum(cost) AS BIGINT) AS cost FROM a GROUP BY project, session) SELECT project, CAST(median(cost) AS DOUBLE) AS median_cost, CAST(count(cost) AS BIGINT) AS sessions FROM s GROUP BY project",
    "generation_max": f"{GEN} SELECT session, generation, {FOUR.format('max')}, max(flag) AS flag FROM g GROUP BY session, generation",
    "turn_usage_sum": f"{GEN} SELECT session, {FOUR.format('sum')} FROM g GROUP BY session",
    "combined_usage": f"""{GEN}, c AS (SELECT DISTINCT session, turn FROM g WHERE event_type = 'signup'),
        u AS (SELECT session, input, output, cache_read, cache_write FROM g WHERE event_type = 'signup' UNION ALL
              SELECT session, CASE WHEN flag AND input > 0 AND cache_read + cache_write > 0 AND input >= cache_read + cache_write THEN input - cache_read - cache_write ELSE input END, output, cache_read, cache_write
              FROM g WHERE event_type <> 'signup' AND (session, turn) NOT IN (SELECT (session, turn) FROM c))
        SELECT session, {FOUR.format('sum')} FROM u GROUP BY session""",
    "distinct_warnings": f"{EV}, w AS (SELECT session, 'w' || CAST(k % 9 AS STRING) AS warning, min(event_id) AS first FROM ev GROUP BY 1, 2) SELECT session, warning, CAST(row_number() OVER (PARTITION BY session ORDER BY first) AS BIGINT) AS place FROM w",
    "session_identity": f"""{EV} SELECT session, arg_min('m' || CAST(k AS STRING), event_id) FILTER (k % 4 = 0) AS model, arg_min('/d' || CAST(k AS STRING), event_id) FILTER (k % 7 = 0) AS cwd,
        arg_min(iso, event_id) FILTER (k % 5 <> 0) AS started, arg_max(iso, event_id) FILTER (k % 5 <> 0) AS updated FROM ev GROUP BY session""",
    "session_start_min": f"{EV} SELECT session, min(iso) FILTER (k % 5 <> 0) AS started FROM ev GROUP BY session",
    "stale_snapshots": f"""{EV}, s AS (SELECT *, k // 10 * 10 + k % 3 AS version FROM ev), m AS (SELECT *, max(version) OVER (PARTITION BY session ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS best FROM s) SELECT session, event_id FROM m WHERE version = best""",
    "transcript_totals": f"""{GEN}, c AS (SELECT *, CAST(event_id // 40 + input % 3 AS BIGINT) AS covered FROM g), m AS (SELECT *, max(covered) OVER (PARTITION BY session ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS best FROM c),
        k AS (SELECT *, lag((covered, input, output)) OVER (PARTITION BY session ORDER BY event_id) AS before FROM m WHERE covered = best)
        SELECT session, arg_max(covered, event_id) AS covered, arg_max(input, event_id) AS input, arg_max(output, event_id) AS output, CAST(count(*) FILTER (before IS NULL OR before <> (covered, input, output)) AS BIGINT) AS revision FROM k GROUP BY session""",
    "outbox_order": f"{EV}, o AS (SELECT iso, CAST(session AS STRING) || ':' || CAST(event_id AS STRING) AS source_id FROM ev WHERE event_type = 'purchase') SELECT source_id, CAST(row_number() OVER (ORDER BY iso, source_id) AS BIGINT) AS n FROM o QUALIFY n <= 50",
    "turn_segment_usage": f"""{SEG}, n AS (SELECT session, k % 20 AS turn, max(seg_id) AS named FROM seg WHERE event_type = 'signup' GROUP BY ALL)
        SELECT seg.session, event_id, coalesce(named, seg_id) AS seg_id FROM seg LEFT JOIN n ON n.session = seg.session AND n.turn = seg.k % 20 WHERE event_type = 'purchase'""",
    "cloud_clean_events": f"{CLOUD} SELECT 'bc-agent-no-' || CAST(user_id AS STRING) AS agent, 1704067200000 + event_id * 260000 AS ms, 'usage' AS type, 'm' || CAST(k % 3 AS STRING) AS model, false AS leaks FROM ce WHERE k % 11 <> 0",
    "cloud_segments": f"""{CLOUD}, e AS (SELECT 'bc-agent-no-' || CAST(user_id AS STRING) AS agent, CASE WHEN k % 5 = 0 THEN '(no conversation)' ELSE 'c' || CAST(user_id % 3 AS STRING) END AS conversation, 'm' || CAST(k % 3 AS STRING) AS model,
          strftime(make_timestamp((1704067200000 + event_id * 260000) * 1000), '%Y-%m-%d') AS day, event_id, CASE WHEN event_id % 4 = 0 THEN 'automation:au' || CAST(event_id % 7 AS STRING) ELSE '(cloud agent)' END AS label, k % 13 <> 0 AS good, k,
          CASE WHEN k % 2 = 0 THEN k * 3 ELSE k END AS cents FROM ce WHERE k % 11 <> 0),
        l AS (SELECT agent, conversation, day, arg_min(label, event_id) AS label FROM e GROUP BY ALL),
        s AS (SELECT agent, conversation, day, model, CAST(coalesce(sum(k) FILTER (good), 0) AS BIGINT) AS input, CAST(2 * count(*) FILTER (good) AS BIGINT) AS output, CAST(0 AS BIGINT) AS cache_read, CAST(0 AS BIGINT) AS cache_5m, CAST(0 AS BIGINT) AS cache_1h,
          CAST(count(*) AS BIGINT) AS requests, round(CAST(sum(cents) AS DOUBLE) / 100, 9) AS charge, bool_or(NOT good) AS partial FROM e GROUP BY ALL)
        SELECT s.*, l.label FROM s JOIN l USING (agent, conversation, day)""",
    "cloud_known_agents": f"{EV} SELECT session AS agent FROM ev WHERE event_type = 'click' UNION SELECT session FROM ev WHERE event_type = 'error' AND k > 90",
    "cloud_sync": f"{EV}, m AS (SELECT event_id, epoch_ms(ts) AS ms, k FROM ev) SELECT event_id, CASE WHEN ms >= 1705000000000 AND ms < 1705900000000 THEN -1 ELSE k END AS k FROM m WHERE ms < 1705000000000 OR ms >= 1705900000000 OR event_id % 2 = 0",
    "all_unmeasured": f"""{EV}, l AS (SELECT session, coalesce(CASE WHEN session % 5 = 0 THEN 'activity_only' WHEN event_type = 'purchase' THEN 'exact' WHEN event_type = 'error' THEN 'activity_only' END, CASE WHEN session % 2 = 0 THEN 'activity_only' ELSE 'exact' END) AS level FROM ev)
        SELECT session, bool_and(level = 'activity_only') AS unmeasured FROM l GROUP BY session""",
}
