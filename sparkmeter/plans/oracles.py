"""DuckDB SQL for the queries of ``queries``; the stand-in views are common table expressions."""

from __future__ import annotations

from .bench_views import EV_LOG_SQL, PRICE_SQL, PRICED_SQL, RATES_SQL, REQ_LOG_SQL, REQUESTS_SQL
from .queries import BUNDLED_SQL, OVERLAY_SQL

LOG = f"WITH req_log AS ({REQ_LOG_SQL}), requests AS ({REQUESTS_SQL})"
PRICED = f"{LOG}, price AS ({PRICE_SQL}), rates AS ({RATES_SQL}), priced AS ({PRICED_SQL})"
#: The same with the eight-character keys only, so most models have no rate.
FEW = f"{LOG}, price AS (SELECT * FROM ({PRICE_SQL}) WHERE length(key) = 8), rates AS ({RATES_SQL}), priced AS ({PRICED_SQL})"
EV = f"WITH ev AS ({EV_LOG_SQL})"
SEG = f"""{EV}, flagged AS (
  SELECT *, event_type IN ('click', 'purchase', 'signup') AS opener,
         sum(CASE WHEN event_type IN ('click', 'purchase', 'signup') THEN 1 ELSE 0 END) OVER w AS seen
  FROM ev WINDOW w AS (PARTITION BY session ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
), seg AS (
  SELECT *, CAST(sum(CASE WHEN event_type = 'signup' OR (opener AND seen = 1) THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seg_id
  FROM flagged
)"""
CHILDREN = f"{SEG}, st AS (SELECT session, seg_id, min(ts) AS start_ts FROM seg WHERE seg_id > 0 GROUP BY session, seg_id), ch AS (SELECT user_id AS session, event_id AS child_id, ts - INTERVAL 1 DAY AS child_ts FROM events)"
BUCKET = "input, output, cache_read, cache_5m, cache_1h, requests"
SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in BUCKET.split(", "))
AGGS = f"{SUMS}, CAST(sum(cost) AS BIGINT) AS cost, coalesce(bool_or(cost IS NULL), false) AS partial"
RATIO = "CAST({0}(cache_read) AS DOUBLE) / nullif(CAST({0}(cache_read) + {0}(input) + {0}(cache_5m) + {0}(cache_1h) AS DOUBLE), 0)"
SESSIONS = f"{PRICED}, s AS (SELECT project, session, CAST(sum(cost) AS BIGINT) AS cost FROM priced GROUP BY ALL)"
MIDDLE = "TIMESTAMP '1995-06-30 00:00:00'"
RISING = "TIMESTAMP '1997-01-01 00:00:00'"


def _history(key: str, calls: str = "CAST(count(DISTINCT session) AS BIGINT)", where: str = "") -> str:
    return f"{PRICED} SELECT {key} AS key, {calls} AS calls, {AGGS} FROM priced {where} GROUP BY {key}"


def _halves(key: str, middle: str = MIDDLE) -> str:
    return (
        f"{PRICED}, h AS (SELECT {key}, CAST(sum(CASE WHEN ts < {middle} THEN coalesce(cost, 0) ELSE 0 END) AS BIGINT) AS before, "
        f"CAST(sum(CASE WHEN ts < {middle} THEN 0 ELSE coalesce(cost, 0) END) AS BIGINT) AS after FROM priced GROUP BY {key})"
    )


ORACLES: dict[str, str] = {
    "usage_dedup_max": f"{LOG} SELECT session, request_id, {BUCKET} FROM requests",
    "usage_first_seen_attrs": f"{LOG} SELECT session, request_id, label, model, day FROM requests",
    "bucket_sums": f"{LOG} SELECT project, model, {SUMS} FROM requests GROUP BY ALL",
    "first_record_per_id": f"{LOG} SELECT session, request_id, model, output, ord FROM req_log QUALIFY row_number() OVER (PARTITION BY session, request_id ORDER BY ord) = 1",
    "generation_first_usage": f"""{EV}, g AS (SELECT CAST(event_id // 7 AS BIGINT) AS generation, event_id, k, event_type = 'purchase' AS bears FROM ev)
        SELECT generation, bool_or(bears) AS measured,
               coalesce(arg_min(k, event_id) FILTER (bears), 0) AS input, coalesce(arg_min(k + 1, event_id) FILTER (bears), 0) AS output,
               CAST(0 AS BIGINT) AS cache_read, CAST(CASE WHEN bool_or(bears) THEN 2 ELSE 0 END AS BIGINT) AS cache_5m, CAST(0 AS BIGINT) AS cache_1h, CAST(1 AS BIGINT) AS requests
        FROM g GROUP BY generation""",
    "unmeasured_ids": f"{EV} SELECT DISTINCT session FROM ev WHERE event_type = 'error' AND session NOT IN (SELECT session FROM ev WHERE event_type = 'purchase' AND k > 95)",
    "price_longest_prefix": f"WITH req_log AS (SELECT p_brand AS model FROM part), price AS ({PRICE_SQL}), rates AS ({RATES_SQL}) SELECT model, key, rate_in, rate_out FROM rates",
    "price_overlay": f"WITH b AS ({BUNDLED_SQL}), o AS ({OVERLAY_SQL}) SELECT key, rate_in, rate_out, rate_read FROM o WHERE rate_in >= 0 UNION ALL SELECT * FROM b WHERE key NOT IN (SELECT key FROM o)",
    "cost_by_model": _history("model", "CAST(sum(requests) AS BIGINT)"),
    "cost_by_project": _history("project"),
    "cost_by_label": _history("label"),
    "cost_by_day": _history("day"),
    "history_ranked": f"{PRICED} SELECT CAST(row_number() OVER (ORDER BY coalesce(sum(cost), 0) DESC, label) AS BIGINT) AS rank, label AS key, CAST(sum(cost) AS BIGINT) AS cost FROM priced GROUP BY label",
    "cost_rollup_total": f"{PRICED} SELECT project AS key, grouping(project) = 1 AS total, {AGGS} FROM priced GROUP BY ROLLUP (project)",
    "label_model_grouping_sets": f"{PRICED} SELECT label, model, CAST(grouping(label, model) AS BIGINT) AS grain, {AGGS} FROM priced GROUP BY GROUPING SETS ((label), (label, model), ())",
    "cache_savings": f"{PRICED} SELECT label, CAST(sum(CAST(round(cache_read * (rate_in - rate_read)) AS BIGINT)) AS BIGINT) AS saved FROM priced GROUP BY label",
    "cache_ratio_by_label": f"{LOG} SELECT label, round({RATIO.format('sum')}, 9) AS ratio FROM requests GROUP BY label",
    "unpriced_models": f"{LOG}, price AS (SELECT * FROM ({PRICE_SQL}) WHERE key <> 'Brand'), rates AS ({RATES_SQL}) SELECT DISTINCT model FROM requests WHERE greatest(input, output, cache_read, cache_5m, cache_1h) > 0 AND model NOT IN (SELECT model FROM rates)",
    "charged_override": f"""{PRICED}, c AS (SELECT *, CASE WHEN session % 7 <> 0 THEN output * 10 END AS charge FROM priced)
        SELECT session, CAST(CASE WHEN count(*) = count(charge) THEN sum(charge) ELSE sum(cost) END AS BIGINT) AS cost, CAST(count(*) - count(charge) AS BIGINT) AS n_missing FROM c GROUP BY session""",
    "partial_flags": f"{FEW} SELECT project AS key, CAST(sum(cost) AS BIGINT) AS cost, bool_or(cost IS NULL) AS partial FROM priced GROUP BY project",
    "history_project_filter": _history("project", where="WHERE contains(project, 'U')"),
    "history_since": f"{LOG} SELECT session, strftime(min(ts), '%Y-%m-%d') AS first_ts FROM requests GROUP BY session HAVING strftime(min(ts), '%Y-%m-%d') >= '1995-02-15'",
    "top_sessions": f"""{PRICED} SELECT CAST(row_number() OVER (ORDER BY sum(cost) DESC NULLS LAST, session) AS BIGINT) AS rank, session AS key, CAST(sum(requests) AS BIGINT) AS calls, CAST(sum(cost) AS BIGINT) AS cost, bool_or(cost IS NULL) AS partial
        FROM priced GROUP BY session QUALIFY rank <= 20""",
    "top_labels": f"""{PRICED} SELECT CAST(row_number() OVER (ORDER BY sum(cost) DESC NULLS LAST, label) AS BIGINT) AS rank, label AS key, CAST(count(DISTINCT session) AS BIGINT) AS calls, CAST(sum(cost) AS BIGINT) AS cost
        FROM priced GROUP BY label QUALIFY rank <= 3""",
    "unpriced_cut_count": f"""{FEW}, m AS (SELECT model, sum(cost) AS cost, row_number() OVER (ORDER BY sum(cost) DESC NULLS LAST, model) AS r FROM priced GROUP BY model)
        SELECT CAST(count(*) FILTER (cost IS NULL) AS BIGINT) AS unpriced, CAST(count(*) FILTER (cost IS NULL AND r > 8) AS BIGINT) AS hidden FROM m""",
    "dashboard_top10": f"""{PRICED}, g AS (SELECT 'project' AS grain, project AS key, cost FROM priced UNION ALL SELECT 'command', label, cost FROM priced UNION ALL SELECT 'model', model, cost FROM priced)
        SELECT grain, key, CAST(sum(cost) AS BIGINT) AS cost, CAST(row_number() OVER (PARTITION BY grain ORDER BY coalesce(sum(cost), 0) DESC, key) AS BIGINT) AS rank FROM g GROUP BY grain, key QUALIFY rank <= 10""",
    "diff_two_sessions": f"""{PRICED}, a AS (SELECT label, CAST(sum(cost) AS BIGINT) AS cost FROM priced WHERE session = 1 GROUP BY label), b AS (SELECT label, CAST(sum(cost) AS BIGINT) AS cost FROM priced WHERE session = 2 GROUP BY label),
        d AS (SELECT coalesce(a.label, b.label) AS label, CASE WHEN a.label IS NULL THEN 0 ELSE a.cost END AS old_cost, CASE WHEN b.label IS NULL THEN 0 ELSE b.cost END AS new_cost FROM a FULL JOIN b ON a.label = b.label)
        SELECT label, CAST(old_cost AS BIGINT) AS old_cost, CAST(new_cost AS BIGINT) AS new_cost, CAST(new_cost - old_cost AS BIGINT) AS delta,
               CAST(row_number() OVER (ORDER BY abs(coalesce(new_cost - old_cost, 0)) DESC, label) AS BIGINT) AS rank FROM d""",
    "median_session_cost": f"{SESSIONS} SELECT project, CAST(median(cost) AS DOUBLE) AS median_cost, CAST(count(cost) AS BIGINT) AS n FROM s GROUP BY project",
    "baseline_by_label": f"""{PRICED}, l AS (SELECT label, session, CAST(sum(cost) AS BIGINT) AS cost, {RATIO.format('sum')} AS ratio FROM priced GROUP BY label, session)
        SELECT label, CAST(count(cost) AS BIGINT) AS n, CAST(median(cost) AS DOUBLE) AS median_cost, round(median(ratio), 9) AS median_ratio FROM l GROUP BY label""",
    "cost_outlier": f"""{SESSIONS}, b AS (SELECT project, median(cost) AS baseline, count(cost) AS n FROM s GROUP BY project)
        SELECT 'cost-outlier' AS rule, CASE WHEN cost / baseline >= 3 THEN 'warn' ELSE 'info' END AS severity, CAST(session AS STRING) AS subject, round(cost / baseline, 6) AS value
        FROM s JOIN b USING (project) WHERE n >= 5 AND cost / nullif(baseline, 0) >= 2""",
    "cache_regression": f"""{LOG}, l AS (SELECT label, request_id, {RATIO.format('sum')} AS ratio FROM (SELECT * REPLACE (cache_read * 10 AS cache_read) FROM requests) GROUP BY label, request_id), b AS (SELECT label, median(ratio) AS base, count(*) AS n FROM l GROUP BY label)
        SELECT 'cache-regression' AS rule, 'warn' AS severity, l.label || '/' || request_id AS subject, round(base - ratio, 6) AS value FROM l JOIN b USING (label) WHERE n >= 5 AND base - ratio >= 0.20""",
    "adhoc_share": f"""{PRICED}, a AS (SELECT session, CAST(sum(CASE WHEN label = '1-URGENT' THEN cost END) AS DOUBLE) / nullif(CAST(sum(cost) AS DOUBLE), 0) AS share FROM priced GROUP BY session)
        SELECT 'adhoc-dominance' AS rule, 'info' AS severity, CAST(session AS STRING) AS subject, round(share, 6) AS value FROM a WHERE share >= 0.5""",
    "agent_fanout": f"""{PRICED}, a AS (SELECT label || '/' || model AS label, CAST(sum(CASE WHEN session % 4 <> 0 THEN cost END) AS DOUBLE) / nullif(CAST(sum(cost) AS DOUBLE), 0) AS share FROM priced GROUP BY 1)
        SELECT 'agent-fanout' AS rule, 'info' AS severity, label AS subject, round(share, 6) AS value FROM a WHERE share >= 0.7""",
    "budget_pace": f"{SESSIONS} SELECT 'budget-pace' AS rule, 'info' AS severity, CAST(session AS STRING) AS subject, round(cost / 20000000000.0::DOUBLE, 6) AS value FROM s WHERE cost / 20000000000.0::DOUBLE >= 0.75 AND cost / 20000000000.0::DOUBLE < 1",
    "spend_trend": f"""{_halves('model')}, t AS (SELECT model, before, CAST(after - before AS DOUBLE) / nullif(CAST(before AS DOUBLE), 0) AS change FROM h)
        SELECT 'spend-trend' AS rule, CASE WHEN change >= 0.5 THEN 'warn' ELSE 'info' END AS severity, model AS subject, round(change, 6) AS value FROM t WHERE before > 0 AND abs(change) >= 0.25""",
    "top_mover": f"""{_halves('label', RISING)}, s AS (SELECT sum(before) AS first, sum(after - before) AS rise FROM h)
        SELECT label, CAST(after - before AS BIGINT) AS delta, round(CAST(after - before AS DOUBLE) / CAST(rise AS DOUBLE), 9) AS share FROM h, s WHERE first > 0 AND rise > 0 AND after > before ORDER BY after - before DESC, label DESC LIMIT 1""",
    "budget_multiple": f"""{PRICED}, d AS (SELECT project, day, sum(cost) AS cost FROM priced GROUP BY project, day),
        m AS (SELECT project, day, CAST(floor(sum(cost) OVER (PARTITION BY project ORDER BY day ROWS UNBOUNDED PRECEDING) / 100000000000) AS BIGINT) AS multiple FROM d)
        SELECT project, day, multiple FROM m QUALIFY multiple > coalesce(lag(multiple) OVER (PARTITION BY project ORDER BY day), 0)""",
    "sticky_segments": f"{SEG} SELECT event_id, seg_id FROM seg",
    "skill_first_use": f"{EV} SELECT session, k % 10 AS use_id, event_id FROM ev WHERE event_type = 'view' QUALIFY row_number() OVER (PARTITION BY session, k % 10 ORDER BY ts, event_id) = 1",
    "prompt_backfill": r"WITH p AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN '' ELSE substr(regexp_replace(text, '^\s+|\s+$', '', 'g'), 1, 120) END AS t FROM conversations WHERE role = 'user') SELECT conv_id, arg_min(t, turn) FILTER (length(t) > 0) AS prompt FROM p GROUP BY conv_id",
    "segment_usage": f"{SEG} SELECT session, seg_id, CAST(sum(k) AS BIGINT) AS output, CAST(count(*) AS BIGINT) AS requests FROM seg WHERE event_type = 'purchase' GROUP BY session, seg_id",
    "cumulative_delta": f"{EV}, l AS (SELECT event_id, k, lag(k) OVER (PARTITION BY session ORDER BY ts, event_id) AS p FROM ev WHERE event_type = 'error') SELECT event_id, k - coalesce(p, 0) AS delta FROM l WHERE NOT coalesce(k < p, false) AND k - coalesce(p, 0) > 0",
    "sticky_model": f"{EV} SELECT event_id, last_value(CASE WHEN event_type = 'view' THEN 'm' || CAST(k % 5 AS STRING) END IGNORE NULLS) OVER (PARTITION BY session ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS now FROM ev",
    "running_max_remainder": f"""{EV}, c AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN k % 7 ELSE 0 END) OVER (PARTITION BY session ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS captured FROM ev WHERE event_type IN ('error', 'purchase')),
        b AS (SELECT *, greatest(0, max(k - captured) OVER (PARTITION BY session ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS best FROM c WHERE event_type = 'error')
        SELECT event_id, CAST(best - coalesce(lag(best) OVER (PARTITION BY session ORDER BY ts, event_id), 0) AS BIGINT) AS remainder FROM b""",
    "turn_folding": """WITH n AS (SELECT *, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS turn_index FROM conversations)
        SELECT conv_id, turn_index, max(text) FILTER (role = 'user') AS prompt, coalesce(string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'assistant'), '') AS assistant, CAST(count(*) FILTER (role = 'assistant') AS BIGINT) AS n_parts
        FROM n WHERE role IN ('user', 'assistant') AND turn_index > 0 GROUP BY conv_id, turn_index""",
    "asof_child_segment": f"""{CHILDREN}, s1 AS (SELECT session, start_ts, max(seg_id) AS seg_id FROM st GROUP BY ALL), la AS (SELECT session, max(seg_id) AS last FROM st GROUP BY session)
        SELECT ch.session, child_id, coalesce(s1.seg_id, la.last) AS seg_id FROM ch ASOF LEFT JOIN s1 ON ch.session = s1.session AND ch.child_ts >= s1.start_ts LEFT JOIN la ON la.session = ch.session""",
    "last_started_segment": f"""{CHILDREN}, s1 AS (SELECT session, start_ts, max(max(seg_id)) OVER (PARTITION BY session ORDER BY start_ts) AS seg_id FROM st GROUP BY session, start_ts)
        SELECT ch.session, child_id, s1.seg_id FROM ch ASOF LEFT JOIN s1 ON ch.session = s1.session AND ch.child_ts >= s1.start_ts""",
    "orphan_anti": "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "coverage_semi": "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT CASE WHEN l_linenumber > 1 AND l_orderkey > 0 THEN l_orderkey ELSE l_suppkey END FROM lineitem WHERE l_quantity > 49)",
    "parent_closure": """WITH RECURSIVE p AS (SELECT o_orderkey AS node, CASE o_orderkey % 1000 WHEN 17 THEN o_orderkey + 1 WHEN 18 THEN o_orderkey - 1 ELSE o_orderkey // 10 END AS parent FROM orders),
        e AS (SELECT node, CAST(parent AS BIGINT) AS parent FROM p WHERE parent IN (SELECT o_orderkey FROM orders) AND parent <> node),
        r AS (SELECT node, parent AS up, 1 AS depth FROM e UNION ALL SELECT r.node, e.parent, depth + 1 FROM r JOIN e ON r.up = e.node WHERE depth < 40)
        SELECT node, max(CASE WHEN up NOT IN (SELECT node FROM e) THEN up END) AS root FROM r GROUP BY node""",
    "ordered_merge": """WITH m AS (SELECT ts, 0 AS source_rank, event_id AS line FROM events UNION ALL SELECT o_orderdate, 1, o_orderkey FROM orders)
        SELECT CAST(CAST(ts AS DATE) AS STRING) AS day, source_rank, line, CAST(row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, source_rank, line) AS BIGINT) AS n FROM m""",
    "tool_result_match": f"""{EV}, n AS (SELECT session, CAST(k % 3 AS STRING) AS name, CASE WHEN k % 4 = 0 THEN k END AS id, event_id, event_type FROM ev WHERE event_type IN ('click', 'view')),
        f AS (SELECT session, id, min(event_id) AS call FROM n WHERE event_type = 'click' AND id IS NOT NULL GROUP BY ALL),
        v AS (SELECT n.*, f.call FROM n LEFT JOIN f ON f.session = n.session AND f.id = n.id WHERE event_type = 'view'),
        a AS (SELECT session, call, min(event_id) AS by_id FROM v WHERE call IS NOT NULL GROUP BY ALL),
        c AS (SELECT n.*, a.by_id FROM n LEFT JOIN a ON a.session = n.session AND a.call = n.event_id WHERE event_type = 'click'),
        o AS (SELECT *, CASE WHEN by_id IS NULL THEN row_number() OVER (PARTITION BY session, name, by_id IS NULL ORDER BY event_id) END AS r FROM c),
        l AS (SELECT *, row_number() OVER (PARTITION BY session, name ORDER BY event_id) AS r FROM v WHERE call IS NULL)
        SELECT coalesce(o.session, l.session) AS session, coalesce(o.name, l.name) AS name, o.event_id, coalesce(o.by_id, l.event_id) AS result_ord, o.event_id IS NULL AS synthetic
        FROM o FULL JOIN l ON o.session = l.session AND o.name = l.name AND o.r = l.r""",
    "latest_version_wins": f"{EV} SELECT session, k, event_id, event_type FROM ev QUALIFY row_number() OVER (PARTITION BY session ORDER BY k DESC, k % 3 DESC, event_id DESC) = 1",
    "window_replace_merge": """SELECT event_id, CASE WHEN ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' THEN 1.0 ELSE value END AS value FROM events
        WHERE NOT (ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20') OR event_id % 3 = 0""",
    "publish_idempotent": f"{EV} SELECT DISTINCT session, sha256('{{\"event_type\":\"' || event_type || '\",\"k\":' || CAST(k AS STRING) || ',\"note\":' || CASE k % 3 WHEN 0 THEN '\"a|b\"' WHEN 1 THEN '\"\"' ELSE 'null' END || '}}') AS content_hash FROM ev",
    "json_counters_strict": "SELECT event_id, CASE WHEN json_type(props, '$.k') IN ('UBIGINT', 'BIGINT') AND CAST(json_extract_string(props, '$.k') AS BIGINT) >= 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events",
    "measurement_tally": f"""{EV} SELECT session, CAST(count(*) FILTER (event_type = 'purchase') AS BIGINT) AS n_exact, CAST(count(*) FILTER (event_type NOT IN ('purchase', 'error')) AS BIGINT) AS n_partial, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS n_activity_only,
        CASE max(CASE event_type WHEN 'purchase' THEN 0 WHEN 'error' THEN 2 ELSE 1 END) WHEN 0 THEN 'exact' WHEN 1 THEN 'partial' ELSE 'activity_only' END AS worst FROM ev GROUP BY session""",
    "activity_only_hidden": f"{PRICED}, h AS (SELECT project, CASE WHEN session % 3 <> 0 THEN cost END AS cost FROM priced) SELECT project AS key, CAST(sum(cost) AS BIGINT) AS cost, bool_or(cost IS NULL) AS partial FROM h GROUP BY project",
    "day_split": f"""{LOG}, d AS (SELECT *, CASE WHEN output % 5 <> 0 THEN day END AS known FROM requests), f AS (SELECT *, coalesce(known, min(known) OVER (PARTITION BY session), 'unknown') AS on_day FROM d)
        SELECT session, on_day AS day, {SUMS} FROM f GROUP BY session, on_day""",
    "export_metrics_long": f"""{LOG}, s AS (SELECT label, {SUMS} FROM requests GROUP BY label)
        SELECT label, 'tokens.input' AS metric, input AS value FROM s UNION ALL SELECT label, 'tokens.output', output FROM s UNION ALL SELECT label, 'tokens.cache_read', cache_read FROM s
        UNION ALL SELECT label, 'tokens.cache_write', cache_5m + cache_1h FROM s UNION ALL SELECT label, 'requests', requests FROM s""",
    "label_regex": r"""SELECT conv_id, turn, nullif(regexp_extract(CASE WHEN turn % 2 = 0 THEN '  /' ELSE '' END || regexp_replace(text, '[^A-Za-z0-9 ]', '', 'g'), '^\s*([$/][A-Za-z0-9][A-Za-z0-9_:-]*)\b', 1), '') AS label, role AS tag FROM conversations""",
    "slug": "SELECT page_id, regexp_replace(url, '[^A-Za-z0-9]', '-', 'g') AS slug, regexp_replace(url, '[^A-Za-z0-9_-]', '', 'g') AS safe FROM pages",
    "clip_text": "SELECT doc_id, CAST(length(CASE WHEN length(text) > 20000 THEN substr(text, 1, 20000) || '…[truncated]' ELSE text END) AS BIGINT) AS n, md5(CASE WHEN length(text) > 20000 THEN substr(text, 1, 20000) || '…[truncated]' ELSE text END) AS digest FROM documents",
    "repo_from_url": r"SELECT page_id, regexp_replace(regexp_replace(regexp_extract(url || '.git', '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '^/+|/+$', '', 'g'), '\.git$', '') AS repo FROM pages",
    "source_ids": "SELECT conv_id, turn, CAST(conv_id AS STRING) || CASE WHEN role = 'assistant' THEN ':a1' ELSE '' END || ':turn-' || CAST(turn AS STRING) AS source_id FROM conversations",
    "surface_map": """WITH r AS (SELECT conv_id, turn, ['Claude', 'claude-code', 'codex', 'other', '', 'Grok-Bot', 'antigravity', 'cloud_agent', NULL][turn % 9 + 1] AS runtime,
          ['/x/a.jsonl', '/home/.Claude/b', 'C:\\codex\\c', '/cloud-agent/d', '/gemini/e', '/grok/f', '/x/claude/g'][conv_id % 7 + 1] AS path FROM conversations),
        n AS (SELECT *, replace(lower(coalesce(runtime, '')), '-', '_') AS rt, lower(replace(path, '\\', '/')) AS low FROM r),
        m AS (SELECT *, CASE WHEN rt IN ('grok', 'grok_bot') THEN 'grok' WHEN rt IN ('cursor', 'cloud_agent', '') THEN 'cursor' WHEN rt IN ('claude', 'claude_code') THEN 'claude' WHEN rt IN ('gemini', 'antigravity') THEN 'gemini' ELSE rt END AS vendor FROM n)
        SELECT conv_id, turn, vendor, CASE WHEN vendor = 'grok' THEN 'grok_bot' ELSE vendor END AS source_type,
          CASE WHEN low LIKE '%cloud-agent%' THEN 'cloud_agent' WHEN vendor = 'grok' THEN 'grok_bot' WHEN vendor = 'codex' THEN 'codex' WHEN vendor = 'claude' THEN 'claude_code' WHEN vendor = 'gemini' THEN 'antigravity' ELSE 'ide' END AS surface,
          CASE WHEN turn % 2 = 0 AND length(coalesce(runtime, '')) > 0 THEN vendor WHEN low LIKE '%grok%' THEN 'grok' WHEN low LIKE '%codex%' THEN 'codex' WHEN low LIKE '%.claude%' OR low LIKE '%/claude/%' THEN 'claude'
               WHEN low LIKE '%gemini%' THEN 'gemini' ELSE 'cursor' END AS inferred FROM m""",
}
