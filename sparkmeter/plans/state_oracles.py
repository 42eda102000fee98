"""DuckDB SQL for the queries of ``state_queries``."""

from __future__ import annotations

from .state_queries import EVENTS, FAMILY, HOOKS, OUTBOX, TURN_LOG


def _log(text: str) -> str:
    return text.replace("{0}", EVENTS).replace("{{", "{").replace("}}", "}")


_BEFORE = "PARTITION BY session ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
ORACLES = {
    "turn_lookahead": f"""WITH l AS ({_log(TURN_LOG)}),
a AS (SELECT *, count(*) FILTER (kind = 'prompt') OVER w AS seg, count(*) FILTER (kind = 'answer') OVER w AS said, last_value(CASE WHEN kind = 'context' AND ident <> '' THEN ident END IGNORE NULLS) OVER ({_BEFORE}) AS announced,
  lag(input, 1, 0) OVER (PARTITION BY session, kind ORDER BY ord) AS last_input FROM l WINDOW w AS (PARTITION BY session ORDER BY ord ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, coalesce(max(CASE WHEN kind = 'prompt' THEN announced END) OVER (PARTITION BY session, seg), '') AS own, max(CASE WHEN seg = 0 THEN said ELSE 0 END) OVER (PARTITION BY session) AS spoke FROM a),
c AS (SELECT *, count(*) FILTER (kind = 'context' AND (seg > 0 OR said > 0) AND (ident = '' OR ident <> own)) OVER (PARTITION BY session, seg ORDER BY ord ROWS UNBOUNDED PRECEDING) AS ahead,
  kind = 'usage' OR (kind = 'total' AND input >= last_input) AS uses FROM b),
d AS (SELECT *, CASE WHEN seg = 0 AND uses AND spoke = 0 THEN 1 WHEN uses AND ahead > 0 THEN seg + 1 ELSE seg END AS turn FROM c),
u AS (SELECT session, turn, max(CASE WHEN kind = 'total' THEN input - last_input ELSE input END) AS input, max(output) AS output FROM d WHERE uses GROUP BY session, turn, CASE WHEN request = '' THEN '#' || CAST(ord AS STRING) ELSE request END),
us AS (SELECT session, turn, CAST(sum(input) AS BIGINT) AS input, CAST(sum(output) AS BIGINT) AS output FROM u GROUP BY session, turn),
n AS (SELECT session, turn, name, count(*) FILTER (kind = 'call') AS calls, count(*) FILTER (kind = 'result') AS results FROM d WHERE kind IN ('call', 'result') GROUP BY session, turn, name),
t AS (SELECT session, turn, CAST(sum(greatest(calls, results)) AS BIGINT) AS tools, CAST(sum(results) AS BIGINT) AS answered FROM n GROUP BY session, turn),
p AS (SELECT session, turn, coalesce(max(CASE WHEN kind = 'prompt' THEN text END), '') AS prompt, coalesce(string_agg(text, chr(10) ORDER BY ord) FILTER (kind = 'answer'), '') AS said, max(own) AS ident FROM d WHERE kind IN ('prompt', 'answer', 'call', 'result') GROUP BY session, turn)
SELECT session, CAST(turn AS BIGINT) AS turn, coalesce(prompt, '') AS prompt, md5(coalesce(said, '')) AS digest, coalesce(ident, '') AS ident, coalesce(input, 0) AS input, coalesce(output, 0) AS output, coalesce(tools, 0) AS tools, coalesce(answered, 0) AS answered
FROM p FULL JOIN us USING (session, turn) LEFT JOIN t USING (session, turn)
WHERE coalesce(prompt, '') <> '' OR coalesce(said, '') <> '' OR coalesce(tools, 0) > 0 OR coalesce(input, 0) > 0 OR coalesce(output, 0) > 0""",
    "outbox_pending": f"""WITH l AS ({_log(OUTBOX)}), done AS (SELECT * FROM l WHERE event_type = 'signup'),
q AS (SELECT * FROM l WHERE event_type <> 'signup' AND NOT EXISTS (SELECT 1 FROM done d WHERE d.source_id = l.source_id AND d.endpoint = l.endpoint AND d.content = l.content)),
m AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY source_id, endpoint ORDER BY turn DESC, stage DESC, revision DESC, created_at DESC) = 1),
s AS (SELECT session, endpoint, max({{'t': turn, 's': stage, 'r': revision}}) AS seen FROM done GROUP BY session, endpoint)
SELECT created_at, source_id, endpoint, session, turn, stage, revision FROM m LEFT JOIN s USING (session, endpoint)
WHERE NOT (mutable AND seen IS NOT NULL AND {{'t': turn, 's': stage, 'r': revision}} < seen)""",
    "hook_replay": f"""WITH l AS (SELECT event_id, 'u' || CAST(user_id AS STRING) AS session, 'g' || CAST(k % 9 AS STRING) AS generation, event_type AS kind, k FROM ({EVENTS}) AS e),
g AS (SELECT session, generation, min(event_id) AS first, arg_min('m' || CAST(k % 3 AS STRING), event_id) FILTER (kind = 'signup') AS model, arg_min('/l' || CAST(k % 5 AS STRING), event_id) FILTER (kind = 'view') AS label,
  coalesce(arg_min(k, event_id) FILTER (kind = 'click' AND k % 2 = 0), 0) AS input, count(*) FILTER (kind = 'click' AND k % 2 = 0) > 0 AS measured, CAST(count(*) FILTER (kind IN ('click', 'purchase')) AS BIGINT) AS ends,
  CAST(count(DISTINCT CASE WHEN kind = 'error' THEN k % 4 END) AS BIGINT) AS agents FROM l GROUP BY session, generation)
SELECT session, generation, CAST(row_number() OVER (PARTITION BY session ORDER BY first) AS BIGINT) AS place, CAST(first AS STRING) AS ts, model, label, CAST(input AS BIGINT) AS input, CAST(CASE WHEN measured THEN 3 ELSE 0 END AS BIGINT) AS output,
  CAST(0 AS BIGINT) AS cache_read, CAST(0 AS BIGINT) AS cache_5m, CAST(0 AS BIGINT) AS cache_1h, measured, ends, agents FROM g""",
    "descendant_closure": f"""WITH RECURSIVE f AS ({FAMILY}),
e AS (SELECT parent, n AS child FROM f WHERE parent IN (SELECT n FROM f) UNION SELECT CAST(floor(n / 25) * 25 AS BIGINT), n FROM f WHERE n % 5 = 0 AND n % 25 <> 0 AND CAST(floor(n / 25) * 25 AS BIGINT) IN (SELECT n FROM f)),
d(root, node) AS (SELECT parent, child FROM e WHERE parent <= 40 UNION SELECT d.root, e.child FROM d JOIN e ON d.node = e.parent)
SELECT root, node FROM d""",
}
