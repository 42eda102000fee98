"""JSON records made from the driver's tables. The SQL text is the same for Spark and DuckDB."""

from __future__ import annotations

#: Counters of a row: a (input), b (output), c (read), d (written), some of them spoiled by the order's number.
FIELDS = """l_orderkey AS okey, l_linenumber AS line, CAST(l_quantity * 100 AS BIGINT) AS a, CAST(floor(l_extendedprice) AS BIGINT) AS b,
CAST(round(l_discount * 100) * 100 AS BIGINT) AS c, CAST(round(l_tax * 100) * 100 AS BIGINT) AS d, l_orderkey % 9 AS m, l_linenumber % 3 AS t"""
IN = "CASE m WHEN 0 THEN 'true' WHEN 1 THEN '-5' WHEN 2 THEN '\"12\"' ELSE CAST(a AS STRING) END"
OUT = "CASE WHEN m = 3 THEN 'null' ELSE CAST(b AS STRING) END"
READ, WRITE = "CAST(c AS STRING)", "CASE WHEN m = 4 THEN '1.5' ELSE CAST(d AS STRING) END"


def usage_sql(body: str) -> str:
    """Rows of ``lineitem`` with a JSON text ``j``."""
    return f"SELECT *, {body} AS j FROM (SELECT {FIELDS} FROM lineitem) AS f"


def _object(**fields: str) -> str:
    parts = [f"'\"{name}\":' || {value}" for name, value in fields.items()]
    return "'{' || " + " || ',' || ".join(parts) + " || '}'"


CLAUDE = f"""CASE t WHEN 0 THEN {_object(input_tokens="CAST(a AS STRING)", output_tokens="CAST(b AS STRING)", cache_read_input_tokens=READ, cache_creation_input_tokens="CAST(d AS STRING)")}
 WHEN 1 THEN {_object(input_tokens="CAST(a AS STRING)", output_tokens="CAST(b AS STRING)", cache_creation_input_tokens="CAST(d AS STRING)", cache_creation="'{\"ephemeral_5m_input_tokens\":' || CAST(c AS STRING) || '}'")}
 ELSE {_object(input_tokens="CAST(a AS STRING)", cache_creation="'{\"ephemeral_5m_input_tokens\":' || CAST(c AS STRING) || ',\"ephemeral_1h_input_tokens\":' || CAST(d AS STRING) || '}'")} END"""
CODEX = _object(input_tokens=IN, output_tokens=OUT, cached_input_tokens=READ, cache_write_input_tokens=WRITE)
GEMINI = _object(input=IN, output=OUT, cached=READ, thoughts=WRITE, tool="CAST(t AS STRING)")
ANTIGRAVITY = _object(input_tokens=IN, output_tokens=OUT, cache_read_tokens=READ, cache_write_tokens=WRITE)
COPILOT = _object(inputTokens=IN, outputTokens=OUT, cacheReadTokens=READ, cacheWriteTokens=WRITE, cacheTtlSeconds="CASE t WHEN 0 THEN '300' WHEN 1 THEN '3600' ELSE '77' END")
BUBBLE = f"CASE WHEN t = 0 THEN {_object(inputTokens=IN, outputTokens=OUT, cacheReadTokens=READ)} WHEN t = 1 THEN {_object(input_tokens=IN, output_tokens=OUT, cache_write_tokens='CAST(d AS STRING)')} ELSE {_object(inputTokens="'0'", outputTokens="'-3'")} END"
HOOK = _object(input_tokens="CASE m WHEN 0 THEN 'true' ELSE CAST(a AS STRING) END", output_tokens=OUT, cache_read_tokens=READ, cache_write_tokens="CAST(d AS STRING)")
CLOUD = f"CASE WHEN t = 0 THEN {_object(inputTokens=IN, outputTokens='CAST(b AS STRING)')} ELSE {_object(inputTokens=IN, outputTokens='CAST(b AS STRING)', cacheReadTokens=READ, cacheWriteTokens=WRITE)} END"
BRIDGE = f"""CASE t WHEN 0 THEN {_object(input="CAST(a AS STRING)", output_tokens="CAST(b AS STRING)", cache_read=READ, cache_creation_input_tokens="CAST(d AS STRING)")}
 WHEN 1 THEN {_object(input_tokens="CAST(a AS STRING)", output_tokens="CAST(b AS STRING)", cached_input_tokens=READ, cache_write_input_tokens="CAST(d AS STRING)")}
 ELSE {_object(input_tokens="CAST(a AS STRING)", output="CAST(b AS STRING)", cache_write_tokens="'999999'", cache_creation="'{\"ephemeral_1h_input_tokens\":' || CAST(d AS STRING) || '}'")} END"""
PAYLOAD = f"CASE WHEN t = 0 THEN {_object(input=IN, cache_read_tokens=READ)} ELSE {_object(output_tokens=OUT, tokens=_object(input_tokens='CAST(a AS STRING)', output='CAST(b AS STRING)'))} END"

#: Chat records of eight forms by the turn's and the conversation's number.
WORDS = "regexp_replace(coalesce(role, '') || 'x', '[^a-z]', '')"
CHAT_SQL = f"""SELECT conv_id, turn, (turn + conv_id) % 8 AS form, {WORDS} AS w, CASE (turn + conv_id) % 8
 WHEN 0 THEN '{{"type":"user","message":{{"role":" User ","model":"m1","timestamp":"t0"}},"requestId":" r ","body":"plain"}}'
 WHEN 1 THEN '{{"role":"ASSISTANT","model":"  ","subagent_model":"m2","ts":" t1 ","body":[{{"type":"text","text":"one"}},{{"type":"image"}},{{"type":"text","text":"two"}}]}}'
 WHEN 2 THEN '{{"speaker":" Human ","created_at":"t2","response_id":"q' || CAST(turn AS STRING) || '","body":[]}}'
 WHEN 3 THEN '{{"author":"grok","time":"t3","message":{{"request_id":"deep"}}}}'
 WHEN 4 THEN '{{"type":"event_msg","payload":{{"type":"token_count"}},"role":"user"}}'
 WHEN 5 THEN '{{"type":"response_item","timestamp":"t5","payload":{{"type":"function_call","call_id":"c' || CAST(conv_id AS STRING) || '","name":"shell","arguments":"{{}}"}}}}'
 WHEN 6 THEN '{{"type":"response_item","payload":{{"type":"message","role":"user","model":"m6"}}}}'
 ELSE '{{"type":"tool_result","name":"' || {WORDS} || '"}}' END AS j FROM conversations"""

#: Cloud usage events; some with a malformed agent, without counters, or without a charge.
CLOUD_EVENT_SQL = """SELECT event_id, user_id, k, d, '{"timestamp":"' || CAST(1704067200000 + event_id * 260000 AS STRING) || '","userEmail":"x@example.org","cloudAgentId":"' || CASE WHEN k % 11 = 0 THEN 'no' ELSE 'bc-agent-no-' || CAST(user_id AS STRING) END
 || '","conversationId":"' || CASE WHEN k % 5 = 0 THEN '' ELSE 'c' || CAST(user_id % 3 AS STRING) END || '","model":"m' || CAST(k % 3 AS STRING) || '"' || CASE WHEN event_id % 4 = 0 THEN ',"automationId":"au' || CAST(event_id % 7 AS STRING) || '"' ELSE '' END
 || ',"tokenUsage":{"inputTokens":' || CASE WHEN k % 13 = 0 THEN 'true' ELSE CAST(k AS STRING) END || ',"outputTokens":2,"totalCents":' || CAST(k AS STRING) || '}' || CASE WHEN k % 2 = 0 THEN ',"chargedCents":' || CAST(k * 3 AS STRING) ELSE '' END || '}' AS j
FROM (SELECT event_id, user_id, CAST(regexp_replace(props, '[^0-9]', '', 'g') AS BIGINT) AS k, CAST(floor(event_id * 260000 / 86400000) AS BIGINT) AS d FROM events) AS e"""
