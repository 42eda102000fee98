"""Queries over operators that carry state along a log: turns, outbox, hook replay, descendants, overlap merge.

Their logs are made from the driver's tables by SQL that both engines read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import joins, turns
from ..streaming import publish, replay
from .bench_views import Views
from .queries import query

#: Events as records of turns: prompts, answers and calls, contexts, requests and a cumulative count that begins anew now and then.
TURN_LOG = """SELECT user_id AS session, event_id AS ord,
 CASE event_type WHEN 'signup' THEN 'prompt' WHEN 'click' THEN 'usage' WHEN 'purchase' THEN 'total' WHEN 'error' THEN CASE k % 2 WHEN 0 THEN 'call' ELSE 'result' END
  ELSE CASE k % 3 WHEN 0 THEN 'context' ELSE 'answer' END END AS kind,
 CASE WHEN event_type = 'view' AND k % 3 = 0 AND k % 4 > 0 THEN 't' || CAST(k % 4 AS STRING) ELSE '' END AS ident, 'n' || CAST(k % 3 AS STRING) AS name,
 '' AS model, CAST(ts AS STRING) AS ts, event_type || ' ' || CAST(k AS STRING) AS text, CASE WHEN k % 2 = 0 THEN 'r' || CAST(k % 5 AS STRING) ELSE '' END AS request,
 CASE WHEN event_type = 'purchase' THEN CASE WHEN k % 17 = 0 THEN 0 ELSE CAST(floor(event_id / 3) AS BIGINT) END ELSE k END AS input, CAST(k % 7 AS BIGINT) * CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END AS output,
 CAST(0 AS BIGINT) AS cache_read, CAST(0 AS BIGINT) AS cache_write FROM ({0}) AS e"""
EVENTS = "SELECT event_id, user_id, event_type, ts, CAST(regexp_replace(props, '[^0-9]', '', 'g') AS BIGINT) AS k FROM events"

#: Events as an outbox: bodies of equal content in two spellings, versions that come out of order, and what of it was delivered.
OUTBOX = """SELECT CAST(ts AS STRING) || '/' || CAST(event_id AS STRING) AS created_at, 's' || CAST(k % 40 AS STRING) || '-' || CAST(user_id AS STRING) AS source_id, CASE WHEN k % 3 = 0 THEN 'end' ELSE 'turn' END AS endpoint,
 'u' || CAST(user_id AS STRING) AS session, k % 3 = 0 AS mutable, CAST(event_id % 11 AS BIGINT) AS turn, CAST(k % 4 AS BIGINT) AS stage, CAST(event_id % 5 AS BIGINT) AS revision,
 CASE WHEN event_id % 2 = 0 THEN '{{"a":' || CAST(k % 6 AS STRING) || ',"b":"x"}}' ELSE '{{ "b":"x", "a":' || CAST(k % 6 AS STRING) || ' }}' END AS body, k % 6 AS content, event_type FROM ({0}) AS e"""

#: Events as lines of a hook log.
HOOKS = """SELECT event_id, '{{"conversation_id":"u' || CAST(user_id AS STRING) || '","generation_id":"g' || CAST(k % 9 AS STRING) || '","ts":"' || CAST(event_id AS STRING) || '","hook":"' ||
 CASE event_type WHEN 'click' THEN 'stop' WHEN 'purchase' THEN 'afterAgentResponse' WHEN 'error' THEN 'subagentStop' ELSE 'beforeSubmitPrompt' END || '"' ||
 CASE WHEN event_type = 'signup' THEN ',"model":"m' || CAST(k % 3 AS STRING) || '"' ELSE '' END || CASE WHEN event_type = 'view' THEN ',"label":"/l' || CAST(k % 5 AS STRING) || '"' ELSE '' END ||
 CASE WHEN event_type = 'error' AND k % 4 > 0 THEN ',"subagent_id":"a' || CAST(k % 4 AS STRING) || '"' ELSE '' END ||
 CASE WHEN event_type = 'click' AND k % 2 = 0 THEN ',"tokens":{{"input_tokens":' || CAST(k AS STRING) || ',"output_tokens":3}}' ELSE '' END || '}}' AS value FROM ({0}) AS e"""

#: Customers as sessions: parents by id (some in a cycle), and folders inside folders for every fifth.
FAMILY = """SELECT c_custkey AS n, CASE WHEN c_custkey % 5 <> 0 THEN CASE WHEN c_custkey % 100 = 3 THEN 2 * c_custkey ELSE CAST(floor(c_custkey / 2) AS BIGINT) END END AS parent,
 CASE WHEN c_custkey % 25 = 0 THEN '/d' || CAST(c_custkey AS STRING) WHEN c_custkey % 5 = 0 THEN '/d' || CAST(CAST(floor(c_custkey / 25) * 25 AS BIGINT) AS STRING) || '/sub/x' || CAST(c_custkey AS STRING) END AS folder FROM customer"""


def _events(v: Views, text: str) -> DataFrame:
    """A log from ``events``; the braces of its JSON are doubled in the text, for Spark's formatter as for Python's."""
    inner = EVENTS.replace(", 'g')", ")").replace("FROM events", "FROM {events}")
    return v.spark.sql(text.replace("{0}", inner), events=v.table("events"))


@query
def turn_lookahead(v: Views) -> DataFrame:
    """Turns with usage that contexts divert to the next one, cumulative totals and tools, over chunks of 2,000 events."""
    log = _events(v, TURN_LOG).withColumn("chunk", F.floor(F.col("ord") / 2000).cast("long"))
    found = turns.fold(log, ["session"])
    return found.select("session", "turn", F.coalesce("prompt", F.lit("")).alias("prompt"), F.md5("assistant").alias("digest"), "ident", "input", "output", "tools", "answered")


@query
def outbox_pending(v: Views) -> DataFrame:
    """What is still to be sent of a log of queued versions, of which some were delivered."""
    rows = _events(v, OUTBOX)
    outbox = rows.where("event_type <> 'signup'").drop("content", "event_type")
    delivered = rows.where("event_type = 'signup'").select("source_id", "endpoint", publish.canonical_hash(F.col("body")).alias("content_hash"), "session", "turn", "stage", "revision")
    return publish.pending(outbox, delivered).select("created_at", "source_id", "endpoint", "session", "turn", "stage", "revision")


@query
def hook_replay(v: Views) -> DataFrame:
    """Generations of a hook log: place, first time, model and label, first usage, ends and subagents."""
    return replay.replayed(replay.parsed(_events(v, HOOKS), F.col("event_id")))


@query
def descendant_closure(v: Views) -> DataFrame:
    """Everything below the sessions up to 40, by parent id or by folder, cycles included."""
    rows = v.sql(FAMILY.replace("FROM customer", "FROM {customer}"), "customer")
    edges = joins.id_edges(rows, "n", "parent").union(joins.folder_edges(rows, "n", "folder"))
    return joins.descendants(rows.where("n <= 40").select(F.col("n").alias("root")), edges).select("root", "node")
