"""Bridge records to common columns: aliases of counters, roles, models, times, ids. Expressions over VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalize import CODEX, Field, Normaliser, codex, get, kind_of

#: Fixed names: record types that hold no chat, and the other spellings of each counter.
SKIP_TYPES = ["session_meta", "progress", "event_msg", "token_count", "turn_context", "rate_limit", "rate_limit_event", "system"]
CODEX_TYPES = ["response_item", "token_usage_record", "session_meta", "turn_context"]
ALIASES = {
    "input": ("input_tokens", "input"),
    "output": ("output_tokens", "output"),
    "cache_read": ("cache_read_tokens", "cache_read_input_tokens", "cache_read", "cached_input_tokens"),
    "cache_write": ("cache_write_tokens", "cache_creation_input_tokens", "cache_write_input_tokens", "cache_write"),
}
PAYLOAD_ALIASES = {c: (f"{n}_tokens", n) for c, n in (("input", "input"), ("output", "output"), ("cache_read", "cache_read"), ("cache_write", "cache_write"))}
SPEAKERS = {"human": "user", "user": "user", "assistant": "assistant", "ai": "assistant", "bot": "assistant", "grok": "assistant", "model": "assistant", "tool": "tool"}


def _first(v: Column, paths: list[str]) -> Column:
    """The first path that holds a string with more than white space, stripped."""
    found = [F.when(kind_of(v, p) == "STRING", F.nullif(F.trim(get(v, p)), F.lit(""))) for p in paths]
    return F.coalesce(*found, F.lit(""))


TTL = ("cache_creation.ephemeral_5m_input_tokens", "cache_creation.ephemeral_1h_input_tokens")


def _usage(f: dict[str, Field]) -> Column:
    five, hour = (f[n].number for n in TTL)
    zero = F.lit(0).cast("long")
    flat = {c: F.coalesce(*[f[n].number for n in names], zero) for c, names in ALIASES.items()}
    by_ttl = F.coalesce(five, hour).isNotNull()
    cached, wrote = f["cached_input_tokens"], f["cache_write_input_tokens"]
    inside = cached.kind.isNotNull() | wrote.kind.isNotNull()
    net = codex.use(f)
    too_much = F.coalesce(cached.number, zero) + F.coalesce(wrote.number, zero) > flat["input"]
    return F.struct(
        F.when(inside & net.isNotNull(), net["input"]).when(inside & too_much, zero).otherwise(flat["input"]).alias("input"),
        flat["output"].alias("output"),
        F.when(inside & net.isNotNull(), net["cache_read"]).otherwise(flat["cache_read"]).alias("cache_read"),
        F.when(by_ttl, F.coalesce(five, zero) + F.coalesce(hour, zero)).when(inside & net.isNotNull(), net["cache_5m"]).otherwise(flat["cache_write"]).alias("cache_write"),
    )


def _payload_tokens(f: dict[str, Field]) -> Column:
    return F.struct(*[F.coalesce(*[f[f"{at}{n}"].number for at in ("", "tokens.") for n in names]).alias(c) for c, names in PAYLOAD_ALIASES.items()])


#: Counters of a usage object under any of their names: input, output, cache_read, cache_write.
#: Cache writes by time to live are the whole of the flat count and not added to it. An object with the
#: cached-input names has its cached tokens inside its input; they are taken off, where they fit.
usage = Normaliser(tuple(dict.fromkeys([*CODEX, *[n for names in ALIASES.values() for n in names], *TTL])), _usage)
#: Counters of a hook payload: at the top, else in its ``tokens``; null where neither names one.
payload_tokens = Normaliser(tuple(f"{at}{n}" for names in PAYLOAD_ALIASES.values() for at in ("", "tokens.") for n in names), _payload_tokens)


def lifted(v: Column) -> Column:
    """The object that holds a record's fields: the payload of the wrapping types, else the record itself."""
    inner = get(v, "$.payload", "variant")
    return F.when(get(v, "$.type").isin(*CODEX_TYPES) & F.coalesce(F.startswith(F.schema_of_variant(inner), F.lit("OBJECT")), F.lit(False)), inner).otherwise(v)


def record_type(v: Column) -> Column:
    """Type after lifting: that of a lifted response item, else the record's own."""
    own = get(v, "$.type")
    return F.when(own == "response_item", F.coalesce(get(v, "$.payload.type"), F.lit("message"))).otherwise(own)


def tool_call(v: Column) -> Column:
    """A function call as struct of id, name and arguments; null for any other record."""
    r = lifted(v)
    name = F.coalesce(get(r, "$.name"), get(r, "$.function.name"), F.lit("tool"))
    arguments = F.coalesce(get(r, "$.arguments"), get(r, "$.function.arguments"), get(r, "$.input"), F.lit("{}"))
    ident = F.coalesce(F.nullif(get(r, "$.call_id"), F.lit("")), get(r, "$.id"), F.lit(""))
    return F.when(record_type(v) == "function_call", F.struct(ident.alias("id"), name.alias("name"), arguments.alias("arguments")))


def role(v: Column) -> Column:
    """Role of a record: none for types without chat, then the message's, its own, its speaker's, its type."""
    r, kind = lifted(v), record_type(v)
    speaker = F.lower(F.trim(F.coalesce(get(r, "$.speaker"), get(r, "$.author"))))
    spoken = F.lit(None).cast("string")
    for name, to in SPEAKERS.items():
        spoken = F.when(speaker == name, F.lit(to)).otherwise(spoken)
    named = F.coalesce(F.lower(F.trim(get(r, "$.message.role"))), F.lower(F.trim(get(r, "$.role"))), spoken, F.when(kind.isin("user", "assistant"), kind))
    shaped = F.when(kind == "function_call", "assistant").when(kind == "function_call_output", "tool")
    return F.when(kind.isin(*SKIP_TYPES), "").when(kind.isin("tool_result", "tool"), "tool").otherwise(F.coalesce(shaped, named, F.lit("")))


def model(v: Column) -> Column:
    return _first(lifted(v), ["$.message.model", "$.model", "$.subagent_model"])


def timestamp(v: Column) -> Column:
    names = ["$.timestamp", "$.ts", "$.created_at", "$.time", "$.message.timestamp"]
    return F.coalesce(F.nullif(_first(lifted(v), names), F.lit("")), _first(v, names[:2]))


def request_id(v: Column) -> Column:
    r = lifted(v)
    return _first(r, [f"$.{at}{n}" for at in ("", "message.") for n in ("requestId", "request_id", "response_id")])
