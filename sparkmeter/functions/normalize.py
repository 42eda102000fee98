"""Vendor usage records to the usage bucket, as Column expressions over VARIANT.

Each function gives a struct of the five counters, or null where the record is not valid. Counters are strict:
JSON booleans and strings are no numbers, negative numbers are invalid.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def kind_of(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def counter(v: Column, path: str) -> Column:
    """A counter that is a whole number and not negative, else null."""
    value = get(v, path, "bigint")
    return F.when((kind_of(v, path) == "BIGINT") & (value >= 0), value)


def number(v: Column, path: str) -> Column:
    """A whole or decimal number, cut to whole; no booleans, no strings."""
    kind = kind_of(v, path)
    return F.when((kind == "BIGINT") | kind.startswith("DECIMAL") | (kind == "DOUBLE"), get(v, path, "double").cast("long"))


def bad(v: Column, path: str) -> Column:
    """Whether a counter is there but not valid."""
    kind = kind_of(v, path)
    return F.coalesce((kind != "VOID") & counter(v, path).isNull(), F.lit(False))


class Field(NamedTuple):
    """What the normalisers ask of a field: its kind, and what ``counter`` and ``number`` give."""

    kind: Column
    count: Column
    number: Column

    def spoiled(self) -> Column:
        """Whether the field is there but no counter."""
        return F.coalesce((self.kind != "VOID") & self.count.isNull(), F.lit(False))


class Normaliser(NamedTuple):
    """A function of the named fields of an object (a dot for a field inside a field), all of them at ``$.``."""

    names: tuple[str, ...]
    use: Callable[[dict[str, Field]], Column]

    def __call__(self, v: Column) -> Column:
        return self.use({n: Field(kind_of(v, f"$.{n}"), counter(v, f"$.{n}"), number(v, f"$.{n}")) for n in self.names})

    def on(self, rows: DataFrame, column: str, name: str) -> DataFrame:
        """``rows`` with the result for a VARIANT column as column ``name``.

        Spark computes an expression again in every branch that names it, so the fields, their kinds and their values are columns of
        three projections: each is looked up, told and cast once.
        """
        inner: dict[str, list[str]] = {}
        for n in self.names:
            inner.setdefault(n.split(".")[0], []).extend(n.split(".")[1:])
        kinds = ", ".join(f"{n} struct<{', '.join(f'{x} variant' for x in own)}>" if own else f"{n} variant" for n, own in inner.items())
        own = [F.col(f"`{c}`") for c in rows.columns]
        found = rows.select(*own, get(F.col(column), "$", f"struct<{kinds}>").alias("_o"))
        found = found.select(*own, "_o", *[F.schema_of_variant(f"_o.{n}").alias(f"_k{i}") for i, n in enumerate(self.names)])
        values = []
        for i, n in enumerate(self.names):
            kind, at = F.col(f"_k{i}"), F.col(f"_o.{n}")
            whole, broken = F.when(kind == "BIGINT", get(at, "$", "bigint")), F.when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), get(at, "$", "double"))
            values += [whole.alias(f"_w{i}"), broken.cast("long").alias(f"_d{i}")]
        found = found.select(*own, *[f"_k{i}" for i in range(len(self.names))], *values)
        fields = {}
        for i, n in enumerate(self.names):
            whole = F.col(f"_w{i}")
            fields[n] = Field(F.col(f"_k{i}"), F.when(whole >= 0, whole), F.coalesce(whole.cast("double").cast("long"), f"_d{i}"))
        return found.select(*own, self.use(fields).alias(name))


def bucket(input_: Column, output: Column, read: Column, w5: Column, w1: Column) -> Column:
    zero = F.lit(0).cast("long")
    names = ("input", "output", "cache_read", "cache_5m", "cache_1h")
    return F.struct(*[F.coalesce(x.cast("long"), zero).alias(n) for n, x in zip(names, (input_, output, read, w5, w1), strict=True)])


def claude(u: Column) -> Column:
    """If either cache-write term is there both are used (missing: 0), else the flat field counts as five minutes."""
    c5, c1 = get(u, "$.cache_creation.ephemeral_5m_input_tokens", "bigint"), get(u, "$.cache_creation.ephemeral_1h_input_tokens", "bigint")
    flat = get(u, "$.cache_creation_input_tokens", "bigint")
    w5 = F.when(F.coalesce(c5, c1).isNull(), flat).otherwise(c5)
    return bucket(get(u, "$.input_tokens", "bigint"), get(u, "$.output_tokens", "bigint"), get(u, "$.cache_read_input_tokens", "bigint"), w5, c1)


CODEX = ("input_tokens", "output_tokens", "cached_input_tokens", "cache_write_input_tokens")
CAMEL = ("inputTokens", "outputTokens", "cacheReadTokens", "cacheWriteTokens")
SNAKE = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")


def _codex(f: dict[str, Field]) -> Column:
    inp, out, cached, wrote = (f[n] for n in CODEX)
    read, written = F.coalesce(cached.count, F.lit(0)), F.coalesce(wrote.count, F.lit(0))
    ok = inp.count.isNotNull() & out.count.isNotNull() & (inp.count >= read + written) & ~cached.spoiled() & ~wrote.spoiled()
    return F.when(ok, bucket(inp.count - read - written, out.count, read, written, F.lit(0)))


def _gemini(f: dict[str, Field]) -> Column:
    inp, out = f["input"].count, f["output"].count
    read, thoughts, tool = (F.coalesce(f[n].count, F.lit(0)) for n in ("cached", "thoughts", "tool"))
    ok = inp.isNotNull() & out.isNotNull() & (read <= inp)
    for name in ("cached", "thoughts", "tool"):
        ok = ok & ~f[name].spoiled()
    return F.when(ok, bucket(inp - read + tool, out + thoughts, read, F.lit(0), F.lit(0)))


def _antigravity(f: dict[str, Field]) -> Column:
    values = [f[n].count for n in SNAKE]
    ok = values[0].isNotNull() & values[1].isNotNull() & ~f[SNAKE[2]].spoiled() & ~f[SNAKE[3]].spoiled()
    return F.when(ok, bucket(*values, F.lit(0)))


def _cursor_bubble(f: dict[str, Field]) -> Column:
    either = [F.coalesce(f[camel].number, f[snake].number) for camel, snake in zip(CAMEL, SNAKE, strict=True)]
    values = [F.when(value > 0, value) for value in either]
    return F.when(F.coalesce(*values).isNotNull(), bucket(*values, F.lit(0)))


def _cursor_hook(f: dict[str, Field]) -> Column:
    inp, out = f["input_tokens"].number, f["output_tokens"].number
    read, written = (F.coalesce(f[n].number, F.lit(0)) for n in SNAKE[2:])
    net = F.when(inp >= read + written, inp - read - written).otherwise(inp)
    return F.when(F.coalesce(inp, out).isNotNull(), bucket(net, out, read, written, F.lit(0)))


def _hook_trusted(f: dict[str, Field]) -> Column:
    read, written = (F.coalesce(f[n].number, F.lit(0)) for n in SNAKE[2:])
    return F.coalesce(f["input_tokens"].number >= read + written, read + written == 0)


def _cloud_api(f: dict[str, Field]) -> Column:
    ok = F.lit(True)
    for name in CAMEL:
        there = F.coalesce(f[name].kind != "VOID", F.lit(False))
        ok = ok & (~there | F.coalesce(f[name].number >= 0, F.lit(False)))
    return F.when(ok, bucket(*[f[n].number for n in CAMEL], F.lit(0)))


#: Input without cached and written tokens; input and output are required.
codex = Normaliser(CODEX, _codex)
#: input - cached + tool; output + thoughts; more cached than input is invalid.
gemini = Normaliser(("input", "output", "cached", "thoughts", "tool"), _gemini)
#: Counters as they are (input is net already).
antigravity = Normaliser(SNAKE, _antigravity)
#: Camel or snake case counters, only positive ones; all zero is unknown.
cursor_bubble = Normaliser((*CAMEL, *SNAKE), _cursor_bubble)
#: Cached tokens are taken off the input where they fit in; and whether they do.
cursor_hook, hook_trusted = Normaliser(SNAKE, _cursor_hook), Normaliser(SNAKE, _hook_trusted)


def copilot(d: Column) -> Column:
    """Input without reads and writes; a time to live of an hour books writes to the hour, any other to five minutes."""
    inp, out = counter(d, "$.inputTokens"), counter(d, "$.outputTokens")
    read, written = F.coalesce(counter(d, "$.cacheReadTokens"), F.lit(0)), F.coalesce(counter(d, "$.cacheWriteTokens"), F.lit(0))
    hour = F.coalesce(get(d, "$.cacheTtlSeconds", "bigint") == 3600, F.lit(False))
    ok = inp.isNotNull() & out.isNotNull() & (inp >= read + written) & ~bad(d, "$.cacheReadTokens") & ~bad(d, "$.cacheWriteTokens")
    return F.when(ok, bucket(inp - read - written, out, read, F.when(hour, F.lit(0)).otherwise(written), F.when(hour, written).otherwise(F.lit(0))))


def copilot_ttl_odd(d: Column) -> Column:
    """Whether written tokens name a time to live that is neither five minutes nor an hour."""
    ttl = get(d, "$.cacheTtlSeconds", "bigint")
    return F.coalesce((F.coalesce(counter(d, "$.cacheWriteTokens"), F.lit(0)) > 0) & ttl.isNotNull() & ~ttl.isin(300, 3600), F.lit(False))


_CLOUD = Normaliser(CAMEL, _cloud_api)


def cloud_api(t: Column) -> Column:
    """A counter that is negative or no number makes the event partial (null)."""
    return F.when(t.isNotNull(), _CLOUD(t))


def with_cloud_api(rows: DataFrame, column: str, name: str) -> DataFrame:
    """``cloud_api`` of a VARIANT column, each field read once."""
    return _CLOUD.on(rows, column, name).withColumn(name, F.when(F.col(column).isNotNull(), F.col(name)))


def text_of(content: Column) -> Column:
    """A string, or the texts of its blocks, one in a line."""
    kind = F.schema_of_variant(content)
    blocks = F.try_variant_get(content, "$", "array<struct<type string, text string>>")
    return F.when(kind == "STRING", content.cast("string")).otherwise(F.array_join(F.transform(F.filter(blocks, lambda b: b["text"].isNotNull()), lambda b: b["text"]), "\n"))
