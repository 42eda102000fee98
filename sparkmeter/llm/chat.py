r"""Chat formatting: a compiler for a small sandboxed template language.

A template is parsed into a syntax tree, constants are folded, and the tree becomes Python closures that
write text and generation marks to a sink. The language has ``{{ expression }}``, ``{% for x in y %}``,
``{% if %}/{% elif %}/{% else %}``, ``{% generation %}`` (text under the loss mask) and ``{# comments #}``;
expressions have names, fields of mappings (``a.b`` and ``a['b']``), strings, numbers, ``==``, ``!=``,
``not``, ``and``, ``or``, ``+`` and filters (``x | escape``). Nothing of Python can be reached: fields are
looked up in mappings only, and filters come from a fixed table.

Conversations are streamed: rows are dealt by conversation, sorted in the task, rendered turn by turn, and
written in chunks, so a conversation of any length needs the memory of one turn and one chunk.

``escape`` makes control strings harmless and can be undone: ``\`` becomes ``\\`` and ``<|`` becomes ``<\|``;
``header`` also writes a line feed as ``\n``.

Results for odd input: null texts and roles count as empty; turns with equal numbers are ordered by role and
text, null turns come first; repeated rows are turns of their own; rows with a null conversation id form one
conversation; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, stage

START, END = "<|im_start|>", "<|im_end|>"

CHAT_TEMPLATE = (
    "{% for message in messages %}<|im_start|>{{ message.role | header }}\n"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}<|im_end|>\n{% endfor %}"
)

#: Characters after which a chunk of formatted text is written.
CHUNK_CHARS = 1 << 20


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def header(text: str) -> str:
    return escape(text).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S) if "\\" in text else text


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "header": header, "trim": str.strip, "upper": str.upper, "lower": str.lower}


class TemplateError(ValueError):
    """A template that the language does not allow."""


# --- syntax tree -------------------------------------------------------------------------------------


@dataclass
class Const:
    value: object


@dataclass
class Name:
    name: str


@dataclass
class Field:
    of: object
    key: object


@dataclass
class Filter:
    of: object
    name: str


@dataclass
class Op:
    kind: str
    args: list


@dataclass
class Write:
    value: object


@dataclass
class If:
    test: object
    then: list
    other: list


@dataclass
class For:
    name: str
    over: object
    body: list


@dataclass
class Generation:
    body: list


_TAGS = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.S)
_TOKENS = re.compile(r"""\s*(?:(?P<str>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[-+|.\[\]()]))""", re.S)


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            match = _TOKENS.match(source, at)
            if not match:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((match.lastgroup, match[match.lastgroup]))
            at = match.end()
        self.at = 0

    def peek(self) -> tuple:
        return self.tokens[self.at] if self.at < len(self.tokens) else (None, None)

    def take(self, *values: str) -> bool:
        if self.peek()[1] in values and self.peek()[0] != "str":
            self.at += 1
            return True
        return False

    def whole(self) -> object:
        found = self.either()
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return found

    def either(self) -> object:
        left = self.both()
        while self.take("or"):
            left = Op("or", [left, self.both()])
        return left

    def both(self) -> object:
        left = self.negated()
        while self.take("and"):
            left = Op("and", [left, self.negated()])
        return left

    def negated(self) -> object:
        return Op("not", [self.negated()]) if self.take("not") else self.compared()

    def compared(self) -> object:
        left = self.added()
        for sign in ("==", "!="):
            if self.take(sign):
                return Op(sign, [left, self.added()])
        return left

    def added(self) -> object:
        left = self.filtered()
        while self.take("+"):
            left = Op("+", [left, self.filtered()])
        return left

    def filtered(self) -> object:
        left = self.fielded()
        while self.take("|"):
            kind, name = self.peek()
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            left = Filter(left, name)
        return left

    def fielded(self) -> object:
        left = self.atom()
        while True:
            if self.take("."):
                kind, name = self.peek()
                if kind != "name" or name.startswith("_"):
                    raise TemplateError(f"no field {name!r}")
                self.at += 1
                left = Field(left, Const(name))
            elif self.take("["):
                left = Field(left, self.either())
                if not self.take("]"):
                    raise TemplateError("a bracket is open")
            else:
                return left

    def atom(self) -> object:
        kind, value = self.peek()
        self.at += 1
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "num":
            return Const(int(value))
        if kind == "name":
            return {"true": Const(True), "false": Const(False), "none": Const(None)}.get(value) or Name(value)
        if value == "(":
            inner = self.either()
            if self.take(")"):
                return inner
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> list:
    """Syntax tree of a template."""
    root: list = []
    stack: list[tuple[str, object, list]] = [("", None, root)]
    at = 0
    for match in _TAGS.finditer(source):
        body = stack[-1][2]
        if match.start() > at:
            body.append(Write(Const(source[at : match.start()])))
        at = match.end()
        if match[1] is not None:
            body.append(Write(_Expression(match[1]).whole()))
        elif match[2] is not None:
            _statement(match[2].strip(), stack)
    if at < len(source):
        stack[-1][2].append(Write(Const(source[at:])))
    if len(stack) != 1:
        raise TemplateError(f"{stack[-1][0]} is not closed")
    return root


def _statement(text: str, stack: list) -> None:
    word, _, rest = text.partition(" ")
    kind, node, body = stack[-1]
    if word == "for":
        match = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
        if not match:
            raise TemplateError(f"cannot read {text!r}")
        made: object = For(match[1], _Expression(match[2]).whole(), [])
        body.append(made)
        stack.append(("for", made, made.body))
    elif word == "if":
        made = If(_Expression(rest).whole(), [], [])
        body.append(made)
        stack.append(("if", made, made.then))
    elif word == "generation":
        made = Generation([])
        body.append(made)
        stack.append(("generation", made, made.body))
    elif word == "elif" and kind in ("if", "elif"):
        made = If(_Expression(rest).whole(), [], [])
        node.other.append(made)
        stack.append(("elif", made, made.then))
    elif word == "else" and kind in ("if", "elif"):
        stack[-1] = (kind, node, node.other)
    elif word == "endif" and kind in ("if", "elif"):
        while stack[-1][0] == "elif":
            stack.pop()
        stack.pop()
    elif word in ("endfor", "endgeneration") and kind == word[3:]:
        stack.pop()
    else:
        raise TemplateError(f"unexpected {text!r}")


def fold(nodes: list) -> list:
    """The tree with constant expressions computed, constant branches chosen and neighbouring texts joined."""
    out: list = []
    for node in nodes:
        if isinstance(node, Write):
            made = [Write(fold_expression(node.value))]
        elif isinstance(node, If):
            test = fold_expression(node.test)
            if isinstance(test, Const):
                made = fold(node.then if test.value else node.other)
            else:
                made = [If(test, fold(node.then), fold(node.other))]
        elif isinstance(node, For):
            made = [For(node.name, fold_expression(node.over), fold(node.body))]
        else:
            made = [Generation(fold(node.body))]
        for new in made:
            if isinstance(new, Write) and isinstance(new.value, Const):
                text = _text(new.value.value)
                if out and isinstance(out[-1], Write) and isinstance(out[-1].value, Const):
                    out[-1] = Write(Const(_text(out[-1].value.value) + text))
                elif text:
                    out.append(Write(Const(text)))
            else:
                out.append(new)
    return out


def fold_expression(node: object) -> object:
    if isinstance(node, Filter):
        node = Filter(fold_expression(node.of), node.name)
        parts = [node.of]
    elif isinstance(node, Field):
        return Field(fold_expression(node.of), fold_expression(node.key))
    elif isinstance(node, Op):
        node = Op(node.kind, [fold_expression(a) for a in node.args])
        parts = node.args
    else:
        return node
    return Const(expression(node)({})) if all(isinstance(p, Const) for p in parts) else node


# --- closures ----------------------------------------------------------------------------------------


def _text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def expression(node: object) -> Callable[[dict], object]:
    """A closure that computes an expression in a scope."""
    if isinstance(node, Const):
        return lambda scope, value=node.value: value
    if isinstance(node, Name):
        return lambda scope, name=node.name: scope.get(name)
    if isinstance(node, Field):
        of, key = expression(node.of), expression(node.key)
        return lambda scope: found.get(key(scope)) if isinstance(found := of(scope), dict) else None
    if isinstance(node, Filter):
        of, run = expression(node.of), FILTERS[node.name]
        return lambda scope: run(_text(of(scope)))
    args = [expression(a) for a in node.args]
    first, last = args[0], args[-1]
    return {
        "not": lambda scope: not first(scope),
        "and": lambda scope: first(scope) and last(scope),
        "or": lambda scope: first(scope) or last(scope),
        "==": lambda scope: first(scope) == last(scope),
        "!=": lambda scope: first(scope) != last(scope),
        "+": lambda scope: _text(first(scope)) + _text(last(scope)),
    }[node.kind]


def loops(node: object) -> bool:
    """Whether a statement has a loop in it; such statements become generators, the others plain functions."""
    if isinstance(node, If):
        return any(map(loops, [*node.then, *node.other]))
    return isinstance(node, For) or isinstance(node, Generation) and any(map(loops, node.body))


def block(nodes: list) -> Callable[[dict, object], None]:
    """A closure that renders statements without loops to a sink."""
    steps = [statement(n) for n in nodes]

    def run(scope: dict, sink: object) -> None:
        for step in steps:
            step(scope, sink)

    return steps[0] if len(steps) == 1 else run


def statement(node: object) -> Callable[[dict, object], None]:
    if isinstance(node, Write):
        if isinstance(node.value, Const):
            return lambda scope, sink, text=_text(node.value.value): sink.write(text)
        value = expression(node.value)
        return lambda scope, sink: sink.write(_text(value(scope)))
    if isinstance(node, If):
        test, then, other = expression(node.test), block(node.then), block(node.other)
        return lambda scope, sink: then(scope, sink) if test(scope) else other(scope, sink)
    body = block(node.body)

    def masked(scope: dict, sink: object) -> None:
        sink.mark(True)
        body(scope, sink)
        sink.mark(False)

    return masked


def stepped(nodes: list) -> Callable[[dict, object], Iterator[None]]:
    """A closure that renders statements step by step: it pauses after every turn of a loop."""
    steps: list[tuple[bool, Callable]] = []
    for node in nodes:
        if not loops(node):
            steps.append((False, statement(node)))
        elif isinstance(node, If):
            steps.append((True, _stepped_if(expression(node.test), stepped(node.then), stepped(node.other))))
        elif isinstance(node, Generation):
            steps.append((True, _stepped_mark(stepped(node.body))))
        else:
            inner = any(map(loops, node.body))
            steps.append((True, _stepped_for(node.name, expression(node.over), stepped(node.body) if inner else block(node.body), inner)))

    def run(scope: dict, sink: object) -> Iterator[None]:
        for pauses, step in steps:
            if pauses:
                yield from step(scope, sink)
            else:
                step(scope, sink)

    return run


def _stepped_if(test: Callable, then: Callable, other: Callable) -> Callable:
    return lambda scope, sink: then(scope, sink) if test(scope) else other(scope, sink)


def _stepped_mark(body: Callable) -> Callable:
    def run(scope: dict, sink: object) -> Iterator[None]:
        sink.mark(True)
        yield from body(scope, sink)
        sink.mark(False)

    return run


def _stepped_for(name: str, over: Callable, body: Callable, inner: bool) -> Callable:
    def run(scope: dict, sink: object) -> Iterator[None]:
        items = iter(over(scope) or ())
        within, index, ahead = dict(scope), 0, next(items, _NOTHING)
        while ahead is not _NOTHING:
            item, ahead = ahead, next(items, _NOTHING)
            within[name] = item
            within["loop"] = {"index0": index, "index": index + 1, "first": not index, "last": ahead is _NOTHING}
            if inner:
                yield from body(within, sink)
            else:
                body(within, sink)
            index += 1
            yield

    return run


_NOTHING = object()


def compile_template(source: str) -> Callable[[dict, object], Iterator[None]]:
    """Closure ``render(scope, sink)``, run by going through what it gives; the sink has ``write(text)`` and ``mark(on)``."""
    return stepped(fold(parse(source)))


def render_text(source: str, scope: dict) -> tuple[str, list[list[int]]]:
    """A whole rendering at once: the text and its spans under the loss mask."""
    sink = Sink()
    for _ in compile_template(source)(scope, sink):
        pass
    sink.flush()
    return "".join(c[0] for c in sink.full), [s for c in sink.full for s in c[1]]


@dataclass
class Sink:
    """Collects formatted text and the spans (in code points) under generation marks."""

    parts: list[str] = field(default_factory=list)
    spans: list[list[int]] = field(default_factory=list)
    done: int = 0
    held: int = 0
    full: list[tuple[str, list[list[int]], int]] = field(default_factory=list)
    open: bool = False

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.held += len(text)
        if self.held >= CHUNK_CHARS:
            self.flush()

    def mark(self, on: bool) -> None:
        at = self.done + self.held
        if on:
            self.spans.append([at, at])
        else:
            self.spans[-1][1] = at
        self.open = on

    def flush(self) -> None:
        """Close a chunk; a span that is open goes on in the next one."""
        at = self.done + self.held
        if self.open:
            self.spans[-1][1] = at
        self.full.append(("".join(self.parts), self.spans, self.done))
        self.parts, self.done, self.held = [], at, 0
        self.spans = [[at, at]] if self.open else []


_CHUNKS = "chunk long, at long, text string, spans array<struct<start:long,end:long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def format_conversations(turns: DataFrame, template: str = CHAT_TEMPLATE, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Formatted conversations in chunks: ``conv_col``, ``chunk`` (from 0), ``at`` (first code point), ``text`` and ``spans`` under the loss mask.

    The chunks of a conversation stand together and in order in one partition.
    """
    prepare(turns.sparkSession)
    fold(parse(template))  # a bad template fails here, not in a task
    rows = turns.select(
        F.col(conv_col).cast("long").alias(conv_col), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        ready: list[tuple] = []
        size = 0

        def pack() -> pa.RecordBatch:
            ids, numbers, at, texts, spans = zip(*ready, strict=True)
            marks = [[{"start": a, "end": b} for a, b in own] for own in spans]
            arrays = [pa.array(ids, pa.int64()), pa.array(numbers, pa.int64()), pa.array(at, pa.int64()), pa.array(texts, pa.string()), pa.array(marks, _SPANS)]
            return pa.RecordBatch.from_arrays(arrays, names=[conv_col, "chunk", "at", "text", "spans"])

        for conv, group in groupby(read(batches), key=lambda r: r[0]):
            sink, number = Sink(), 0
            for _ in render({"messages": ({"role": role, "text": text} for _, role, text in group)}, sink):
                for chunk, spans, at in sink.full:
                    ready.append((conv, number, at, chunk, spans))
                    size += len(chunk)
                    number += 1
                sink.full.clear()
                if size >= CHUNK_CHARS:
                    yield pack()
                    ready, size = [], 0
            sink.flush()
            for chunk, spans, at in sink.full:
                ready.append((conv, number, at, chunk, spans))
                size += len(chunk)
                number += 1
            if size >= CHUNK_CHARS or len(ready) >= 4096:
                yield pack()
                ready, size = [], 0
        if ready:
            yield pack()

    dealt = rows.repartition(conv_col).sortWithinPartitions(conv_col, F.col("turn").asc_nulls_first(), "role", "text")
    return dealt.mapInArrow(stage(run), f"`{conv_col}` long, {_CHUNKS}")


class Reader:
    """Reads formatted text back, piece by piece: turns, and the text under the loss mask."""

    def __init__(self) -> None:
        self.buffer, self.at = "", 0
        self.spans: list[tuple[int, int]] = []
        self.turns, self.chars, self.loss_chars = 0, 0, 0
        self.turns_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()
        self.partial = ""

    def feed(self, text: str, spans: list[tuple[int, int]]) -> None:
        self.buffer += text
        self.chars += len(text)
        for start, end in spans:
            if self.spans and self.spans[-1][1] == start and start == self.chars - len(text):
                self.spans[-1] = (self.spans[-1][0], end)
            else:
                self.spans.append((start, end))
        mark = END + "\n"
        done = 0
        while (end := self.buffer.find(mark, done)) >= 0:
            self._turn(self.buffer[done:end], self.at + done)
            done = end + len(mark)
        self.buffer = self.buffer[done:]
        self.at += done

    def _turn(self, body: str, at: int) -> None:
        if not body.startswith(START):
            raise ValueError("the formatted text has no turn mark here")
        role, _, text = body[len(START) :].partition("\n")
        self.turns += 1
        self.turns_hash.update(f"{unescape(role)}\n{unescape(text)}\n".encode("utf-8", "surrogatepass"))
        while self.spans and self.spans[0][1] <= at + len(body):
            start, end = self.spans.pop(0)
            masked = unescape(body[start - at : end - at])
            self.loss_chars += len(masked)
            self.loss_hash.update(masked.encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        if self.buffer:
            raise ValueError("the formatted text ends inside a turn")
        return self.turns, self.turns_hash.hexdigest(), self.loss_chars, self.loss_hash.hexdigest(), self.chars


def read_back(chunks: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Digests of formatted conversations, read from the chunks of ``format_conversations`` (in their order, no shuffle)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, now, started, out = Reader(), None, False, []

        def pack() -> pa.RecordBatch:
            ids, rows = [r[0] for r in out], list(zip(*[r[1] for r in out], strict=True)) or [()] * 5
            kinds = pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()
            names = [conv_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(list(c), k) for c, k in zip(rows, kinds, strict=True)]], names=names)

        for batch in batches:
            for conv, number, text, spans in zip(*[batch.column(i).to_pylist() for i in (0, 1, 3, 4)], strict=True):
                if number == 0:
                    if started:
                        out.append((now, reader.row()))
                    reader, now, started = Reader(), conv, True
                reader.feed(text, [(s["start"], s["end"]) for s in spans])
            if len(out) >= 4096:
                yield pack()
                out = []
        if started:
            out.append((now, reader.row()))
        yield pack()

    schema = f"`{conv_col}` long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return chunks.mapInArrow(stage(run), schema)
