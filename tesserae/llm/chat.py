r"""Chat formatting by a template compiler.

A template is parsed into a syntax tree, constants are folded, and the tree becomes Python closures. The language is a sandbox:

    {{ expr }}   {% for m in messages %} .. {% endfor %}   {% if expr %} .. {% elif expr %} .. {% else %} .. {% endif %}
    {% set name = expr %}   {% generation %} .. {% endgeneration %}

with strings, integers, true, false, names, `m.role` or `m['role']` (keys of given data only, never Python attributes), loop.first,
loop.last, loop.index0, == != + and or not ( ), and the filters escape, escape_role, upper, lower, trim. Any other name, key or
filter is an error when the template is compiled or run. What stands within generation is under the loss mask.

A conversation streams through the closures turn by turn, so that one of any length needs the memory of one turn only.

Texts are escaped reversibly: a backslash doubles, and the first character of each control string gets a backslash before it.
Defined results: rows with a null conv_id are one conversation; a null role or text is empty; turns that are equal in number go by
role, then text, repeated rows are repeated turns; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tesserae.llm.common import ready, text_of

OPEN, CLOSE = "### ", "</turn>"
TEMPLATE = OPEN.join(("{% for m in messages %}", "{{ m.role | escape_role }}: {% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}")) + CLOSE + "\n{% endfor %}"


def escape(text: str) -> str:
    out = text.replace("\\", "\\\\")
    return out.replace(CLOSE, "\\" + CLOSE).replace(OPEN, "\\" + OPEN) if CLOSE in out or OPEN in out else out


def escape_role(text: str) -> str:
    return escape(text).replace(":", "\\:")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "escape_role": escape_role, "upper": str.upper, "lower": str.lower, "trim": str.strip}


class TemplateError(ValueError):
    """The template isn't valid, or asks for what isn't there."""


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: Any
    key: str


@dataclass(frozen=True)
class Op:
    """not, and, or, ==, != or +."""

    op: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    of: Any


@dataclass(frozen=True)
class Text:
    value: Any


@dataclass(frozen=True)
class If:
    cases: tuple  # of (condition, body)
    other: tuple


@dataclass(frozen=True)
class For:
    var: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class Set:
    var: str
    value: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[+|().\[\]=]))")


class _Expr:
    """An expression's tokens, parsed by descent."""

    def __init__(self, source: str):
        self.tokens: list[str] = []
        at, source = 0, source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append(m[0].strip())
            at = m.end()

    def peek(self) -> str:
        return self.tokens[0] if self.tokens else ""

    def take(self, want: str | None = None) -> str:
        if not self.tokens or want and self.tokens[0] != want:
            raise TemplateError(f"{want or 'more'} is missing before {self.peek() or 'the end'}")
        return self.tokens.pop(0)

    def whole(self):
        out = self.either()
        if self.tokens:
            raise TemplateError(f"{self.peek()!r} is left over")
        return out

    def _chain(self, op: str, below):
        out = below()
        while self.peek() == op:
            self.take()
            out = Op(op, (out, below()))
        return out

    def either(self):
        return self._chain("or", lambda: self._chain("and", self.negated))

    def negated(self):
        if self.peek() == "not":
            self.take()
            return Op("not", (self.negated(),))
        out = self._chain("+", self.filtered)
        if self.peek() in ("==", "!="):
            return Op(self.take(), (out, self._chain("+", self.filtered)))
        return out

    def filtered(self):
        out = self.path()
        while self.peek() == "|":
            self.take()
            name = self.take()
            if name not in FILTERS:
                raise TemplateError(f"there is no filter {name}")
            out = Filter(name, out)
        return out

    def path(self):
        t = self.take()
        if t == "(":
            out = self.either()
            self.take(")")
        elif t[0] in "'\"":
            out = Const(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), t[1:-1]))
        elif t.isdigit():
            out = Const(int(t))
        elif t in ("true", "false"):
            out = Const(t == "true")
        elif t[0].isalpha() or t[0] == "_":
            out = Name(t)
        else:
            raise TemplateError(f"{t!r} can't stand here")
        while self.peek() in (".", "["):
            if self.take() == ".":
                out = Item(out, self.take())
            else:
                key = self.take()
                self.take("]")
                out = Item(out, key[1:-1] if key[0] in "'\"" else key)
        return out


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    parts = re.split(r"(\{\{.*?\}\}|\{%.*?%\})", source, flags=re.S)

    def block(ends: tuple[str, ...]) -> tuple[tuple, str]:
        body: list = []
        while parts:
            p = parts.pop(0)
            if p.startswith("{{"):
                body.append(Text(_Expr(p[2:-2]).whole()))
            elif p.startswith("{%"):
                said = p[2:-2].strip()
                word, _, rest = said.partition(" ")
                if word in ends:
                    return tuple(body), said
                if word == "for" and (m := re.fullmatch(r"(\w+)\s+in\s+(.+)", rest, re.S)):
                    inner, _ = block(("endfor",))
                    body.append(For(m[1], _Expr(m[2]).whole(), inner))
                elif word == "if":
                    cases, other, end = [], (), said
                    while end.split()[0] != "endif":
                        if end == "else":
                            other, end = block(("endif",))
                            continue
                        condition = _Expr(end.partition(" ")[2]).whole()
                        inner, end = block(("elif", "else", "endif"))
                        cases.append((condition, inner))
                    body.append(If(tuple(cases), other))
                elif word == "set" and (m := re.fullmatch(r"(\w+)\s*=\s*(.+)", rest, re.S)):
                    body.append(Set(m[1], _Expr(m[2]).whole()))
                elif said == "generation":
                    body.append(Generation(block(("endgeneration",))[0]))
                else:
                    raise TemplateError(f"{p} can't stand here")
            elif p:
                body.append(Text(Const(p)))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(body), ""

    return block(())[0]


def _apply(op: str, args: list) -> Any:
    if op == "not":
        return not args[0]
    if op == "+":
        if not all(type(a) is type(args[0]) and type(a) in (str, int) for a in args):
            raise TemplateError("+ takes two strings or two integers")
        return args[0] + args[1]
    return (args[0] == args[1]) == (op == "==")


def fold(node):
    """The tree with constant parts worked out and neighbouring texts joined."""
    if isinstance(node, tuple):
        out: list = []
        for x in map(fold, node):
            for y in x if isinstance(x, tuple) else (x,):
                if isinstance(y, Text) and isinstance(y.value, Const) and out and isinstance(out[-1], Text) and isinstance(out[-1].value, Const):
                    out[-1] = Text(Const(str(out[-1].value.value) + str(y.value.value)))
                else:
                    out.append(y)
        return tuple(out)
    if isinstance(node, Op):
        args = tuple(map(fold, node.args))
        if node.op in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (node.op == "and") else args[0]
        if node.op not in ("and", "or") and all(isinstance(a, Const) for a in args):
            return Const(_apply(node.op, [a.value for a in args]))
        return Op(node.op, args)
    if isinstance(node, Filter):
        of = fold(node.of)
        return Const(FILTERS[node.name](str(of.value))) if isinstance(of, Const) else Filter(node.name, of)
    if isinstance(node, Item):
        return Item(fold(node.of), node.key)
    if isinstance(node, Text):
        return Text(fold(node.value))
    if isinstance(node, Set):
        return Set(node.var, fold(node.value))
    if isinstance(node, For):
        return For(node.var, fold(node.over), fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, If):
        cases, other = [], fold(node.other)
        for condition, body in node.cases:
            condition = fold(condition)
            if isinstance(condition, Const):
                if condition.value:
                    other = fold(body)
                    break
                continue
            cases.append((condition, fold(body)))
        return If(tuple(cases), other) if cases else other
    return node


#: Stands between the turns in what a template yields.
TURN = object()


def _value(node) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        return lambda env, v=node.value: v
    if isinstance(node, Name):

        def name(env: dict) -> Any:
            if node.name not in env:
                raise TemplateError(f"there is no {node.name}")
            return env[node.name]

        return name
    if isinstance(node, Item):
        of = _value(node.of)

        def item(env: dict) -> Any:
            data = of(env)
            if type(data) is not dict or node.key not in data:
                raise TemplateError(f"there is no {node.key}")
            return data[node.key]

        return item
    if isinstance(node, Filter):
        of, f = _value(node.of), FILTERS[node.name]
        return lambda env: f(str(of(env)))
    args = [_value(a) for a in node.args]
    if node.op == "and":
        return lambda env: args[0](env) and args[1](env)
    if node.op == "or":
        return lambda env: args[0](env) or args[1](env)
    return lambda env: _apply(node.op, [a(env) for a in args])


def _body(nodes: tuple) -> Callable[[dict], Iterator]:
    """A closure from the environment to (text, whether under the mask), and TURN after each round of a loop."""
    steps = [_step(n) for n in nodes]

    def run(env: dict) -> Iterator:
        for step in steps:
            yield from step(env)

    return run


def _step(node) -> Callable[[dict], Iterator]:
    if isinstance(node, Text):
        of = _value(node.value)

        def text(env: dict) -> Iterator:
            yield str(of(env)), env["generation"]

        return text
    if isinstance(node, Set):
        of = _value(node.value)

        def put(env: dict) -> Iterator:
            env[node.var] = of(env)
            return iter(())

        return put
    if isinstance(node, Generation):
        inner = _body(node.body)
        return lambda env: inner(env | {"generation": True})
    if isinstance(node, If):
        cases, other = [(_value(c), _body(b)) for c, b in node.cases], _body(node.other)

        def choose(env: dict) -> Iterator:
            for condition, body in cases:
                if condition(env):
                    return body(env)
            return other(env)

        return choose
    over, inner = _value(node.over), _body(node.body)

    def loop(env: dict) -> Iterator:
        rows = iter(over(env))
        now, i = next(rows, TURN), 0
        while now is not TURN:
            after = next(rows, TURN)
            yield from inner(env | {node.var: now, "loop": {"first": i == 0, "last": after is TURN, "index0": i}})
            yield TURN, False
            now, i = after, i + 1

    return loop


@dataclass
class Segment:
    """A turn's part of the formatted conversation; spans under the mask count from the part's start."""

    text: str
    loss: list[tuple[int, int]]


class Template:
    """A compiled template. render() streams a conversation's segments."""

    def __init__(self, source: str = TEMPLATE):
        self.tree = fold(parse(source))
        self._run = _body(self.tree)

    def render(self, messages: Iterator[dict]) -> Iterator[Segment]:
        parts, spans, at = [], [], 0
        for text, masked in self._run({"messages": messages, "generation": False}):
            if text is TURN:
                yield Segment("".join(parts), spans)
                parts, spans, at = [], [], 0
            elif text:
                if masked and spans and spans[-1][1] == at:
                    spans[-1] = (spans[-1][0], at + len(text))
                elif masked:
                    spans.append((at, at + len(text)))
                parts.append(text)
                at += len(text)
        if parts:
            yield Segment("".join(parts), spans)


_PART = re.compile(r"\\.|" + re.escape(CLOSE) + r"\n|:\x20", re.S)


def read(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn in what TEMPLATE renders."""
    at, role = 0, None
    for m in _PART.finditer(text):
        if m[0][0] == "\\":
            continue
        if m[0] == ": ":
            if role is None:
                if not text.startswith(OPEN, at):
                    raise ValueError("a turn doesn't open")
                role, at = unescape(text[at + len(OPEN) : m.start()]), m.end()
            continue
        if role is None:
            raise ValueError("a turn has no role")
        yield role, unescape(text[at : m.start()])
        at, role = m.end(), None
    if at != len(text):
        raise ValueError("a turn doesn't close")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    rows = ((i, {"role": r, "text": t}) for b in batches for i, r, t in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
    for conv_id, group in groupby(rows, key=lambda x: x[0]):
        yield conv_id, (m for _, m in group)


def _dealt(conversations: DataFrame) -> DataFrame:
    """Conversations' rows side by side, in order: sorted on disk where they don't fit in memory."""
    ready(conversations.sparkSession)
    slim = conversations.select(F.col("conv_id").cast("long"), text_of("role").alias("role"), text_of().alias("text"), F.col("turn").cast("long"))
    return slim.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def _in_rows(rows: Iterator[tuple], schema: pa.Schema, most: int = 2000, most_chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    kept, chars = [], 0
    for r in rows:
        kept.append(r)
        chars += sum(len(x) for x in r if isinstance(x, str))
        if len(kept) >= most or chars >= most_chars:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept, strict=True), schema, strict=True)], schema=schema)
            kept, chars = [], 0
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept, strict=True), schema, strict=True)], schema=schema)


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, part (from 0), text, loss (spans under the mask, from the part's start): a conversation is its parts in order."""
    compiled = Template(template)  # an error in the template shows here, not in a task
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))])
    del compiled

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Template(template)
        rows = ((i, k, s.text, [{"s": a, "e": b} for a, b in s.loss]) for i, messages in _conversations(batches) for k, s in enumerate(made.render(messages)))
        return _in_rows(rows, schema)

    return _dealt(conversations).mapInArrow(run, "conv_id long, part long, text string, loss array<struct<s:long,e:long>>")


def digest(segments: Iterator[Segment]) -> tuple[int, str, int, str, int]:
    """Read a formatted conversation back: turns, their hash, characters and hash under the mask, formatted characters."""
    turns, loss, n, chars, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
    for s in segments:
        size += len(s.text)
        for role, text in read(s.text):
            n += 1
            turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        for a, b in s.loss:
            plain = unescape(s.text[a:b])
            chars += len(plain)
            loss.update(plain.encode("utf-8", "surrogatepass"))
    return n, turns.hexdigest(), chars, loss.hexdigest(), size


def report(conversations: DataFrame) -> DataFrame:
    """digest() of each conversation as TEMPLATE renders it."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Template()
        return _in_rows(((i, *digest(made.render(messages))) for i, messages in _conversations(batches)), schema)

    return _dealt(conversations).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
