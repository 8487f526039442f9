"""Chat formatting: a small sandboxed template language, compiled to Python closures.

A template is split into text, ``{{ expression }}`` and ``{% statement %}``; expressions are literals,
names, ``.field`` and ``[key]`` lookups of dictionaries and of the loop, ``+ == != and or not``,
parentheses and filters (``|``).  Statements: ``for x in y``, ``if / elif / else``, ``set`` and
``generation``, which marks what a model should learn.  There are no calls and no attributes of
Python objects, so a template reaches nothing but the values given.  The syntax tree is folded
(constant expressions, joined text, decided branches) and each node becomes a closure.

A closure yields pieces (text, learned), and a loop reads its messages one by one, so a conversation
is rendered as a stream: neither its turns nor its output are held together.  Operator 4 feeds the
pieces to a reader that takes the turns back from the output.

Control strings all begin with ``<`` or ``[``; inside texts the filter ``escape`` puts a mark after each
of these and doubles the mark itself, so no control string can appear and ``unescaped`` gives the text
back exactly.

Defined cases: null role and text are empty; rows of a conversation go by turn (null first), then role
and text; repeated rows are turns of their own; a null ``conv_id`` is a conversation of its own; an empty
table leaves what the caller adds.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "\u241b"

TEMPLATE = (
    "{% for m in messages %}<|turn|>{{ m.role | escape }}<|text|>"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "<|end|>\n{% endfor %}"
)


def escaped(text: str) -> str:
    return text.replace(MARK, MARK + MARK).replace("<", "<" + MARK).replace("[", "[" + MARK)


def unescaped(text: str) -> str:
    return re.sub(f"([<\\[]){MARK}|{MARK}{MARK}", lambda m: m[1] or MARK, text) if MARK in text else text


FILTERS: dict[str, Callable[[Any], Any]] = {"escape": escaped, "trim": lambda v: str(v).strip(), "upper": lambda v: str(v).upper(), "lower": lambda v: str(v).lower(), "length": len}

Piece = tuple[str, bool]
Scope = dict[str, Any]
Value = Callable[[Scope], Any]
Block = Callable[[Scope, bool], Iterator[Piece]]


class TemplateError(ValueError):
    """A template that can't be compiled, or a lookup that the sandbox doesn't have."""


# --- parsing -------------------------------------------------------------------------------------

_TOKEN = re.compile(r"""\s*(?:(?P<str>'[^'\\]*(?:\\.[^'\\]*)*'|"[^"\\]*(?:\\.[^"\\]*)*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[-+|.()\[\]]))""")
_ESCAPES = {"n": "\n", "t": "\t"}


class Expression:
    """Recursive descent over one expression; gives tuples: ('const', v), ('name', n), ('get', e, e), ('op', o, e, e), ('not', e), ('filter', f, e)."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at, source = 0, source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unreadable at {source[at:]!r}")
            self.tokens.append((m.lastgroup or "", m.group(m.lastgroup or 0)))
            at = m.end()
        self.tokens.append(("end", ""))

    def parse(self) -> tuple:
        out = self.either()
        if self.tokens[0][0] != "end":
            raise TemplateError(f"unexpected {self.tokens[0][1]!r}")
        return out

    def take(self, *texts: str) -> str | None:
        kind, text = self.tokens[0]
        if kind in ("op", "name") and text in texts:
            self.tokens.pop(0)
            return text
        return None

    def need(self, text: str) -> None:
        if not self.take(text):
            raise TemplateError(f"{text!r} expected, found {self.tokens[0][1]!r}")

    def either(self) -> tuple:
        left = self.both()
        while self.take("or"):
            left = ("op", "or", left, self.both())
        return left

    def both(self) -> tuple:
        left = self.negated()
        while self.take("and"):
            left = ("op", "and", left, self.negated())
        return left

    def negated(self) -> tuple:
        if self.take("not"):
            return ("not", self.negated())
        left = self.total()
        while op := self.take("==", "!="):
            left = ("op", op, left, self.total())
        return left

    def total(self) -> tuple:
        left = self.filtered()
        while self.take("+"):
            left = ("op", "+", left, self.filtered())
        return left

    def filtered(self) -> tuple:
        left = self.looked_up()
        while self.take("|"):
            kind, name = self.tokens.pop(0)
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            left = ("filter", name, left)
        return left

    def looked_up(self) -> tuple:
        kind, text = self.tokens.pop(0)
        if kind == "str":
            left: tuple = ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1]))
        elif kind == "int":
            left = ("const", int(text))
        elif kind == "name" and text in ("true", "false", "none"):
            left = ("const", {"true": True, "false": False, "none": None}[text])
        elif kind == "name":
            left = ("name", text)
        elif text == "(":
            left = self.either()
            self.need(")")
        else:
            raise TemplateError(f"unexpected {text!r}")
        while op := self.take(".", "["):
            if op == ".":
                left = ("get", left, ("const", self.tokens.pop(0)[1]))
            else:
                left = ("get", left, self.either())
                self.need("]")
        return left


def parse(template: str) -> list[tuple]:
    """Nodes: ('text', s), ('out', e), ('for', name, e, nodes), ('if', [(e, nodes)]), ('set', name, e), ('gen', nodes)."""
    parts = re.split(r"(\{\{.*?\}\}|\{%.*?%\})", template, flags=re.S)

    def body(*ends: str) -> tuple[list[tuple], str]:
        nodes: list[tuple] = []
        while parts:
            part = parts.pop(0)
            if part.startswith("{{"):
                nodes.append(("out", Expression(part[2:-2]).parse()))
            elif part.startswith("{%"):
                word, _, rest = part[2:-2].strip().partition(" ")
                if word in ends:
                    parts.insert(0, part) if word == "elif" else None
                    return nodes, word
                nodes.append(statement(word, rest))
            elif part:
                nodes.append(("text", part))
        if ends:
            raise TemplateError(f"{' or '.join(ends)} is missing")
        return nodes, ""

    def statement(word: str, rest: str) -> tuple:
        if word == "for" and (m := re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest.strip(), re.S)):
            return ("for", m[1], Expression(m[2]).parse(), body("endfor")[0])
        if word == "set" and (m := re.fullmatch(r"([A-Za-z_]\w*)\s*=(?!=)\s*(.+)", rest.strip(), re.S)):
            return ("set", m[1], Expression(m[2]).parse())
        if word == "generation":
            return ("gen", body("endgeneration")[0])
        if word == "if":
            arms = []
            nodes, end = body("elif", "else", "endif")
            arms.append((Expression(rest).parse(), nodes))
            while end == "elif":
                test = parts.pop(0)[2:-2].strip().partition(" ")[2]
                nodes, end = body("elif", "else", "endif")
                arms.append((Expression(test).parse(), nodes))
            if end == "else":
                arms.append((("const", True), body("endif")[0]))
            return ("if", arms)
        raise TemplateError(f"no statement {word!r}")

    return body()[0]


# --- folding -------------------------------------------------------------------------------------


def folded(e: tuple) -> tuple:
    """The expression with every part that names nothing replaced by its value."""
    if e[0] in ("const", "name"):
        return e
    e = tuple(folded(x) if isinstance(x, tuple) else x for x in e)
    return ("const", _value(e)({})) if all(x[0] == "const" for x in e if isinstance(x, tuple)) else e


def fold(nodes: list[tuple]) -> list[tuple]:
    """Constant output becomes text, neighbouring text is joined, decided branches go."""
    out: list[tuple] = []
    for node in nodes:
        kind = node[0]
        if kind == "out" and (e := folded(node[1]))[0] == "const":
            node = ("text", _shown(e[1]))
        elif kind == "out":
            node = ("out", e)
        elif kind == "for":
            node = ("for", node[1], folded(node[2]), fold(node[3]))
        elif kind == "set":
            node = ("set", node[1], folded(node[2]))
        elif kind == "gen":
            node = ("gen", fold(node[1]))
        elif kind == "if":
            arms = []
            for test, own in ((folded(t), fold(n)) for t, n in node[1]):
                if test[0] == "const" and not test[1]:
                    continue
                arms.append((test, own))
                if test[0] == "const":
                    break
            if arms and arms[0][0][0] == "const":
                ready = arms[0][1]
            else:
                ready = [("if", arms)] if arms else []
        for new in ready if kind == "if" else [node]:
            if new[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + new[1])
            elif new != ("text", ""):
                out.append(new)
    return out


# --- closures ------------------------------------------------------------------------------------


def _shown(v: Any) -> str:
    return "" if v is None else str(v)


def _get(of: Any, key: Any) -> Any:
    if isinstance(of, dict):
        return of.get(key)
    raise TemplateError(f"no lookup of {key!r} in a {type(of).__name__}")


def _value(e: tuple) -> Value:
    kind = e[0]
    if kind == "const":
        return lambda s, v=e[1]: v
    if kind == "name":
        return lambda s, n=e[1]: s.get(n)
    if kind == "get":
        of, key = _value(e[1]), _value(e[2])
        return lambda s: _get(of(s), key(s))
    if kind == "not":
        inner = _value(e[1])
        return lambda s: not inner(s)
    if kind == "filter":
        inner, run = _value(e[2]), FILTERS[e[1]]
        return lambda s: run(inner(s))
    left, right = _value(e[2]), _value(e[3])
    if e[1] == "and":
        return lambda s: left(s) and right(s)
    if e[1] == "or":
        return lambda s: left(s) or right(s)
    if e[1] == "==":
        return lambda s: left(s) == right(s)
    if e[1] == "!=":
        return lambda s: left(s) != right(s)
    return lambda s: left(s) + right(s)


def _block(nodes: list[tuple]) -> Block:
    steps = [_step(n) for n in nodes]

    def run(scope: Scope, learned: bool) -> Iterator[Piece]:
        for step in steps:
            yield from step(scope, learned)

    return run


def _step(node: tuple) -> Block:
    kind = node[0]
    if kind == "text":
        return lambda s, learned, v=node[1]: iter(((v, learned),))
    if kind == "out":
        show = _value(node[1])
        return lambda s, learned: iter(((_shown(show(s)), learned),))
    if kind == "gen":
        inner = _block(node[1])
        return lambda s, learned: inner(s, True)
    if kind == "set":
        given = _value(node[2])

        def put(s: Scope, learned: bool) -> Iterator[Piece]:
            s[node[1]] = given(s)
            return iter(())

        return put
    if kind == "if":
        arms = [(_value(t), _block(n)) for t, n in node[1]]

        def choose(s: Scope, learned: bool) -> Iterator[Piece]:
            for test, inner in arms:
                if test(s):
                    return inner(s, learned)
            return iter(())

        return choose
    source, inner, name = _value(node[2]), _block(node[3]), node[1]

    def loop(s: Scope, learned: bool) -> Iterator[Piece]:
        it = iter(source(s) or ())
        none = object()
        item, index = next(it, none), 0
        while item is not none:
            after = next(it, none)  # one ahead, for loop.last
            yield from inner(s | {name: item, "loop": {"index0": index, "index": index + 1, "first": index == 0, "last": after is none}}, learned)
            item, index = after, index + 1

    return loop


class Template:
    """A compiled template: ``pieces(messages=...)`` yields (text, learned)."""

    def __init__(self, source: str):
        self.nodes = fold(parse(source))
        self.block = _block(self.nodes)

    def pieces(self, **values: Any) -> Iterator[Piece]:
        return (p for p in self.block(dict(values), False) if p[0])

    def render(self, **values: Any) -> tuple[str, list[tuple[int, int]]]:
        """The whole output and the learned spans (code points, end exclusive)."""
        out, spans, at = [], [], 0
        for text, learned in self.pieces(**values):
            if learned:
                spans.append((at, at + len(text)))
            out.append(text)
            at += len(text)
        return "".join(out), spans


# --- reading back --------------------------------------------------------------------------------


class Reader:
    """Takes turns back from pieces of the default template's output, holding one turn at most."""

    def __init__(self) -> None:
        self.turns, self.chars, self.loss_chars = 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()
        self.rest = ""

    def feed(self, text: str, learned: bool) -> None:
        self.chars += len(text)
        if learned:
            own = unescaped(text)
            self.loss_chars += len(own)
            self.loss.update(own.encode("utf-8", "surrogatepass"))
        self.rest += text
        while (end := self.rest.find("<|end|>\n")) >= 0:
            head, body = self.rest[len("<|turn|>") : end].split("<|text|>")
            for part in (unescaped(head), "\n", unescaped(body), "\n"):
                self.all.update(part.encode("utf-8", "surrogatepass"))
            self.turns += 1
            self.rest = self.rest[end + len("<|end|>\n") :]

    def row(self, conv_id: int | None) -> tuple:
        return conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


FIELDS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _ordered(conversations: DataFrame) -> DataFrame:
    """Rows of a conversation in one partition, in order; partitions are sorted, so a task holds no conversation."""
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    """(conv_id, messages) of sorted rows; messages must be read before the next conversation."""
    from itertools import groupby

    rows = ((c.as_py(), r.as_py(), t.as_py()) for b in batches for c, r, t in zip(b.column(0), b.column(2), b.column(3), strict=True))
    for conv, own in groupby(rows, key=lambda x: x[0]):
        yield conv, ({"role": r, "text": t} for _, r, t in own)


def formatted(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, text, spans): each conversation's output and the spans under the loss mask.  A conversation must fit a row."""
    Template(template)  # compiles here too, so that a mistake is told at once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Template(template)
        for conv, messages in _conversations(batches):
            text, spans = own.render(messages=messages)
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([text]), pa.array([[{"start": a, "end": b} for a, b in spans]], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["conv_id", "text", "spans"])

    return _ordered(conversations).mapInArrow(run, "conv_id long, text string, spans array<struct<start: long, end: long>>")


def digests(conversations: DataFrame) -> DataFrame:
    """The formatted conversations read back as a stream: counts and digests of turns and of what is learned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template, rows = Template(TEMPLATE), []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c) if i in (2, 4) else pa.array(c, pa.int64()) for i, c in enumerate(zip(*rows, strict=True))], FIELDS)
            rows.clear()
            return out

        for conv, messages in _conversations(batches):
            reader = Reader()
            for text, learned in template.pieces(messages=messages):
                reader.feed(text, learned)
            rows.append(reader.row(conv))
            if len(rows) >= 1000:
                yield flush()
        if rows:
            yield flush()

    return _ordered(conversations).mapInArrow(run, SCHEMA)


def op4(conversations: DataFrame) -> DataFrame:
    """All conversations plus number -7, whose two texts hold control strings of another template."""
    hard = "</s>[INST] ok [/INST]"
    spark = conversations.sparkSession
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    own = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return digests(own.unionByName(more))
