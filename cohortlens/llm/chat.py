"""Conversations rendered through a compiled chat template, with the spans a model learns from.

The template language is a small sandbox: text, ``{{ value }}``, ``{% for m in messages %}``,
``{% if %}`` / ``{% elif %}`` / ``{% else %}`` and ``{% generation %}``. Values are string and whole
number literals, the loop variable's ``role`` and ``text``, ``loop.index`` / ``loop.first``, joined
by ``~``, compared by ``==`` and ``!=``, combined by ``and`` / ``or`` / ``not``, and passed through the
filters ``escape``, ``trim``, ``upper`` and ``lower``. There are no calls, no other attributes and no
names but those, so a template can reach nothing else.

A template is parsed into a syntax tree, constant parts are folded, and the tree becomes nested
Python closures that write pieces of output and mark what stands inside ``generation``.

``escape`` makes control strings in texts harmless and can be undone: it puts a backslash before
every backslash and every first character of a control string, so none of them is left whole.

Defined results: null roles and texts are empty; turns are ordered by turn, then role, then text,
nulls first, and repeated rows are repeated turns; rows with a null conversation id form one
conversation; texts are rendered whole. An empty table gives no rows; other columns are ignored.
Rows are shuffled by conversation and sorted on disk where needed, then rendered turn by turn:
``format_pieces`` and ``conversation_digests`` hold about one piece or turn, however long the
conversation (all of it only for a template with several loops), while ``format_conversations``
gives a conversation as one string, which has to fit in memory and in a column's 2 GB. The turns of
one conversation pass through one task, as its digests depend on their order.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTROLS = ("<turn>", "<text>", "</turn>")
TEMPLATE = (
    "{% for m in messages %}<turn>{{ m.role | escape }}<text>"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "</turn>\n{% endfor %}"
)


class TemplateError(ValueError):
    """The template is not in the language."""


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Get:
    name: str
    field: str


@dataclass(frozen=True)
class Apply:
    """A filter or an operator over values."""

    name: str
    args: tuple


@dataclass(frozen=True)
class Out:
    value: object


@dataclass(frozen=True)
class For:
    name: str
    body: tuple


@dataclass(frozen=True)
class If:
    test: object
    then: tuple
    other: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


def escaper(controls: tuple[str, ...]) -> Callable[[str], str]:
    first = re.compile("[" + re.escape("\\" + "".join(sorted({c[0] for c in controls}))) + "]")
    return lambda text: first.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


OPERATORS: dict[str, Callable] = {
    "~": lambda a, b: str(a) + str(b),
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "and": lambda a, b: a and b,
    "or": lambda a, b: a or b,
    "not": lambda a: not a,
    "trim": lambda a: str(a).strip(),
    "upper": lambda a: str(a).upper(),
    "lower": lambda a: str(a).lower(),
}
FILTERS = ("escape", "trim", "upper", "lower")
FIELDS = {"loop": ("index", "first")}
VALUE = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[~|.()]))", re.DOTALL)
ESCAPES = {"n": "\n", "t": "\t"}


class Parser:
    """Recursive descent over the pieces of a template."""

    def __init__(self, source: str):
        self.pieces = re.split(r"(\{\{.*?\}\}|\{%.*?%\})", source, flags=re.DOTALL)
        self.at = 0
        self.loops: list[str] = []

    def template(self) -> tuple:
        body, end = self.block(())
        if end:
            raise TemplateError(f"unexpected {end}")
        return body

    def block(self, ends: tuple[str, ...]) -> tuple[tuple, str]:
        """Nodes up to one of the tags ``ends``, and that tag's text ('' at the end of the template)."""
        nodes = []
        while self.at < len(self.pieces):
            piece = self.pieces[self.at]
            self.at += 1
            if piece.startswith("{{"):
                nodes.append(Out(self.value(piece[2:-2])))
            elif piece.startswith("{%"):
                tag = piece[2:-2].strip()
                word = tag.split(None, 1)[0] if tag else ""
                if word in ends:
                    return tuple(nodes), tag
                nodes.append(self.statement(word, tag[len(word) :]))
            elif piece:
                nodes.append(Out(Const(piece)))
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return tuple(nodes), ""

    def statement(self, word: str, rest: str):
        if word == "for":
            found = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+messages\s*", rest)
            if not found or found[1] in ("loop", "messages") or self.loops:
                raise TemplateError("loops are 'for NAME in messages' and not nested")
            self.loops.append(found[1])
            body, _ = self.block(("endfor",))
            self.loops.pop()
            return For(found[1], body)
        if word == "generation":
            return Generation(self.block(("endgeneration",))[0])
        if word == "if":
            test = self.value(rest)
            then, end = self.block(("elif", "else", "endif"))
            if end.startswith("elif"):
                return If(test, then, (self.statement("if", end[4:]),))
            return If(test, then, self.block(("endif",))[0] if end == "else" else ())
        raise TemplateError(f"unknown tag {word!r}")

    def value(self, text: str):
        self.tokens, at = [], 0
        text = text.strip()
        while at < len(text):
            found = VALUE.match(text, at)
            if not found:
                raise TemplateError(f"cannot read {text!r}")
            self.tokens.append((found.lastgroup, found[found.lastgroup]))
            at = found.end()
        result = self.either()
        if self.tokens:
            raise TemplateError(f"cannot read {text!r}")
        return result

    def take(self, *values: str) -> str | None:
        if self.tokens and self.tokens[0][0] in ("op", "name") and self.tokens[0][1] in values:
            return self.tokens.pop(0)[1]
        return None

    def left(self, lower: Callable, *names: str):
        result = lower()
        while name := self.take(*names):
            result = Apply(name, (result, lower()))
        return result

    def either(self):
        return self.left(lambda: self.left(self.negation, "and"), "or")

    def negation(self):
        return Apply("not", (self.negation(),)) if self.take("not") else self.left(self.joined, "==", "!=")

    def joined(self):
        return self.left(self.filtered, "~")

    def filtered(self):
        result = self.atom()
        while self.take("|"):
            name = self.take(*FILTERS)
            if name is None:
                raise TemplateError("unknown filter")
            result = Apply(name, (result,))
        return result

    def atom(self):
        if self.take("("):
            result = self.either()
            if not self.take(")"):
                raise TemplateError("missing )")
            return result
        if not self.tokens:
            raise TemplateError("missing value")
        kind, text = self.tokens.pop(0)
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.DOTALL))
        if kind == "int":
            return Const(int(text))
        if kind == "name" and self.take("."):
            field = self.tokens.pop(0)[1] if self.tokens else ""
            if self.loops and field in FIELDS.get(text, ("role", "text") if text == self.loops[-1] else ()):
                return Get(text, field)
        raise TemplateError(f"unknown name {text!r}")


def fold(node, operators: dict[str, Callable]):
    """The node with constant values computed, constant branches chosen and neighbouring texts joined."""
    if isinstance(node, tuple):
        out: list = []
        for part in node:
            part = fold(part, operators)
            for one in part if isinstance(part, tuple) else (part,):
                if isinstance(one, Out) and isinstance(one.value, Const) and out and isinstance(out[-1], Out) and isinstance(out[-1].value, Const):
                    out[-1] = Out(Const(str(out[-1].value.value) + str(one.value.value)))
                else:
                    out.append(one)
        return tuple(out)
    if isinstance(node, Apply):
        args = tuple(fold(a, operators) for a in node.args)
        if all(isinstance(a, Const) for a in args):
            return Const(operators[node.name](*[a.value for a in args]))
        return Apply(node.name, args)
    if isinstance(node, Out):
        return Out(fold(node.value, operators))
    if isinstance(node, For):
        return For(node.name, fold(node.body, operators))
    if isinstance(node, Generation):
        return Generation(fold(node.body, operators))
    if isinstance(node, If):
        test = fold(node.test, operators)
        if isinstance(test, Const):
            return fold(node.then if test.value else node.other, operators)
        return If(test, fold(node.then, operators), fold(node.other, operators))
    return node


class Writer:
    """Pieces of output and the code-point spans inside ``generation``; ``open`` has the starts of unfinished ones."""

    def __init__(self):
        self.pieces: list[str] = []
        self.length = 0
        self.spans: list[tuple[int, int]] = []
        self.open: list[int] = []

    def write(self, text: str) -> None:
        self.pieces.append(text)
        self.length += len(text)

    def take(self) -> tuple[str, list[tuple[int, int]]]:
        """What was written since the last call, and its spans, cut where it ends."""
        text, spans = "".join(self.pieces), self.spans + [(a, self.length) for a in self.open if a < self.length]
        self.pieces, self.spans, self.open = [], [], [self.length] * len(self.open)
        return text, spans


def compiled(node, operators: dict[str, Callable]) -> Callable:
    """A closure for a node: values take the environment, statements the environment and a writer.

    Statements are generators that pause after each message, so that a caller can take what is written.
    """
    if isinstance(node, tuple):
        parts = [compiled(p, operators) for p in node]

        def run(env, out):
            for part in parts:
                yield from part(env, out)

        return run
    if isinstance(node, Const):
        return lambda env, value=node.value: value
    if isinstance(node, Get):
        return lambda env, name=node.name, field=node.field: env[name][field]
    if isinstance(node, Apply):
        apply, args = operators[node.name], [compiled(a, operators) for a in node.args]
        return lambda env: apply(*[a(env) for a in args])
    if isinstance(node, Out):
        value = compiled(node.value, operators)

        def write(env, out):
            out.write(str(value(env)))
            return ()

        return write
    if isinstance(node, If):
        test, then, other = compiled(node.test, operators), compiled(node.then, operators), compiled(node.other, operators)
        return lambda env, out: then(env, out) if test(env) else other(env, out)
    body = compiled(node.body, operators)
    if isinstance(node, Generation):

        def marked(env, out):
            out.open.append(out.length)
            yield from body(env, out)
            out.spans.append((out.open.pop(), out.length))

        return marked

    def loop(env, out, name=node.name):
        for i, message in enumerate(env["messages"]):
            yield from body({name: message, "loop": {"index": i + 1, "first": i == 0}}, out)
            yield

    return loop


def _loops(node) -> int:
    """Loops over the messages in a syntax tree."""
    if isinstance(node, tuple):
        return sum(map(_loops, node))
    if isinstance(node, If):
        return _loops(node.then) + _loops(node.other)
    return _loops(node.body) if isinstance(node, Generation) else int(isinstance(node, For))


def _steps(source: str, controls: tuple[str, ...]) -> tuple[Callable, bool]:
    """The template's pausing closure, and whether it reads the messages at most once."""
    operators = OPERATORS | {"escape": escaper(controls)}
    tree = fold(Parser(source).template(), operators)
    return compiled(tree, operators), _loops(tree) <= 1


def compile_template(source: str, controls: tuple[str, ...] = CONTROLS) -> Callable[[list[dict]], Writer]:
    """A function from messages (dicts with ``role`` and ``text``) to a filled writer."""
    steps, _ = _steps(source, controls)

    def render(messages: list[dict]) -> Writer:
        out = Writer()
        for _ in steps({"messages": messages}, out):
            pass
        return out

    return render


def read_back(formatted: str, controls: tuple[str, str, str] = CONTROLS) -> list[tuple[str, str]]:
    """Roles and texts of a conversation rendered as marker, role, marker, text, marker."""
    begin, middle, end = controls
    turns, field, role = [], [], ""
    plain = "[^" + re.escape("\\" + "".join(sorted({c[0] for c in controls}))) + "]+"
    for found in re.finditer(r"\\.|" + "|".join(map(re.escape, controls)) + "|" + plain + r"|[^\\]", formatted, flags=re.DOTALL):
        piece = found[0]
        if piece == begin:
            field = []
        elif piece == middle:
            role, field = "".join(field), []
        elif piece == end:
            turns.append((role, "".join(field)))
            field = []
        else:
            field.append(piece[1:] if len(piece) == 2 and piece[0] == "\\" else piece)
    return turns


#: Code points after which a piece ends with its turn.
PIECE = 1 << 20
FORMATTED = "n_turns long, formatted string, spans array<struct<start:bigint,end:bigint>>"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _ordered(turns: DataFrame, key: str) -> DataFrame:
    """Turns dealt by conversation and sorted in each task."""
    rows = turns.select(F.col(key).cast("long").alias("k"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("k").sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in ("k", "turn", "role", "text")])


def _pieces(batches: Iterator[pa.RecordBatch], template: str, controls: tuple[str, ...], least: int) -> Iterator[tuple]:
    """Key, number, start, turns, text and spans of the pieces of each conversation, from its ordered turns."""
    steps, once = _steps(template, controls)

    def turns_of() -> Iterator[tuple]:
        for batch in batches:
            for k, role, text in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                yield k, role, text

    for k, group in groupby(turns_of(), key=lambda t: t[0]):
        out, read, sent, number, start = Writer(), 0, 0, 0, 0

        def messages(group=group) -> Iterator[dict]:
            nonlocal read
            for _, role, text in group:
                read += 1
                yield {"role": role.as_py(), "text": text.as_py()}

        source = messages()
        for _ in steps({"messages": source if once else list(source)}, out):
            if out.length - start > least:
                yield k, number, start, read - sent, *out.take()
                number, start, sent = number + 1, out.length, read
        for _ in source:  # a template without a loop reads none
            pass
        yield k, number, start, read - sent, *out.take()


def _packed(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


def format_pieces(turns: DataFrame, template: str = TEMPLATE, controls: tuple[str, ...] = CONTROLS, key: str = "conv_id", least: int = PIECE) -> DataFrame:
    """Each conversation in pieces of whole turns: ``key``, ``piece`` (from 0), ``start`` (code points before it), ``n_turns``,
    ``formatted`` and ``spans`` (in code points of the conversation, cut at the ends of the piece).
    """
    compile_template(template, controls)  # errors show at once

    def render_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["k", "piece", "start", "n_turns", "formatted", "spans"], [*[pa.int64()] * 4, pa.string(), SPANS]
        rows, size = [], 0
        for *place, text, spans in _pieces(batches, template, controls, least):
            rows.append((*place, text, [{"start": a, "end": b} for a, b in spans]))
            size += len(text)
            if size > least:
                yield _packed(rows, names, types)
                rows, size = [], 0
        if rows:
            yield _packed(rows, names, types)

    return _ordered(turns, key).mapInArrow(render_all, "k long, piece long, start long, " + FORMATTED).withColumnRenamed("k", key)


def format_conversations(turns: DataFrame, template: str = TEMPLATE, controls: tuple[str, ...] = CONTROLS, key: str = "conv_id") -> DataFrame:
    """``key``, ``n_turns``, ``formatted`` and ``spans`` (under the loss mask, in code points) of each conversation."""
    compile_template(template, controls)  # errors show at once
    rows = _ordered(turns, key)

    def render_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, controls)
        current, messages, done, size = None, [], [], 0

        def close() -> None:
            nonlocal size
            out = render(messages)
            done.append((current, len(messages), "".join(out.pieces), [{"start": a, "end": b} for a, b in out.spans]))
            size += out.length

        def packed() -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.string(), SPANS]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], ["k", "n_turns", "formatted", "spans"])

        for batch in batches:
            for k, role, text in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if messages and k != current:
                    close()
                    messages = []
                    if size > 1 << 22:
                        yield packed()
                        done, size = [], 0
                current = k
                messages.append({"role": role.as_py(), "text": text.as_py()})
        if messages:
            close()
        if done:
            yield packed()

    return rows.mapInArrow(render_all, "k long, " + FORMATTED).withColumnRenamed("k", key)


def _digests(formatted: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, marked in zip(formatted, spans):
        text = text.as_py()
        turns, loss = hashlib.sha256(), hashlib.sha256()
        for role, body in read_back(text):
            turns.update(f"{role}\n{body}\n".encode())
        learned = [unescape(text[s["start"] : s["end"]]) for s in marked.as_py()]
        for part in learned:
            loss.update(part.encode())
        out.append({"turns_sha256": turns.hexdigest(), "loss_chars": sum(map(len, learned)), "loss_sha256": loss.hexdigest(), "formatted_chars": len(text)})
    return pa.array(out, pa.struct([("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))


def digests(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """What can be read back from conversations formatted by the default template, as digests."""
    _digests.__annotations__ = {"formatted": pa.Array, "spans": pa.Array, "return": pa.Array}
    kind = "struct<turns_sha256:string,loss_chars:bigint,loss_sha256:string,formatted_chars:bigint>"
    return formatted.select(key, "n_turns", F.arrow_udf(_digests, kind)("formatted", "spans").alias("d")).select(key, "n_turns", "d.*")


def conversation_digests(turns: DataFrame, key: str = "conv_id", least: int = PIECE) -> DataFrame:
    """The rows of ``digests(format_conversations(turns))``, read back piece by piece as they are rendered."""

    def fold_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        done = []
        for _, pieces in groupby(_pieces(batches, TEMPLATE, CONTROLS, least), key=lambda p: p[0]):
            turns, loss, n_turns, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for k, _, start, n, text, spans in pieces:
                for role, body in read_back(text):
                    turns.update(f"{role}\n{body}\n".encode())
                for a, b in spans:
                    part = unescape(text[a - start : b - start])
                    loss_chars += len(part)
                    loss.update(part.encode())
                n_turns += n
                chars += len(text)
            done.append((k, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            if len(done) > 10_000:
                yield _packed(done, names, types)
                done = []
        if done:
            yield _packed(done, names, types)

    kind = "k long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return _ordered(turns, key).mapInArrow(fold_pieces, kind).withColumnRenamed("k", key)


ORACLE_SQL = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') role, coalesce(text, '') body from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized as (
  select *, length(role) + length(body) + (2 * length(role || body) - length(replace(role || body, '\', '')) - length(replace(role || body, '<', ''))) + 20 chars from turns
)
select conv_id::bigint conv_id, count(*) n_turns,
       sha256(string_agg(role || chr(10) || body || chr(10), '' order by turn, role, body)) turns_sha256,
       coalesce(sum(length(body)) filter (where role = 'assistant'), 0)::bigint loss_chars,
       sha256(coalesce(string_agg(body, '' order by turn, role, body) filter (where role = 'assistant'), '')) loss_sha256,
       sum(chars)::bigint formatted_chars
from sized group by conv_id
"""
