"""Chat formatting by a template compiler.

A small sandboxed template language is parsed to a syntax tree, constants are folded,
and the tree becomes nested Python closures. Templates see only what they are given:
names, ``.field`` or ``['field']`` of a turn, ``loop.first/last/index``, literals,
``+ == != < > and or not in``, and the filters ``escape``, ``trim``, ``upper``,
``lower``. There are no calls, no attributes of Python objects, no imports. Blocks:
``{% for x in xs %}``, ``{% if %}{% elif %}{% else %}``, ``{% set x = e %}`` and
``{% generation %}`` (the text that carries loss).

Formatting streams: rows are dealt by conversation and sorted by turn, the loop over
turns pulls them one by one, and one output row leaves per turn with its text and loss
span. A conversation of any length thus never sits in memory as a whole.

``escape`` puts a backslash into control strings (``<|`` and ``|>``) and doubles
backslashes, so texts can hold any control string and be read back exactly.

Edge cases: a null role or text is empty; rows of equal turn go by role, then text;
repeated rows are turns of their own; a null turn comes first; a null conversation id
is a conversation; an empty table gives no rows; only the four named columns are read.
An id of a type other than an integer is returned as its text.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, table


class TemplateError(ValueError):
    pass


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|").replace("|>", "|\\>")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}


# --- syntax tree --------------------------------------------------------------

@dataclass
class Const:
    value: object


@dataclass
class Name:
    name: str


@dataclass
class Field:
    of: object
    name: str


@dataclass
class Op:
    op: str
    args: list


@dataclass
class Filter:
    name: str
    of: object


@dataclass
class Output:
    value: object


@dataclass
class If:
    branches: list  # (condition, body)
    other: list = field(default_factory=list)


@dataclass
class For:
    name: str
    over: object
    body: list = field(default_factory=list)


@dataclass
class Set:
    name: str
    value: object


@dataclass
class Generation:
    body: list


_TAG = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)
_LEX = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[-+<>().\[\]|]))""")
_WORDS = {"and", "or", "not", "in"}
_ESCAPES = {"n": "\n", "t": "\t", "\\": "\\", "'": "'", '"': '"'}


class _Expr:
    """Recursive descent over one expression."""

    def __init__(self, text: str):
        self.toks, at, text = [], 0, text.strip()
        while at < len(text):
            m = _LEX.match(text, at)
            if not m:
                raise TemplateError(f"cannot read {text[at:]!r}")
            self.toks.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.i = 0

    def peek(self, *values: str) -> bool:
        return self.i < len(self.toks) and self.toks[self.i][1] in values and self.toks[self.i][0] != "str"

    def take(self, *values: str) -> bool:
        hit = self.peek(*values)
        self.i += hit
        return hit

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} expected")

    def whole(self):
        e = self.either()
        if self.i != len(self.toks):
            raise TemplateError(f"unexpected {self.toks[self.i][1]!r}")
        return e

    def either(self):
        e = self.both()
        while self.take("or"):
            e = Op("or", [e, self.both()])
        return e

    def both(self):
        e = self.negated()
        while self.take("and"):
            e = Op("and", [e, self.negated()])
        return e

    def negated(self):
        return Op("not", [self.negated()]) if self.take("not") else self.compared()

    def compared(self):
        e = self.summed()
        for op in ("==", "!=", "<", ">", "in"):
            if self.take(op):
                return Op(op, [e, self.summed()])
        return e

    def summed(self):
        e = self.filtered()
        while self.take("+"):
            e = Op("+", [e, self.filtered()])
        return e

    def filtered(self):
        e = self.atom()
        while self.take("|"):
            kind, name = self.toks[self.i] if self.i < len(self.toks) else ("", "")
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.i += 1
            e = Filter(name, e)
        return e

    def atom(self):
        if self.i >= len(self.toks):
            raise TemplateError("an expression ends early")
        kind, value = self.toks[self.i]
        self.i += 1
        if kind == "str":
            e = Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), value[1:-1], flags=re.S))
        elif kind == "num":
            e = Const(int(value))
        elif kind == "name" and value not in _WORDS:
            e = Const({"true": True, "false": False, "none": None}[value]) if value in ("true", "false", "none") else Name(value)
        elif value == "(":
            e = self.either()
            self.need(")")
        else:
            raise TemplateError(f"unexpected {value!r}")
        while self.peek(".", "["):
            if self.take("."):
                kind, name = self.toks[self.i] if self.i < len(self.toks) else ("", "")
                if kind != "name":
                    raise TemplateError("a field name is expected")
                self.i += 1
            else:
                self.need("[")
                kind, name = self.toks[self.i] if self.i < len(self.toks) else ("", "")
                if kind != "str":
                    raise TemplateError("a quoted field name is expected")
                self.i += 1
                name = name[1:-1]
                self.need("]")
            if name.startswith("_"):
                raise TemplateError(f"field {name!r} is not open to templates")
            e = Field(e, name)
        return e


def parse(source: str) -> list:
    """The syntax tree of a template: a list of nodes."""
    top: list = []
    stack: list[tuple[str, object, list]] = [("", None, top)]  # kind, node, list being filled
    for k, part in enumerate(_TAG.split(source)):
        body = stack[-1][2]
        if k % 2 == 0:
            if part:
                body.append(Output(Const(part)))
        elif part.startswith("{{"):
            body.append(Output(_Expr(part[2:-2]).whole()))
        elif part.startswith("{%"):
            word, _, rest = part[2:-2].strip().partition(" ")
            kind, node, _ = stack[-1]
            if word == "if":
                node = If([(_Expr(rest).whole(), [])])
                body.append(node)
                stack.append(("if", node, node.branches[0][1]))
            elif word == "elif" and kind == "if":
                node.branches.append((_Expr(rest).whole(), []))
                stack[-1] = ("if", node, node.branches[-1][1])
            elif word == "else" and kind == "if":
                stack[-1] = ("if", node, node.other)
            elif word == "for" and (m := re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest.strip(), re.S)):
                node = For(m[1], _Expr(m[2]).whole())
                body.append(node)
                stack.append(("for", node, node.body))
            elif word == "set" and (m := re.fullmatch(r"([A-Za-z_]\w*)\s*=(?!=)(.+)", rest.strip(), re.S)):
                body.append(Set(m[1], _Expr(m[2]).whole()))
            elif word == "generation":
                node = Generation([])
                body.append(node)
                stack.append(("generation", node, node.body))
            elif word.startswith("end") and word[3:] == kind and kind:
                stack.pop()
            else:
                raise TemplateError(f"unexpected block {word!r}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]!r} is not closed")
    return top


# --- constant folding ---------------------------------------------------------

_OPS: dict[str, Callable] = {
    "+": lambda a, b: a + b if isinstance(a, int) and isinstance(b, int) else f"{_text(a)}{_text(b)}",
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
    "<": lambda a, b: _ordered(a, b) < 0, ">": lambda a, b: _ordered(a, b) > 0, "in": lambda a, b: _text(a) in _text(b), "not": lambda a: not a,
}


def _text(v) -> str:
    return "" if v is None else str(v)


def _ordered(a, b) -> int:
    """-1, 0 or 1 for two numbers or two texts; other pairs have no order."""
    if isinstance(a, str) != isinstance(b, str) or a is None or b is None:
        raise TemplateError(f"cannot order {_text(a)!r} and {_text(b)!r}")
    return (a > b) - (a < b)


def fold(node):
    """Evaluate what is constant; choose constant branches; join neighbouring texts."""
    if isinstance(node, list):
        out: list = []
        for n in map(fold, node):
            for x in n if isinstance(n, list) else [n]:
                if isinstance(x, Output) and isinstance(x.value, Const):
                    x = Output(Const(_text(x.value.value)))
                    if out and isinstance(out[-1], Output) and isinstance(out[-1].value, Const):
                        out[-1] = Output(Const(out[-1].value.value + x.value.value))
                        continue
                out.append(x)
        return out
    if isinstance(node, Op):
        args = [fold(a) for a in node.args]
        if node.op in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (node.op == "and") else args[0]
        if all(isinstance(a, Const) for a in args) and node.op in _OPS:
            return Const(_OPS[node.op](*(a.value for a in args)))
        return Op(node.op, args)
    if isinstance(node, Filter):
        of = fold(node.of)
        return Const(FILTERS[node.name](_text(of.value))) if isinstance(of, Const) else Filter(node.name, of)
    if isinstance(node, Field):
        return Field(fold(node.of), node.name)
    if isinstance(node, Output):
        return Output(fold(node.value))
    if isinstance(node, Set):
        return Set(node.name, fold(node.value))
    if isinstance(node, If):
        branches, other = [], fold(node.other)
        for cond, body in ((fold(c), fold(b)) for c, b in node.branches):
            if isinstance(cond, Const):
                if cond.value:
                    other = body
                    break
                continue
            branches.append((cond, body))
        return If(branches, other) if branches else other
    if isinstance(node, For):
        return For(node.name, fold(node.over), fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    return node


# --- closures -----------------------------------------------------------------

#: Leaves the renderer after each turn of the outermost loop.
TURN_ENDS = object()


def _value(node) -> Callable[[dict], object]:
    if isinstance(node, Const):
        v = node.value
        return lambda env: v
    if isinstance(node, Name):
        name = node.name
        return lambda env: env.get(name)
    if isinstance(node, Field):
        of, name = _value(node.of), node.name

        def get(env):
            v = of(env)
            return v.get(name) if type(v) is dict else None

        return get
    if isinstance(node, Filter):
        of, f = _value(node.of), FILTERS[node.name]
        return lambda env: f(_text(of(env)))
    args = [_value(a) for a in node.args]
    if node.op == "and":
        return lambda env: args[0](env) and args[1](env)
    if node.op == "or":
        return lambda env: args[0](env) or args[1](env)
    op = _OPS[node.op]
    return (lambda env: op(args[0](env))) if len(args) == 1 else (lambda env: op(args[0](env), args[1](env)))


def _body(nodes: list, depth: int, loss: bool) -> Callable[[dict], Iterator]:
    parts = [_node(n, depth, loss) for n in nodes]

    def run(env):
        for p in parts:
            yield from p(env)

    return run


def _node(node, depth: int, loss: bool) -> Callable[[dict], Iterator]:
    if isinstance(node, Output):
        value = _value(node.value)

        def out(env):
            yield _text(value(env)), loss

        return out
    if isinstance(node, Set):
        name, value = node.name, _value(node.value)

        def put(env):
            env[name] = value(env)
            yield from ()

        return put
    if isinstance(node, If):
        branches, other = [(_value(c), _body(b, depth, loss)) for c, b in node.branches], _body(node.other, depth, loss)

        def choose(env):
            for cond, body in branches:
                if cond(env):
                    yield from body(env)
                    return
            yield from other(env)

        return choose
    if isinstance(node, Generation):
        return _body(node.body, depth, True)
    name, over, body = node.name, _value(node.over), _body(node.body, depth + 1, loss)

    def loop(env):
        items = iter(over(env) or ())
        own, nothing, i = dict(env), object(), 0
        now = next(items, nothing)
        while now is not nothing:  # one turn of look-ahead, for loop.last
            after = next(items, nothing)
            own[name], own["loop"] = now, {"index": i + 1, "index0": i, "first": i == 0, "last": after is nothing}
            yield from body(own)
            if depth == 0:
                yield TURN_ENDS
            now, i = after, i + 1

    return loop


class Template:
    """A compiled template; tasks receive its source and compile it themselves."""

    def __reduce__(self):
        return Template, (self.source,)

    def __init__(self, source: str):
        self.source = source
        self.tree = fold(parse(source))
        self._run = _body(self.tree, 0, False)

    def pieces(self, messages: Iterable[dict]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        """(text, loss spans within it), one for each turn; what precedes or follows the
        loop goes with the first or after the last turn. ``messages`` may be a stream."""
        text: list[str] = []
        spans: list[tuple[int, int]] = []
        at = 0
        for event in self._run({"messages": messages}):
            if event is TURN_ENDS:
                yield "".join(text), spans
                text, spans, at = [], [], 0
                continue
            s, loss = event
            if loss and s:
                spans = spans[:-1] + [(spans[-1][0], at + len(s))] if spans and spans[-1][1] == at else spans + [(at, at + len(s))]
            text.append(s)
            at += len(s)
        if text:
            yield "".join(text), spans

    def render(self, messages: Iterable[dict]) -> tuple[str, list[tuple[int, int]]]:
        """The whole text and its loss spans."""
        text, spans, at = [], [], 0
        for s, own in self.pieces(messages):
            text.append(s)
            spans += [(a + at, b + at) for a, b in own]
            at += len(s)
        return "".join(text), spans


TEMPLATE = Template(
    "{% for m in messages %}<|{{ m.role | escape }}|>\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}<|end|>\n{% endfor %}")
_ONE_TURN = re.compile(r"<\|((?:[^\\|]++|\\.|\|(?!>))*+)\|>\n((?:[^<\\]++|\\.|<(?!\|))*+)<\|end\|>\n", re.S)


def read_back(piece: str) -> tuple[str, str]:
    """Role and text of one formatted turn of ``TEMPLATE``."""
    m = _ONE_TURN.fullmatch(piece)
    if not m:
        raise ValueError("not a formatted turn")
    return unescape(m[1]), unescape(m[2])


def _rows(batches) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def _emit(rows: Iterable[tuple], schema: pa.Schema, size: int = 2000):
    rows = iter(rows)
    while part := list(itertools.islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)


def format_conversations(df: DataFrame, template: str | Template = TEMPLATE) -> DataFrame:
    """conv_id, part, formatted, loss_spans (array of start, end within ``formatted``):
    one row per turn, in order, a conversation's rows next to each other."""
    template = Template(template) if isinstance(template, str) else template
    kind = df.schema["conv_id"].dataType.simpleString()

    def run(batches):
        def out():
            for conv, turns in itertools.groupby(_rows(batches), key=lambda r: r[0]):
                messages = ({"role": role or "", "text": text or ""} for _, role, text in turns)
                for part, (text, spans) in enumerate(template.pieces(messages)):
                    yield conv, part, text, [{"start": a, "end": b} for a, b in spans]

        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        conv_type = pa.int64() if kind in ("bigint", "int", "smallint", "tinyint") else pa.string()
        yield from _emit(out(), pa.schema([("conv_id", conv_type), ("part", pa.int64()), ("formatted", pa.string()), ("loss_spans", span)]))

    conv = F.col("conv_id").cast("long") if kind in ("bigint", "int", "smallint", "tinyint") else F.col("conv_id").cast("string")
    ordered = (df.select(conv.alias("conv_id"), "turn", "role", "text").repartition("conv_id")
               .sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text"))
    out_kind = "long" if kind in ("bigint", "int", "smallint", "tinyint") else "string"
    return mapped(ordered, run, f"conv_id {out_kind}, part long, formatted string, loss_spans array<struct<start: long, end: long>>")


def digests(formatted: DataFrame) -> DataFrame:
    """Read the formatted turns back, in place, and digest each conversation as it streams by."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches):
        def out():
            for conv, parts in itertools.groupby(_rows(batches), key=lambda r: r[0]):
                turns, loss, n, n_loss, n_chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                for _, _, text, spans in parts:
                    role, said = read_back(text)
                    turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    own = unescape("".join(text[s["start"]:s["end"]] for s in spans))
                    loss.update(own.encode("utf-8", "surrogatepass"))
                    n, n_loss, n_chars = n + 1, n_loss + len(own), n_chars + len(text)
                yield conv, n, turns.hexdigest(), n_loss, loss.hexdigest(), n_chars

        yield from _emit(out(), pa.schema([("conv_id", pa.int64() if kind == "bigint" else pa.string()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                                           ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))

    return mapped(formatted, run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn int, role string, text string")
    return digests(format_conversations(rows.unionByName(extra.select(*[F.col(f.name).cast(f.dataType) for f in rows.schema]))))
