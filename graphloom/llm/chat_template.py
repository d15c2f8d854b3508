"""Chat formatting by a template compiler.

A small template language is parsed to a syntax tree, constants are folded, and the tree becomes Python closures that
write (text, trained) pieces to a sink one by one, so a conversation of any length is rendered in bounded memory.

    {{ expression }}   {% for x in name %} ... {% endfor %}   {% if c %} ... {% elif c %} ... {% else %} ... {% endif %}
    {% set x = e %}    {% generation %} ... {% endgeneration %}   {# comment #}   a dash beside % or { trims blanks there

Expressions: strings, integers, true, false, none, names, a.b, + ~ * - == != < > <= >= in, and, or, not, `x if c else y`
and filters after |. There is no call, no index and no Python attribute: names lead to what the caller passed and fields
to keys of mappings, so a template reaches nothing else.
"""

from __future__ import annotations

import hashlib
import operator
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class TemplateError(ValueError):
    pass


# ---- control strings -------------------------------------------------------------------------------------------


def escape(text: str) -> str:
    """No `<|` is left, and unescape() gives the text back: a backslash is doubled, one goes between < and |."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_line(text: str) -> str:
    return escape(text).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


FILTERS: dict[str, Callable] = {"trim": str.strip, "upper": str.upper, "lower": str.lower, "length": len, "escape": escape, "escape_line": escape_line, "string": str}

# ---- parsing -----------------------------------------------------------------------------------------------------

_TAG = re.compile(r"\{#.*?#\}|\{\{.*?\}\}|\{%.*?%\}", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~*<>|.()]))", re.S)
_COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge, "in": lambda a, b: a in b}
_SIMPLE = {"n": "\n", "t": "\t", "r": "\r"}


def _tokens(source: str) -> list[tuple[str, object]]:
    out, at, source = [], 0, source.rstrip()
    while at < len(source):
        if not (m := _TOKEN.match(source, at)):
            raise TemplateError(f"can't read {source[at:]!r}")
        value: object = m[m.lastgroup]
        if m.lastgroup == "str":
            value = re.sub(r"\\(.)", lambda x: _SIMPLE.get(x[1], x[1]), value[1:-1], flags=re.S)
        elif m.lastgroup == "int":
            value = int(value)
        out.append((m.lastgroup, value))
        at = m.end()
    return out


class _Expression:
    """Precedence climbing over a token list; gives tuples ("const", v), ("name", n), ("field", e, n), ("op", f, a, b) ..."""

    def __init__(self, source: str):
        self.tokens, self.at = _tokens(source), 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "name") and self.tokens[self.at][1] in values

    def take(self, *values: str):
        if self.at >= len(self.tokens) or values and not self.peek(*values):
            raise TemplateError(f"expected {' or '.join(values) or 'more'}")
        self.at += 1
        return self.tokens[self.at - 1]

    def whole(self):
        out = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def choice(self):
        out = self.either()
        if self.peek("if"):
            self.take()
            test = self.either()
            self.take("else")
            out = ("choice", test, out, self.choice())
        return out

    def either(self):
        out = self.both()
        while self.peek("or"):
            self.take()
            out = ("or", out, self.both())
        return out

    def both(self):
        out = self.inverse()
        while self.peek("and"):
            self.take()
            out = ("and", out, self.inverse())
        return out

    def inverse(self):
        if self.peek("not"):
            self.take()
            return ("call", operator.not_, self.inverse())
        out = self.sum()
        while self.peek(*_COMPARE):
            out = ("op", _COMPARE[self.take()[1]], out, self.sum())
        return out

    def sum(self):
        out = self.product()
        while self.peek("+", "-", "~"):
            sign = self.take()[1]
            call = {"+": operator.add, "-": operator.sub, "~": lambda a, b: f"{a}{b}"}[sign]
            out = ("op", call, out, self.product())
        return out

    def product(self):
        out = self.filtered()
        while self.peek("*"):
            self.take()
            out = ("op", _times, out, self.filtered())
        return out

    def filtered(self):
        out = self.atom()
        while self.peek(".", "|"):
            sign, (kind, name) = self.take()[1], self.take()
            if kind != "name":
                raise TemplateError(f"a name should follow {sign}")
            if sign == "|" and name not in FILTERS:
                raise TemplateError(f"no filter {name}")
            out = ("field", out, name) if sign == "." else ("call", FILTERS[name], out)
        return out

    def atom(self):
        kind, value = self.take()
        if kind in ("str", "int"):
            return ("const", value)
        if kind == "name" and value in ("true", "false", "none"):
            return ("const", {"true": True, "false": False, "none": None}[value])
        if kind == "name" and value not in ("if", "else", "and", "or", "not", "in"):
            return ("name", value)
        if value == "(":
            out = self.choice()
            self.take(")")
            return out
        raise TemplateError(f"unexpected {value!r}")


def _times(a, b):
    """Only small products: a template can't ask for an endless string."""
    out_of = max(len(x) if isinstance(x, str) else 1 for x in (a, b)) * max(abs(x) if isinstance(x, int) else 1 for x in (a, b))
    if out_of > 1_000_000_000 or isinstance(a, str) + isinstance(b, str) and out_of > 1_000_000:
        raise TemplateError("the product is too large")
    return a * b


def parse(source: str) -> list[tuple]:
    """The syntax tree: ("text", s), ("put", e), ("for", name, e, body), ("if", [(e, body)], other), ("set", name, e), ("gen", body)."""
    pieces: list[tuple[str, str]] = []
    at, trim = 0, False
    for m in _TAG.finditer(source):
        text, tag = source[at : m.start()], m[0]
        text = text.lstrip() if trim else text
        inner = tag[2:-2]
        if inner.startswith("-"):
            text, inner = text.rstrip(), inner[1:]
        trim = inner.endswith("-")
        inner = inner[:-1] if trim else inner
        pieces += [("text", text)] * bool(text)
        if tag[1] != "#":
            pieces.append(("put" if tag[1] == "{" else "tag", inner.strip()))
        at = m.end()
    rest = source[at:].lstrip() if trim else source[at:]
    if re.search(r"\{[{%#]", rest):
        raise TemplateError("a tag is not closed")
    pieces += [("text", rest)] * bool(rest)
    pieces.reverse()

    def block(*ends: str) -> tuple[list[tuple], str, str]:
        out: list[tuple] = []
        while pieces:
            kind, value = pieces.pop()
            if kind == "text":
                out.append(("text", value))
            elif kind == "put":
                out.append(("put", _Expression(value).whole()))
            else:
                word, _, rest = value.partition(" ")
                if word in ends:
                    return out, word, rest
                out.append(statement(word, rest))
        if ends:
            raise TemplateError(f"{ends[0]} is missing")
        return out, "", ""

    def statement(word: str, rest: str) -> tuple:
        if word == "for" and (m := re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)):
            return ("for", m[1], _Expression(m[2]).whole(), block("endfor")[0])
        if word == "set" and (m := re.fullmatch(r"\s*([A-Za-z_]\w*)\s*=\s*(.+)", rest, re.S)):
            return ("set", m[1], _Expression(m[2]).whole())
        if word == "generation":
            return ("gen", block("endgeneration")[0])
        if word == "if":
            cases, test = [], rest
            while True:
                body, end, more = block("elif", "else", "endif")
                cases.append((_Expression(test).whole(), body))
                if end != "elif":
                    return ("if", cases, block("endif")[0] if end == "else" else [])
                test = more
        raise TemplateError(f"can't read the tag {word!r}")

    return block()[0]


# ---- folding -----------------------------------------------------------------------------------------------------


def fold_expression(e: tuple) -> tuple:
    """The same expression with every part that names nothing computed now. What would fail stays, to fail when rendered."""
    kind, *parts = e
    if kind in ("const", "name"):
        return e
    if kind == "field":
        return ("field", fold_expression(parts[0]), parts[1])
    head, inner = (parts[:1], parts[1:]) if kind in ("op", "call") else ([], parts)
    inner = [fold_expression(x) for x in inner]
    known = [x[0] == "const" for x in inner]
    if kind == "choice" and known[0]:
        return inner[1] if inner[0][1] else inner[2]
    if kind in ("and", "or") and known[0]:
        return inner[1] if bool(inner[0][1]) == (kind == "and") else inner[0]
    if kind in ("op", "call") and all(known):
        try:
            return ("const", head[0](*(x[1] for x in inner)))
        except (TypeError, TemplateError):
            pass
    return (kind, *head, *inner)


def fold(tree: list[tuple]) -> list[tuple]:
    """Constants computed, decided branches taken, neighbouring texts joined."""
    out: list[tuple] = []
    for kind, *parts in tree:
        if kind == "put":
            e = fold_expression(parts[0])
            new = [("text", _shown(e[1]))] if e[0] == "const" else [("put", e)]
        elif kind == "set":
            new = [("set", parts[0], fold_expression(parts[1]))]
        elif kind == "for":
            new = [("for", parts[0], fold_expression(parts[1]), fold(parts[2]))]
        elif kind == "gen":
            new = [("gen", fold(parts[0]))]
        elif kind == "if":
            cases, other = [], fold(parts[1])
            for test, body in parts[0]:
                test = fold_expression(test)
                if test[0] != "const":
                    cases.append((test, fold(body)))
                elif test[1]:
                    other = fold(body)
                    break
            new = [("if", cases, other)] if cases else other
        else:
            new = [(kind, *parts)]
        for x in new:
            if x[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + x[1])
            elif x != ("text", ""):
                out.append(x)
    return out


# ---- closures ----------------------------------------------------------------------------------------------------


def _shown(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def _field(value: object, name: str) -> object:
    if isinstance(value, dict):
        return value.get(name)
    raise TemplateError(f"no field {name} here")


def _compute(e: tuple) -> Callable[[dict], object]:
    kind, *p = e
    if kind == "const":
        return lambda names: p[0]
    if kind == "name":
        return lambda names: names.get(p[0])
    if kind == "field":
        inner, name = _compute(p[0]), p[1]
        return lambda names: _field(inner(names), name)
    if kind == "call":
        call, inner = p[0], _compute(p[1])
        return lambda names: call(inner(names))
    if kind == "op":
        call, a, b = p[0], _compute(p[1]), _compute(p[2])
        return lambda names: call(a(names), b(names))
    a, b = _compute(p[0]), _compute(p[1])
    if kind == "and":
        return lambda names: a(names) and b(names)
    if kind == "or":
        return lambda names: a(names) or b(names)
    c = _compute(p[2])
    return lambda names: b(names) if a(names) else c(names)


Sink = Iterator[tuple[str, bool]]


def _write(tree: list[tuple], trained: bool) -> Callable[[dict], Sink]:
    steps = [_step(node, trained) for node in tree]

    def run(names: dict) -> Sink:
        for step in steps:
            yield from step(names)

    return run


def _step(node: tuple, trained: bool) -> Callable[[dict], Sink]:
    kind, *p = node
    if kind == "text":
        piece = ((p[0], trained),)
        return lambda names: piece
    if kind == "put":
        value = _compute(p[0])
        return lambda names: ((_shown(value(names)), trained),)
    if kind == "gen":
        return _write(p[0], True)
    if kind == "set":
        name, value = p[0], _compute(p[1])

        def put(names: dict) -> Sink:
            names[name] = value(names)
            return iter(())

        return put
    if kind == "for":
        name, values, body = p[0], _compute(p[1]), _write(p[2], trained)

        def loop(names: dict) -> Sink:
            for i, x in enumerate(values(names) or ()):
                yield from body(names | {name: x, "loop": {"index": i + 1, "index0": i, "first": i == 0}})

        return loop
    cases, other = [(_compute(test), _write(body, trained)) for test, body in p[0]], _write(p[1], trained)

    def choose(names: dict) -> Sink:
        return next((body for test, body in cases if test(names)), other)(names)

    return choose


def compile_template(source: str) -> Callable[[dict], Sink]:
    """A function of the names that gives (text, trained) pieces; what it iterates over may itself be an iterator."""
    return _write(fold(parse(source)), False)


def render(source: str, **names: object) -> tuple[str, list[tuple[int, int]]]:
    """The whole text and the [start, end) of what stood between generation markers."""
    text, spans = "", []
    for piece, trained in compile_template(source)(dict(names)):
        if trained and piece:
            if spans and spans[-1][1] == len(text):
                spans[-1] = (spans[-1][0], len(text) + len(piece))
            else:
                spans.append((len(text), len(text) + len(piece)))
        text += piece
    return text, spans


#: One turn: a marked role line, the escaped text, an end marker. Each assistant text is trained.
CHATML = (
    "{%- for m in messages -%}<|im_start|>{{ m.role | escape_line }}{{ '\\n' }}"
    "{%- if m.role == 'assistant' -%}{%- generation -%}{{ m.text | escape }}{%- endgeneration -%}{%- else -%}{{ m.text | escape }}{%- endif -%}"
    "<|im_end|>{{ '\\n' }}{%- endfor -%}"
)

# ---- over DataFrames ---------------------------------------------------------------------------------------------


def _turns(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def format_conversations(df: DataFrame, template: str = CHATML, segment: int = 1 << 20, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows by turn to rows (_conv, _segment, _formatted, _spans): the parts of each formatted conversation, in order.

    Turns are ordered by turn, role and text (nulls first); null roles and texts count as empty, null conversation ids
    as one conversation; repeated rows are turns of their own. A conversation's rows are sorted into one partition and
    stream through it: a part ends when it has `segment` characters, and a span [start, end) counts from its part's
    start, so memory is bounded however long a conversation is. An empty table gives no rows.
    """
    rows = df.select(F.col(conv).cast("long").alias("c"), F.col(turn).cast("long").alias("t"), F.coalesce(F.col(role), F.lit("")).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("x"))
    rows = rows.repartition("c").sortWithinPartitions("c", "t", "r", "x")
    compile_template(template)  # reports errors here

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write, feed, held = compile_template(template), _turns(batches), []
        head = next(feed, None)

        def own(first: tuple) -> Iterator[dict]:
            nonlocal head
            head = first
            while head is not None and head[0] == first[0]:
                yield {"role": head[2], "text": head[3], "turn": head[1]}
                head = next(feed, None)

        def parts(first: tuple) -> Iterator[tuple]:
            texts, spans, size, n = [], [], 0, 0
            for piece, trained in write({"messages": own(first)}):
                while piece:
                    cut = piece[: max(1, segment - size)]
                    if trained:
                        if spans and spans[-1]["end"] == size:
                            spans[-1]["end"] = size + len(cut)
                        else:
                            spans.append({"start": size, "end": size + len(cut)})
                    texts.append(cut)
                    size, piece = size + len(cut), piece[len(cut) :]
                    if size >= segment:
                        yield first[0], n, "".join(texts), spans
                        texts, spans, size, n = [], [], 0, n + 1
            if texts or not n:
                yield first[0], n, "".join(texts), spans

        kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        names = ["_conv", "_segment", "_formatted", "_spans"]
        give = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
        chars = 0
        while head is not None:
            here = head
            for part in parts(here):
                held.append(part)
                chars += len(part[2])
                if chars >= segment:
                    yield give()
                    held, chars = [], 0
            while head is not None and head[0] == here[0]:  # a template need not use all turns
                head = next(feed, None)
        if held:
            yield give()

    return rows.mapInArrow(work, "_conv long, _segment long, _formatted string, _spans array<struct<start:long,end:long>>")


def read_conversations(formatted: DataFrame) -> DataFrame:
    """Back from format_conversations() with CHATML: _conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    It must follow that operator directly, as it needs the parts of a conversation one after the other. Turns are found
    by their markers and unescaped; the trained text is what the spans cover, unescaped. Parts are read one by one.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        state: dict | None = None

        def finish(s: dict) -> tuple:
            if s["left"]:
                raise ValueError("a formatted conversation ends within a turn")
            return s["conv"], s["n"], s["turns"].hexdigest(), s["chars"], s["loss"].hexdigest(), s["size"]

        for conv, segment, text, spans in _turns(batches):
            if segment == 0:
                out += [finish(state)] if state else []
                state = {"conv": conv, "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0, "size": 0, "left": "", "cut": ""}
            state["size"] += len(text)
            for span in spans:
                trained = state["cut"] + text[span["start"] : span["end"]]
                odd = (len(trained) - len(trained.rstrip("\\"))) % 2 and span["end"] == len(text)  # an escape goes on in the next part
                state["cut"], trained = ("\\", trained[:-1]) if odd else ("", trained)
                plain = unescape(trained)
                state["chars"] += len(plain)
                state["loss"].update(plain.encode())
            *whole, state["left"] = (state["left"] + text).split("<|im_end|>\n")
            for one in whole:
                role, mark, said = one.removeprefix("<|im_start|>").partition("\n")
                if not one.startswith("<|im_start|>") or not mark:
                    raise ValueError("a formatted turn has no marker")
                state["n"] += 1
                state["turns"].update(f"{unescape(role)}\n{unescape(said)}\n".encode())
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema)
                out = []
        out += [finish(state)] if state else []
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema)

    names = ["_conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = pa.schema([(n, pa.string() if "sha" in n else pa.int64()) for n in names])
    return formatted.mapInArrow(work, "_conv long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
