"""Extractors: source text to symbols, imports, exports and calls, one result a file.

No parser generator is at hand, so JavaScript and TypeScript are read by a scanner that knows comments, strings,
templates and nesting; Python by its own `ast`; other languages by declaration patterns. register() adds or replaces
a language.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = (
    "source_file string, symbols array<struct<name:string,kind:string,line:int,pos:int,content_hash:string>>, "
    "imports array<struct<specifier:string,kind:string,local:string,imported:string,pos:int>>, "
    "exports array<struct<symbol:string,alias:string,specifier:string,kind:string,pos:int>>, "
    "calls array<struct<callee:string,is_member:boolean,line:int,pos:int>>, default_symbol string, error string"
)
_KINDS = {"line": pa.int32(), "pos": pa.int32(), "is_member": pa.bool_()}
_TABLES = {"symbols": ("name", "kind", "line", "pos", "content_hash"), "imports": ("specifier", "kind", "local", "imported", "pos"), "exports": ("symbol", "alias", "specifier", "kind", "pos"), "calls": ("callee", "is_member", "line", "pos")}
ARROW = pa.schema([("source_file", pa.string()), *[(t, pa.list_(pa.struct([(c, _KINDS.get(c, pa.string())) for c in cs]))) for t, cs in _TABLES.items()], ("default_symbol", pa.string()), ("error", pa.string())])
#: Files whose results make one batch, and the characters of text after which a batch is closed early.
BATCH, CHARS = 256, 4_000_000
Result = dict[str, list[dict]]
EXTRACTORS: dict[str, Callable[[str], Result]] = {}


def register(extension: str, extract: Callable[[str], Result]) -> None:
    EXTRACTORS[extension] = extract


def supported() -> list[str]:
    return list(EXTRACTORS)


def empty() -> Result:
    return {"symbols": [], "imports": [], "exports": [], "calls": [], "default_symbol": None}


def text_hash(text: str) -> str:
    """functions.ids.content_hash of a text on a worker: h = 33 h + unit over UTF-16 units from 5381, modulo 2**32, in base 36."""
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2").astype(np.uint32)
    h = 5381
    for at in range(0, len(units), 1 << 16):
        part = units[at : at + (1 << 16)]
        powers = np.ones(len(part) + 1, np.uint32)
        np.multiply.accumulate(np.full(len(part), 33, np.uint32), out=powers[1:])
        h = (h * int(powers[-1]) + int((part * powers[-2::-1]).sum(dtype=np.uint64))) % (1 << 32)
    return np.base_repr(h, 36).lower()


# ---- JavaScript and TypeScript -----------------------------------------------------------------------------------

_LEX = re.compile(
    r"(?P<skip>//[^\n]*|/\*.*?\*/|\s+)|(?P<str>'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\")|(?P<tpl>`(?:\\.|[^`\\])*`)"
    r"|(?P<id>[A-Za-z_$#][\w$]*)|(?P<num>\d[\w.]*)|(?P<op>=>|\?\.|\.\.\.|[^\w\s])", re.S,
)
_NO_CALL = {"async", "if", "for", "while", "switch", "catch", "function", "return", "typeof", "new", "await", "super", "constructor", "import", "with", "do", "else", "of", "in", "instanceof", "delete", "void", "yield", "throw", "case"}


def _lex(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, text, line, place in the text) of each token."""
    out, at, line = [], 0, 1
    while at < len(text):
        m = _LEX.match(text, at)
        if not m:
            at += 1
            continue
        if m.lastgroup != "skip":
            out.append((m.lastgroup, m[0], line, at))
        line += m[0].count("\n")
        at = m.end()
    return out


def extract_script(text: str) -> Result:
    """Functions, classes, methods (but constructors), function- or class-valued variables; imports, exports, calls."""
    t, out = _lex(text), empty()
    val = lambda i: t[i][1] if 0 <= i < len(t) else ""
    kind = lambda i: t[i][0] if 0 <= i < len(t) else ""
    place = iter(range(1 << 30))
    scopes: list[str | None] = []  # the class that each open brace belongs to
    parens, pending = 0, None
    declared, brought = set(), {}

    def span(start: int, block: bool) -> str:
        """The text of a declaration from a token on: to the end of its block, or of a statement where that ends first."""
        depth, j = 0, start
        while j < len(t):
            v, line = val(j), t[j][2]
            if depth == 0 and j > start and (v in (";", ",", "}", ")") or not block and line > t[j - 1][2] and val(j - 1) not in ("=", "=>", ",", "(", "{", "[") and kind(j) in ("id", "str")):
                break
            depth += (v in ("(", "[", "{")) - (v in (")", "]", "}"))
            j += 1
            if block and depth == 0 and v == "}":
                break
        return text[t[start][3] : t[j - 1][3] + len(val(j - 1))]

    def symbol(name: str, what: str, line: int, start: int | None = None, block: bool = True) -> None:
        owner = ".".join(c for c in scopes if c)
        declared.add(name)
        out["symbols"].append({"name": f"{owner}.{name}" if owner else name, "kind": what, "line": line, "pos": next(place), "content_hash": None if start is None else text_hash(span(start, block))})

    def export(name: str, alias: str | None = None, spec: str | None = None, what: str = "named") -> None:
        out["exports"].append({"symbol": name, "alias": alias, "specifier": spec, "kind": what, "pos": next(place)})

    def names(i: int) -> tuple[list[tuple[str, str | None, bool]], int]:
        """The (name, alias, type_only) of a list in braces, and where it ends."""
        found = []
        while i < len(t) and val(i) != "}":
            typed = val(i) == "type" and kind(i + 1) == "id" and val(i + 1) != "as"
            i += typed
            if kind(i) in ("id", "str"):
                name, alias = val(i).strip("'\""), None
                if val(i + 1) == "as":
                    alias, i = val(i + 2).strip("'\""), i + 2
                found.append((name, alias, typed))
            i += 1
        return found, i + 1

    def imports(i: int) -> int:
        def bring(spec: str, what: str, local: str | None = None, name: str | None = None) -> None:
            out["imports"].append({"specifier": spec, "kind": what, "local": local, "imported": name, "pos": next(place)})
            if what in ("default", "named"):
                brought[local] = (spec, name)

        if kind(i) == "str":
            bring(val(i)[1:-1], "side-effect")
            return i + 1
        typed = val(i) == "type" and val(i + 1) != "from" and val(i + 1) != ","
        i += typed
        default, star, listed = None, None, []
        while i < len(t) and val(i) != "from":
            if val(i) == "*" and val(i + 1) == "as":
                star, i = val(i + 2), i + 3
            elif val(i) == "{":
                listed, i = names(i + 1)
            elif kind(i) == "id":
                default, i = val(i), i + 1
            elif val(i) == ",":
                i += 1
            else:
                return i
        spec = val(i + 1)[1:-1] if kind(i + 1) == "str" else None
        if spec is None:
            return i
        if star:
            bring(spec, "namespace", star, "*")  # what stands beside it is not recorded
            return i + 2
        if default:
            bring(spec, "type-default" if typed else "default", default, "default")
        for name, alias, one in listed:
            bring(spec, "type-named" if typed or one else "named", alias or name, name)
        return i + 2

    i = 0
    while i < len(t):
        what, v, line, _ = t[i]
        top = not scopes
        if what == "op":
            if v == "{":
                scopes.append(pending)
                pending = None
            elif v == "}" and scopes:
                scopes.pop()
            elif v == "(":
                parens += 1
            elif v == ")":
                parens -= 1
        elif what == "id" and val(i - 1) != ".":
            if v == "import" and top and val(i + 1) not in ("(", "."):
                i = imports(i + 1)
                continue
            if v == "export" and top:
                j = i + 1
                if val(j) == "type" and val(j + 1) in ("{", "*"):
                    j += 1
                    while j < len(t) and val(j) != ";" and not (val(j) == "from" and kind(j + 1) == "str"):
                        j += 1
                    i = j + 2
                    continue
                if val(j) == "*":
                    alias = val(j + 2) if val(j + 1) == "as" else None
                    j += 3 if alias else 1
                    if val(j) == "from":
                        export(alias or "*", None, val(j + 1)[1:-1], "namespace" if alias else "star")
                    i = j + 2
                    continue
                if val(j) == "{":
                    listed, j = names(j + 1)
                    spec = val(j + 1)[1:-1] if val(j) == "from" else None
                    for name, alias, typed in listed:
                        if not typed:
                            export(name, alias, spec, "clause")
                    i = j + 2 if spec else j
                    continue
                if val(j) == "default":
                    k = j + 1 + (val(j + 1) == "async")
                    named = val(k + 1 + (val(k + 1) == "*")) if val(k) in ("function", "class") else val(k) if kind(k) == "id" and val(k + 1) in (";", "", "\n") or kind(k) == "id" and kind(k + 1) == "id" else None
                    named = named if named and re.match(r"[A-Za-z_$]", named) and named not in ("extends",) else None
                    out["default_symbol"] = named or "default"
                    if not named:
                        symbol("default", "default", 1)
                    export(named or "default", "default", None, "default")
                    i = j + 1
                    continue
                k = j + (val(j) in ("async", "abstract", "declare"))
                if val(k) in ("function", "class", "const", "let", "var", "enum"):
                    name = val(k + 1 + (val(k + 1) == "*"))
                    if kind(k + 1 + (val(k + 1) == "*")) == "id":
                        export(name, None, None, "declaration")
            elif v == "function" and (kind(i + 1) == "id" or val(i + 1) == "*" and kind(i + 2) == "id"):
                at = i + 1 + (val(i + 1) == "*")
                symbol(val(at), "function", line, i - (val(i - 1) == "async"))
                i = at + 1
                continue
            elif v == "class" and kind(i + 1) == "id" and val(i + 1) not in ("extends", "implements"):
                symbol(val(i + 1), "class", line, i)
                pending, i = val(i + 1), i + 2
                continue
            elif v in ("const", "let", "var") and kind(i + 1) == "id":
                declared.add(val(i + 1))
                j = i + 2
                while j < len(t) and val(j) not in ("=", ";", ",", ")", "of", "in"):
                    j += 1
                if val(j) == "=":
                    k = j + 1 + (val(j + 1) == "async")
                    arrow = kind(k) == "id" and val(k + 1) == "=>"
                    if val(k) == "(":
                        depth, m = 1, k + 1
                        while m < len(t) and depth:
                            depth += (val(m) == "(") - (val(m) == ")")
                            m += 1
                        arrow = val(m) == "=>" or val(m) == ":" and "=>" in [x[1] for x in t[m : m + 12]]
                    if arrow or val(k) in ("function", "class"):
                        symbol(val(i + 1), "variable", line, i + 1, False)
                        if val(k) == "class":
                            pending = val(i + 1)
            elif val(i + 1) == "(" and scopes and scopes[-1] and parens == 0 and v not in _NO_CALL and val(i - 1) in ("{", "}", ";", "async", "static", "get", "set", "public", "private", "protected", "*", "override"):
                symbol(v, "method", line, i)
                i += 1
                continue
        if what == "id" and val(i + 1) == "(" and v not in _NO_CALL:
            j, chain = i, [v]
            while val(j - 1) in (".", "?.") and kind(j - 2) == "id":
                j -= 2
                chain.append(val(j))
            member = val(j - 1) in (".", "?.") or len(chain) > 1
            out["calls"].append({"callee": ".".join(reversed(chain)), "is_member": member, "line": line, "pos": next(place)})
        i += 1
    name = out["default_symbol"]
    if name not in (None, "default") and name not in declared:
        if name in brought:  # a default that is only passed on
            spec, imported = brought[name]
            out["exports"].append({"symbol": imported, "alias": "default", "specifier": spec, "kind": "clause", "pos": next(place)})
        out["default_symbol"], out["error"] = None, f"unresolved default export: {name}"
    return out


# ---- Python ------------------------------------------------------------------------------------------------------


def _parsed(text: str) -> tuple[list[ast.AST], str | None]:
    """The parts of a module that can be parsed, lines as in the whole, and what is wrong with the others.

    A text that doesn't parse as a whole is cut where a line begins at the margin, and only such parts as fail are lost.
    """
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            return [ast.parse(text)], None
        except (SyntaxError, ValueError, RecursionError) as e:
            said = f"{type(e).__name__}: {e}"
        lines = text.replace("\0", " ").split("\n")
        begins = [i for i, x in enumerate(lines) if re.match(r"[^\s#)\]}]", x) and not re.match(r"(else|elif|except|finally)\b", x) and not (i and lines[i - 1].startswith("@"))]
        found = []
        for a, b in zip(begins, [*begins[1:], len(lines)], strict=True):
            try:
                part = ast.parse("\n".join(lines[a:b]))
            except (SyntaxError, ValueError, RecursionError):
                continue
            found.append(ast.increment_lineno(part, a))
    return found, said


def extract_python(text: str) -> Result:
    out, place = empty(), iter(range(1 << 30))
    lines = text.splitlines(keepends=True)

    def source(x: ast.AST) -> str:
        """The text of a definition, without its decorators."""
        cut = lines[x.lineno - 1 : x.end_lineno]
        last = len(cut[-1].encode()[: x.end_col_offset].decode(errors="ignore"))
        cut[-1] = cut[-1][:last]
        return "".join(cut)[len(lines[x.lineno - 1].encode()[: x.col_offset].decode(errors="ignore")) :]

    def visit(node: ast.AST, owner: tuple[str, ...]) -> None:
        for x in ast.iter_child_nodes(node):
            inner = owner
            if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                kind = "class" if isinstance(x, ast.ClassDef) else "function"
                out["symbols"].append({"name": ".".join([*owner, x.name]), "kind": kind, "line": x.lineno, "pos": next(place), "content_hash": text_hash(source(x))})
                inner = (*owner, x.name) if kind == "class" else owner
            elif isinstance(x, ast.Import):
                for a in x.names:
                    out["imports"].append({"specifier": a.name, "kind": "namespace", "local": a.asname or a.name.split(".")[0], "imported": "*", "pos": next(place)})
            elif isinstance(x, ast.ImportFrom):
                for a in x.names:
                    star = a.name == "*"
                    out["imports"].append({"specifier": "." * x.level + (x.module or "").replace(".", "/"), "kind": "side-effect" if star else "named", "local": None if star else a.asname or a.name, "imported": None if star else a.name, "pos": next(place)})
            elif isinstance(x, ast.Call):
                name = ast.unparse(x.func)
                if re.fullmatch(r"[\w.]+", name):
                    out["calls"].append({"callee": name, "is_member": "." in name, "line": x.lineno, "pos": next(place)})
            visit(x, inner)

    parts, out["error"] = _parsed(text)
    for part in parts:
        visit(part, ())
    return out


# ---- other languages ---------------------------------------------------------------------------------------------

# Declarations by language.
_DECLARED = {
    ".go": r"^func\s+(?:\([^)]*\)\s*)?(?P<function>\w+)|^type\s+(?P<class>\w+)\s+(?:struct|interface)",
    ".rs": r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:(?:async|const|unsafe|extern)\s+)*fn\s+(?P<function>\w+)|^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum|trait)\s+(?P<class>\w+)",
    ".java": r"^\s*(?:(?:public|private|protected|static|final|abstract)\s+)*(?:class|interface|enum|record)\s+(?P<class>\w+)|^\s+(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)+[\w<>\[\], ?]+\s+(?P<function>\w+)\s*\(",
    ".c": r"^(?:[A-Za-z_][\w*]*\s+)+\**(?P<function>\w+)\s*\([^;\n]*$|^(?:typedef\s+)?struct\s+(?P<class>\w+)",
}
_DECLARED |= {".cpp": _DECLARED[".c"] + r"|^\s*class\s+(?P<klass>\w+)", ".h": _DECLARED[".c"] + r"|^\s*class\s+(?P<klass>\w+)"}


_EDGES = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|[{};]", re.S)


def _block(text: str, start: int) -> str:
    """A declaration's text: to the end of its braces, or to a semicolon where that comes first."""
    depth = 0
    for m in _EDGES.finditer(text, start):
        if len(m[0]) > 1:
            continue
        depth += (m[0] == "{") - (m[0] == "}")
        if depth <= 0 and m[0] in "};":
            return text[start : m.end()].strip()
    return text[start:].strip()


def pattern_extractor(pattern: str) -> Callable[[str], Result]:
    compiled = re.compile(pattern, re.M)

    def extract(text: str) -> Result:
        out = empty()
        for n, m in enumerate(compiled.finditer(re.sub(r"/\*.*?\*/", lambda c: re.sub(r"[^\n]", " ", c[0]), text, flags=re.S))):
            kind = "function" if m.lastgroup == "function" else "class"
            out["symbols"].append({"name": m[m.lastgroup], "kind": kind, "line": text.count("\n", 0, m.start(m.lastgroup)) + 1, "pos": n, "content_hash": text_hash(_block(text, m.start()))})
        return out

    return extract


for _e in (".ts", ".tsx", ".js", ".jsx"):
    register(_e, extract_script)
register(".py", extract_python)
for _e, _p in _DECLARED.items():
    register(_e, pattern_extractor(_p))


def extract_file(path: str, text: str, known: dict[str, Callable[[str], Result]] | None = None) -> dict:
    """One file's result; an unknown language gives nothing, a text that can't be parsed an error."""
    base = empty() | {"source_file": path, "error": None}
    extract = (EXTRACTORS if known is None else known).get("." + path.rsplit(".", 1)[-1])
    if extract is None:
        return base
    try:
        return base | extract(text)
    except (ValueError, RecursionError) as e:
        return base | {"error": f"{type(e).__name__}: {e}"}


def extract(files: DataFrame) -> DataFrame:
    """(source_file, text) to SCHEMA, file by file, results in batches of bounded size. Null texts count as empty.

    The extractors registered by now travel with the job, so workers know them too.
    """
    known = dict(EXTRACTORS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, chars = [], 0
            for path, text in zip(*batch.columns, strict=True):
                path, text = path.as_py(), text.as_py() or ""
                rows.append(extract_file(path or "", text, known) | {"source_file": path})
                chars += len(text)
                if len(rows) == BATCH or chars > CHARS:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)
                    rows, chars = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, ARROW)

    return files.select("source_file", "text").mapInArrow(work, SCHEMA)
