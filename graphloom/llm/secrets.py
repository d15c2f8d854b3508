"""Secret scans: patterns, and a test of token efficiency.

A string that a subword vocabulary can only spell in very short tokens is random. Long runs of letters, digits and
signs are measured in characters a token, after known digests and identifiers are excluded.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import kept_columns, map_texts

# The base patterns, with the group that counts and its least length, in the order of the report.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
KINDS = [k for k, *_ in BASE] + ["random"]
_BASE = [(k, re.compile(p, re.ASCII), g, n) for k, p, g, n in BASE]
#: Runs that are measured.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,200}(?![A-Za-z0-9+/_=-])|[A-Za-z0-9+/_=-]{201,}")
#: Lengths of hex digests in common use (MD5, SHA-1, SHA-2), which are no secrets.
DIGESTS = (32, 40, 56, 64, 96, 128)
_HEX = re.compile(r"[0-9A-Fa-f]+")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: Parts that case tells apart; digits stay with what they follow.
_CASES = re.compile(r"[A-Z]?[a-z][a-z0-9]*|[A-Z0-9]+(?![a-z])|[A-Z0-9]")
_SIGNS = re.compile(r"[+/_=-]+")
#: Up to four characters again and again.
_FILLER = re.compile(r"(.{1,4}?)\1{4,}.{0,3}")


def known_digest(run: str) -> bool:
    return bool(_HEX.fullmatch(run)) and len(run) in DIGESTS or bool(_UUID.fullmatch(run))


def identifier(run: str, encoding, longest_part: float = 2.5) -> bool:
    """A number, a repeated filler, or a name or path: several parts, told apart by signs or case, of longest_part characters a token on average.

    Parts that are numbers of their own don't count. A run of one part is never an identifier, be it of one case.
    """
    bare = _SIGNS.sub("", run)
    if not bare or bare.isdigit() or _FILLER.fullmatch(run):
        return True
    named = [x for x in _SIGNS.split(run) if x and not x.isdigit()]
    parts = [p for x in named for p in _CASES.findall(x)]
    if len(parts) + sum(x.isdigit() for x in _SIGNS.split(run)) < 2:
        return False
    return sum(map(len, parts)) >= longest_part * sum(len(encoding.encode_ordinary(p)) for p in parts)


@functools.lru_cache(maxsize=1)
def load_encoding(ranks_file: str, pattern: str):
    """A tiktoken encoding from a rank file (a parameter; it is read, never copied), one for each worker process."""
    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def scan(text: str, encoding, most_chars: float = 2.2) -> list[tuple[int, int, int]]:
    """Spans (start, kind, end) in code points, sorted: base matches, and runs of less than most_chars characters a token that no base match covers."""
    found = []
    low = text.lower() if text.isascii() else text.translate(_LOWER)
    for kind, (_, pattern, group, least) in enumerate(_BASE):
        if kind == 0 and not any(x in low for x in ("passw", "secret", "token", "api")) or kind == 1 and "AKIA" not in text:
            continue
        found += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if len(m[group]) >= least]
    base = sorted(found)
    for m in RUN.finditer(text):
        run = m[0]
        if any(s <= m.start() and m.end() <= e for s, _, e in base) or known_digest(run) or identifier(run, encoding):
            continue
        if len(run) / len(encoding.encode_ordinary(run)) < most_chars:
            found.append((m.start(), len(_BASE), m.end()))
    return sorted(found)


_LOWER = {c: c + 32 for c in range(65, 91)}


def scan_secrets(df: DataFrame, ranks_file: str, pattern: str, text: str = "text", keep: list[str] | None = None, most_chars: float = 2.2, redact: bool = False, mark: str = "[SECRET]") -> DataFrame:
    """The kept columns with _spans, an array of (start, end, kind), and _redacted, the text with a mark for each span, if asked for.

    Spans count code points, the end excluded; they are sorted by start, then kind. Overlapping spans get one mark. A
    null text has no spans and stays null. Equal texts get equal spans; an empty table gives no rows.
    """
    kept = kept_columns(df, keep, "_spans", "_redacted")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = load_encoding(ranks_file, pattern)
        for part in batches:
            spans, texts = [], []
            for x in part.column(part.num_columns - 1).to_pylist():
                found = scan(x or "", encoding, most_chars)
                spans.append([{"start": s, "end": e, "kind": KINDS[k]} for s, k, e in found])
                texts.append(x if not redact or not found else redacted(x, found, mark))
            made = [pa.array(spans, kind)] + [pa.array(texts, pa.string())] * redact
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=[*part.schema.names[:-1], "_spans", *["_redacted"] * redact])

    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    return map_texts(df, text, kept, work, "_spans array<struct<start:long,end:long,kind:string>>" + ", _redacted string" * redact)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, at, last = [], 0, -1
    for s, _, e in spans:
        if s >= last:
            out += [text[at:s], mark]
        last = max(last, e)
        at = last
    return "".join([*out, text[at:]])
