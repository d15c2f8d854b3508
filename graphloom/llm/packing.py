"""Best-fit packing in bulk-synchronous supersteps.

Documents are tokenised, cut into pieces and range-sorted by length over the cluster; a piece's rank is its place in
that order. Pieces of one length are alike, and so are sequences with one gap, so both sides are held as runs: the
counts of at most `capacity` lengths, and runs of consecutive sequences with equal gaps. A superstep takes the longest
length left and sweeps over the gaps from its successor on: each run takes as many of the pieces as fit, conflicts
within a length are resolved by rank, gaps are updated, and what finds no gap opens new sequences. The sweep's intervals
of ranks then place all pieces in parallel.
"""

from __future__ import annotations

import bisect
import functools
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept_columns, map_texts, settle, with_global_rank

#: Bytes that a Python worker keeps of chunks from task to task, twice at most, what each takes besides its letters and
#: ids, and the longest that is kept.
REMEMBERED, ENTRY, CHUNK = 45_000_000, 200, 64
#: Intervals that one broadcast holds at most (48 bytes each).
INTERVALS = 1_000_000


class Interval(NamedTuple):
    """Pieces of ranks from `rank` on: `each` of them in every sequence from `sequence` on, the first at `offset`."""

    rank: int
    count: int
    each: int
    sequence: int
    offset: int
    length: int


def sweep(counts: dict[int, int], capacity: int) -> list[Interval]:
    """Where best-fit by decreasing length puts counts[length] pieces of each length, ranked from the longest on."""
    out: list[Interval] = []
    gaps: list[int] = []  # gap sizes that have runs, ascending
    runs: dict[int, list[tuple[int, int]]] = {}  # gap: (first sequence, how many)
    rank = opened = 0

    def add(gap: int, first: int, many: int) -> None:
        if many and gap:
            if gap not in runs:
                bisect.insort(gaps, gap)
                runs[gap] = []
            runs[gap].append((first, many))

    def fill(gap: int, first: int, many: int, length: int, left: int) -> int:
        """Fills sequences of one gap with as many pieces as fit, by rank; returns how many are left."""
        nonlocal rank
        each = gap // length
        whole = min(many, left // each)
        over = min(left - whole * each, each) if whole < many else 0
        taken = whole * each + over
        if taken:
            out.append(Interval(rank, taken, each, first, capacity - gap, length))
        rank += taken
        add(gap - each * length, first, whole)
        if over:
            add(gap - over * length, first + whole, 1)
        add(gap, first + whole + bool(over), many - whole - bool(over))
        return left - taken

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left and (at := bisect.bisect_left(gaps, length)) < len(gaps):
            gap = gaps[at]
            first, many = runs[gap].pop()
            if not runs[gap]:
                del runs[gap], gaps[at]
            left = fill(gap, first, many, length, left)
        if left:
            many = -(-left // (capacity // length))
            opened, first = opened + many, opened
            fill(capacity, first, many, length, left)
    return out


class Tokenizer:
    """Ids as little-endian 32-bit bytes.

    The tokenizer parts texts at blanks and between letters and marks, so what stands between blanks is tokenised once
    and remembered: what was asked for lately stays, the rest goes when the bound is reached. Capitals and a mark after a word are told apart from it beforehand where that can't
    change a token: not beside combining marks, which compose with some small letters only, or special tokens.
    """

    BETWEEN = "\x1e"  # a token of its own, between chunks that are tokenised at once
    COMBINING = re.compile("[\u0300-\u036f]")
    MARK = re.compile(rb"(?<=[a-z])[.,](?=\s)")

    def __init__(self, file: str):
        from tokenizers import Tokenizer as Read

        self.read = Read.from_file(file)
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}  # what was known when the bound was last reached
        self.held = 0
        (self.between,) = self._ids(self.BETWEEN)

    def _ids(self, text: str) -> list[int]:
        return self.read.encode(text, add_special_tokens=False).ids

    def chunks(self, text: str) -> list[bytes]:
        raw = text.encode()
        if "<|" not in text and (text.isascii() or not self.COMBINING.search(text)):
            raw = self.MARK.sub(rb" \g<0>", raw.lower())
        return raw.split()

    def learn(self, new: list[bytes]) -> None:
        odd, sign = [w for w in new if self.BETWEEN.encode() in w], f" {self.BETWEEN} ".encode()
        for w in odd:
            self.known[w] = np.array(self._ids(w.decode()), dtype="<u4").tobytes()
        new = [w for w in new if w not in self.known]
        for at in range(0, len(new), 2048):
            part = new[at : at + 2048]
            ids = np.array(self._ids(sign.join(part).decode()), dtype="<u4")
            cuts = np.flatnonzero(ids == self.between)
            raw, ends = ids.tobytes(), [*(4 * cuts).tolist(), 4 * len(ids)]
            for w, lo, hi in zip(part, [0, *(4 * cuts + 4).tolist()], ends, strict=True):
                self.known[w] = raw[lo:hi]

    def encode(self, texts: list[str]) -> list[bytes]:
        known, before, split = self.known, self.before, [self.chunks(t) for t in texts]
        new = {w for words in split for w in words if w not in known}
        found = {w: before[w] for w in new if w in before}
        known |= found
        self.learn([w for w in new if w not in found])
        out = [b"".join(map(known.__getitem__, words)) for words in split]
        for w in new:
            if len(w) > CHUNK:
                del known[w]
            else:
                self.held += len(w) + len(known[w]) + ENTRY
        if self.held > REMEMBERED:
            self.before, self.known, self.held = known, {}, 0
        return out


@functools.lru_cache(maxsize=1)
def load_tokenizer(file: str) -> Tokenizer:
    """One for each worker process, which serves many tasks."""
    return Tokenizer(file)


def tokenized_pieces(df: DataFrame, tokenizer_file: str, capacity: int = 2048, text: str = "text", keep: list[str] | None = None, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """The kept columns with _piece, _start, _length, _ids_crc32 (and _ids, as little-endian bytes, if asked for).

    A document is its ids and end_id; only longer ones than the capacity are cut, into pieces of the capacity and a
    rest. Null counts as empty: one piece of end_id. The tokenizer must drop blanks, as word_bpe_49k does, since texts
    are tokenised between blanks.
    """
    kept = kept_columns(df, keep if keep is not None else [c for c in df.columns if c != text], "_piece", "_start", "_length", "_ids_crc32", "_ids")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, last, size = load_tokenizer(tokenizer_file), np.array([end_id], dtype="<u4").tobytes(), 4 * capacity
        for part in batches:
            rows, cols = [], []
            for i, ids in enumerate(tokenizer.encode([x or "" for x in part.column(part.num_columns - 1).to_pylist()])):
                ids += last
                for k in range(0, len(ids), size):
                    piece = ids[k : k + size]
                    rows.append(i)
                    cols.append((k // size, k // 4, len(piece) // 4, zlib.crc32(piece), piece))
            made = [pa.array(c, t) for c, t in zip(zip(*cols, strict=True), kinds, strict=False)]
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows)) for c in part.columns[:-1]), *made], names=[*part.schema.names[:-1], *names])

    names = ["_piece", "_start", "_length", "_ids_crc32"] + ["_ids"] * with_ids
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
    return map_texts(df, text, kept, work, "_piece int, _start long, _length long, _ids_crc32 long" + ", _ids binary" * with_ids)


def best_fit(pieces: DataFrame, capacity: int = 2048, length: str = "_length", order: tuple[str, ...] = ()) -> DataFrame:
    """pieces (narrow rows, lengths from 1 to the capacity) with _sequence and _offset, its place there.

    Lengths are sorted descending, ties by the order given, then as read: equal rows get places of their own. Offsets
    of a sequence leave no gap. An empty table gives no rows. What goes to the driver is a count for each length.
    """
    spark = pieces.sparkSession
    pieces = settle(pieces.drop("_sequence", "_offset", "_rank"))
    counts = {r[0]: r[1] for r in pieces.groupBy(length).count().collect()}
    if any(n is None or not 0 < n <= capacity for n in counts):
        raise ValueError("a length is not between 1 and the capacity")
    ranked, _ = with_global_rank(pieces, [F.col(length).desc(), *[F.col(c) for c in order]], "_rank")
    placed = np.array(sweep(counts, capacity), dtype=np.int64).reshape(-1, 6)
    names = ranked.columns
    schema = T.StructType([*ranked.schema.fields, *T.StructType.fromDDL("_sequence long, _offset long").fields])

    def place(part: np.ndarray, rows: DataFrame) -> DataFrame:
        table = spark.sparkContext.broadcast(part)

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rank, _, each, sequence, offset, size = table.value.T
            for batch in batches:
                r = batch.column(batch.schema.get_field_index("_rank")).to_numpy()
                at = np.searchsorted(rank, r, side="right") - 1
                nth = r - rank[at]
                made = [pa.array(sequence[at] + nth // each[at]), pa.array(offset[at] + nth % each[at] * size[at])]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*names, "_sequence", "_offset"])

        return rows.mapInArrow(work, schema)

    if len(placed) <= INTERVALS:
        return place(placed, ranked).drop("_rank")
    out = None  # beyond the bound, slices of ranks are placed one by one
    for at in range(0, len(placed), INTERVALS):
        part = placed[at : at + INTERVALS]
        some = place(part, ranked.where(F.col("_rank").between(int(part[0, 0]), int(part[-1, 0] + part[-1, 1] - 1))))
        out = some if out is None else out.unionByName(some)
    return out.drop("_rank")
