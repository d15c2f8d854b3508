"""Merkle manifest of a data set: leaves, proofs and roots of ternary trees.

Rows of a group form a tree, groups' roots another. A tree is cut into aligned blocks of ARITY ** HEIGHT leaves, each walked in
one task; blocks' roots are leaves of the next round, so rounds are logarithmic in the rows. Within a block a traversal
schedules treehash stacks that advance the authentication path leaf by leaf; what lies above the block is shared by all
its leaves and appended.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import placed, settle, with_global_rank

#: Children of a node, and levels of a block: 2187 leaves.
ARITY, HEIGHT = 3, 7
#: Proofs that a task gives at once.
GIVEN = 512

PROOF = "array<struct<position:int,siblings:array<string>>>"


def joined(digests: list[str]) -> str:
    """H of digests as hex text."""
    return sha256("".join(digests).encode()).hexdigest()


def encoded(value: Column) -> Column:
    """`-` for null, else the value's UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]).cast("binary"), 256)


class Treehash:
    """A stack that makes the nodes of one level over a range of leaves, a leaf at a time."""

    def __init__(self, level: int, start: int, stop: int, seen: Callable[[int, str], None] | None = None):
        self.level, self.at, self.stop, self.seen = level, start, max(start, stop), seen
        self.stack: list[tuple[int, str]] = []

    @property
    def low(self) -> int:
        """The lowest node it holds; it is served before stacks with higher ones."""
        return self.stack[-1][0] if self.stack else self.level

    def _push(self, level: int, digest: str) -> None:
        self.stack.append((level, digest))
        if self.seen:
            self.seen(level, digest)

    def _merge(self, level: int) -> None:
        run = []
        while self.stack and self.stack[-1][0] == level:
            run.append(self.stack.pop()[1])
        if run:
            self._push(level + 1, joined(run[::-1]))

    def feed(self, leaf: str) -> None:
        self._push(0, leaf)
        self.at += 1
        n, level = self.at, 0
        while level < self.level and n % ARITY == 0:
            self._merge(level)
            n, level = n // ARITY, level + 1
        if self.at == self.stop:  # the last runs may be short
            for level in range(self.level):
                self._merge(level)


class Traversal:
    """Authentication paths of leaves 0, 1, ... of one tree, each from the one before, as advance() goes on.

    Of each level it holds the run that the path is in, and a stack that makes the next one; each step feeds as many leaves as
    there are levels, always to the stack whose lowest node is lowest. So it holds a number of nodes that grows with
    the tree's height; `widest` is the most it held.
    """

    def __init__(self, leaves: list[str], height: int):
        self.leaves, self.height, self.index = leaves, height, 0
        self.runs: list[list[str]] = [[] for _ in range(height)]
        made = Treehash(height, 0, len(leaves), self._first)
        for leaf in leaves:
            made.feed(leaf)
        self.root = made.stack[-1][1]
        self.stacks = [self._stack(level, ARITY ** (level + 1)) for level in range(height)]
        self.widest = 0

    def _first(self, level: int, digest: str) -> None:
        if level < self.height and len(self.runs[level]) < ARITY:
            self.runs[level].append(digest)

    def _stack(self, level: int, start: int) -> Treehash:
        return Treehash(level, start, min(start + ARITY ** (level + 1), len(self.leaves)))

    def _feed(self, stack: Treehash) -> None:
        stack.feed(self.leaves[stack.at])

    def path(self) -> list[tuple[int, list[str]]]:
        """Of each level, upwards: the node's position in its run, and the run's other nodes."""
        out, n = [], self.index
        for run in self.runs:
            at = n % ARITY
            out.append((at, run[:at] + run[at + 1 :]))
            n //= ARITY
        return out

    def advance(self) -> None:
        self.index += 1
        if self.index >= len(self.leaves):
            return
        for level in range(self.height):
            if self.index % ARITY ** (level + 1):
                break
            stack = self.stacks[level]
            while stack.at < stack.stop:
                self._feed(stack)
            self.runs[level] = [digest for _, digest in stack.stack]
            self.stacks[level] = self._stack(level, self.index + ARITY ** (level + 1))
        for _ in range(self.height):
            open_ = [s for s in self.stacks if s.at < s.stop]
            if not open_:
                break
            self._feed(min(open_, key=lambda s: (s.low, s.level)))
        self.widest = max(self.widest, sum(len(s.stack) for s in self.stacks) + sum(map(len, self.runs)))


def height_of(block: int, count: int, full: int) -> int:
    """A block that is not the only one of its tree is as high as a full one; a lone one ends where one node remains."""
    if block:
        return full
    height = 0
    while ARITY**height < count:
        height += 1
    return height


def _by_block(rows: DataFrame, full: int) -> DataFrame:
    block = F.when(F.col("idx") < 0, -1 - F.col("idx")).otherwise(F.floor(F.col("idx") / F.lit(ARITY**full))).cast("long")
    return rows.withColumn("block", block).repartition("key", "block").sortWithinPartitions("key", "block", "idx")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Table]]:
    """Key, number and rows of each block of sorted rows."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys, numbers, start = batch.column("key").to_pylist(), batch.column("block").to_pylist(), 0
        for i, now in enumerate(zip(keys, numbers, strict=True)):
            if now != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield *last, pa.Table.from_batches(held).combine_chunks()
                held, start, last = [], i, now
        if batch.num_rows > start:
            held.append(batch.slice(start))
    if held:
        yield *last, pa.Table.from_batches(held).combine_chunks()


def block_roots(rows: DataFrame, full: int) -> DataFrame:
    """(key, idx, digest) of each block of the nodes (key, idx, digest): its number and its root."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, block, table in _blocks(batches):
            made = Treehash(height_of(block, table.num_rows, full), 0, table.num_rows)
            for leaf in table["digest"].to_pylist():
                made.feed(leaf)
            yield pa.RecordBatch.from_pydict({"key": [key], "idx": [block], "digest": [made.stack[-1][1]]})

    return _by_block(rows.select("key", "idx", "digest"), full).mapInArrow(work, "key string, idx long, digest string")


def block_proofs(rows: DataFrame, above: DataFrame, full: int) -> DataFrame:
    """rows (key, idx, digest, kept) with proof and top. above: key, idx, proof and top of each block.

    A block's row comes before its leaves in the sorted partition, so no leaf is shuffled with a proof.
    """
    kept = rows.schema["kept"].dataType
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL(f"proof {PROOF}, top string").fields])
    blank = F.lit(None)
    own = rows.select("key", "idx", "digest", "kept", blank.cast(PROOF).alias("proof"), blank.cast("string").alias("top"))
    heads = above.select("key", (-1 - F.col("idx")).alias("idx"), blank.cast("string").alias("digest"), blank.cast(kept).alias("kept"), "proof", "top")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block, table in _blocks(batches):
            head, table = table.slice(0, 1), table.slice(1)
            upper, top = head["proof"][0].as_py(), head["top"][0].as_py()
            ends = [(x["position"], x["siblings"]) for x in upper]
            walk = Traversal(table["digest"].to_pylist(), height_of(block, table.num_rows, full))
            for start in range(0, table.num_rows, GIVEN):
                part = table.slice(start, GIVEN).combine_chunks()
                rows_, levels, positions, siblings = [0], [0], [], []
                for _ in range(part.num_rows):
                    for position, others in walk.path() + ends:
                        positions.append(position)
                        siblings.extend(others)
                        levels.append(len(siblings))
                    rows_.append(len(positions))
                    walk.advance()
                others = pa.ListArray.from_arrays(pa.array(levels, pa.int32()), pa.array(siblings, pa.string()))
                steps = pa.StructArray.from_arrays([pa.array(positions, pa.int32()), others], names=["position", "siblings"])
                proof = pa.ListArray.from_arrays(pa.array(rows_, pa.int32()), steps)
                columns = [part[x].chunk(0) for x in ("key", "idx", "digest", "kept")]
                yield pa.RecordBatch.from_arrays([*columns, proof, pa.array([top] * part.num_rows, pa.string())], names=["key", "idx", "digest", "kept", "proof", "top"])

    return _by_block(own.unionByName(heads), full).mapInArrow(work, schema)


def _upwards(rows: DataFrame, full: int) -> list[DataFrame]:
    """The nodes, their blocks' roots, the roots of blocks of those, and so on up to one a key."""
    out = [rows]
    while True:
        out.append(settle(block_roots(out[-1], full)))
        if out[-1].where("idx > 0").isEmpty():
            return out


def _downwards(levels: list[DataFrame], above: DataFrame, full: int) -> DataFrame:
    """The proofs of levels[0], from those of levels[-1]."""
    for rows in levels[-2:0:-1]:
        above = block_proofs(rows.withColumn("kept", F.lit(None).cast("string")), above, full)
    return block_proofs(levels[0], above, full)


def merkle_manifest(df: DataFrame, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), keep: list[str] | None = None, height: int = HEIGHT) -> DataFrame:
    """The kept columns with _leaf, _subroot, _root and _proof of each row.

    A leaf is the hash of the fields' encoded values (null: `-`, which no value encodes to). Leaves of a group ascend by
    key, nulls first, and by leaf where keys are equal, so repeated rows each have a leaf and any order of them gives the
    same tree. Groups ascend bytewise, null first and apart from the empty one. _proof has for each level up to
    _root the node's position in its run and the run's other nodes; it is empty for the only row of a table. An empty
    table gives no rows. Kept columns named like the new ones give way to them.
    """
    added = ("_leaf", "_subroot", "_root", "_proof")
    kept = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in (df.columns if keep is None else keep) if c not in added]).alias("kept")
    name = F.coalesce(F.concat(F.lit("1"), F.col(f"`{group}`").cast("string")), F.lit("0"))
    leaves = df.select(name.alias("key"), F.col(f"`{key}`").alias("own"), leaf_hash(*[F.col(f"`{c}`") for c in fields]).alias("digest"), kept)
    leaves = settle(placed(leaves, "key", [F.col("own"), F.col("digest")], "idx").select("key", "idx", "digest", "kept"))
    trees = _upwards(leaves, height)
    tops, _ = with_global_rank(trees[-1].select(F.col("key").alias("kept"), "digest"), [F.col("kept")], "idx")
    tops = settle(tops.select(F.lit("").alias("key"), "idx", "digest", "kept"))
    above = _upwards(tops, height)
    root = above[-1].select("idx", "digest", F.lit("").alias("key"), F.array().cast(PROOF).alias("proof"), F.col("digest").alias("top"))
    groups = _downwards(above, root, height).select(F.col("kept").alias("key"), F.lit(0).cast("long").alias("idx"), "proof", F.struct("digest", "top").alias("roots"))
    # Two roots travel as one string: 64 hex digits each.
    groups = groups.select("key", "idx", "proof", F.concat("roots.digest", "roots.top").alias("top"))
    out = _downwards(trees, settle(groups), height)
    names = [c for c in out.schema["kept"].dataType.names if c != "_"]
    return out.select(*[F.col("kept")[c].alias(c) for c in names], F.col("digest").alias("_leaf"), F.substring("top", 1, 64).alias("_subroot"), F.substring("top", 65, 64).alias("_root"), F.col("proof").alias("_proof"))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""

    def up(digest: Column, step: Column) -> Column:
        left = F.slice(step["siblings"], 1, step["position"])
        right = F.slice(step["siblings"], step["position"] + 1, F.size(step["siblings"]))
        return F.sha2(F.concat(F.array_join(left, ""), digest, F.array_join(right, "")).cast("binary"), 256)

    return F.aggregate(proof, leaf, up)


def proof_hash(proof: Column) -> Column:
    """H of all siblings, upwards and from left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(proof, lambda s: s["siblings"])), "").cast("binary"), 256)
