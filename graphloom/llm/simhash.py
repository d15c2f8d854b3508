"""SimHash near-duplicates by BK-trees.

Fingerprints that differ in at most `radius` of 64 bits agree in all bits of some blocks, so each distinct fingerprint
goes to one shard for each choice of blocks. A shard keeps a BK-tree (children keyed by their Hamming distance to the
parent); each fingerprint follows only edges within the radius of its own distance and is then added. A shard emits
links that span its groups, never all pairs, and the links' components are found by rounds of star contraction.
Shards above a bound never meet in one task: their fingerprints are linked where their balls of half the radius meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import drop_folder, settle, shared_folder, written
from .common import kept_columns, map_texts, release

SEED, WIDTH = 42, 4
SLICE = 1 << 16
#: Fingerprints that a shard should hold on average: more of them, and shards are told apart by more bits.
SHARD = 8
#: Fingerprints that one task may hold as a tree; fuller shards are linked by midpoints.
FULL = 1 << 14
#: Links that are contracted in one task.
LINKS = 1 << 17
#: Nodes after which a task that contracts links gives what it has.
HELD = 1 << 19
#: Copies of a component's least key, among which its fingerprints are dealt.
COPIES = 64


def simhash(text: str | None, width: int = WIDTH) -> int:
    """64-bit fingerprint of the word shingles of a text, repeats included; 0 if it has no words."""
    import xxhash

    words = (text or "").encode().lower().split()  # both by ASCII alone: A-Z, and the blanks 20, 09-0D
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(words) - width + 1)
    lo, hi = starts[:n].tolist(), (ends[min(width, len(words)) - 1 :] - 1).tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, n, SLICE):
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(lo[at : at + SLICE], hi[at : at + SLICE], strict=True)), dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", keep: list[str] | None = None, width: int = WIDTH) -> DataFrame:
    """The kept columns with _fp, the fingerprint of the whole text as a signed long. Null counts as empty."""
    kept = kept_columns(df, keep if keep is not None else [c for c in df.columns if c != text], "_fp")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([simhash(x.as_py(), width) for x in batch.column(batch.num_columns - 1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found.view(np.int64))], names=[*batch.schema.names[:-1], "_fp"])

    return map_texts(df, text, kept, work, "_fp long")


class BKTree:
    """Integers by Hamming distance, with the groups that distances within the radius connect."""

    def __init__(self, radius: int):
        self.radius = radius
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> list[int]:
        """Adds the value. Returns indexes of members within the radius, at least one for each group that has any.

        A member within the radius of the value speaks for the subtrees that hang at most the radius from it: all their
        values are linked to it already, so they are not visited.
        """
        found: list[int] = []
        values, children, r = self.values, self.children, self.radius
        if not values:
            values.append(value)
            children.append({})
            return found
        stack = [0]
        while stack:
            at = stack.pop()
            d = (values[at] ^ value).bit_count()
            lowest = d - r
            if d <= r:
                found.append(at)
                lowest = r + 1
            for key, child in children[at].items():
                if lowest <= key <= d + r:
                    stack.append(child)
        at = 0
        while True:
            d = (values[at] ^ value).bit_count()
            if d not in children[at]:
                children[at][d] = len(values)
                break
            at = children[at][d]
        values.append(value)
        children.append({})
        return found


def spanning_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links within the radius that connect what all such links would connect; fewer than there are values."""
    tree, top, out = BKTree(radius), list(range(len(values))), []

    def root(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for i, v in enumerate(values):
        for j in tree.add(v):
            a, b = root(i), root(j)
            if a != b:
                top[max(a, b)] = min(a, b)
                out.append((v, values[j]))
    return out


def block_masks(radius: int, count: int) -> list[int]:
    """Masks of block choices: two fingerprints within the radius agree under one of them at least.

    b blocks leave b - radius that agree. More blocks, and so more bits in a choice, are taken the more fingerprints
    there are; all give the same links.
    """
    for b in range(radius + 1, 2 * radius + 5):
        edges = [64 * k // b for k in range(b + 1)]
        blocks = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:], strict=False)]
        if count <= SHARD << (64 * (b - radius) // b):
            break
    return [sum(c) for c in combinations(blocks, b - radius)]


def midpoint_links(prints: DataFrame, radius: int, fp: str = "fp") -> DataFrame:
    """Links (u, v), u > v, that connect what all links within the radius would connect, however dense the fingerprints.

    Two fingerprints are within the radius if and only if some point is within its half (rounded down) of the one and
    the rest of it of the other. Each names all such points; those that meet at a point are linked to the smallest of
    the near half. A point has no more fingerprints than a ball has points, so no group grows with the table.
    """
    half = radius // 2
    flips = [(sum(1 << b for b in c), k <= half) for k in range(radius - half + 1) for c in combinations(range(64), k)]
    patterns, near = np.array([f for f, _ in flips], dtype=np.uint64), np.array([n for _, n in flips])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            step = max(1, (1 << 18) // len(patterns))
            for at in range(0, len(own), step):
                part = own[at : at + step]
                points = (part[:, None] ^ patterns[None, :]).ravel().view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(points), pa.array(np.repeat(part, len(patterns)).view(np.int64)), pa.array(np.tile(near, len(part)))], names=["point", "fp", "near"])

    points = prints.select(fp).mapInArrow(work, "point long, fp long, near boolean")
    met = points.groupBy("point").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("v"), F.collect_set("fp").alias("all")).where("v IS NOT NULL AND size(all) > 1")
    pairs = met.select(F.explode("all").alias("u"), "v").where("u <> v")
    return pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def near_links(distinct: DataFrame, radius: int, count: int, fp: str = "_fp", full: int = FULL) -> DataFrame:
    """Links (u, v), u > v, between distinct fingerprints within the radius that span their groups."""
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in block_masks(radius, count)]
    shards = F.array(*[F.struct(F.lit(i).cast("int").alias("choice"), F.col(fp).bitwiseAND(F.lit(m).cast("long")).alias("bits")) for i, m in enumerate(signed)])
    rows = distinct.select(fp, F.explode(shards).alias("s")).select("s.choice", "s.bits", F.col(fp).alias("fp"))
    if count <= full:
        return tree_links(rows, radius)
    over = settle(rows.groupBy("choice", "bits").count().where(F.col("count") > full).select("choice", "bits"))
    if over.isEmpty():
        return tree_links(rows, radius)
    dense = rows.join(over, ["choice", "bits"], "left_semi").select("fp").distinct()
    return tree_links(rows.join(over, ["choice", "bits"], "left_anti"), radius).union(midpoint_links(dense, radius)).distinct()


def tree_links(rows: DataFrame, radius: int) -> DataFrame:
    """Links (u, v), u > v, within the shards of rows (choice, bits, fp), each by its own tree in one task."""
    rows = rows.repartition("choice", "bits").sortWithinPartitions("choice", "bits", "fp")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # what the last shard of former batches has so far
        last = None
        links: list[tuple[int, int]] = []

        def close() -> None:
            shard = np.concatenate(held) if held else np.empty(0, np.int64)
            if len(shard) > 1:
                links.extend(spanning_links(shard.view(np.uint64).tolist(), radius))

        def give() -> pa.RecordBatch:
            pairs = np.array(links, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            links.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs.max(axis=1)), pa.array(pairs.min(axis=1))], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            choice, bits, fps = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            cuts = np.flatnonzero((choice[1:] != choice[:-1]) | (bits[1:] != bits[:-1])) + 1
            starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(fps)]))
            for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True):
                key = (choice[lo], bits[lo])
                if key != last:
                    close()
                    held, last = [], key
                held.append(fps[lo:hi])
            if len(links) > 100_000:
                yield give()
        close()
        yield give()

    return rows.mapInArrow(work, "u long, v long").distinct()


def contracted(links: DataFrame, parts: int, held: int = HELD) -> DataFrame:
    """Links (u, v), u > v, that connect the same nodes: in each of so many partitions every node goes to its smallest one there.

    A task that has more than `held` nodes gives what it has and begins anew.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[int, int] = {}

        def root(i: int) -> int:
            at = i
            while (up := top.setdefault(at, at)) != at:
                at = up
            while top[i] != at:
                top[i], i = at, top[i]
            return at

        def give() -> pa.RecordBatch:
            pairs = [(x, r) for x in list(top) if (r := root(x)) != x]
            top.clear()
            made = np.array(pairs, dtype=np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(made[:, 0]), pa.array(made[:, 1])], names=["u", "v"])

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(u), root(v)
                if a != b:
                    top[max(a, b)] = min(a, b)
            if len(top) > held:
                yield give()
        yield give()

    return links.select("u", "v").coalesce(parts).mapInArrow(work, "u long, v long")


def components(links: DataFrame, most: int = LINKS) -> DataFrame:
    """(node, root) of every node of the links (u, v), u > v: root is the smallest node that can be reached.

    Links are contracted within partitions of about `most`; if there are more partitions than one, rounds of large and
    small stars follow until nothing changes. Each round is written to the shared folder and the one before deleted.
    Nothing but a count and a checksum goes to the driver.
    """
    spark = links.sparkSession
    folder = shared_folder(spark, "components")
    raw = written(links, f"{folder}/links")
    parts = 1 + raw.count() // most
    edges, before, turn = written(contracted(raw, parts), f"{folder}/0"), None, 0
    while parts > 1:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Edges never grow by much from round to round.
        edges = written(small.union(least.select("u", F.col("m").alias("v"))).distinct().coalesce(parts), f"{folder}/{turn + 1}")
        drop_folder(spark, f"{folder}/{turn}")
        turn += 1
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    out = settle(edges.toDF("node", "root"))
    drop_folder(spark, folder)
    release(spark)
    return out


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", radius: int = 4, width: int = WIDTH) -> DataFrame:
    """(key, _fp, _component): the smallest key that links of at most `radius` differing bits reach, itself included.

    Equal texts have equal fingerprints, which are linked as one before anything is compared. Texts without words have
    fingerprint zero, which is linked like any other. Null texts count as empty, null keys are never the smallest (a
    component of null keys only has null); repeated rows each get a row; an empty table gives none.
    """
    prints = settle(fingerprints(df, text, [key], width))
    distinct = settle(prints.groupBy("_fp").agg(F.min(key).alias("least")))
    roots = components(near_links(distinct, radius, distinct.count()))
    roots = settle(distinct.join(roots, distinct["_fp"] == roots["node"], "left").select("_fp", "least", "root"))
    # Most fingerprints are alone. Of the others the least key of each root goes out in COPIES, which a frequent root's rows are dealt to.
    below, tops = roots.where("root IS NOT NULL"), roots.where("root IS NULL").select("_fp", "least")
    named = below.groupBy(F.col("root").alias("_root")).agg(F.min("least").alias("_low"))
    tops = settle(tops.join(named, F.col("_fp") == F.col("_root"), "left").select(F.col("_fp").alias("_own"), F.least("least", "_low").alias("_component"), F.col("_root").isNotNull().alias("_heads")))
    heads = tops.where("_heads").select(F.col("_own").alias("_root"), "_component", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))).alias("_copy"))
    below = below.withColumn("copy", F.pmod(F.xxhash64("_fp"), F.lit(COPIES)).cast("int"))
    below = below.join(heads, (F.col("root") == F.col("_root")) & (F.col("copy") == F.col("_copy"))).select(F.col("_fp").alias("_own"), "_component")
    named = below.union(tops.select("_own", "_component"))
    return prints.join(named, prints["_fp"] == named["_own"]).select(key, "_fp", "_component")
