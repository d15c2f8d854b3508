"""Louvain over tables, one way at all sizes.

Nodes are dealt to blocks of about BLOCK edge ends. A round moves each block's nodes one after the other, in one task
a block, with what lies outside held still. Blocks are the vertices of a coloured graph: of two adjacent nodes in
different blocks that could both move, only the one whose block has the higher colour of that round may, so links
between blocks are never counted wrongly. Loads of communities and modularity follow by deltas of what moved, and a
later round only looks at nodes of which a neighbour moved. A level ends when no node is left to look at; its
communities are parted into connected ones and folded into the nodes of the next.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.connect import connected
from ..functions.lineage import drop_folder, running, settle, shared_folder, written

#: Edge ends in a block; a node with more has no block, and is moved by an aggregation.
BLOCK = 1 << 17
#: Rounds of a level that may bring nothing before it ends.
IDLE = 3

MOVE = "node long, k double, own long, best long, gained double"


def _block_moves(rows: DataFrame, total: float, resolution: float) -> DataFrame:
    """MOVE rows of the blocks in rows (block, a, k, home, load, held, b, w, home_b, load_b), sorted by block and a."""

    def moved(block: pa.Table) -> list[tuple[int, float, int, int, float]]:
        a, k, home_a, load_a, held, b, w, home_b, load_b = (block[x].to_pylist() for x in ("a", "k", "home", "load", "held", "b", "w", "home_b", "load_b"))
        home, load, degree, still = dict(zip(b, home_b, strict=True)), dict(zip(home_b, load_b, strict=True)), dict(zip(a, k, strict=True)), set()
        home.update(zip(a, home_a, strict=True))
        load.update(zip(home_a, load_a, strict=True))
        near: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for x, y, v, h in zip(a, b, w, held, strict=True):
            near[x].append((y, v))
            if h:
                still.add(x)
        before = dict(home)
        order, gained, again = [x for x in sorted(near) if x not in still], 0.0, True
        while again:
            again = False
            for x in order:
                own, part = home[x], resolution * degree[x] / total
                load[own] -= degree[x]
                link: dict[int, float] = defaultdict(float)
                for y, v in near[x]:
                    link[home[y]] += v
                stay = link.get(own, 0.0) - part * load[own]
                best, most = own, stay + 1e-12
                for c in sorted(link):
                    now = link[c] - part * load[c]
                    if now > most:
                        best, most = c, now
                if best != own:
                    gained += link[best] - link.get(own, 0.0)
                    home[x], again = best, True
                load[best] += degree[x]
        found = [[x, degree[x], before[x], home[x], 0.0] for x in order if home[x] != before[x]]
        if found:
            found[0][4] = gained  # a block's gain in links stands with one of its moves
        return found

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def close() -> pa.RecordBatch:
            found = moved(pa.Table.from_batches(held)) if held else []
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.float64()))], names=["node", "k", "own", "best", "gained"])

        for batch in batches:
            if not batch.num_rows:
                continue
            blocks = batch.column(0).to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(blocks[1:] != blocks[:-1]) + 1, [len(blocks)]))
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if blocks[lo] != last:
                    yield close()
                    held, last = [], blocks[lo]
                held.append(batch.slice(lo, hi - lo))
        yield close()

    return rows.repartition("block").sortWithinPartitions("block", "a").mapInArrow(work, MOVE)


def _hub_moves(rows: DataFrame, total: float, resolution: float) -> DataFrame:
    """MOVE rows of nodes with more edge ends than a block has: their links are summed by community over the cluster."""
    links = rows.groupBy("a", "k", "home", "load", "home_b", "load_b").agg(F.sum("w").alias("w"), F.max("held").alias("held"))
    others = F.col("load_b") - F.when(F.col("home_b") == F.col("home"), F.col("k")).otherwise(0.0)
    links = links.withColumn("gain", F.col("w") - F.lit(resolution / total) * F.col("k") * others)
    inside = F.col("home_b") == F.col("home")
    best = links.groupBy("a", "k", "home", "load").agg(F.max("held").alias("held"), F.min_by(F.struct("home_b", "gain", "w"), F.struct(-F.col("gain"), "home_b")).alias("best"), F.max(F.when(inside, F.col("gain"))).alias("in_gain"), F.max(F.when(inside, F.col("w"))).alias("in_w"))
    stay = F.coalesce("in_gain", -F.lit(resolution / total) * F.col("k") * (F.col("load") - F.col("k")))
    return best.where(~F.col("held") & (F.col("best.gain") > stay + 1e-12) & (F.col("best.home_b") != F.col("home"))).select(F.col("a").alias("node"), "k", F.col("home").alias("own"), F.col("best.home_b").alias("best"), (F.col("best.w") - F.coalesce("in_w", F.lit(0.0))).alias("gained"))


def _level(pairs: DataFrame, total: float, resolution: float, block: int, folder: str) -> DataFrame | None:
    """(node, home) after the rounds of a level over pairs (a, b, weight), longs; None if nothing moved."""
    spark = pairs.sparkSession
    ends = pairs.select("a", "b", F.col("weight").alias("w")).unionByName(pairs.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("weight").alias("w")))
    ends = written(ends, folder)
    own = ends.groupBy("a").agg(F.sum(F.when(F.col("a") == F.col("b"), F.col("w") * 2).otherwise(F.col("w"))).alias("k"), F.count(F.lit(1)).alias("n"))
    placed = running(own, [F.col("a")], F.when(F.col("n") <= block, F.col("n")).otherwise(0), "ends")
    placed = placed.withColumn("hub", F.col("n") > block)
    nodes = written(placed.select(F.col("a").alias("node"), "k", "ends", "hub", F.col("a").alias("home"), F.col("k").alias("load"), F.lit(True).alias("active")), folder)
    ends = ends.where("a <> b")
    moved_ever, idle, turn = False, 0, 0
    while idle < IDLE:
        shift = block // 2 * (turn % 2)
        dealt: Column = F.when(F.col("hub"), -1 - F.col("node")).otherwise(F.floor((F.col("ends") + shift) / block)).cast("long")
        colour = F.xxhash64("block", F.lit(turn))
        now = nodes.withColumn("block", dealt).withColumn("colour", colour)
        here = now.where("active").select(F.col("node").alias("a"), "k", "home", "load", "block", "colour", "hub")
        there = now.select(F.col("node").alias("b"), F.col("home").alias("home_b"), F.col("load").alias("load_b"), F.col("block").alias("block_b"), F.col("colour").alias("colour_b"), F.col("active").alias("active_b"))
        rows = ends.join(here, "a").join(there, "b")
        rows = rows.withColumn("held", F.col("active_b") & (F.col("block") != F.col("block_b")) & (F.struct("colour_b", "block_b") > F.struct("colour", "block")))
        rows = rows.select("block", "a", "k", "home", "load", "held", "b", "w", "home_b", "load_b", "hub")
        moves = written(_block_moves(rows.where("NOT hub").drop("hub"), total, resolution).unionByName(_hub_moves(rows.where("hub"), total, resolution)), folder)
        count, links = moves.agg(F.count(F.lit(1)), F.sum("gained")).first()
        # Nodes that had to hold still are looked at again, and those a neighbour of which, in another block, has left or joined them.
        held = rows.where("held").select(F.col("a").alias("node"))
        if count:
            delta = moves.select(F.col("own").alias("home"), (-F.col("k")).alias("by")).unionByName(moves.select(F.col("best").alias("home"), F.col("k").alias("by"))).groupBy("home").agg(F.sum("by").alias("by"))
            loads = written(now.select("home", "load").distinct().join(delta, "home").select("home", F.col("load").alias("old"), (F.col("load") + F.col("by")).alias("new")), folder)
            squares = loads.agg(F.sum(F.col("new") * F.col("new") - F.col("old") * F.col("old"))).first()[0]
            better = 2 * links / total - resolution * squares / total**2 > 1e-12
            idle = 0 if better else idle + 1
            if better:
                moved_ever = True
                changed = ends.join(moves.select(F.col("node").alias("b"), F.col("best").alias("home_b")), "b").join(now.select(F.col("node").alias("b"), F.col("block").alias("block_b")), "b")
                changed = changed.join(now.select(F.col("node").alias("a"), "home", "block"), "a").where("block <> block_b AND home <> home_b").select(F.col("a").alias("node"))
                held = held.unionByName(changed)
                fresh = now.join(moves.select("node", "best"), "node", "left").withColumn("home", F.coalesce("best", "home"))
                fresh = fresh.join(loads.select("home", "new"), "home", "left").withColumn("load", F.coalesce("new", "load"))
            else:
                fresh = now
                held = held.unionByName(moves.select("node"))
        else:
            fresh = now
        fresh = fresh.drop("active").join(held.distinct().withColumn("active", F.lit(True)), "node", "left")
        nodes = written(fresh.select("node", "k", "ends", "hub", "home", "load", F.coalesce("active", F.lit(False)).alias("active")), folder)
        turn += 1
        if nodes.where("active").isEmpty():
            break
    if not moved_ever:
        return None
    return _parted(nodes.select("node", "home"), ends, folder)


def _parted(homes: DataFrame, ends: DataFrame, folder: str) -> DataFrame:
    """(node, home): communities parted into connected ones, each named by its smallest node."""
    left, right = homes.select(F.col("node").alias("a"), "home"), homes.select(F.col("node").alias("b"), F.col("home").alias("home_b"))
    links = ends.where("a > b").join(left, "a").join(right, "b").where("home = home_b").select(F.col("a").alias("u"), F.col("b").alias("v"))
    roots = connected(links)
    return written(homes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("home")), folder)


def louvain(weights: DataFrame, resolution: float = 1.0, block: int = BLOCK) -> DataFrame:
    """(node, label) of the nodes of (a, b, weight), strings, a <= b: nodes with one label are a community, and connected.

    Labels are numbers of their smallest nodes in the order of names. Nothing but sums goes to the driver. Pairs without
    weight, and a table without pairs, give every node its own label.
    """
    spark = weights.sparkSession
    folder = shared_folder(spark, "louvain")
    named = written(weights.select("a", "b", F.col("weight").cast("double").alias("weight")), folder)
    names = named.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    names = written(running(names, [F.col("node")], F.lit(1)).select("node", F.col("rank").alias("label")), folder)
    a, b = names.select(F.col("node").alias("a"), F.col("label").alias("x")), names.select(F.col("node").alias("b"), F.col("label").alias("y"))
    pairs = written(named.join(a, "a").join(b, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "weight"), folder)
    total = (pairs.agg(F.sum("weight")).first()[0] or 0.0) * 2
    labels = names
    while total > 0:
        homes = _level(pairs, total, resolution, block, folder)
        if homes is None:
            break
        labels = written(labels.join(homes.withColumnRenamed("node", "label"), "label").select("node", F.col("home").alias("label")), folder)
        x, y = homes.select(F.col("node").alias("a"), F.col("home").alias("x")), homes.select(F.col("node").alias("b"), F.col("home").alias("y"))
        folded = pairs.join(x, "a").join(y, "b").groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("weight").alias("weight"))
        pairs = written(folded, folder)
    out = settle(labels)
    drop_folder(spark, folder)
    return out
