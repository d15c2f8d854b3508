"""Strongly connected components over tables, in rounds that grow with logarithms rather than with path lengths.

A node with one way out belongs to the component of what it leads to or to none but its own. So chains of such nodes,
which form trees that hang below the next node with several ways, or rings, are drawn together by pointer doubling, and
the same is done for one way in, until little is left. Rings are components as they are. What is left is coloured from
sampled pivots, forwards and backwards. Then chains get their components back, last drawn together, first given back.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import drop_folder, settle, shared_folder, tabled

#: Part of the edges that a pass over chains must take away for another to follow.
SHRINK = 0.1


@dataclass
class Rounds:
    """How many rounds each part took, for those who watch growth."""

    doubling: int = 0
    passes: int = 0
    colours: int = 0
    spreading: int = 0
    levels: int = 0


@dataclass
class _Chains:
    """Chain nodes of one pass: jumps (node, to) of doubling length, terminals (node, to), and entries (u, x, t) from nodes off any chain."""

    jumps: list[DataFrame] = field(default_factory=list)
    ends: DataFrame | None = None
    entries: DataFrame | None = None


def _draw_together(core: DataFrame, folder: str, rounds: Rounds) -> tuple[_Chains, DataFrame, DataFrame]:
    """The chains of (a, b) where a has one way out, the rings among them (node, component), and the edges that are left."""
    made = _Chains()
    one = core.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("to")).where("n = 1")
    at = tabled(one.select(F.col("a").alias("node"), "to", F.col("a").alias("low")), folder)
    count, reach = at.count(), 1
    on = at.select(F.col("node").alias("x"))
    while True:
        made.jumps.append(at.select("node", "to"))
        # Twice the jump; one that ends off the chains stays there. low: the smallest node passed, the end left out.
        nxt = at.select(F.col("node").alias("via"), F.col("to").alias("far"), F.col("low").alias("low2"))
        both = at.join(nxt, at["to"] == nxt["via"], "left")
        fresh = tabled(both.select("node", F.coalesce("far", "to").alias("to"), F.least("low", F.coalesce("low2", "low")).alias("low"), F.col("via").isNotNull().alias("open")), folder)
        rounds.doubling += 1
        at, reach = fresh.drop("open"), reach * 2
        if fresh.where("open").isEmpty() or reach >= 2 * count:
            break
    # Jumps as long as all nodes: who is still on a chain is on a ring, and rings are where those jumps end.
    open_ = at.join(on, at["to"] == on["x"], "left_semi")
    ring = open_.select("to").distinct()
    rings = at.join(ring.withColumnRenamed("to", "r"), at["node"] == F.col("r"), "left_semi").select("node", F.col("low").alias("component"))
    made.ends = tabled(at.join(on, at["to"] == on["x"], "left_anti").select("node", "to"), folder)
    free = core.join(on, core["a"] == on["x"], "left_anti")
    ends = made.ends.select(F.col("node").alias("x"), F.col("to").alias("t"))
    tied = free.join(ends, free["b"] == ends["x"])
    made.entries = tabled(tied.select(F.col("a").alias("u"), "x", "t"), folder)
    direct = free.join(on, free["b"] == on["x"], "left_anti")
    left = direct.unionByName(made.entries.select(F.col("u").alias("a"), F.col("t").alias("b")).where("a <> b")).distinct()
    return made, rings, tabled(left, folder)


def _turned(core: DataFrame) -> DataFrame:
    return core.select(F.col("b").alias("a"), F.col("a").alias("b"))


def _trimmed(core: DataFrame, folder: str) -> DataFrame:
    """Once without nodes that nothing leads to or that lead nowhere."""
    heads, tails = core.select(F.col("b").alias("x")).distinct(), core.select(F.col("a").alias("x")).distinct()
    return tabled(core.join(heads, core["a"] == heads["x"], "left_semi").join(tails, core["b"] == tails["x"], "left_semi"), folder)


def _coloured(core: DataFrame, folder: str, rounds: Rounds) -> DataFrame:
    """(node, component) of the nodes of a core that lie on cycles.

    Every node is a pivot of its own; the smallest by a hash that reaches a node colours it, and what reaches the
    pivot within its colour is the pivot's component. Hashes change with each colouring, so no order of names is bad.
    """
    out = None
    while not core.isEmpty():
        rounds.colours += 1
        nodes = core.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        label = tabled(nodes.select("node", F.struct(F.xxhash64("node", F.lit(rounds.colours)).alias("h"), F.col("node").alias("pivot")).alias("label")), folder)
        fresh = label
        while not fresh.isEmpty():  # only what changed goes on
            rounds.spreading += 1
            came = core.join(fresh, core["a"] == fresh["node"]).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("came"))
            joined = tabled(label.join(came, "node", "left").select("node", F.least("label", F.coalesce("came", "label")).alias("label"), (F.coalesce(F.col("came") < F.col("label"), F.lit(False))).alias("new")), folder)
            label, fresh = joined.drop("new"), joined.where("new").drop("new")
        colour = label.select("node", F.col("label.pivot").alias("pivot"))
        left, right = colour.select(F.col("node").alias("a"), F.col("pivot").alias("p")), colour.select(F.col("node").alias("b"), F.col("pivot").alias("q"))
        same = tabled(core.join(left, "a").join(right, "b").where("p = q").select("a", "b", "p"), folder)
        back = fresh = tabled(colour.where("node = pivot").select("node", F.col("pivot").alias("component")), folder)
        while not fresh.isEmpty():
            rounds.spreading += 1
            came = same.join(fresh, same["b"] == fresh["node"]).select(F.col("a").alias("node"), F.col("p").alias("component")).distinct()
            fresh = tabled(came.join(back, "node", "left_anti"), folder)
            back = back.unionByName(fresh)
        back = tabled(back, folder)
        out = back if out is None else out.unionByName(back)
        gone = back.select(F.col("node").alias("x"))
        rest = core.join(left, "a").join(right, "b").where("p = q").select("a", "b")  # no component spans two colours
        rest = tabled(rest.join(gone, rest["a"] == gone["x"], "left_anti").join(gone, F.col("b") == gone["x"], "left_anti"), folder)
        core = _trimmed(rest, folder)
    return out


def strong_components(pairs: DataFrame, rounds: Rounds | None = None) -> DataFrame:
    """(node, component, size) of nodes on cycles of several nodes, over (source, target); component is the smallest node.

    Loops of one node don't count, repeated and null ends neither. No edge, node or label goes to the driver.
    """
    rounds = rounds if rounds is not None else Rounds()
    folder = shared_folder(pairs.sparkSession, "cycles")
    core = tabled(pairs.select(F.col("source").alias("a"), F.col("target").alias("b")).where("a <> b").distinct(), folder)
    passes: list[_Chains] = []
    kind = core.schema["a"].dataType.simpleString()
    found = pairs.sparkSession.createDataFrame([], f"node {kind}, component {kind}")
    size = core.count()
    while size:
        rounds.passes += 1
        before = size
        for turned in (False, True):
            chains, rings, core = _draw_together(_turned(core) if turned else core, folder, rounds)
            core = _turned(core) if turned else core
            passes.append(chains)
            found = found.unionByName(rings)
        core = _trimmed(core, folder)
        size = core.count()
        if size > (1 - SHRINK) * before:
            break
    coloured = _coloured(core, folder, rounds)
    labels = tabled(found if coloured is None else found.unionByName(coloured), folder)
    for chains in reversed(passes):
        of = lambda x: labels.select(F.col("node").alias(f"_{x}"), F.col("component").alias(f"c{x}"))  # noqa: B023, E731
        entries = chains.entries.join(of("u"), F.col("u") == F.col("_u"), "left").join(of("t"), F.col("t") == F.col("_t"), "left")
        own = entries.withColumn("cu", F.coalesce("cu", "u")).withColumn("ct", F.coalesce("ct", "t")).where("cu = ct")
        marks = tabled(own.select(F.col("x").alias("node"), F.col("ct").alias("component"), "t").distinct(), folder)
        if marks.isEmpty():
            continue
        tops = marks.select(F.col("t").alias("node"), "component").distinct()
        marks = marks.select("node", "component")
        for jump in chains.jumps:  # all nodes from an entry down to where its chain ends
            marks = tabled(marks.unionByName(marks.join(jump, "node").select(F.col("to").alias("node"), "component")).distinct(), folder)
        labels = tabled(labels.unionByName(marks).unionByName(tops).distinct(), folder)
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("least")).where("size > 1")
    out = settle(labels.join(sizes, "component").select("node", F.col("least").alias("component"), "size"))
    drop_folder(pairs.sparkSession, folder)
    return out
