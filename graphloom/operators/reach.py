"""How many nodes reach each node, for all nodes at once and without listing pairs.

Components become one vertex each. Trees of vertices with one way out and chains of vertices with one way in are crossed
by pointer doubling, so that rounds follow the number of branchings on a path, not its length. What reaches a vertex is
held as a theta sketch, exact while it is small and of a size that doesn't grow; sketches go along the levels of what is
left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import drop_folder, running, settle, shared_folder, tabled
from .cycles import Rounds, _draw_together, strong_components
from .graph import imported


def _levels(direct: DataFrame, folder: str) -> tuple[DataFrame, int]:
    """(node, level) of the ends of the acyclic (r, w): the longest path that leads there; and the highest level."""
    nodes = direct.select(F.explode(F.array("r", "w")).alias("node")).distinct()
    at = tabled(nodes.withColumn("level", F.lit(0)), folder)
    fresh = at
    top = 0
    while not fresh.isEmpty():
        came = direct.join(fresh, direct["r"] == fresh["node"]).groupBy(F.col("w").alias("node")).agg((F.max("level") + 1).alias("came"))
        at = tabled(at.join(came, "node", "left").select("node", F.greatest("level", F.coalesce("came", F.lit(0))).alias("level"), F.coalesce(F.col("came") > F.col("level"), F.lit(False)).alias("new")), folder)
        fresh, at = at.where("new").drop("new"), at.drop("new")
        top += 1
    return at, top - 1


class _Sketches:
    """Sketches (at, sketch) of all that leads to each vertex of an acyclic flow (u, v), from the vertices' own ones."""

    def __init__(self, folder: str, lg_entries: int, rounds: Rounds):
        self.folder, self.rounds, self.size = folder, rounds, F.lit(lg_entries)

    def keep(self, df: DataFrame) -> DataFrame:
        return tabled(df, self.folder)

    def summed(self, *parts: DataFrame) -> DataFrame:
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        return rows.groupBy("at").agg(F.theta_union_agg("sketch", self.size).alias("sketch"))

    def down(self, sketches: DataFrame, jumps: list[DataFrame]) -> DataFrame:
        """What vertices that lead one way send along it, to all below them: jumps double, so do the lengths covered."""
        for jump in jumps:
            sent = sketches.join(jump, sketches["at"] == jump["node"]).select(F.col("to").alias("at"), "sketch")
            sketches = self.keep(self.summed(sketches, sent))
        return sketches

    def through_trees(self, flow: DataFrame, own: DataFrame) -> DataFrame:
        """Vertices with one way out form trees; what is left after them has fewer levels."""
        trees, _, left = _draw_together(flow.select(F.col("u").alias("a"), F.col("v").alias("b")), self.folder, self.rounds)
        if trees.ends.isEmpty():
            return self.through_chains(flow, own)
        inner = trees.ends.select("node")
        gathered = self.down(own, trees.jumps)
        rest = self.keep(gathered.join(inner, gathered["at"] == inner["node"], "left_anti"))
        full = self.keep(self.through_chains(left.select(F.col("a").alias("u"), F.col("b").alias("v")), rest))
        came = full.join(trees.entries.select(F.col("u").alias("at"), "x").distinct(), "at").select(F.col("x").alias("at"), "sketch")
        mine = own.join(inner, own["at"] == inner["node"], "left_semi")
        onward = [j.join(inner.withColumnRenamed("node", "to"), "to", "left_semi").select("node", "to") for j in trees.jumps]
        return full.unionByName(self.down(self.keep(self.summed(mine, came)), onward))

    def through_chains(self, flow: DataFrame, own: DataFrame) -> DataFrame:
        """Vertices with one way in form chains; what is left goes level by level."""
        chains, _, _ = _draw_together(flow.select(F.col("v").alias("a"), F.col("u").alias("b")), self.folder, self.rounds)
        ends = chains.ends.select(F.col("node").alias("v"), F.col("to").alias("root"))
        # seg: the vertices from a chain's vertex up to where its chain ends, that end left out.
        seg = own.join(chains.ends, own["at"] == chains.ends["node"], "left_semi").select(F.col("at").alias("v"), "sketch")
        both = lambda one, two: F.when(two.isNull(), one).otherwise(F.theta_union(one, F.coalesce(two, one), self.size))
        for jump in chains.jumps:
            above = seg.join(jump, seg["v"] == jump["node"]).select(F.col("v").alias("low"), "to")
            more = above.join(seg.select(F.col("v").alias("to"), F.col("sketch").alias("up")), "to").select(F.col("low").alias("v"), "up")
            seg = self.keep(seg.join(more, "v", "left").select("v", both(F.col("sketch"), F.col("up")).alias("sketch")))
        # What leads to a vertex off the chains is another such vertex and perhaps a piece of a chain.
        met = flow.join(ends.select(F.col("v").alias("c")), flow["v"] == F.col("c"), "left_anti")
        met = self.keep(met.join(ends.select(F.col("v").alias("u"), "root"), "u", "left"))
        pieces = met.where("root IS NOT NULL").join(seg.select(F.col("v").alias("u"), "sketch"), "u").select(F.col("v").alias("at"), "sketch")
        base = self.keep(self.summed(own.join(ends, own["at"] == ends["v"], "left_anti").select("at", "sketch"), pieces))
        full = self.by_levels(self.keep(met.select(F.coalesce("root", "u").alias("r"), F.col("v").alias("w")).distinct()), base)
        below = ends.join(full.select(F.col("at").alias("root"), F.col("sketch").alias("up")), "root").join(seg, "v")
        return full.unionByName(below.select(F.col("v").alias("at"), both(F.col("sketch"), F.col("up")).alias("sketch")))

    def by_levels(self, direct: DataFrame, base: DataFrame) -> DataFrame:
        """Each vertex's sketch is made once, when all that leads to it is made, and sent once to each vertex it leads to."""
        spark, top_folder = base.sparkSession, shared_folder(base.sparkSession, "levels")
        folder = f"{self.folder}/{top_folder.rsplit('/', 1)[1]}"
        levels, top = _levels(direct, self.folder)
        self.rounds.levels += top + 1
        to = self.keep(direct.join(levels.select(F.col("node").alias("w"), F.col("level").alias("w_level")), "w"))
        base = base.join(levels, base["at"] == levels["node"], "left").select("at", "sketch", F.coalesce("level", F.lit(0)).alias("level"))
        base.write.partitionBy("level").parquet(f"{folder}/base")
        base = spark.read.schema("at long, sketch binary, level int").parquet(f"{folder}/base")
        sent: list[DataFrame] = []
        for level in range(max(top, 0) + 1):
            parts = [part.where(F.col("w_level") == level).select("at", "sketch") for part in sent]
            self.summed(base.where(F.col("level") == level).select("at", "sketch"), *parts).write.parquet(f"{folder}/full/level={level}")
            full = spark.read.schema("at long, sketch binary").parquet(f"{folder}/full/level={level}")
            if level < top:
                path = f"{folder}/sent/{level}"
                full.join(to, full["at"] == to["r"]).select(F.col("w").alias("at"), "sketch", "w_level").write.partitionBy("w_level").parquet(path)
                sent.append(spark.read.schema("at long, sketch binary, w_level int").parquet(path))
        return spark.read.schema("at long, sketch binary, level int").parquet(f"{folder}/full").select("at", "sketch")


def dependent_counts(edges: DataFrame, lg_entries: int = 10, rounds: Rounds | None = None) -> DataFrame:
    """(node, dependents, exact) of every end of a physical import: how many nodes lead to it, itself only if it is on a cycle.

    A sketch has 2 ** lg_entries entries: counts up to half of that are exact, and greater ones are estimates with a
    relative deviation of 1 / sqrt(2 ** lg_entries), 3 in 100 as it stands. Tables grow with nodes and edges only. Null ends
    are left out; repeated edges count once.
    """
    spark = edges.sparkSession
    rounds = rounds if rounds is not None else Rounds()
    folder = shared_folder(spark, "reach")
    pairs = imported(edges).select("source", "target").where("source IS NOT NULL AND target IS NOT NULL").distinct()
    names = running(pairs.select(F.explode(F.array("source", "target")).alias("name")).distinct(), [F.col("name")], F.lit(1))
    names = tabled(names.select("name", F.col("rank").alias("node")), folder)
    a, b = names.select(F.col("name").alias("source"), F.col("node").alias("a")), names.select(F.col("name").alias("target"), F.col("node").alias("b"))
    pairs = tabled(pairs.join(a, "source").join(b, "target").select("a", "b"), folder)
    comp = strong_components(pairs.select(F.col("a").alias("source"), F.col("b").alias("target")), rounds)
    loops = pairs.where("a = b").select(F.col("a").alias("loop"))
    at = names.select("node").join(comp, "node", "left").join(loops, F.col("node") == F.col("loop"), "left")
    at = tabled(at.select("node", F.coalesce("component", "node").alias("at"), (F.col("component").isNotNull() | F.col("loop").isNotNull()).alias("ring")), folder)
    x, y = at.select(F.col("node").alias("a"), F.col("at").alias("u")), at.select(F.col("node").alias("b"), F.col("at").alias("v"))
    flow = tabled(pairs.join(x, "a").join(y, "b").where("u <> v").select("u", "v").distinct(), folder)  # u leads to v

    own = tabled(at.groupBy("at").agg(F.theta_sketch_agg("node", F.lit(lg_entries)).alias("sketch")), folder)
    every = _Sketches(folder, lg_entries, rounds).through_trees(flow, own)
    counts = every.select("at", F.theta_sketch_estimate("sketch").alias("n"))
    n = F.col("n") - F.when(F.col("ring"), 0).otherwise(1)
    out = at.join(counts, "at").join(names, "node").select(F.col("name").alias("node"), n.cast("long").alias("dependents"), (F.col("n") <= 1 << (lg_entries - 1)).alias("exact"))
    out = settle(out)
    drop_folder(spark, folder)
    return out
