"""Communities: weights, Louvain, stable ids, overviews and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import settle, with_rank
from .louvain import louvain

# The cognitive relations that bind, at this part of their score.
COGNITIVE = ("rationale_for", "implements", "constrains", "motivates", "contradicts", "references")
COGNITIVE_PART = 0.3


def clustering_edges(edges: DataFrame) -> DataFrame:
    """(source, target, score): physical and containing edges as they are, binding cognitive ones in part; no others."""
    whole = (F.col("type") == "PHYSICAL") | ((F.col("type") == "COGNITIVE") & (F.col("relation") == "contains"))
    part = (F.col("type") == "COGNITIVE") & F.col("relation").isin(*COGNITIVE)
    return edges.select("source", "target", F.when(whole, F.col("score")).when(part, F.col("score") * F.lit(COGNITIVE_PART)).alias("score")).where(F.col("score").isNotNull())


def pair_weights(edges: DataFrame) -> DataFrame:
    """(a, b, weight), a <= b: summed scores of an unordered pair; a score of zero counts 1."""
    score = F.when(F.col("score") == 0, F.lit(1.0)).otherwise(F.col("score"))
    return edges.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.sum(score).alias("weight"))


def detect(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, community) of all nodes, numbered from 0 by their smallest nodes; a node without binding edges is one of its own."""
    labels = louvain(settle(pair_weights(clustering_edges(edges))))
    ids = nodes.select(F.col("id").alias("node")).distinct()
    out = ids.join(labels, "node", "left").select("node", F.coalesce(F.col("label").cast("string"), F.concat(F.lit("~"), F.col("node"))).alias("name"))
    out = settle(out)
    ranked = with_rank(out.groupBy("name").agg(F.min("node").alias("first")), [F.col("first")], "community")
    return out.join(ranked.select("name", "community"), "name").select("node", "community")


def jaccard(new: DataFrame, old: DataFrame) -> DataFrame:
    """(new, old, score) of communities (node, community) that share nodes."""
    n = new.groupBy(F.col("community").alias("new")).agg(F.count(F.lit(1)).alias("n"))
    o = old.groupBy(F.col("community").alias("old")).agg(F.count(F.lit(1)).alias("o"))
    shared = new.withColumnRenamed("community", "new").join(old.withColumnRenamed("community", "old"), "node").groupBy("new", "old").agg(F.count(F.lit(1)).alias("both"))
    return shared.join(n, "new").join(o, "old").select("new", "old", (F.col("both") / (F.col("n") + F.col("o") - F.col("both"))).alias("score"))


def match_greedily(overlaps: list[tuple[int, int, float]], new: list[int]) -> dict[int, int]:
    """new -> stable id: pairs by falling score, each side once; the rest get the smallest unused ids."""
    taken: dict[int, int] = {}
    used: set[int] = set()
    for a, b, _ in sorted(overlaps, key=lambda x: (-x[2], x[0], x[1])):
        if a not in taken and b not in used:
            taken[a] = b
            used.add(b)
    spare = 0
    for a in sorted(new):
        if a not in taken:
            while spare in used:
                spare += 1
            taken[a] = spare
            used.add(spare)
    return taken


def stabilize(new: DataFrame, old: DataFrame) -> DataFrame:
    """(node, community) of the new clustering under the ids of the old one where they overlap most.

    Pairs by falling overlap, each side once, as match_greedily does, but over tables: a pair that is the best of both
    its sides is taken, its sides' other pairs go, and so on. The rest get the smallest unused ids, in their order.
    """
    left = settle(jaccard(new, old))
    names = new.select(F.col("community").cast("long").alias("new")).distinct()
    order = F.struct(-F.col("score"), "new", "old")
    taken = None
    while not left.isEmpty():
        mine = left.groupBy("new").agg(F.min_by("old", order).alias("old"))
        theirs = left.groupBy("old").agg(F.min_by("new", order).alias("new"))
        pairs = settle(mine.join(theirs, ["new", "old"]).select("new", "old"))
        taken = pairs if taken is None else taken.unionByName(pairs)
        left = settle(left.join(pairs.select("new"), "new", "left_anti").join(pairs.select("old"), "old", "left_anti"))
    if taken is None:
        taken = names.sparkSession.createDataFrame([], "new long, old long")
    taken = settle(taken.select(F.col("new").cast("long").alias("new"), F.col("old").cast("long").alias("stable")))
    rest = with_rank(names.join(taken, "new", "left_anti"), [F.col("new")], "nth")
    n = rest.count() + taken.count()
    free = new.sparkSession.range(n).select(F.col("id").alias("stable")).join(taken.select("stable"), "stable", "left_anti")
    spare = with_rank(free, [F.col("stable")], "nth")
    plan = taken.unionByName(rest.join(spare, "nth").select("new", "stable"))
    return new.join(plan, new["community"] == plan["new"]).select("node", F.col("stable").alias("community"))


def overview(nodes: DataFrame, degree: DataFrame, hub_ids: DataFrame, top: int = 5) -> DataFrame:
    """(community, size, hub, labels): members by falling degree, then id; the first hub among them or else the first."""
    hub = hub_ids.select(F.col("node").alias("hub_id")).distinct()
    rows = nodes.join(degree, nodes["id"] == degree["node"], "left").join(hub, nodes["id"] == hub["hub_id"], "left")
    rows = rows.select(F.coalesce("community", F.lit(0)).alias("community"), "id", "label", F.coalesce("degree", F.lit(0)).alias("degree"), F.col("hub_id").isNull().alias("plain"))
    rank = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("degree"), "id"))
    best = rows.withColumn("rank", rank).where(F.col("rank") <= top).groupBy("community").agg(F.array_sort(F.collect_list(F.struct("rank", "label"))).alias("r"))
    sums = rows.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.min_by("id", F.struct("plain", -F.col("degree"), "id")).alias("hub"))
    return sums.join(best, "community").select("community", "size", "hub", F.transform("r", lambda x: x["label"]).alias("labels"))


def summaries(nodes: DataFrame, degree: DataFrame) -> DataFrame:
    """(community, size, percent, folder, hub_file): the commonest parent folder, `(root)` for files that have none, and the file of greatest degree (of all edges, both ends), ties by name."""
    folder = F.when(F.col("source_file").contains("/"), F.regexp_replace("source_file", "/[^/]*$", "")).otherwise("(root)")
    rows = nodes.join(degree, nodes["id"] == degree["node"], "left").select(F.coalesce("community", F.lit(0)).alias("community"), "id", "source_file", F.coalesce("degree", F.lit(0)).alias("degree"), folder.alias("folder"))
    folders = rows.groupBy("community", "folder").agg(F.count(F.lit(1)).alias("n"))
    folder = folders.groupBy("community").agg(F.min_by("folder", F.struct(-F.col("n"), "folder")).alias("folder"))
    sums = rows.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.min_by(F.element_at(F.split("source_file", "/"), -1), F.struct(-F.col("degree"), "id")).alias("hub_file"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return sums.join(folder, "community").join(F.broadcast(total)).select("community", "size", F.round(F.lit(100.0) * F.col("size") / F.col("total")).cast("int").alias("percent"), "folder", "hub_file")


def members(nodes: DataFrame) -> DataFrame:
    """(community, id, label, source_file, place): the nodes of each community, placed from 0 by id; a row each, as a community may hold most nodes."""
    rows = nodes.select(F.coalesce("community", F.lit(0)).alias("community"), "id", "label", "source_file")
    ranks = with_rank(rows, [F.col("community"), F.col("id")], "nth")
    first = ranks.groupBy("community").agg(F.min("nth").alias("first"))
    return ranks.join(first, "community").select("community", "id", "label", "source_file", (F.col("nth") - F.col("first")).alias("place"))


def folder_rollup(summary: DataFrame) -> DataFrame:
    """(folder, size, communities): summaries by their folder."""
    return summary.groupBy("folder").agg(F.sum("size").alias("size"), F.array_sort(F.collect_list("community")).alias("communities"))


def severity(score: Column) -> Column:
    return F.when(score >= 0.8, "error").otherwise("warn")
