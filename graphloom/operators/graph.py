"""Graph operators over nodes (id, label, file_type, source_file, ...) and edges (source, target, relation, type, score, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import ranked as ranked_rows
from ..functions.lineage import running, settle, small, with_rank
from .cycles import strong_components


def both_ways(edges: DataFrame) -> DataFrame:
    """(node, other) for each edge in both directions."""
    return edges.select(F.explode(F.array(F.struct(F.col("source").alias("node"), F.col("target").alias("other")), F.struct(F.col("target").alias("node"), F.col("source").alias("other")))).alias("x")).select("x.*")


def degree_distinct(edges: DataFrame) -> DataFrame:
    """Number of different neighbours over all but suspicious edges; a loop counts its own node once.

    Pairs are told apart once, not once from each end; least and greatest skip nulls, so those are put second.
    """
    none = F.col("source").isNull() | F.col("target").isNull()
    pairs = edges.where("type <> 'SUSPICIOUS'").select(F.least("source", "target").alias("a"), F.when(~none, F.greatest("source", "target")).alias("b")).distinct()
    ends = pairs.select(F.explode(F.when(F.col("a").eqNullSafe(F.col("b")), F.array("a")).otherwise(F.array("a", "b"))).alias("node"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def degree_multi(edges: DataFrame) -> DataFrame:
    """Ends of edges at each node; a loop counts twice."""
    return both_ways(edges).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def hubs(edges: DataFrame, sigmas: float = 5.0, least: int = 50) -> DataFrame:
    """(node, degree) above the mean by so many deviations and above `least`, over nodes with physical edges."""
    degree = degree_multi(edges.where("type = 'PHYSICAL'"))
    line = degree.agg((F.avg("degree") + F.lit(sigmas) * F.stddev_pop("degree")).alias("line"))
    return degree.join(F.broadcast(line)).where((F.col("degree") > F.col("line")) & (F.col("degree") > least)).select("node", "degree")


def prune_dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose two ends are nodes."""
    ids = nodes.select(F.col("id")).distinct()
    return edges.join(ids, edges["source"] == ids["id"], "left_semi").join(ids, edges["target"] == ids["id"], "left_semi")


induced_edges = prune_dangling


def prune_few(nodes: DataFrame, edges: DataFrame, most: int = 10_000) -> DataFrame:
    """As prune_dangling, where most ends are nodes: up to so many other ends are taken out as they pass, and edges are not shuffled."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("end")).where("end IS NOT NULL").distinct()
    lost = settle(ends.join(nodes.select("id"), F.col("end") == F.col("id"), "left_anti"))
    if not small(lost, most):
        return prune_dangling(nodes, edges)
    out = edges.where("source IS NOT NULL AND target IS NOT NULL")
    if lost.isEmpty():
        return out
    for side in ("source", "target"):
        out = out.join(F.broadcast(lost.withColumnRenamed("end", f"_{side}")), F.col(side) == F.col(f"_{side}"), "left_anti")
    return out


def search(nodes: DataFrame, text: str, most: int | None = 8) -> DataFrame:
    """Nodes whose label or id has the text in it, capitals alike; none for a blank text."""
    wanted = F.lit(text.strip().lower())
    found = nodes.where((F.lower("label").contains(wanted) | F.lower("id").contains(wanted)) & F.lit(bool(text.strip())))
    return found.orderBy("id").limit(most) if most else found


def facet_filter(nodes: DataFrame, file_types: list[str], prefix: str = "", communities: list[int] | None = None) -> DataFrame:
    out = nodes.where(F.col("file_type").isin(*file_types) & F.col("source_file").startswith(prefix))
    return out if communities is None else out.where(F.coalesce("community", F.lit(0)).isin(*communities))


def suppress_covered(edges: DataFrame, show_suspicious: bool = True) -> DataFrame:
    """Without the physical edges whose pair, in either direction, has a suspicious one; all edges where those aren't shown."""
    if not show_suspicious:
        return edges
    pair = lambda: (F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"))
    covered = edges.where("type = 'SUSPICIOUS'").select(*pair()).distinct()
    hit = (F.least("source", "target") == covered["a"]) & (F.greatest("source", "target") == covered["b"]) & (F.col("type") == "PHYSICAL")
    return edges.join(covered, hit, "left_anti")


def layers(edges: DataFrame, physical: bool = True, cognitive: bool = True, suspicious: bool = True) -> DataFrame:
    """Edges of the types that are shown; edges of any other type always are."""
    hidden = [t for t, on in (("PHYSICAL", physical), ("COGNITIVE", cognitive), ("SUSPICIOUS", suspicious)) if not on]
    return edges.where(~F.col("type").isin(*hidden)) if hidden else edges


def edge_tiers(edges: DataFrame, core: DataFrame) -> DataFrame:
    """Edges with a tier: 2 with both ends among the core ids (id), 1 with one, else 0."""
    ids = core.select("id").distinct()
    a, b = ids.select(F.col("id").alias("_s")), ids.select(F.col("id").alias("_t"))
    out = edges.join(a, edges["source"] == a["_s"], "left").join(b, edges["target"] == b["_t"], "left")
    return out.withColumn("tier", F.col("_s").isNotNull().cast("int") + F.col("_t").isNotNull().cast("int")).drop("_s", "_t")


def warnings_sorted(edges: DataFrame) -> DataFrame:
    """Suspicious edges, the greatest score first, then by relation, then by their ends."""
    return edges.where("type = 'SUSPICIOUS'").orderBy(F.desc("score"), "relation", "source", "target")


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    """(direction, other, relation, score) of a node, the first edge of each: by position, where edges have one, then by type and score."""
    at = F.col("position") if "position" in edges.columns else F.lit(0)
    ends = lambda here, there, way: edges.where(F.col(here) == node).select(F.lit(way).alias("direction"), F.col(there).alias("other"), "relation", "score", "type", at.alias("at"))
    out, into = ends("source", "target", "out"), ends("target", "source", "in")
    first = F.min_by("score", F.struct("at", "type", "score")).alias("score")
    return out.unionByName(into).groupBy("direction", "other", "relation").agg(first)


def focus_tiers(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """(id, tier): 2 for the node, 1 for its neighbours, 0 for all others."""
    return tiers(nodes, edges, nodes.where(F.col("id") == node).select("id"))


def tiers(nodes: DataFrame, edges: DataFrame, core: DataFrame) -> DataFrame:
    """(id, tier): 2 for the core ids (id), 1 for their neighbours, 0 for all others."""
    ids = core.select(F.col("id").alias("core")).distinct()
    near = both_ways(edges).join(ids, F.col("node") == F.col("core"), "left_semi").select(F.col("other").alias("near")).distinct()
    joined = nodes.join(near, nodes["id"] == near["near"], "left").join(ids, nodes["id"] == ids["core"], "left")
    return joined.select("id", F.when(F.col("core").isNotNull(), 2).when(F.col("near").isNotNull(), 1).otherwise(0).alias("tier"))


# ---- reachability ------------------------------------------------------------------------------------------------


def imported(edges: DataFrame, relation: str = "imports") -> DataFrame:
    """Physical edges of the relation: no others make a file depend on another."""
    return edges.where((F.col("type") == "PHYSICAL") & (F.col("relation") == relation))


def dependents(edges: DataFrame, start: str, relation: str = "imports") -> DataFrame:
    """(node) from which the start can be reached over physical edges of the relation, frontier by frontier; the start only if on a cycle."""
    back = imported(edges, relation).select(F.col("target").alias("at"), F.col("source").alias("node")).distinct()
    front = settle(back.where(F.col("at") == start).select("node").distinct())
    seen = front
    while not front.isEmpty():
        step = back.join(front.withColumnRenamed("node", "at"), "at").select("node").distinct()
        front = settle(step.join(seen, "node", "left_anti"))
        seen = seen.unionByName(front)
    return seen


def all_dependents(edges: DataFrame, relation: str = "imports") -> DataFrame:
    """(root, node): node reaches root, for all roots at once; reach.dependent_counts counts without the pairs.

    Paths double in length each round, so rounds are few.
    """
    reach = settle(imported(edges, relation).select(F.col("target").alias("root"), F.col("source").alias("node")).distinct())
    size = reach.count()
    while True:
        far = reach.alias("a").join(reach.alias("b"), F.col("a.node") == F.col("b.root")).select(F.col("a.root"), F.col("b.node"))
        reach = settle(reach.unionByName(far).distinct())
        size, before = reach.count(), size
        if size == before:
            return reach


def neighbourhood(edges: DataFrame, start: str, depth: int) -> DataFrame:
    """(node, distance) within so many steps in any direction over all but suspicious edges; one plan, no jobs between."""
    step = both_ways(edges.where("type <> 'SUSPICIOUS'")).distinct()
    seen = edges.sparkSession.createDataFrame([(start, 0)], "node string, distance int")
    for d in range(1, depth + 1):
        front = seen.where(F.col("distance") == d - 1).select("node")
        found = step.join(F.broadcast(front) if d == 1 else front, "node").select(F.col("other").alias("node"), F.lit(d).alias("distance"))
        seen = seen.unionByName(found).groupBy("node").agg(F.min("distance").alias("distance"))
    return seen


#: Rows that one task may rank.
RANKED = 100_000


def within_budget(ranked: DataFrame, order: list[Column], cost: Column, budget: int, chars_a_token: int = 4, least: int = 1) -> DataFrame:
    """Rows in order while the summed cost stays within the budget; the first always. Adds rank, spent and kept.

    Costs are at least `least`, so what is kept is a prefix, and no more rows than the budget could hold and one are
    ranked: a bounded top-k comes first, and rows beyond it are not returned. A budget that could hold more than RANKED
    rows is summed a partition at a time; the sums are the same.
    """
    most = budget * chars_a_token // least + 2
    if most <= RANKED:
        w = Window.orderBy(*order)
        out = ranked.orderBy(*order).limit(most).withColumn("rank", F.row_number().over(w)).withColumn("spent", F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    else:
        out = running(ranked, order, cost, "spent").withColumn("rank", (F.col("rank") + 1).cast("int")).where(F.col("rank") <= most)
    return out.withColumn("kept", (F.col("rank") == 1) | (F.col("spent") <= budget * chars_a_token))


# ---- cycles ------------------------------------------------------------------------------------------------------


def tarjan(pairs: list[tuple[str, str]]) -> dict[str, str]:
    """node -> smallest node of its strongly connected component, without recursion."""
    after: dict[str, list[str]] = {}
    for a, b in pairs:
        after.setdefault(a, []).append(b)
        after.setdefault(b, [])
    order: dict[str, int] = {}
    low: dict[str, int] = {}
    held: list[str] = []
    inside: set[str] = set()
    out: dict[str, str] = {}
    for start in after:
        if start in order:
            continue
        todo = [(start, iter(after[start]))]
        order[start] = low[start] = len(order)
        held.append(start)
        inside.add(start)
        while todo:
            node, rest = todo[-1]
            for other in rest:
                if other not in order:
                    order[other] = low[other] = len(order)
                    held.append(other)
                    inside.add(other)
                    todo.append((other, iter(after[other])))
                    break
                if other in inside:
                    low[node] = min(low[node], order[other])
            else:
                todo.pop()
                if todo:
                    low[todo[-1][0]] = min(low[todo[-1][0]], low[node])
                if low[node] == order[node]:
                    part = []
                    while not part or part[-1] != node:
                        part.append(held.pop())
                        inside.discard(part[-1])
                    out |= dict.fromkeys(part, min(part))
    return out


def components(pairs: DataFrame, driver_edges: int = 200_000) -> DataFrame:
    """(node, component) of nodes on cycles of several nodes, over (source, target); component is the smallest node.

    Up to driver_edges different edges go to the driver; more, and the components are found over tables, with the same
    result (cycles.strong_components). 0 takes that way always.
    """
    core = settle(pairs.select("source", "target").where("source <> target").distinct())
    if not (driver_edges and small(core, driver_edges)):
        return strong_components(core)
    found = tarjan([(r.source, r.target) for r in core.collect()])
    out = pairs.sparkSession.createDataFrame(sorted(found.items()), "node string, component string")
    sizes = out.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return out.join(sizes, "component").select("node", "component", "size")


def cycle_edges(edges: DataFrame, driver_edges: int = 200_000) -> DataFrame:
    """(source, target, component, size, score) of physical edges within a component of several nodes: 0.4 + 0.1 a node, at most 1."""
    pairs = settle(edges.where("type = 'PHYSICAL'").select("source", "target").distinct())
    comp = components(pairs, driver_edges)
    a = comp.select(F.col("node").alias("source"), "component", "size")
    b = comp.select(F.col("node").alias("target"), F.col("component").alias("other"))
    inside = pairs.join(a, "source").join(b, "target").where("component = other")
    return inside.select("source", "target", "component", "size", F.least(F.lit(1.0), F.lit(0.4) + F.lit(0.1) * F.col("size")).alias("score"))


def closed_walk(nodes: list[str], pairs: list[tuple[str, str]]) -> list[str]:
    """A closed walk through the nodes in order, each leg a shortest path."""
    after: dict[str, list[str]] = {}
    for a, b in sorted(pairs):
        after.setdefault(a, []).append(b)

    def leg(a: str, b: str) -> list[str]:
        came, front = {a: a}, [a]
        first = True
        while front and (first or b not in came or a == b):
            first, following = False, []
            for x in front:
                for y in after.get(x, []):
                    if y == b:
                        path = [b, x]
                        while path[-1] != a:
                            path.append(came[path[-1]])
                        return path[::-1]
                    if y not in came:
                        came[y] = x
                        following.append(y)
            front = following
        return []

    walk = [nodes[0]]
    for a, b in zip(nodes, [*nodes[1:], nodes[0]], strict=True):
        walk += leg(a, b)[1:]
    return walk


def all_warning_groups(edges: DataFrame, driver_edges: int = 200_000) -> DataFrame:
    """Suspicious edges (source, target, relation, score) to (type, key, nodes, n_edges, score), the greatest score first, then by key.

    Circular dependencies make a row for each component of their own graph, a node with only a loop too; each other
    edge is a row of its own, of type boundary or other.
    """
    circular = F.col("relation") == "circular_dependency"
    kind = F.when(F.col("relation") == "violates_boundary", "boundary").otherwise("other")
    alone = edges.where(~circular).select(kind.alias("type"), F.concat(F.lit("sus_"), "source", F.lit("->"), "target", F.lit("_"), "relation").alias("key"), F.array().cast("array<string>").alias("nodes"), F.lit(1).cast("long").alias("n_edges"), "score")
    rings = settle(edges.where(circular).select("source", "target", "score"))
    comp = components(rings, driver_edges).select("node", "component")
    loops = rings.where("source = target").select(F.col("source").alias("node")).distinct().join(comp, "node", "left_anti")
    comp = settle(comp.unionByName(loops.withColumn("component", F.col("node"))))
    inside = rings.join(comp.withColumnRenamed("node", "source"), "source").join(comp.select(F.col("node").alias("target"), F.col("component").alias("other")), "target").where("component = other")
    groups = warning_groups(inside).select(F.lit("cycle").alias("type"), "key", "nodes", "n_edges", "score")
    return alone.unionByName(groups).orderBy(F.desc("score"), "key")


def warning_groups(cycles: DataFrame, walks: bool = False, longest_walk: int = 100_000) -> DataFrame:
    """Cycle edges to a row for each component: key, sorted nodes, number of edges, greatest score, and a closed walk.

    A walk is one sequence of legs, made in one task. Where a component has more than longest_walk edges, walks are
    refused with a ValueError rather than left out.
    """
    if walks and not cycles.groupBy("component").count().where(F.col("count") > longest_walk).isEmpty():
        raise ValueError(f"a component has over {longest_walk} edges: no closed walk is made through it")
    out = cycles.groupBy("component").agg(F.array_sort(F.collect_set("source")).alias("nodes"), F.count(F.lit(1)).alias("n_edges"), F.max("score").alias("score"), *[F.collect_list(F.struct("source", "target")).alias("pairs")] * walks)
    out = out.withColumn("key", F.concat(F.lit("cycle_"), F.array_join("nodes", "_")))
    if not walks:
        return out.select("key", "nodes", "n_edges", "score")

    @F.udf("array<string>")
    def walk(nodes, pairs):
        return closed_walk(nodes, [(p[0], p[1]) for p in pairs])

    return out.select("key", "nodes", "n_edges", "score", walk("nodes", "pairs").alias("walk"))


# ---- size and place ----------------------------------------------------------------------------------------------


def node_sizes(nodes: DataFrame, edges: DataFrame, hub_ids: DataFrame) -> DataFrame:
    """(id, size): 4 + 1.8 sqrt(degree), at least 13 for hubs, at most 22."""
    degree = degree_multi(prune_few(nodes, edges))
    hub = hub_ids.select(F.col("node").alias("hub")).distinct()
    joined = nodes.join(degree, nodes["id"] == degree["node"], "left").join(hub, nodes["id"] == hub["hub"], "left")
    least = F.when(F.col("hub").isNotNull(), F.lit(13.0)).otherwise(F.lit(0.0))
    return joined.select("id", F.least(F.lit(22.0), F.greatest(least, F.lit(4.0) + F.lit(1.8) * F.sqrt(F.coalesce("degree", F.lit(0))))).alias("size"))


def layout_members(nodes: DataFrame) -> DataFrame:
    """(id, community_index, n_communities, i) of nodes (id, community): communities in the order of their numbers, nodes over the whole table by id."""
    rows = nodes.select("id", F.coalesce("community", F.lit(0)).alias("community"))
    groups, n = ranked_rows(rows.select("community").distinct(), [F.col("community")], "community_index")
    return with_rank(rows, [F.col("id")], "i").join(groups, "community").select("id", "community_index", F.lit(n).alias("n_communities"), "i")


def seed_layout(members: DataFrame) -> DataFrame:
    """(id, x, y) from (id, community_index, n_communities, i): a ring of anchors (the centre for one community), and a golden-angle spiral around each."""
    ring = F.when(F.col("n_communities") <= 1, F.lit(0.0)).otherwise(F.lit(120.0) + F.lit(45.0) * F.col("n_communities"))
    turn = F.lit(2.0) * F.pi() * F.col("community_index") / F.col("n_communities")
    spiral, golden = F.lit(14.0) * F.sqrt(F.col("i") + 1), F.pi() * (F.lit(3.0) - F.sqrt(F.lit(5.0))) * F.col("i")
    return members.select("id", (F.cos(turn) * ring + F.cos(golden) * spiral).alias("x"), (F.sin(turn) * ring + F.sin(golden) * spiral).alias("y"))


def hash_layout(nodes: DataFrame) -> DataFrame:
    """(id, x, y) from a 31-hash of the id in 32 bits, its absolute value folded into 800 by 800."""
    wrap = lambda v: F.pmod(v + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)
    h = F.aggregate(F.filter(F.split("id", ""), lambda c: c != ""), F.lit(0).cast("long"), lambda s, c: wrap(s * 31 + F.ascii(c)))
    out = nodes.select("id", F.abs(h).alias("h"))
    return out.select("id", (F.col("h") % 800 - 400).alias("x"), ((F.col("h") * 7) % 800 - 400).alias("y"))


def layout_edges(nodes: DataFrame, edges: DataFrame, hub_ids: DataFrame) -> DataFrame:
    """Edges that pull: both ends are nodes, and no physical edge touches a hub."""
    hub = hub_ids.select(F.col("node").alias("hub")).distinct()
    inside = prune_few(nodes, edges)
    hub = settle(hub)
    hub = F.broadcast(hub) if small(hub, 10_000) else hub
    for end in ("source", "target"):
        inside = inside.join(hub, (F.col(end) == F.col("hub")) & (F.col("type") == "PHYSICAL"), "left_anti")
    return inside


def bounding_box(points: DataFrame, padding: float) -> DataFrame:
    return points.agg(*[(f(c) + F.lit(sign * padding)).alias(f"{n}_{c}") for c in ("x", "y") for f, n, sign in ((F.min, "min", -1), (F.max, "max", 1))])


def nearest_node(points: DataFrame, x: float, y: float) -> DataFrame:
    """The first node, by id, whose circle (its size, 6 if it has none, and 3 around) holds the point, its rim left out."""
    inside = F.pow(F.col("x") - x, 2) + F.pow(F.col("y") - y, 2) < F.pow(F.coalesce("size", F.lit(6.0)) + 3, 2)
    return points.where(inside).orderBy("id").limit(1)


def nearest_edge(segments: DataFrame, x: float, y: float, zoom: float = 1.0) -> DataFrame:
    """The edge (x1, y1, x2, y2) nearest to the point, if nearer than 12 / zoom; none below a zoom of 0.1."""
    if zoom < 0.1:
        segments = segments.limit(0)
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    length = dx * dx + dy * dy
    t = F.when(length == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - F.col("x1")) * dx + (y - F.col("y1")) * dy) / length)))
    away = F.sqrt(F.pow(F.col("x1") + t * dx - x, 2) + F.pow(F.col("y1") + t * dy - y, 2))
    return segments.withColumn("away", away).where(F.col("away") < 12 / zoom).orderBy("away", "source", "target").limit(1)


def in_view(points: DataFrame, camera: tuple[float, float], zoom: float, width: float, height: float) -> DataFrame:
    """Points on a screen of so many pixels around the camera, twice their size allowed for, with `labelled`.

    From a zoom of 1.4 on all have labels; hubs and sizes of 9 on have them from 0.45 on, less on screens larger than
    1200 by 800, in proportion to their area.
    """
    at = lambda c, middle, half: (F.col(c) - middle) * zoom + half / 2
    sx, sy, wide = at("x", camera[0], width), at("y", camera[1], height), F.coalesce("size", F.lit(6.0)) * 2
    seen = points.where((sx + wide >= 0) & (sx - wide <= width) & (sy + wide >= 0) & (sy - wide <= height))
    prominent = zoom >= 0.45 * min(1.0, 1200 * 800 / (width * height))
    return seen.withColumn("labelled", F.lit(zoom >= 1.4) | (F.lit(prominent) & (F.col("hub") | (F.coalesce("size", F.lit(6.0)) >= 9))))
