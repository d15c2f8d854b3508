"""A compiled graph and the questions it answers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import community, graph, rules

TEXT_CHARS = 4  # characters that count as a token


def clamp(value: object, default: int, low: int, high: int) -> int:
    """The whole number that a parameter begins with: 0 and what begins with none mean the default; then within bounds."""
    found = re.match(r"\s*([+-]?[0-9]+)", str(value))
    return max(low, min(high, int(found[1]) if found and int(found[1]) else default))


class Graph:
    """nodes (with community), edges, hub ids (node) and rules. Every answer is a DataFrame, or text where that is asked for.

    A compiled graph also has what it was made of: imports as they stand in the files (caller, kind, local, imported,
    specifier, pos), exports (file, symbol, target_file, target_symbol, star_pos, pos), bindings (caller, local_key,
    target_file, target_symbol, kind) and default_exports (file, symbol).
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame, hubs: DataFrame | None = None, rule_list: list | None = None, chunks: DataFrame | None = None, **made_of: DataFrame):
        self.nodes, self.edges, self.rules, self.chunks = nodes, edges, rule_list or [], chunks
        self.imports, self.exports, self.bindings, self.default_exports = (made_of.get(x) for x in ("imports", "exports", "bindings", "default_exports"))
        self.hubs = hubs if hubs is not None else graph.hubs(edges)

    @property
    def communities(self) -> DataFrame:
        return self.nodes.select(F.col("id").alias("node"), "community")

    def register(self, prefix: str = "") -> None:
        """Views nodes, edges and hubs for SQL."""
        for name in ("nodes", "edges", "hubs"):
            getattr(self, name).createOrReplaceTempView(prefix + name)

    def violations(self) -> DataFrame:
        """Suspicious edges with their ends' labels and files, a severity, and the reason that the edge carries (rationale), if any."""
        reason = F.coalesce("rationale", F.lit("")) if "rationale" in self.edges.columns else F.lit("")
        end = lambda side, to: self.nodes.select(F.col("id").alias(side), F.col("label").alias(f"{to}_label"), F.col("source_file").alias(f"{to}_file"))
        out = self.edges.where("type = 'SUSPICIOUS'").select("source", "target", "relation", "score", reason.alias("reason"))
        out = out.join(end("source", "from"), "source", "left").join(end("target", "to"), "target", "left")
        return out.withColumn("severity", community.severity(F.col("score")))

    def boundaries(self, file: str) -> dict:
        """Rules that touch a file, the rules broken on it (no cycles), and how many files depend on it. ValueError without a file."""
        file = _path(file)
        if not file:
            raise ValueError("file is missing")
        hits = self.violations().where((F.col("relation") == "violates_boundary") & ((F.col("from_file") == file) | (F.col("to_file") == file)))
        ids = self.nodes.where((F.col("source_file") == file) & F.col("source_location").isNull()).select("id").limit(1).collect()
        count = graph.dependents(self.edges, ids[0].id).count() if ids else 0
        return {"rules": rules.rules_touching(self.rules, file), "violations": hits, "dependents": count}

    def overview(self) -> DataFrame:
        return community.overview(self.nodes, graph.degree_distinct(self.edges), self.hubs)

    def overview_text(self) -> str:
        said = self.overview_json()
        head = f"GRAPH {said['nodes']} nodes, {said['edges']} edges, {len(said['communities'])} communities"
        return "\n".join([head, *[f"COMMUNITY {c['id']} ({c['size']} nodes) hub={c['hub']} | {', '.join(c['top'])}" for c in said["communities"]]])

    def overview_json(self) -> dict:
        """The overview, the largest community first, then by id; a hub by its label and its id."""
        rows = self.overview().join(self.nodes.select(F.col("id").alias("hub"), F.col("label").alias("hub_label")), "hub", "left").orderBy(F.desc("size"), "community").collect()
        listed = [{"id": r.community, "size": r["size"], "hub": r.hub_label or r.hub, "hub_id": r.hub, "top": r.labels} for r in rows]
        return {"nodes": self.nodes.count(), "edges": self.edges.count(), "communities": listed}

    def neighbourhood(self, node: str, depth: object = 2, budget: object = 1500, cost: Column | None = None) -> tuple[DataFrame, DataFrame]:
        """Ranked nodes (distance, degree, rank, kept) and, among those kept, the edges. ValueError without a node, KeyError for an unknown one.

        What a node costs is the length of its line, unless told otherwise. Nodes that no budget would reach are left out.
        """
        if not node:
            raise ValueError("node is missing")
        if self.nodes.where(F.col("id") == node).isEmpty():
            raise KeyError(node)
        cost, least = (F.length(node_line()) + 1, 12) if cost is None else (cost, 2)
        near = graph.neighbourhood(self.edges, node, clamp(depth, 2, 1, 5))
        ranked = near.join(self.nodes, near["node"] == self.nodes["id"]).join(graph.degree_distinct(self.edges), "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
        ranked = graph.within_budget(ranked, [F.col("distance"), F.desc("degree"), F.col("id")], cost, clamp(budget, 1500, 100, 50_000), TEXT_CHARS, least)
        kept = ranked.where("kept")
        return ranked, graph.induced_edges(kept, self.edges.where("type <> 'SUSPICIOUS'"))

    def neighbourhood_text(self, node: str, depth: object = 2, budget: object = 1500) -> str:
        ranked, edges = self.neighbourhood(node, depth, budget)
        lines = [r.line for r in ranked.where("kept").orderBy("rank").select(node_line().alias("line")).collect()]
        links = [r.line for r in edges.orderBy("source", "relation", "target").select(edge_line().alias("line")).collect()]
        cut = "" if ranked.where("NOT kept").isEmpty() else " (truncated to budget)"
        head = f"NEIGHBORHOOD root={node} depth={clamp(depth, 2, 1, 5)} | {len(lines)} nodes, {len(links)} edges{cut}"
        return "\n".join([head, *lines, *links])

    def neighbourhood_json(self, node: str, depth: object = 2, budget: object = 1500) -> dict:
        """The neighbourhood with whole nodes and edges; a node costs the length of its JSON."""
        cols = [c for c in self.nodes.columns]
        ranked, edges = self.neighbourhood(node, depth, budget, F.length(F.to_json(F.struct(*cols))))
        nodes = [r.asDict(True) for r in ranked.where("kept").orderBy("rank").select(*cols).collect()]
        links = [r.asDict(True) for r in edges.orderBy("source", "relation", "target").collect()]
        return {"root": node, "depth": clamp(depth, 2, 1, 5), "truncated": not ranked.where("NOT kept").isEmpty(), "nodes": nodes, "edges": links}

    def resolve(self, file: str, symbol: str | None = None) -> DataFrame:
        """(id, label, source_location) of a file's own node, or of its nodes with the label that the symbol's last dotted part is, capitals alike.

        ValueError without a file, KeyError where the file has no nodes.
        """
        file, symbol = _path(file), (symbol or "").strip()
        if not file:
            raise ValueError("file is missing")
        found = self.nodes.where(_plain_path(F.col("source_file")) == file).select("id", "label", "source_location")
        if found.isEmpty():
            raise KeyError(file)
        if not symbol:
            return found.orderBy(F.col("id").contains(":"), "id").limit(1)
        return found.where(F.lower("label") == symbol.split(".")[-1].lower())


def _path(path: str | None) -> str:
    return (path or "").replace("\\", "/").removeprefix("./")


def _plain_path(path: Column) -> Column:
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^\./", "")


def node_line() -> Column:
    """`NODE id | label [location]`, `file` where a node has no location."""
    return F.concat(F.lit("NODE "), F.col("id"), F.lit(" | "), F.col("label"), F.lit(" ["), F.coalesce("source_location", F.lit("file")), F.lit("]"))


def edge_line() -> Column:
    """`EDGE source --relation--> target`."""
    return F.concat(F.lit("EDGE "), "source", F.lit(" --"), "relation", F.lit("--> "), "target")
