"""The registered queries of the graph operators over the driver's tables, each with DuckDB SQL that says the same."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import ids
from .functions.lineage import settle, shared_folder, with_rank, written
from .operators import change, community, graph, reach, resolve, rules
from .operators.resolve import GENERIC
from .plans import projections as P
from .plans.compile import with_files
from .plans.serve import Graph
from .sources import files as sources
from .sources.extract import extract

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# ---- the graphs, in SQL ------------------------------------------------------------------------------------------

TRADE = """
tnodes AS (SELECT 'nation_'||n_nationkey AS id, n_name AS label, r_name||'/'||n_name AS source_file, CAST(n_regionkey AS BIGINT) AS community FROM nation JOIN region ON n_regionkey = r_regionkey),
sold AS (SELECT c_nationkey AS cn, s_nationkey AS sn, sum(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2),
tedges AS (SELECT 'nation_'||cn AS source, 'nation_'||sn AS target, 'imports' AS relation, 'PHYSICAL' AS type, CAST(1 AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY cn ORDER BY q DESC, n_name) AS r FROM sold JOIN nation ON sn = n_nationkey) WHERE r <= 2)"""
NEXT = """
led AS (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS b FROM lineitem),
nedges AS (SELECT 'part_'||a AS source, 'part_'||b AS target FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY count(*) DESC, b) AS r FROM led WHERE b IS NOT NULL GROUP BY a, b) WHERE r = 1)"""
MARKET = """
medges AS (SELECT DISTINCT 'supplier_'||l_suppkey AS source, 'part_'||l_partkey AS target FROM lineitem UNION ALL SELECT DISTINCT 'customer_'||o_custkey, 'part_'||l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
TREE = """
rnodes AS (
 SELECT 'region_'||r_regionkey AS id, r_name AS label, r_name AS source_file, CAST(r_regionkey AS BIGINT) AS community FROM region
 UNION ALL SELECT 'nation_'||n_nationkey, n_name, r_name||'/'||n_name, n_regionkey FROM nation JOIN region ON n_regionkey = r_regionkey
 UNION ALL SELECT 'supplier_'||s_suppkey, s_name, r_name||'/'||n_name||'/'||s_name, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
 UNION ALL SELECT 'customer_'||c_custkey, c_name, r_name||'/'||n_name||'/'||c_name, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
redges AS (SELECT 'region_'||n_regionkey AS source, 'nation_'||n_nationkey AS target FROM nation UNION ALL SELECT 'nation_'||s_nationkey, 'supplier_'||s_suppkey FROM supplier UNION ALL SELECT 'nation_'||c_nationkey, 'customer_'||c_custkey FROM customer)"""
RULES = [
    {"from": "ASIA/**", "to": "MIDDLE EAST/**"},
    {"from": "**", "to": "AMERICA/**", "except": ["AMERICA/NATION_11"], "severity": "warn"},
    {"from": "MIDDLE EAST/**", "to": "**", "severity": "warn", "reason": "the middle east buys at home"},
]
HITS = """
filed AS (SELECT e.source, e.target, a.source_file AS from_file, b.source_file AS to_file FROM tedges e JOIN tnodes a ON e.source = a.id JOIN tnodes b ON e.target = b.id),
hits AS (SELECT *, CASE WHEN regexp_matches(from_file, '^ASIA/.*$') AND regexp_matches(to_file, '^MIDDLE EAST/.*$') THEN 0 WHEN regexp_matches(to_file, '^AMERICA/.*$') AND to_file <> 'AMERICA/NATION_11' THEN 1 WHEN regexp_matches(from_file, '^MIDDLE EAST/.*$') THEN 2 END AS rule_pos FROM filed)"""


def reaching(edges: str, name: str = "reach") -> str:
    return f"{name} AS (SELECT source AS node, target AS root FROM {edges} UNION SELECT e.source, r.root FROM {edges} e JOIN {name} r ON e.target = r.node)"


def cyc(edges: str) -> str:
    """Cycle edges of a table of edges, through mutual reachability."""
    return (
        reaching(edges)
        + f""",
mutual AS (SELECT a.node, a.root AS other FROM reach a JOIN reach b ON a.node = b.root AND a.root = b.node WHERE a.node <> a.root),
comp AS (SELECT node, least(node, min(other)) AS component, count(DISTINCT other) + 1 AS size FROM mutual GROUP BY node),
cyc AS (SELECT DISTINCT e.source, e.target, a.component, a.size, least(CAST(1 AS DOUBLE), CAST(0.4 AS DOUBLE) + CAST(0.1 AS DOUBLE) * a.size) AS score FROM {edges} e JOIN comp a ON e.source = a.node JOIN comp b ON e.target = b.node WHERE a.component = b.component)"""
    )


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql.strip()
        return f

    return register


def checked_rules(spark: SparkSession) -> list[dict]:
    return rules.parse_rules({"boundaries": RULES}, spark)


def trade(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return P.trade_nodes(spark, sf), P.trade_edges(spark, sf)


def big(c: str):
    return F.col(c).cast("long").alias(c)


# ---- degrees, filters, sets --------------------------------------------------------------------------------------

_BOTH = "both_ AS (SELECT source AS node, target AS other FROM medges UNION ALL SELECT target, source FROM medges)"


@query(f"WITH {MARKET}, {_BOTH} SELECT node, count(*) AS degree FROM (SELECT DISTINCT node, other FROM both_) GROUP BY node")
def degree_distinct(spark, sf):
    return graph.degree_distinct(P.market_edges(spark, sf))


@query(f"WITH {MARKET}, {_BOTH} SELECT node, count(*) AS degree FROM both_ GROUP BY node")
def degree_multi(spark, sf):
    return graph.degree_multi(P.market_edges(spark, sf))


_HUBS = f"{MARKET}, {_BOTH}, deg AS (SELECT node, count(*) AS degree FROM both_ GROUP BY node), line AS (SELECT avg(degree) + 5 * stddev_pop(degree) AS line FROM deg), hubs AS (SELECT node, degree FROM deg, line WHERE degree > line AND degree > 50)"


@query(f"WITH {_HUBS} SELECT node, degree FROM hubs")
def hub_nodes(spark, sf):
    return graph.hubs(P.market_edges(spark, sf))


@query(f"WITH {TREE}, kept AS (SELECT id FROM rnodes WHERE NOT (id LIKE 'nation_%' AND TRY_CAST(substr(id, 8) AS INT) % 2 = 1)) SELECT source, target FROM redges WHERE source IN (SELECT id FROM kept) AND target IN (SELECT id FROM kept)")
def dangling_prune(spark, sf):
    odd = F.col("id").startswith("nation_") & (F.expr("try_cast(substr(id, 8) AS INT)") % 2 == 1)
    return graph.prune_dangling(P.tree_nodes(spark, sf).where(~odd), P.tree_edges(spark, sf)).select("source", "target")


@query(f"WITH {TREE} SELECT id, label FROM rnodes WHERE contains(lower(label), 'nation_1') OR contains(lower(id), 'nation_1') ORDER BY id LIMIT 8")
def search(spark, sf):
    return graph.search(P.tree_nodes(spark, sf), " Nation_1 ").select("id", "label")


@query(f"WITH {TREE} SELECT id FROM rnodes WHERE source_file LIKE 'ASIA/%' AND community = 2")
def facet_filter(spark, sf):
    return graph.facet_filter(P.tree_nodes(spark, sf), ["code", "document"], "ASIA/", [2]).select("id")


@query(f"WITH {TREE}, v AS (SELECT id FROM rnodes WHERE source_file LIKE 'ASIA%') SELECT source, target FROM redges WHERE source IN (FROM v) AND target IN (FROM v)")
def induced_edges(spark, sf):
    nodes = graph.facet_filter(P.tree_nodes(spark, sf), ["code"], "ASIA")
    return graph.induced_edges(nodes, P.tree_edges(spark, sf)).select("source", "target")


@query(f"""WITH {TRADE}, twice AS (SELECT source, target, relation, 2 AS position, score FROM tedges UNION ALL SELECT source, target, relation, 1, CAST(0.5 AS DOUBLE) FROM tedges)
SELECT 'out' AS direction, target AS other, relation, arg_min(score, position) AS score FROM twice WHERE source = 'nation_7' GROUP BY ALL UNION ALL SELECT 'in', source, relation, arg_min(score, position) FROM twice WHERE target = 'nation_7' GROUP BY ALL""")
def neighbors_in_out(spark, sf):
    """Every edge twice, the one that stands first with another score and a type that sorts last."""
    edges = P.trade_edges(spark, sf)
    first = edges.withColumns({"position": F.lit(1), "score": F.lit(0.5), "type": F.lit("SUSPICIOUS")})
    return graph.neighbours(edges.withColumn("position", F.lit(2)).unionByName(first), "nation_7")


@query(f"WITH {TRADE}, near AS (SELECT target AS n FROM tedges WHERE source = 'nation_7' UNION SELECT source FROM tedges WHERE target = 'nation_7') SELECT id, CAST(CASE WHEN id = 'nation_7' THEN 2 WHEN id IN (FROM near) THEN 1 ELSE 0 END AS BIGINT) AS tier FROM tnodes")
def focus_tiers(spark, sf):
    return graph.focus_tiers(*trade(spark, sf), "nation_7").select("id", big("tier"))


_SUS = f"{TRADE}, {HITS}, every AS (SELECT source, target, type FROM tedges UNION ALL SELECT source, target, 'SUSPICIOUS' FROM hits WHERE rule_pos IS NOT NULL)"


def _with_suspicious(spark, sf):
    nodes, edges = trade(spark, sf)
    hits = rules.violations(with_files(nodes, edges), checked_rules(spark))
    sus = hits.select("source", "target", F.lit("violates_boundary").alias("relation"), F.lit("SUSPICIOUS").alias("type"), F.col("violation_score").alias("score"), F.col("reason").alias("rationale"))
    return nodes, edges.unionByName(sus, allowMissingColumns=True)


@query(f"WITH {_SUS} SELECT source, target, type FROM every e WHERE type = 'SUSPICIOUS' OR NOT EXISTS (SELECT 1 FROM every s WHERE s.type = 'SUSPICIOUS' AND least(s.source, s.target) = least(e.source, e.target) AND greatest(s.source, s.target) = greatest(e.source, e.target))")
def suppressed_edges(spark, sf):
    return graph.suppress_covered(_with_suspicious(spark, sf)[1]).select("source", "target", "type")


# ---- cycles and reach --------------------------------------------------------------------------------------------


@query(f"WITH RECURSIVE {TRADE}, {cyc('tedges')} SELECT source, target, component, CAST(size AS BIGINT) AS size, round(score, 6) AS score FROM cyc")
def cycle_edges_trade(spark, sf):
    return graph.cycle_edges(P.trade_edges(spark, sf)).select("source", "target", "component", big("size"), F.round("score", 6).alias("score"))


@query(f"WITH RECURSIVE {NEXT}, {cyc('nedges')} SELECT source, target, component, CAST(size AS BIGINT) AS size, round(score, 6) AS score FROM cyc")
def cycle_edges_next(spark, sf):
    return graph.cycle_edges(P.next_edges(spark, sf)).select("source", "target", "component", big("size"), F.round("score", 6).alias("score"))


@query(f"WITH RECURSIVE {NEXT}, {cyc('nedges')} SELECT source, target, component, CAST(size AS BIGINT) AS size, round(score, 6) AS score FROM cyc")
def cycle_edges_far(spark, sf):
    """The cycles of cycle_edges_next, found over tables: no edge goes to the driver."""
    return graph.cycle_edges(P.next_edges(spark, sf), driver_edges=0).select("source", "target", "component", big("size"), F.round("score", 6).alias("score"))


@query(f"WITH RECURSIVE {NEXT}, {cyc('nedges')} SELECT 'cycle_'||string_agg(DISTINCT source, '_' ORDER BY source) AS key, count(*) AS n_edges, round(max(score), 6) AS score FROM cyc GROUP BY component")
def warning_groups(spark, sf):
    return graph.warning_groups(graph.cycle_edges(P.next_edges(spark, sf))).select("key", "n_edges", F.round("score", 6).alias("score"))


@query()
def cycle_walk(spark, sf):
    return graph.warning_groups(graph.cycle_edges(P.trade_edges(spark, sf)), walks=True).select("key", F.array_join("walk", ",").alias("walk"))


def _and_others(edges):
    """Edges and, the other way round, ones that make nothing depend on another: cognitive imports and physical calls."""
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "relation", "type", "score")
    return edges.unionByName(back.withColumn("type", F.lit("COGNITIVE"))).unionByName(back.withColumn("relation", F.lit("calls")))


@query(f"WITH RECURSIVE {TRADE}, {reaching('tedges')} SELECT root, node FROM reach")
def blast_radius_all(spark, sf):
    return graph.all_dependents(_and_others(P.trade_edges(spark, sf))).select("root", "node")


@query(f"""WITH RECURSIVE {NEXT}, {reaching('nedges')}, n AS (SELECT root, count(*) AS n, bool_or(node = root) AS ring FROM reach GROUP BY root),
f AS (SELECT e.node, coalesce(n, 0) AS n, coalesce(ring, false) AS ring FROM (SELECT source AS node FROM nedges UNION SELECT target FROM nedges) e LEFT JOIN n ON e.node = root)
SELECT node, CASE WHEN n + (NOT ring)::INT <= 512 THEN n END AS dependents, n + (NOT ring)::INT <= 512 AS exact FROM f""")
def blast_counts(spark, sf):
    """How many nodes lead to each, without pairs. Counts that are estimates are null here, so that SQL can say the same; tests hold them against their stated error."""
    out = reach.dependent_counts(_and_others(P.next_edges(spark, sf)))
    return out.select("node", F.when(F.col("exact"), F.col("dependents")).alias("dependents"), "exact")


@query(f"WITH RECURSIVE {NEXT}, r AS (SELECT source AS node FROM nedges WHERE target = 'part_1' UNION SELECT e.source FROM nedges e JOIN r ON e.target = r.node) SELECT node FROM r")
def blast_radius(spark, sf):
    return graph.dependents(_and_others(P.next_edges(spark, sf)), "part_1")


_HOP = "step AS (SELECT source AS a, target AS b FROM redges UNION SELECT target, source FROM redges), hop AS (SELECT 'nation_7' AS node, 0 AS d UNION SELECT b, d + 1 FROM hop JOIN step ON node = a WHERE d < 2), near AS (SELECT node, min(d) AS distance FROM hop GROUP BY node)"


@query(f"WITH RECURSIVE {TREE}, {_HOP} SELECT node, CAST(distance AS BIGINT) AS distance FROM near")
def khop_neighborhood(spark, sf):
    return graph.neighbourhood(P.tree_edges(spark, sf), "nation_7", 2).select("node", big("distance"))


@query(f"""WITH RECURSIVE {TREE}, {_HOP}, deg AS (SELECT a AS node, count(DISTINCT b) AS degree FROM step GROUP BY a),
ranked AS (SELECT near.node, distance, degree, row_number() OVER w AS rank, sum(length('NODE '||id||' | '||label||' [file]') + 1) OVER (w ROWS UNBOUNDED PRECEDING) AS spent FROM near JOIN rnodes ON node = id JOIN deg ON deg.node = near.node WINDOW w AS (ORDER BY distance, degree DESC, near.node))
SELECT node, CAST(distance AS BIGINT) AS distance, CAST(degree AS BIGINT) AS degree, CAST(rank AS BIGINT) AS rank, CAST(spent AS BIGINT) AS spent FROM ranked WHERE rank = 1 OR spent <= 400 * 4""")
def khop_budgeted(spark, sf):
    nodes, edges = P.tree_nodes(spark, sf).withColumn("source_location", F.lit(None).cast("string")), P.tree_edges(spark, sf)
    ranked, _ = Graph(nodes, edges, hubs=nodes.limit(0).select(F.col("id").alias("node"))).neighbourhood("nation_7", 2, 400)
    return ranked.where("kept").select("node", *map(big, ("distance", "degree", "rank", "spent")))


# ---- rules -------------------------------------------------------------------------------------------------------


@query(f"WITH {TRADE}, {HITS} SELECT source, target, CAST(rule_pos AS BIGINT) AS rule_pos, CASE WHEN rule_pos = 0 THEN 'error' ELSE 'warn' END AS severity, CASE rule_pos WHEN 0 THEN 'Forbidden import: ASIA/** must not import MIDDLE EAST/**' WHEN 1 THEN 'Forbidden import: ** must not import AMERICA/**' ELSE 'the middle east buys at home' END AS reason FROM hits WHERE rule_pos IS NOT NULL")
def boundary_violations(spark, sf):
    return rules.violations(with_files(*trade(spark, sf)), checked_rules(spark)).select("source", "target", big("rule_pos"), "severity", "reason")


#: Five hundred rules over nations' and customers' files: globs with and without a literal folder, exceptions, regexes.
MANY = [
    {"from": ("AMERICA", "ASIA", "EUROPE")[k % 3] + f"/NATION_{k % 23}" if k % 2 else f"*/NATION_{k % 25}", "to": f"*/NATION_{k % 25}/Customer*{k % 10}{k % 7}", "except": [f"**{k % 9}{k % 7}"] if k % 4 == 0 else []}
    if k % 5
    else {"from": f"NATION_{k % 25}$", "to": f"#0*{k}$", "pathKind": "regex", "severity": "warn"}
    for k in range(500)
]


def _many_sql() -> str:
    """The rules as a table of patterns; an exception that is none matches nothing."""
    rows = []
    for k, rule in enumerate(MANY):
        pattern = lambda p, kind=rule.get("pathKind", "glob"): rules.pattern_of(p, kind).replace("'", "''")
        rows.append(f"({k}, '{pattern(rule['from'])}', '{pattern(rule['to'])}', '{pattern(rule['except'][0]) if rule.get('except') else '^$'}')")
    return "many(pos, a, b, but) AS (VALUES " + ", ".join(rows) + ")"


@query(f"""WITH {TREE}, {_many_sql()}, f AS (SELECT e.source, e.target, a.source_file AS x, b.source_file AS y FROM redges e JOIN rnodes a ON e.source = a.id JOIN rnodes b ON e.target = b.id WHERE e.target LIKE 'customer_%')
SELECT source, target, CAST(min(pos) AS BIGINT) AS rule_pos FROM f JOIN many ON regexp_matches(x, a) AND regexp_matches(y, b) AND NOT regexp_matches(y, but) GROUP BY source, target""")
def boundary_violations_many(spark, sf):
    edges = with_files(P.tree_nodes(spark, sf), P.tree_edges(spark, sf).where(F.col("target").startswith("customer_")))
    return rules.violations(edges, rules.parse_rules({"boundaries": MANY}, spark)).select("source", "target", big("rule_pos"))


@query(f"""WITH RECURSIVE {TRADE}, {HITS}, r AS (SELECT source AS node FROM tedges WHERE target = 'nation_4' UNION SELECT e.source FROM tedges e JOIN r ON e.target = r.node),
f AS (SELECT source_file AS file FROM tnodes WHERE id = 'nation_4')
SELECT f.file, CAST(1 + regexp_matches(file, '^(ASIA|MIDDLE EAST)/')::INT + (regexp_matches(file, '^AMERICA/') OR TRUE)::INT AS BIGINT) AS n_rules, (SELECT count(*) FROM hits WHERE rule_pos IS NOT NULL AND (from_file = file OR to_file = file)) AS n_violations, (SELECT count(*) FROM r) AS dependents FROM f""")
def boundary_briefing(spark, sf):
    nodes, edges = _with_suspicious(spark, sf)
    file = nodes.where("id = 'nation_4'").select("source_file").first()[0]
    said = Graph(nodes, edges, hubs=nodes.limit(0).select(F.col("id").alias("node")), rule_list=checked_rules(spark)).boundaries(file)
    return said["violations"].agg(F.lit(file).alias("file"), F.lit(len(said["rules"])).cast("long").alias("n_rules"), F.count(F.lit(1)).alias("n_violations"), F.lit(said["dependents"]).cast("long").alias("dependents"))


@query(f"""WITH RECURSIVE {TRADE}, {HITS}, {cyc('tedges')},
sus AS (SELECT source, target, 'circular_dependency' AS relation, score, '' AS reason FROM cyc UNION ALL SELECT source, target, 'violates_boundary', CASE WHEN rule_pos = 0 THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END, CASE rule_pos WHEN 0 THEN 'Forbidden import: ASIA/** must not import MIDDLE EAST/**' WHEN 1 THEN 'Forbidden import: ** must not import AMERICA/**' ELSE 'the middle east buys at home' END FROM hits WHERE rule_pos IS NOT NULL)
SELECT source, target, relation, reason, round(score, 6) AS score, a.label AS from_label, a.source_file AS from_file, b.label AS to_label, b.source_file AS to_file, CASE WHEN score >= CAST(0.8 AS DOUBLE) THEN 'error' ELSE 'warn' END AS severity FROM sus LEFT JOIN tnodes a ON source = a.id LEFT JOIN tnodes b ON target = b.id""")
def violations(spark, sf):
    nodes, edges = _with_suspicious(spark, sf)
    cycles = graph.cycle_edges(edges).select("source", "target", F.lit("circular_dependency").alias("relation"), F.lit("SUSPICIOUS").alias("type"), "score")
    out = Graph(nodes, edges.unionByName(cycles, allowMissingColumns=True), hubs=nodes.limit(0).select(F.col("id").alias("node"))).violations()
    return out.select("source", "target", "relation", "reason", F.round("score", 6).alias("score"), "from_label", "from_file", "to_label", "to_file", "severity")


# ---- communities -------------------------------------------------------------------------------------------------

_DEG = "deg AS (SELECT node, count(DISTINCT other) AS degree FROM (SELECT source AS node, target AS other FROM redges UNION ALL SELECT target, source FROM redges) GROUP BY node)"


def _no_hubs(nodes):
    return nodes.limit(0).select(F.col("id").alias("node"))


@query(f"""WITH {TREE}, {_DEG}, ranked AS (SELECT community, id, label, row_number() OVER (PARTITION BY community ORDER BY coalesce(degree, 0) DESC, id) AS r FROM rnodes LEFT JOIN deg ON id = node)
SELECT community, count(*) AS size, min(CASE WHEN r = 1 THEN id END) AS hub, string_agg(CASE WHEN r <= 5 THEN label END, ',' ORDER BY r) AS labels FROM ranked GROUP BY community""")
def community_overview(spark, sf):
    nodes, edges = P.tree_nodes(spark, sf), P.tree_edges(spark, sf)
    out = community.overview(nodes, graph.degree_distinct(edges), _no_hubs(nodes))
    return out.select(big("community"), "size", "hub", F.array_join("labels", ",").alias("labels"))


_SUMMARY = f"""{TREE}, {_DEG.replace('count(DISTINCT other)', 'count(*)')}, rows_ AS (SELECT coalesce(community, 0) AS community, id, CASE WHEN contains(source_file, '/') THEN regexp_replace(source_file, '/[^/]*$', '') ELSE '(root)' END AS folder, source_file, coalesce(degree, 0) AS degree FROM rnodes LEFT JOIN deg ON id = node),
summary AS (SELECT community, count(*) AS size, CAST(floor(100.0 * count(*) / (SELECT count(*) FROM rows_) + 0.5) AS BIGINT) AS percent, (SELECT folder FROM rows_ f WHERE f.community = rows_.community GROUP BY folder ORDER BY count(*) DESC, folder LIMIT 1) AS folder, list_last(string_split((SELECT source_file FROM rows_ f WHERE f.community = rows_.community ORDER BY degree DESC, id LIMIT 1), '/')) AS hub_file FROM rows_ GROUP BY community)"""


@query(f"WITH {_SUMMARY} SELECT community, size, percent, folder, hub_file FROM summary".replace("list_last(string_split(", "list_extract(string_split(").replace("LIMIT 1), '/'))", "LIMIT 1), '/'), -1)"))
def community_summary(spark, sf):
    return community.summaries(P.tree_nodes(spark, sf), graph.degree_multi(P.tree_edges(spark, sf))).select(big("community"), "size", big("percent"), "folder", "hub_file")


@query(f"WITH {_SUMMARY} SELECT folder, CAST(sum(size) AS BIGINT) AS size, string_agg(CAST(community AS VARCHAR), ',' ORDER BY community) AS communities FROM summary GROUP BY folder".replace("list_last(string_split(", "list_extract(string_split(").replace("LIMIT 1), '/'))", "LIMIT 1), '/'), -1)"))
def folder_rollup(spark, sf):
    made = community.summaries(P.tree_nodes(spark, sf), graph.degree_multi(P.tree_edges(spark, sf)))
    return community.folder_rollup(made).select("folder", "size", F.array_join(F.transform("communities", lambda c: c.cast("string")), ",").alias("communities"))


_TWO = "SELECT 'customer_'||c_custkey AS node, CAST(c_nationkey AS BIGINT) AS community FROM customer"


def _clusterings(spark, sf):
    c = P.read(spark, sf, "customer")
    segments = {s: i for i, s in enumerate(("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))}
    number = F.coalesce(F.create_map(*[x for k, v in segments.items() for x in (F.lit(k), F.lit(v).cast("long"))])[F.col("c_mktsegment")], F.lit(9).cast("long"))
    node = F.concat(F.lit("customer_"), F.col("c_custkey").cast("string")).alias("node")
    return c.select(node, F.col("c_nationkey").cast("long").alias("community")), c.select(node, number.alias("community"))


@query(f"""WITH new AS ({_TWO}), old AS (SELECT 'customer_'||c_custkey AS node, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 WHEN 'HOUSEHOLD' THEN 3 WHEN 'MACHINERY' THEN 4 ELSE 9 END AS community FROM customer),
n AS (SELECT community, count(*) AS n FROM new GROUP BY 1), o AS (SELECT community, count(*) AS o FROM old GROUP BY 1), both_ AS (SELECT a.community AS new, b.community AS old, count(*) AS both_ FROM new a JOIN old b USING (node) GROUP BY 1, 2)
SELECT new, CAST(old AS BIGINT) AS old, round(both_ / (n + o - both_), 9) AS score FROM both_ JOIN n ON new = n.community JOIN o ON old = o.community""")
def community_jaccard(spark, sf):
    new, old = _clusterings(spark, sf)
    return community.jaccard(new, old).select("new", "old", F.round("score", 9).alias("score"))


@query()
def stabilize(spark, sf):
    return community.stabilize(*_clusterings(spark, sf))


# Cognitive relations with scores: those that bind, some that don't, and one whose score counts whole.
_RELATIONS = {"rationale_for": 0.9, "implements": 0.8, "constrains": 0.7, "motivates": 0.6, "contradicts": 0.5, "references": 0.4, "mentions": 0.9, "relates_to": 0.9, "depends_on": 0.9, "explains": 0.9, "contains": 0.0}
_MIXED = "mixed AS (SELECT source, target, relation, type, score FROM tedges" + "".join(f" UNION ALL SELECT source, target, '{r}', 'COGNITIVE', CAST({s} AS DOUBLE) FROM tedges" for r, s in _RELATIONS.items()) + ")"


@query(f"WITH {TRADE}, {_MIXED}, scored AS (SELECT source, target, CASE WHEN type = 'PHYSICAL' OR relation = 'contains' THEN score WHEN relation IN ('rationale_for', 'implements', 'constrains', 'motivates', 'contradicts', 'references') THEN score * CAST(0.3 AS DOUBLE) END AS score FROM mixed) SELECT least(source, target) AS a, greatest(source, target) AS b, round(sum(CASE WHEN score = 0 THEN 1 ELSE score END), 6) AS weight FROM scored WHERE score IS NOT NULL GROUP BY ALL")
def cluster_weights(spark, sf):
    e = P.trade_edges(spark, sf)
    kind = lambda r, s: e.select("source", "target", F.lit(r).alias("relation"), F.lit("COGNITIVE").alias("type"), F.lit(s).alias("score"))
    every = functools.reduce(DataFrame.unionByName, [kind(r, s) for r, s in _RELATIONS.items()], e)
    return community.pair_weights(community.clustering_edges(every)).select("a", "b", F.round("weight", 6).alias("weight"))


@query()
def louvain(spark, sf):
    return community.detect(*trade(spark, sf))


# ---- change ------------------------------------------------------------------------------------------------------

_SNAPS = """old AS (SELECT p_partkey AS id, p_name AS label, p_size AS size FROM part WHERE p_partkey % 10 <> 0), new AS (SELECT p_partkey AS id, p_name AS label, CASE WHEN p_partkey % 7 = 0 THEN p_size + 1 ELSE p_size END AS size FROM part WHERE p_partkey % 10 <> 1)"""


def _snapshots(spark, sf):
    p = P.read(spark, sf, "part")
    pick = lambda df, size: df.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), size.cast("long").alias("size"))
    return pick(p.where("p_partkey % 10 <> 0"), F.col("p_size")), pick(p.where("p_partkey % 10 <> 1"), F.when(F.col("p_partkey") % 7 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))


@query(f"WITH {_SNAPS} SELECT coalesce(old.id, new.id) AS id, CASE WHEN old.id IS NULL THEN 'added' WHEN new.id IS NULL THEN 'removed' ELSE 'updated' END AS op FROM old FULL JOIN new ON old.id = new.id WHERE old.id IS NULL OR new.id IS NULL OR old.label IS DISTINCT FROM new.label OR old.size IS DISTINCT FROM new.size")
def snapshot_diff(spark, sf):
    return change.snapshot_diff(*_snapshots(spark, sf), "id")


@query(f"WITH {_SNAPS} SELECT id, label, CAST(size AS BIGINT) AS size FROM new")
def diff_apply(spark, sf):
    old, new = _snapshots(spark, sf)
    ops = change.snapshot_diff(old, new, "id")
    feed = ops.join(new, "id", "left").withColumn("seq", F.lit(1))
    return change.apply_changes(old, feed, "id")


@query("WITH a AS (SELECT 'n'||p_partkey AS id, p_name AS label FROM part), b AS (SELECT 'n'||s_suppkey AS id, s_name AS label FROM supplier) SELECT coalesce(b.id, a.id) AS id, coalesce(b.label, a.label) AS label FROM a FULL JOIN b ON a.id = b.id")
def layer_merge(spark, sf):
    named = lambda t, k, n: P.read(spark, sf, t).select(F.concat(F.lit("n"), F.col(k).cast("string")).alias("id"), F.col(n).alias("label"))
    return change.merge_layers([named("part", "p_partkey", "p_name"), named("supplier", "s_suppkey", "s_name")])


def _concepts(spark, sf):
    d = P.read(spark, sf, "documents")
    return d.select(F.concat(F.lit("concept_"), F.col("doc_id").cast("string")).alias("id"), F.col("lang").alias("label"), F.lit("concept").alias("file_type"), F.concat(F.lit("docs/"), F.col("source"), F.lit(".md")).alias("source_file"))


_DOCS = "docs AS (SELECT DISTINCT 'docs/'||source||'.md' AS source_file, 'doc_'||regexp_replace(regexp_replace(lower('docs/'||source||'.md'), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')||'_'||substr(sha256('docs/'||source||'.md'), 1, 8) AS id FROM documents)"


@query(f"WITH {_DOCS} SELECT id, list_extract(string_split(source_file, '/'), -1) AS label, source_file FROM docs")
def derive_documents(spark, sf):
    return change.derive_documents(_concepts(spark, sf))[0].select("id", "label", "source_file")


@query(f"WITH {_DOCS} SELECT id AS source, 'concept_'||doc_id AS target FROM documents JOIN docs ON source_file = 'docs/'||source||'.md'")
def derived_edges(spark, sf):
    return change.derive_documents(_concepts(spark, sf))[1].select("source", "target")


@query("""WITH c AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '/abs/' WHEN doc_id % 13 = 0 THEN 'a/../' ELSE 'docs/' END||source AS file, CASE WHEN doc_id % 5 = 0 THEN 'picture' ELSE 'concept' END AS kind, coalesce(quality, 0) + CASE WHEN doc_id % 17 = 0 THEN 1 ELSE 0 END AS score FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, kind = 'concept' AND file NOT LIKE '/%' AND file NOT LIKE '%..%' AND score BETWEEN 0 AND 1 AS valid FROM c""")
def validate_chunk(spark, sf):
    d = P.read(spark, sf, "documents").join(P.read(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    i = F.col("doc_id")
    file = F.concat(F.when(i % 11 == 0, "/abs/").when(i % 13 == 0, "a/../").otherwise("docs/"), F.col("source"))
    node = F.struct(i.cast("string").alias("id"), F.col("lang").alias("label"), F.when(i % 5 == 0, "picture").otherwise("concept").alias("file_type"), file.alias("source_file"), F.lit(None).cast("string").alias("source_location"))
    score = (F.coalesce("quality", F.lit(0)) + F.when(i % 17 == 0, 1).otherwise(0)).cast("double")
    edge = F.struct(i.cast("string").alias("source"), F.lit("x").alias("target"), F.lit("implements").alias("relation"), F.lit("COGNITIVE").alias("type"), score.alias("score"), F.lit(None).cast("string").alias("source_file"), F.lit(None).cast("map<string,string>").alias("metadata"))
    return d.select("doc_id", change.valid_chunk(F.array(node), F.array(edge)).alias("valid"))


@query("""WITH v AS (SELECT *, event_id AS arrival, epoch_us(ts) // 1000 AS at_ms FROM events), last AS (SELECT 'user_'||user_id AS file, arg_max(event_type, arrival) AS activity, arg_max(at_ms, arrival) AS timestamp, greatest(1000, least(3600000, coalesce(nullif(CAST(arg_max(CASE WHEN event_id % 7 = 0 THEN 0 ELSE floor(value * 40000) END, arrival) AS BIGINT), 0), 60000))) AS ttl FROM v GROUP BY user_id)
SELECT file, activity, timestamp, CAST(ttl AS BIGINT) AS ttl FROM last WHERE (SELECT max(at_ms) FROM v) - timestamp <= ttl""")
def focus_active(spark, sf):
    e = P.read(spark, sf, "events")
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    now = e.agg(F.max(at)).first()[0] or 0
    rows = e.select(F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("file"), F.col("event_type").alias("activity"), at.alias("timestamp"), F.when(F.col("event_id") % 7 == 0, 0).otherwise(F.floor(F.col("value") * 40000)).cast("long").alias("ttl"), F.col("event_id").alias("arrival"))
    return change.active_focus(rows, now)


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 120 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts)) // 1000 AS start_ms, count(*) AS n FROM s GROUP BY user_id, k""")
def session_bursts(spark, sf):
    e = P.read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return change.bursts(e, "user_id", "ts", "120 minutes").select("user_id", F.unix_millis("start").alias("start_ms"), "n")


_PARTS = """before AS (SELECT p_partkey AS id, p_name AS label, p_brand AS source_file, CAST(p_size AS VARCHAR) AS content_hash, p_partkey % 5 AS community FROM part WHERE p_partkey % 10 <> 0),
after AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 11 = 0 THEN 'new' ELSE p_name END AS label, CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_brand END AS source_file, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE CAST(p_size AS VARCHAR) END AS content_hash, p_partkey % 3 AS community FROM part WHERE p_partkey % 10 <> 1)"""


@query(f"""WITH {_PARTS} SELECT a.id, CASE WHEN b.id IS NULL THEN 'added' ELSE 'updated' END AS op, b.id IS NULL OR a.label IS DISTINCT FROM b.label OR a.source_file IS DISTINCT FROM b.source_file OR a.content_hash IS DISTINCT FROM b.content_hash AS changed FROM after a LEFT JOIN before b ON a.id = b.id
WHERE b.id IS NULL OR a.label IS DISTINCT FROM b.label OR a.source_file IS DISTINCT FROM b.source_file OR a.content_hash IS DISTINCT FROM b.content_hash OR a.community <> b.community""")
def code_changes(spark, sf):
    """New labels, lost files and lost hashes are changes of code; another community is none."""
    k, none = F.col("p_partkey"), F.lit(None).cast("string")
    size = F.col("p_size").cast("string")
    make = lambda df, label, file, content, m: df.select(k.alias("id"), label.alias("label"), file.alias("source_file"), content.alias("content_hash"), (k % m).alias("community"))
    part = P.read(spark, sf, "part")
    before = make(part.where(k % 10 != 0), F.col("p_name"), F.col("p_brand"), size, 5)
    after = make(part.where(k % 10 != 1), F.when(k % 11 == 0, "new").otherwise(F.col("p_name")), F.when(k % 13 == 0, none).otherwise(F.col("p_brand")), F.when(k % 17 == 0, none).otherwise(size), 3)
    return change.code_changes(before, after)


@query("""WITH every AS (SELECT o_custkey AS id, CAST(o_orderkey AS BIGINT) AS arrival, o_orderpriority AS title, epoch_ms(CAST(o_orderdate AS TIMESTAMP)) AS ts FROM orders UNION ALL SELECT c_custkey, -1, c_name, NULL FROM customer)
SELECT id, arg_max(title, arrival) AS title, arg_max(coalesce(ts, 0), arrival) AS "timestamp" FROM every GROUP BY id""")
def tour_upsert(spark, sf):
    """Customers are tours, and each order is a message that replaces its customer's."""
    tours = P.read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.lit(None).cast("long").alias("timestamp"))
    came = P.read(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("title"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("timestamp"), F.col("o_orderkey").alias("arrival"))
    return change.upsert_tours(tours, came).select("id", "title", F.coalesce("timestamp", F.lit(0).cast("long")).alias("timestamp"))


@query("SELECT conv_id, CAST(max(turn) AS BIGINT) AS ts FROM conversations GROUP BY conv_id ORDER BY ts DESC, conv_id LIMIT 50")
def tour_retention(spark, sf):
    tours = P.read(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").cast("long").alias("ts"))
    return change.newest(tours, "ts", "conv_id")


@query("""WITH d AS (SELECT conv_id, turn, role, coalesce(text, '') AS say, greatest(2500, length(coalesce(text, '')) * 90) AS ms FROM conversations)
SELECT conv_id, turn, CAST(ms AS BIGINT) AS duration_ms, CAST(coalesce(sum(ms) OVER (PARTITION BY conv_id ORDER BY turn, role, say ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms FROM d""")
def beat_offsets(spark, sf):
    b = P.read(spark, sf, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("say"), F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")).alias("place"))
    return change.beat_offsets(b, "conv_id", "place", "say").select("conv_id", "turn", "duration_ms", "start_ms")


# ---- names and resolution ----------------------------------------------------------------------------------------


@query("SELECT page_id, list_aggregate(list_filter(list_transform(string_split(url, '/'), lambda s: regexp_replace(regexp_replace(lower(s), '[^a-z0-9.]+', '_', 'g'), '^[._]+|[._]+$', '', 'g')), lambda s: s <> ''), 'string_agg', '_') AS file_id FROM pages")
def file_ids(spark, sf):
    return P.read(spark, sf, "pages").select("page_id", ids.file_id(F.col("url")).alias("file_id"))


@query(f"WITH {_DOCS} SELECT DISTINCT source_file, id FROM docs")
def slug_ids(spark, sf):
    files = P.read(spark, sf, "documents").select(F.concat(F.lit("docs/"), F.col("source"), F.lit(".md")).alias("source_file")).distinct()
    return files.select("source_file", ids.document_id(F.col("source_file")).alias("id"))


@query("SELECT p_partkey, p_name||CASE WHEN row_number() OVER w = 1 THEN '' ELSE '~'||row_number() OVER w END AS id FROM part WINDOW w AS (PARTITION BY p_name ORDER BY p_partkey)")
def duplicate_ordinals(spark, sf):
    return ids.with_ordinals(P.read(spark, sf, "part"), "p_name", ["p_partkey"], "id").select("p_partkey", "id")


@query("""WITH h AS (SELECT p_partkey, list_reduce(list_prepend(CAST(5381 AS BIGINT), list_transform(string_split(p_name, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda h, u: (h * 33 + u) % 4294967296) AS h FROM part)
SELECT p_partkey, lower(to_base(h, 36)) AS content_hash FROM h""")
def content_hashes(spark, sf):
    return P.read(spark, sf, "part").select("p_partkey", ids.content_hash(F.col("p_name")).alias("content_hash"))


_SPECS = "specs AS (SELECT l_orderkey * 10 + l_linenumber AS import_id, './part'||(l_partkey % 50) AS specifier FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2)), files AS (SELECT 'lib/part'||(p_partkey % 40)||CASE WHEN p_partkey % 3 = 0 THEN '.js' WHEN p_partkey % 3 = 1 THEN '.ts' ELSE '/index.py' END AS file FROM part GROUP BY 1)"


@query(f"""WITH {_SPECS}, probes AS (SELECT * FROM (VALUES (0, ''), (1, '.ts'), (2, '.tsx'), (3, '.js'), (4, '.jsx'), (5, '.py'), (6, '.go'), (7, '.rs'), (8, '.java'), (9, '.c'), (10, '.cpp'), (11, '.h'), (12, '/index.ts'), (13, '/index.tsx'), (14, '/index.js'), (15, '/index.jsx'), (16, '/index.py')) v(pos, tail)),
kinds AS (SELECT DISTINCT specifier FROM specs), best AS (SELECT specifier, arg_min(file, pos) AS target_file FROM kinds, probes JOIN files ON file = 'lib'||substr(specifier, 2)||tail GROUP BY specifier)
SELECT import_id, target_file FROM specs LEFT JOIN best USING (specifier)""")
def resolve_first_candidate(spark, sf):
    line = P.read(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("k"))
    specs = line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("import_id"), F.lit("lib/main.ts").alias("caller"), F.concat(F.lit("./part"), (F.col("k") % 50).cast("string")).alias("specifier"))
    k = F.col("p_partkey")
    tail = F.when(k % 3 == 0, ".js").when(k % 3 == 1, ".ts").otherwise("/index.py")
    files = P.read(spark, sf, "part").select(F.concat(F.lit("lib/part"), (k % 40).cast("string"), tail).alias("source_file")).distinct()
    return resolve.resolve_modules(specs, files)


@query(f"""WITH RECURSIVE {NEXT}, hop AS (SELECT source AS req, source AS file, [source] AS seen, FALSE AS again FROM nedges UNION ALL SELECT req, target, list_append(seen, target), list_contains(seen, target) FROM hop JOIN nedges ON file = source WHERE NOT again)
SELECT req AS req_id, arg_max(file, len(seen)) AS file, 'f' AS symbol FROM hop GROUP BY req""")
def reexport_unwrap(spark, sf):
    e = settle(P.next_edges(spark, sf).select("source", "target"))
    exports = e.select(F.col("source").alias("file"), F.lit("f").alias("symbol"), F.col("target").alias("target_file"), F.lit("f").alias("target_symbol"), F.lit(None).cast("int").alias("star_pos"))
    requests = e.select(F.col("source").alias("req_id"), F.col("source").alias("file"), F.lit("f").alias("symbol"))
    return resolve.unwrap_reexports(requests, exports)


_STARS = f"""{TREE}, up AS (SELECT target AS file, source AS target_file FROM redges),
leaves AS (SELECT file FROM up WHERE file NOT LIKE 'nation%'),
near AS (SELECT l.file AS req, l.file, 0 AS d FROM leaves l UNION ALL SELECT req, up.target_file, d + 1 FROM near JOIN up USING (file))"""


@query(f"WITH RECURSIVE {_STARS} SELECT req AS req_id, 'core' AS file, CASE WHEN arg_max(file, d) IN ('region_1', 'region_3') THEN 'h' ELSE 'g' END AS symbol FROM near GROUP BY req")
def reexport_stars(spark, sf):
    """Each customer's and supplier's file stars its nation's, that its region's, which exports f under other names, the last one counting."""
    up = P.tree_edges(spark, sf).select(F.col("target").alias("file"), F.col("source").alias("target_file"))
    none = F.lit(None).cast("string")
    stars = up.select("file", none.alias("symbol"), "target_file", none.alias("target_symbol"), F.lit(0).alias("star_pos"), F.lit(0).alias("pos"))
    regions = P.read(spark, sf, "region").select(F.concat(F.lit("region_"), F.col("r_regionkey").cast("string")).alias("file"), "r_regionkey")
    named = lambda rows, to, pos: rows.select("file", F.lit("f").alias("symbol"), F.lit("core").alias("target_file"), F.lit(to).alias("target_symbol"), F.lit(None).cast("int").alias("star_pos"), F.lit(pos).alias("pos"))
    exports = stars.unionByName(named(regions, "g", 1)).unionByName(named(regions.where("r_regionkey IN (1, 3)"), "h", 2)).unionByName(named(regions, "z", 0))
    requests = up.where(~F.col("file").startswith("nation")).select(F.col("file").alias("req_id"), "file", F.lit("f").alias("symbol"))
    return resolve.unwrap_reexports(requests, exports)


_CALLS = """sym AS (SELECT 's'||p_partkey AS id, CASE WHEN p_partkey % 97 < 44 THEN list_extract(generic, 1 + p_partkey % 97) ELSE 'fn'||(p_partkey % 97) END AS label, 'f'||(p_partkey % 31) AS file, p_partkey AS pos FROM part, stop UNION ALL SELECT 'n'||n_nationkey, 'ns'||n_nationkey, 'f'||((n_nationkey + 1) % 31), 0 FROM nation WHERE n_nationkey % 3 = 0),
binds AS (SELECT 'f'||(n_nationkey % 31) AS caller, CASE WHEN n_nationkey % 3 = 0 THEN 'ns'||n_nationkey ELSE 'fn'||(n_nationkey * 4) END AS name, 'f'||((n_nationkey + 1) % 31) AS tf, n_nationkey % 3 = 0 AS ns FROM nation),
led AS (SELECT 'f'||((n_nationkey + 1) % 31) AS file, 'lent' AS symbol, 'f'||((n_nationkey + 2) % 31) AS to_file, 'fn'||(44 + n_nationkey % 53) AS to_symbol FROM nation WHERE n_nationkey % 3 = 0),
calls AS (SELECT DISTINCT 'f'||(l_orderkey % 31) AS caller, CASE l_suppkey % 6 WHEN 0 THEN 'ns'||(l_orderkey % 31)||'.'||CASE WHEN l_partkey % 2 = 0 THEN 'lent' ELSE 'FN'||(l_partkey % 120) END WHEN 1 THEN 'odd.fn'||(l_partkey % 120) WHEN 2 THEN 'a.b.fn'||(l_partkey % 120) WHEN 3 THEN list_extract(generic, 1 + CAST(l_partkey % 44 AS INT)) ELSE 'fn'||(l_partkey % 120) END AS callee FROM lineitem, stop UNION SELECT 'f'||(n_nationkey % 31), 'ns'||n_nationkey FROM nation WHERE n_nationkey % 3 = 0),
parts AS (SELECT caller, callee, lower(list_extract(string_split(callee, '.'), -1)) AS name, list_extract(string_split(callee, '.'), 1) AS head, len(string_split(callee, '.')) AS n FROM calls),
local AS (SELECT file, lower(label) AS label, arg_max(id, pos) AS id FROM sym GROUP BY 1, 2), only_ AS (SELECT lower(label) AS label, min(id) AS id FROM sym GROUP BY 1 HAVING count(*) = 1),
tiers AS (SELECT p.caller, CASE WHEN n = 2 AND s.tf IS NULL THEN NULL WHEN n = 2 THEN m.id WHEN list_contains(generic, p.name) THEN NULL WHEN l.id IS NOT NULL THEN l.id WHEN b.ns THEN NULL WHEN b.tf IS NOT NULL THEN t.id WHEN n = 1 THEN o.id END AS target, n = 1 AND NOT list_contains(generic, p.name) AND l.id IS NULL AND b.tf IS NULL AS wide
 FROM parts p CROSS JOIN stop LEFT JOIN binds s ON s.ns AND s.caller = p.caller AND s.name = p.head AND n = 2 LEFT JOIN led r ON r.file = s.tf AND r.symbol = p.name LEFT JOIN local m ON m.file = coalesce(r.to_file, s.tf) AND m.label = coalesce(r.to_symbol, p.name)
 LEFT JOIN local l ON l.file = p.caller AND l.label = p.name LEFT JOIN binds b ON b.caller = p.caller AND b.name = p.name LEFT JOIN local t ON t.file = b.tf AND t.label = p.name LEFT JOIN only_ o ON o.label = p.name)"""


def _stop() -> str:
    return "stop AS (SELECT [" + ", ".join(f"'{x}'" for x in GENERIC) + "] AS generic)"


@query(f"WITH {_stop()}, {_CALLS} SELECT caller AS source_file, target, CASE WHEN bool_and(wide) THEN CAST(0.8 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS score FROM tiers WHERE target IS NOT NULL GROUP BY ALL")
def call_cascade(spark, sf):
    """Plain, member and namespace calls, calls of a namespace's own name, callees of the stop-list, bindings, and a member that a namespace's file lends from another."""
    k, n, order = F.col("p_partkey"), F.col("n_nationkey"), F.col("l_orderkey") % 31
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    generic = lambda c: F.element_at(F.array(*map(F.lit, GENERIC)), (c + 1).cast("int"))
    label = F.when(k % 97 < 44, generic(F.least(k % 97, F.lit(43)))).otherwise(text("fn", k % 97))
    symbols = P.read(spark, sf, "part").select(text("s", k).alias("id"), label.alias("label"), text("f", k % 31).alias("source_file"), k.alias("pos"))
    part = F.col("l_partkey") % 120
    kinds = {0: F.concat(text("ns", order), F.when(F.col("l_partkey") % 2 == 0, F.lit(".lent")).otherwise(text(".FN", part))), 1: text("odd.fn", part), 2: text("a.b.fn", part), 3: generic(F.col("l_partkey") % 44)}
    callee = functools.reduce(lambda c, x: c.when(F.col("l_suppkey") % 6 == x[0], x[1]), list(kinds.items())[1:], F.when(F.col("l_suppkey") % 6 == 0, kinds[0])).otherwise(text("fn", part))
    calls = P.read(spark, sf, "lineitem").select(text("f", order).alias("caller_file"), callee.alias("callee"), F.lit(0).alias("pos")).distinct().withColumn("is_member", F.col("callee").contains("."))
    space = n % 3 == 0
    nation = P.read(spark, sf, "nation")
    named = nation.where(space)
    symbols = symbols.unionByName(named.select(text("n", n).alias("id"), text("ns", n).alias("label"), text("f", (n + 1) % 31).alias("source_file"), F.lit(0).cast("long").alias("pos")))
    calls = calls.unionByName(named.select(text("f", n % 31).alias("caller_file"), text("ns", n).alias("callee"), F.lit(0).alias("pos"), F.lit(False).alias("is_member")))
    binds = nation.select(text("f", n % 31).alias("caller"), F.when(space, text("ns", n)).otherwise(text("fn", n * 4)).alias("local_key"), text("f", (n + 1) % 31).alias("target_file"), F.lit(None).cast("string").alias("target_symbol"), F.when(space, "namespace").otherwise("named").alias("kind"))
    exports = nation.where(space).select(text("f", (n + 1) % 31).alias("file"), F.lit("lent").alias("symbol"), text("f", (n + 2) % 31).alias("target_file"), text("fn", 44 + n % 53).alias("target_symbol"), F.lit(None).cast("int").alias("star_pos"))
    return resolve.call_edges(calls, symbols, binds, exports)


@query("""WITH want AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem WHERE l_partkey % 11 <> 0), made AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem WHERE l_linenumber > 1)
SELECT count(made.a) AS found, count(*) AS expected, round(count(made.a) / count(*), 9) AS ratio FROM want LEFT JOIN made USING (a, b)""")
def import_coverage(spark, sf):
    """Of the pairs of files that imports resolve to, the share that the graph has an edge for."""
    line = P.read(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_linenumber")
    caller, to = F.concat(F.lit("src/s"), F.col("l_suppkey").cast("string")), F.concat(F.lit("lib/p"), F.col("l_partkey").cast("string"))
    pairs = line.select(caller.alias("caller"), F.when(F.col("l_partkey") % 11 != 0, to).alias("target_file"))
    # A file's id is made once, not for each import of the file.
    named = lambda key, file: settle(line.select(key).distinct().select(key, ids.file_id(file).alias("id"), file.alias("source_file")))
    callers, targets = named("l_suppkey", caller), named("l_partkey", to)
    nodes = callers.select("id", "source_file").union(targets.select("id", "source_file"))
    of = lambda files, key, end: files.select(key, F.col("id").alias(end)).hint("shuffle_hash")
    edges = line.where("l_linenumber > 1").select("l_suppkey", "l_partkey").distinct().join(of(targets, "l_partkey", "target"), "l_partkey").join(of(callers, "l_suppkey", "source"), "l_suppkey")
    edges = edges.select("source", "target", F.lit("imports").alias("relation"), F.lit("PHYSICAL").alias("type"))
    return resolve.coverage(pairs, nodes, edges).select("found", "expected", F.round("ratio", 9).alias("ratio"))


# ---- sizes, layout, extraction -----------------------------------------------------------------------------------


@query("""WITH f AS (SELECT text, row_number() OVER (ORDER BY lpad(CAST(doc_id AS VARCHAR), 9, '0')) - 1 AS nth, count(*) OVER () AS n FROM documents)
SELECT any_value(n) AS files, CAST(round(avg(len(regexp_split_to_array(coalesce(text, ''), '[\\t\\n\\x0B\\f\\r \\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+'))) * any_value(n)) AS BIGINT) AS words FROM f WHERE nth % greatest(1, n // least(100, n)) = 0""")
def size_estimate(spark, sf):
    d = P.read(spark, sf, "documents").select(F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("source_file"), "text")
    return sources.size_estimate(d)


@query(f"WITH {TREE} SELECT split_part(source_file, '/', 1) AS folder, count(*) AS n FROM rnodes GROUP BY 1 ORDER BY n DESC, folder LIMIT 5")
def top_dirs(spark, sf):
    return sources.top_folders(P.tree_nodes(spark, sf))


@query(f"""WITH {_HUBS}, nodes AS (SELECT DISTINCT node AS id FROM both_) SELECT id, round(least(CAST(22 AS DOUBLE), greatest(CASE WHEN id IN (SELECT node FROM hubs) THEN CAST(13 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END, CAST(4 AS DOUBLE) + CAST(1.8 AS DOUBLE) * sqrt(degree))), 6) AS size FROM nodes JOIN deg ON id = node""")
def node_size(spark, sf):
    edges = written(P.market_edges(spark, sf), shared_folder(spark, "market"))
    nodes = settle(graph.both_ways(edges).select(F.col("node").alias("id")).distinct())
    return graph.node_sizes(nodes, edges, graph.hubs(edges)).select("id", F.round("size", 6).alias("size"))


@query("""WITH m AS (SELECT 'supplier_'||s_suppkey AS id, dense_rank() OVER (ORDER BY s_nationkey) - 1 AS k, row_number() OVER (ORDER BY 'supplier_'||s_suppkey) - 1 AS i, (SELECT count(DISTINCT s_nationkey) FROM supplier) AS n FROM supplier),
r AS (SELECT *, CASE WHEN n <= 1 THEN 0 ELSE 120 + 45 * n END AS ring FROM m)
SELECT id, round(cos(2 * pi() * k / n) * ring + cos(pi() * (3 - sqrt(5)) * i) * 14 * sqrt(i + 1), 3) AS x, round(sin(2 * pi() * k / n) * ring + sin(pi() * (3 - sqrt(5)) * i) * 14 * sqrt(i + 1), 3) AS y FROM r""")
def seed_layout(spark, sf):
    """Suppliers by nation; a node's place on its spiral is its place among all nodes."""
    nodes = P.read(spark, sf, "supplier").select(F.concat(F.lit("supplier_"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_nationkey").alias("community"))
    return graph.seed_layout(graph.layout_members(nodes)).select("id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query("""WITH c AS (SELECT s_name AS id, list_transform(string_split(s_name, ''), lambda ch: CAST(ascii(ch) AS BIGINT)) AS u FROM supplier),
h AS (SELECT id, list_reduce(list_prepend(CAST(0 AS BIGINT), u), lambda s, x: (s * 31 + x + 2147483648) % 4294967296 - 2147483648 + CASE WHEN (s * 31 + x + 2147483648) % 4294967296 < 0 THEN 4294967296 ELSE 0 END) AS h FROM c)
SELECT id, abs(h) % 800 - 400 AS x, (abs(h) * 7) % 800 - 400 AS y FROM h""")
def hash_layout(spark, sf):
    return graph.hash_layout(P.read(spark, sf, "supplier").select(F.col("s_name").alias("id")))


@query("SELECT min(s_acctbal) - 180 AS min_x, max(s_acctbal) + 180 AS max_x, CAST(min(s_nationkey) AS DOUBLE) - 180 AS min_y, CAST(max(s_nationkey) AS DOUBLE) + 180 AS max_y FROM supplier")
def bounding_box(spark, sf):
    return graph.bounding_box(P.read(spark, sf, "supplier").select(F.col("s_acctbal").alias("x"), F.col("s_nationkey").cast("double").alias("y")), 180.0)


@query(f"WITH {_HUBS} SELECT source, target FROM medges WHERE source NOT IN (SELECT node FROM hubs) AND target NOT IN (SELECT node FROM hubs)")
def layout_edges(spark, sf):
    edges = written(P.market_edges(spark, sf), shared_folder(spark, "market"))
    nodes = settle(graph.both_ways(edges).select(F.col("node").alias("id")).distinct())
    return graph.layout_edges(nodes, edges, graph.hubs(edges)).select("source", "target")


@query("SELECT 's'||s_suppkey AS id, CASE WHEN s_acctbal / 10000 >= 1 THEN 'EXTRACTED' WHEN s_acctbal / 10000 BETWEEN 0.6 AND 0.9 THEN 'INFERRED' WHEN s_acctbal / 10000 BETWEEN 0.1 AND 0.3 THEN 'AMBIGUOUS' ELSE 'UNCLASSIFIED' END AS band FROM supplier")
def provenance_bands(spark, sf):
    band = change.provenance(F.col("s_acctbal") / 10000)
    return P.read(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), band.alias("band"))


@query("SELECT 'm'||p_partkey||'.py' AS source_file, 'f'||p_partkey AS name, CAST(1 AS BIGINT) AS n_calls FROM part")
def extract_python(spark, sf):
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("def f"), k, F.lit("(x):\n    return g(x)\n"))
    out = extract(P.read(spark, sf, "part").select(F.concat(F.lit("m"), k, F.lit(".py")).alias("source_file"), text.alias("text")))
    return out.select("source_file", F.col("symbols")[0]["name"].alias("name"), F.size("calls").cast("long").alias("n_calls"))


@query("SELECT 'm'||p_partkey||'.ts' AS source_file, 'f'||p_partkey AS name, './p'||p_size AS specifier FROM part")
def extract_script(spark, sf):
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("import { h } from './p"), F.col("p_size").cast("string"), F.lit("'\nexport function f"), k, F.lit("(x) { return h(x) }\n"))
    out = extract(P.read(spark, sf, "part").select(F.concat(F.lit("m"), k, F.lit(".ts")).alias("source_file"), text.alias("text")))
    return out.select("source_file", F.col("symbols")[0]["name"].alias("name"), F.col("imports")[0]["specifier"].alias("specifier"))


# ---- layers, focus, tours, warnings ------------------------------------------------------------------------------


@query(f"WITH {_SUS} SELECT source, target, type FROM every WHERE type <> 'PHYSICAL'")
def edge_layers(spark, sf):
    return graph.layers(_with_suspicious(spark, sf)[1], physical=False).select("source", "target", "type")


@query(f"WITH RECURSIVE {TRADE}, {HITS}, {cyc('tedges')}, sus AS (SELECT source, target, 'circular_dependency' AS relation, score FROM cyc UNION ALL SELECT source, target, 'violates_boundary', CASE WHEN rule_pos = 0 THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END FROM hits WHERE rule_pos IS NOT NULL) SELECT source, target, relation, CAST(row_number() OVER (ORDER BY score DESC, relation, source, target) AS BIGINT) AS place FROM sus")
def warnings_sorted(spark, sf):
    ordered = graph.warnings_sorted(_all_suspicious(spark, sf)).select("source", "target", "relation", "score")
    return with_rank(ordered, [F.desc("score"), F.col("relation"), F.col("source"), F.col("target")], "place").select("source", "target", "relation", (F.col("place") + 1).alias("place"))


def _all_suspicious(spark, sf):
    edges = _with_suspicious(spark, sf)[1]
    cycles = graph.cycle_edges(edges).select("source", "target", F.lit("circular_dependency").alias("relation"), F.lit("SUSPICIOUS").alias("type"), "score")
    return edges.unionByName(cycles, allowMissingColumns=True).where("type = 'SUSPICIOUS'")


@query(f"""WITH RECURSIVE {TRADE}, {HITS}, {cyc('tedges')}
SELECT 'boundary' AS type, 'sus_'||source||'->'||target||'_violates_boundary' AS key, '' AS nodes, CAST(1 AS BIGINT) AS n_edges, CASE WHEN rule_pos = 0 THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS score FROM hits WHERE rule_pos IS NOT NULL
UNION ALL SELECT 'cycle', 'cycle_'||string_agg(DISTINCT source, '_' ORDER BY source), string_agg(DISTINCT source, ',' ORDER BY source), count(*), round(max(score), 6) FROM cyc GROUP BY component
UNION ALL SELECT 'other', 'sus_'||source||'->'||target||'_looks_odd', '', CAST(1 AS BIGINT), CAST(0.3 AS DOUBLE) FROM tedges
UNION ALL SELECT 'cycle', 'cycle_region_'||r_regionkey, 'region_'||r_regionkey, CAST(1 AS BIGINT), CAST(0.2 AS DOUBLE) FROM region""")
def warning_kinds(spark, sf):
    odd = P.trade_edges(spark, sf).select("source", "target", F.lit("looks_odd").alias("relation"), F.lit(0.3).alias("score"))
    region = F.concat(F.lit("region_"), F.col("r_regionkey").cast("string"))
    loops = P.read(spark, sf, "region").select(region.alias("source"), region.alias("target"), F.lit("circular_dependency").alias("relation"), F.lit(0.2).alias("score"))
    every = _all_suspicious(spark, sf).select("source", "target", "relation", "score").unionByName(odd).unionByName(loops)
    return graph.all_warning_groups(every).select("type", "key", F.array_join("nodes", ",").alias("nodes"), "n_edges", F.round("score", 6).alias("score"))


@query(f"WITH {TREE} SELECT community, id, row_number() OVER (PARTITION BY community ORDER BY id) - 1 AS place FROM (SELECT id, coalesce(CASE WHEN community = 4 THEN NULL ELSE community END, 0) AS community FROM rnodes WHERE source_file NOT LIKE 'EUROPE/%')")
def community_members(spark, sf):
    """Members over the facets' base; who has no community is in the first."""
    nodes = P.tree_nodes(spark, sf).where(~F.col("source_file").startswith("EUROPE/")).withColumn("community", F.when(F.col("community") != 4, F.col("community")))
    return community.members(nodes).select(big("community"), "id", "place")


@query(f"WITH {TREE}, f AS (SELECT r_name||'/'||n_name AS file, n_name||' read' AS activity FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 = 0) SELECT id, activity FROM rnodes JOIN f ON source_file = file")
def focus_nodes(spark, sf):
    nodes = P.tree_nodes(spark, sf)
    events = P.trade_nodes(spark, sf).where("CAST(substr(id, 8) AS INT) % 3 = 0").select(F.col("source_file").alias("file"), F.concat("label", F.lit(" read")).alias("activity"))
    return change.focus_nodes(nodes, events)


_BEATS = f"""{TREE}, beats AS (SELECT conv_id AS tour, turn AS pos, unnest(['nation_'||(conv_id % 40), 'region_'||(turn % 5), 'nation_'||(turn % 25), 'nation_'||(conv_id % 40)]) AS id FROM conversations),
lit AS (SELECT DISTINCT tour, pos, id FROM beats WHERE id IN (SELECT id FROM rnodes))"""


def _lit(spark, sf):
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    named = F.array(text("nation_", F.col("conv_id") % 40), text("region_", F.col("turn") % 5), text("nation_", F.col("turn") % 25), text("nation_", F.col("conv_id") % 40))
    beats = P.read(spark, sf, "conversations").select(F.col("conv_id").alias("tour"), F.col("turn").alias("pos"), named.alias("nodes"))
    return change.beat_nodes(beats, P.tree_nodes(spark, sf))


@query(f"WITH {_BEATS} SELECT tour, pos, id FROM lit")
def beat_nodes(spark, sf):
    return _lit(spark, sf)


@query(f"WITH {_BEATS} SELECT a.tour, a.pos, source, target FROM redges JOIN lit a ON a.id = source JOIN lit b ON b.id = target AND a.tour = b.tour AND a.pos = b.pos")
def beat_edges(spark, sf):
    return change.beat_edges(_lit(spark, sf), P.tree_edges(spark, sf)).select("tour", "pos", "source", "target")


@query(f"WITH {TRADE}, core AS (SELECT id FROM tnodes WHERE community = 2) SELECT source, target, CAST((source IN (FROM core))::INT + (target IN (FROM core))::INT AS BIGINT) AS tier FROM tedges")
def edge_tiers(spark, sf):
    nodes, edges = trade(spark, sf)
    return graph.edge_tiers(edges, nodes.where("community = 2")).select("source", "target", big("tier"))


# ---- files and polls ---------------------------------------------------------------------------------------------


@query("SELECT event_id AS file, CASE WHEN event_id % 9 = 0 THEN 1 ELSE 0 END AS size FROM events WHERE event_id % 4 <> 0 AND event_id % 9 <> 0")
def write_settled(spark, sf):
    """Files that two polls see alike: not those that grew, nor those that came between the polls."""
    poll = lambda size: P.read(spark, sf, "events").select(F.col("event_id").alias("source_file"), size.cast("int").alias("size"), F.col("ts").alias("mtime"))
    first, second = poll(F.lit(0)).where("source_file % 4 <> 0"), poll(F.when(F.col("event_id") % 9 == 0, 1).otherwise(0))
    return change.settled(first, second).select(F.col("source_file").alias("file"), "size")


@query("SELECT DISTINCT user_id AS file FROM events WHERE event_type <> (SELECT min(event_type) FROM events)")
def immediate_focus(spark, sf):
    e = P.read(spark, sf, "events")
    gone = e.agg(F.min("event_type").alias("gone"))
    return change.immediate_focus(e.crossJoin(F.broadcast(gone)).select(F.col("user_id").alias("file"), F.when(F.col("event_type") == F.col("gone"), "delete").otherwise("change").alias("op")))


@query("SELECT source_file, op FROM (SELECT coalesce(a.event_id, b.event_id) AS source_file, CASE WHEN a.event_id IS NULL THEN 'added' WHEN b.event_id IS NULL THEN 'removed' WHEN b.event_id % 5 = 0 THEN 'updated' END AS op FROM (SELECT event_id FROM events WHERE event_id % 4 <> 0) a FULL JOIN (SELECT event_id FROM events WHERE event_id % 6 <> 0) b USING (event_id)) WHERE op IS NOT NULL")
def stat_index(spark, sf):
    """What a stat index written and read back tells of the files: come, gone, or of another size."""
    e = P.read(spark, sf, "events").select(F.col("event_id").alias("source_file"), F.lit(1).alias("size"), F.col("ts").alias("mtime"))
    folder = shared_folder(spark, "stat-index")
    sources.write_generation(e.limit(0), folder)
    sources.write_generation(e.where("source_file % 4 <> 0"), folder)
    now = e.where("source_file % 6 <> 0").withColumn("size", F.when(F.col("source_file") % 5 == 0, 2).otherwise(1))
    return change.snapshot_diff(sources.read_generation(spark, folder), now, "source_file")


@query("""WITH f AS (SELECT user_id AS name, event_type AS folder, max(event_id) AS mtime FROM events GROUP BY ALL)
SELECT name, arg_max(folder, mtime) AS folder, max(mtime) AS mtime FROM f GROUP BY name""")
def newest_files(spark, sf):
    files = P.read(spark, sf, "events").groupBy(F.col("user_id").alias("name"), F.col("event_type").alias("folder")).agg(F.max("event_id").alias("mtime"))
    return sources.newest_files(files)


@query("""SELECT * FROM (VALUES ('^src', '^lib', 'error', 'no way back', '^lib/ok'), ('(?:^a|^b)', '^c', 'warn', 'two', ''), ('^x', '^y', 'warn', 'Forbidden: ^x -> ^y', '^y/a,^y/b')) v("from", "to", severity, reason, excepted)""")
def rules_import(spark, sf):
    """A project's dependency rules, found by name, as rules; those that go from no path to a path, or refer back, are left out."""
    import json
    import tempfile

    listed = [
        {"name": "back", "severity": "error", "comment": "no way back", "from": {"path": "^src"}, "to": {"path": "^lib", "pathNot": "^lib/ok"}},
        {"name": "two", "severity": "info", "from": {"path": ["^a", "^b"], "pathNot": "^z"}, "to": {"path": ["^c"]}},
        {"from": {"path": "^x"}, "to": {"path": "^y", "pathNot": ["^y/a", "^y/b"]}},
        {"name": "round", "from": {}, "to": {"circular": True}},
        {"name": "ref", "from": {"path": "^(a)"}, "to": {"path": "$1"}},
    ]
    with tempfile.TemporaryDirectory() as root:  # a driver's project folder
        with open(f"{root}/.dependency-cruiser.json", "w", encoding="utf-8") as f:
            json.dump({"forbidden": listed}, f)
        made = rules.parse_rules(rules.import_config(root)[0], spark)
    return spark.createDataFrame([(r["from"], r["to"], r["severity"], r["reason"], ",".join(r["except"])) for r in made], "`from` string, `to` string, severity string, reason string, excepted string")


# ---- extraction of varied sources --------------------------------------------------------------------------------

_SOURCES = {
    "a.ts": "import d, { n as m, type T } from './x'\nimport * as ns from './y'\nimport './z'\nimport type Q from './q'\nexport { a as b, type U } from './w'\nexport * from './v'\nexport * as all from './u'\nexport default d\n",
    "b.ts": "export class K {\n  constructor() { super() }\n  run(x) { return this.go(x) }\n}\nexport const f = async (x) => g(x)\nconst plain = 1\nexport default function main() { f() }\n",
    "c.js": "export default class { }\nfunction* gen() { ns.call(1) }\nvar h = function () { return a.b.c() }\n",
    "d.py": "import os.path as p, sys\nfrom pkg.mod import one as uno, two\nfrom star import *\n@deco\nclass C(Base):\n    def m(self):\n        return self.m()\n",
    "e.py": "def good():\n    return 1\n\ndef bad(:\n    pass\n\nclass Late:\n    pass\n",
    "f.go": "func Run() {\n}\ntype Box struct {\n}\n",
    "g.none": "function no() {}",
}
_FOUND = """
a.ts import default d default ./x|a.ts import named m n ./x|a.ts import type-named T T ./x|a.ts import namespace ns * ./y|a.ts import side-effect - - ./z|a.ts import type-default Q default ./q
a.ts export a b ./w clause|a.ts export * - ./v star|a.ts export all - ./u namespace|a.ts export d default - default|a.ts export default default ./x clause
b.ts symbol K class 1|b.ts symbol K.run method 3|b.ts symbol f variable 5|b.ts symbol main function 7|b.ts export K - - declaration|b.ts export f - - declaration|b.ts export main default - default
b.ts call this.go true 3|b.ts call g false 5|b.ts call f false 7
c.js symbol default default 1|c.js symbol gen function 2|c.js symbol h variable 3|c.js export default default - default|c.js call ns.call true 2|c.js call a.b.c true 3
d.py import namespace p * os.path|d.py import namespace sys * sys|d.py import named uno one pkg/mod|d.py import named two two pkg/mod|d.py import side-effect - - star
d.py symbol C class 5|d.py symbol C.m function 6|d.py call self.m true 7
e.py symbol good function 1|e.py symbol Late class 7
f.go symbol Run function 1|f.go symbol Box class 3"""


@query("SELECT * FROM (VALUES " + ", ".join(f"('{x}')" for x in _FOUND.strip().replace("\n", "|").split("|")) + ") v(said)")
def extract_forms(spark, sf):
    """Import, export, declaration and call forms of several languages, and a text that doesn't parse, each row as a line."""
    files = spark.createDataFrame(list(_SOURCES.items()), "source_file string, text string")
    out = extract(files)
    say = lambda kind, cols: F.transform(cols[0], lambda x: F.concat_ws(" ", "source_file", F.lit(kind), *[F.coalesce(x[c].cast("string"), F.lit("-")) for c in cols[1]]))
    rows = F.concat(say("import", ("imports", ("kind", "local", "imported", "specifier"))), say("export", ("exports", ("symbol", "alias", "specifier", "kind"))), say("symbol", ("symbols", ("name", "kind", "line"))), say("call", ("calls", ("callee", "is_member", "line"))))
    return out.select(F.explode(rows).alias("said"))
