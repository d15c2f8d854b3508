"""From a source tree to a graph: scan, extract, resolve, merge insights, find cycles and violations, cluster."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import edge_key, file_id, symbol_id, with_ordinals
from ..functions.lineage import settle
from ..operators import change, community, graph, rules
from ..sources import extract as extractors
from ..sources import files as sources
from . import incremental

NODE = "id string, label string, file_type string, source_file string, source_location string, content_hash string"
EDGE = "source string, target string, relation string, type string, score double, rationale string"
#: Caches and states of another version are not read.
VERSION = "1.1.0"


@dataclass
class Config:
    root: str
    scope: str = ""
    aliases: list = field(default_factory=list)
    rules: list = field(default_factory=list)
    insights: str | None = None
    cache: str | None = None
    state: str | None = None
    driver_edges: int = 200_000
    #: At the start of a service insights lose what names files that are gone; later such an insight is left out whole.
    startup: bool = False


def extract_cached(files: DataFrame, cache: str | None) -> DataFrame:
    """Extraction of the files; of those whose path, size and time a Parquet cache has, from there.

    The cache's next generation is written whole before the last one goes. One of another version is not looked at.
    """
    spark = files.sparkSession
    if cache is None:
        return settle(extractors.extract(files))
    cache = f"{cache.rstrip('/')}/version={VERSION}"
    old = sources.read_generation(spark, cache)
    stat = ["source_file", "size", "mtime"]
    if old is None:
        new = files
    else:
        new = files.join(old.select(*stat), stat, "left_anti")
    fresh = extractors.extract(new).join(new.select(*stat), "source_file")
    every = fresh if old is None else old.join(files.select(*stat), stat, "left_semi").select(*fresh.columns).unionByName(fresh)
    every = settle(every)
    sources.write_generation(every, cache)
    return every


def code_nodes(extracted: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """File and symbol nodes, and `contains` edges between them; symbols also with their position."""
    path, none = F.col("source_file"), F.lit(None).cast("string")
    heads = files.select(file_id(path).alias("id"), F.element_at(F.split(path, "/"), -1).alias("label"), F.lit("code").alias("file_type"), "source_file", none.alias("source_location"), none.alias("content_hash"))
    found = extracted.select("source_file", F.explode("symbols").alias("s")).select("source_file", "s.name", "s.line", "s.pos", "s.content_hash")
    found = with_ordinals(found.withColumn("base", symbol_id(path, F.col("name"))), "base", ["pos"], "id")
    symbols = found.select("id", F.element_at(F.split("name", r"\."), -1).alias("label"), F.lit("code").alias("file_type"), "source_file", F.concat(F.lit("L"), F.col("line").cast("string")).alias("source_location"), "content_hash", "pos")
    edges = symbols.select(file_id(path).alias("source"), F.col("id").alias("target"), F.lit("contains").alias("relation"), F.lit("PHYSICAL").alias("type"), F.lit(1.0).alias("score"))
    return heads, symbols, edges


def compile_graph(spark: SparkSession, cfg: Config, previous: DataFrame | None = None) -> Graph:  # noqa: F821
    """All steps in order. previous: (node, community) of an earlier graph, whose community ids are kept where they fit.

    Without it they are read from the state folder, if the configuration names one; what is found is written there.
    """
    from .serve import Graph

    state = cfg.state and f"{cfg.state.rstrip('/')}/version={VERSION}/communities"
    if previous is None and state:
        previous = sources.read_generation(spark, state)
    files = settle(sources.scan(spark, cfg.root, cfg.scope))
    extracted = extract_cached(files, cfg.cache)
    heads, symbols, contains = code_nodes(extracted, files)
    symbols = settle(symbols)
    found = incremental.resolved(spark, extracted, files, symbols, cfg.aliases, cfg.state and f"{cfg.state.rstrip('/')}/version={VERSION}/resolved")
    import_edges = found.brought.where("caller <> target_file").select(file_id(F.col("caller")).alias("source"), file_id(F.col("target_file")).alias("target"), F.lit("imports").alias("relation"), F.lit("PHYSICAL").alias("type"), F.lit(1.0).alias("score")).distinct()
    call_edges = found.called.select(file_id(F.col("source_file")).alias("source"), "target", F.lit("calls").alias("relation"), F.lit("PHYSICAL").alias("type"), "score")
    nodes = heads.unionByName(symbols.drop("pos"), allowMissingColumns=True)
    edges = contains.unionByName(import_edges).unionByName(call_edges)
    chunks = None
    if cfg.insights:
        there = settle(sources.listing(spark, cfg.root))
        texts = sources.read_insights(spark, cfg.insights)
        if cfg.startup:
            chunks = settle(change.reconciled(change.route_chunks(texts), there))
        else:
            chunks = settle(change.route_chunks(texts, there))
        extra, links = change.chunk_graph(chunks)
        nodes = change.merge_layers([nodes, extra.select("id", "label", "file_type", "source_file", "source_location")])
        docs, doc_edges = change.derive_documents(nodes)
        nodes = change.merge_layers([docs, nodes])
        edges = edges.unionByName(links.where("type <> 'SUSPICIOUS'").select(*edges.columns)).unionByName(doc_edges)
    nodes, edges = settle(nodes), settle(edges)
    suspicious = find_suspicious(nodes, edges, cfg)
    hub_ids = settle(graph.hubs(edges))
    groups = community.detect(nodes, edges)
    if previous is not None:
        groups = community.stabilize(groups, previous)
    if state:
        groups = settle(groups)
        sources.write_generation(groups, state)
    nodes = nodes.join(groups.withColumnRenamed("node", "id"), "id", "left")
    every = settle(graph.prune_dangling(nodes, edges.unionByName(suspicious, allowMissingColumns=True)))
    made_of = {"imports": incremental.raw_imports(extracted), "exports": found.exports, "bindings": found.binds, "default_exports": extracted.where("default_symbol IS NOT NULL").select(F.col("source_file").alias("file"), F.col("default_symbol").alias("symbol"))}
    return Graph(settle(nodes), every, hub_ids, cfg.rules, chunks, **made_of)


def find_suspicious(nodes: DataFrame, edges: DataFrame, cfg: Config) -> DataFrame:
    """Cycle edges and rule violations as suspicious edges, with a rationale."""
    label = lambda c, to: nodes.select(F.col("id").alias(c), F.col("label").alias(to))
    cycles = graph.cycle_edges(edges, cfg.driver_edges).join(label("source", "a"), "source", "left").join(label("target", "b"), "target", "left")
    why = F.concat(F.lit("Circular dependency: "), F.coalesce("a", "source"), F.lit(" ↔ "), F.coalesce("b", "target"))
    cycles = cycles.select("source", "target", F.lit("circular_dependency").alias("relation"), F.lit("SUSPICIOUS").alias("type"), "score", why.alias("rationale"))
    hits = rules.violations(with_files(nodes, edges.where("relation = 'imports' AND type = 'PHYSICAL'")), cfg.rules)
    hits = hits.select("source", "target", F.lit("violates_boundary").alias("relation"), F.lit("SUSPICIOUS").alias("type"), F.col("violation_score").alias("score"), F.col("reason").alias("rationale"))
    return cycles.unionByName(hits.distinct())


def with_files(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """edges with from_file and to_file."""
    a = nodes.select(F.col("id").alias("source"), F.col("source_file").alias("from_file"))
    b = nodes.select(F.col("id").alias("target"), F.col("source_file").alias("to_file"))
    return edges.join(a, "source").join(b, "target")


def diff_graphs(before: Graph, after: Graph) -> tuple[DataFrame, DataFrame]:  # noqa: F821
    """(id, op) of nodes and (key, op) of edges; edges by their typed key."""
    key = lambda e: e.withColumn("key", edge_key(e))
    last = lambda e: e.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score")))).where("n = 1").drop("n")
    return change.snapshot_diff(before.nodes, after.nodes, "id"), change.snapshot_diff(last(key(before.edges)), last(key(after.edges)), "key")
