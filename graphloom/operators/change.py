"""Snapshots, layers and insights: diff, apply, merge, validate, derive, reconcile, retain."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import document_id
from ..functions.lineage import settle


def snapshot_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, op): added, removed or updated. Rows are compared column by column, nulls as values."""
    cols = [c for c in before.columns if c != key]
    pack = lambda df, name: df.select(F.col(key), F.struct(*cols).alias(name))
    both = pack(before, "old").withColumn("_b", F.lit(True)).join(pack(after, "new").withColumn("_a", F.lit(True)), key, "full_outer")
    op = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "updated")
    return both.select(key, op.alias("op")).where(F.col("op").isNotNull())


def apply_changes(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """rows after changes (same columns, and op, seq): the last of each key counts, removed keys go."""
    cols = rows.columns
    feed = rows.withColumns({"op": F.lit("added"), "seq": F.lit(-1).cast("long")}).unionByName(changes.select(*cols, "op", F.col("seq").cast("long").alias("seq")))
    last = feed.groupBy(key).agg(F.max_by(F.struct("op", *[c for c in cols if c != key]), "seq").alias("x"))
    return last.where("x.op <> 'removed'").select(key, "x.*").select(*cols)


def real_change(old: str, new: str) -> Column:
    """Whether code changed: its label or file, else its content; moves and clusters don't count."""
    differs = lambda c: ~F.col(f"{old}.{c}").eqNullSafe(F.col(f"{new}.{c}"))
    return differs("label") | differs("source_file") | differs("content_hash")


def code_changes(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """(key, op, changed) of nodes that a diff adds or updates: what is added is a change, what is updated only if its code is other."""
    ops = snapshot_diff(before, after, key).where("op <> 'removed'")
    side = lambda df, name: df.select(key, F.struct("label", "source_file", "content_hash").alias(name))
    both = ops.join(side(before, "_old"), key, "left").join(side(after, "_new"), key)
    return both.select(key, "op", ((F.col("op") == "added") | real_change("_old", "_new")).alias("changed"))


def upsert_tours(tours: DataFrame, incoming: DataFrame, key: str = "id", time: str = "timestamp") -> DataFrame:
    """Tours after others came: an id that is there already gets the row that came last (by `arrival`, a column of incoming), the newest first."""
    cols = [c for c in tours.columns if c != key]
    every = tours.withColumn("arrival", F.lit(-1).cast("long")).unionByName(incoming.select(*tours.columns, F.col("arrival").cast("long")))
    last = every.groupBy(key).agg(F.max_by(F.struct(*cols), "arrival").alias("x")).select(key, "x.*")
    return last.orderBy(F.coalesce(F.col(time), F.lit(0)).desc(), key)


def provenance(score: Column) -> Column:
    """How an edge of this score came to be: EXTRACTED from 1, INFERRED from 0.6 to 0.9, AMBIGUOUS from 0.1 to 0.3; scores between are UNCLASSIFIED."""
    return F.when(score >= 1, "EXTRACTED").when(score.between(0.6, 0.9), "INFERRED").when(score.between(0.1, 0.3), "AMBIGUOUS").otherwise("UNCLASSIFIED")


def merge_layers(layers: list[DataFrame], key: str = "id") -> DataFrame:
    """One row a key: that of the last layer that has it."""
    tagged = [df.withColumn("_layer", F.lit(i)) for i, df in enumerate(layers)]
    every = functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    cols = [c for c in every.columns if c not in (key, "_layer")]
    return every.groupBy(key).agg(F.max_by(F.struct(*cols), "_layer").alias("x")).select(key, "x.*")


#: An insight file: the nodes and edges that an agent wrote about a document.
CHUNK = (
    "nodes array<struct<id:string,label:string,file_type:string,source_file:string,source_location:string>>, "
    "edges array<struct<source:string,target:string,relation:string,type:string,score:double,source_file:string,metadata:map<string,string>>>"
)


def safe_path(path: Column) -> Column:
    """Relative, and without a step upwards."""
    return path.isNotNull() & (path != "") & ~path.startswith("/") & ~path.rlike(r"^[A-Za-z]:") & ~path.rlike(r"(^|[/\\])\.\.([/\\]|$)")


def valid_chunk(nodes: Column, edges: Column, strict_metadata: bool = True) -> Column:
    """The checks that a chunk must pass as a whole; never null."""
    filled = lambda c: c.isNotNull() & (c != "")
    known = lambda m: m.isNull() | (F.forall(F.map_keys(m), lambda k: k.isin("rationale", "source_doc")) & F.forall(F.map_values(m), lambda v: v.isNotNull())) if strict_metadata else F.lit(True)
    node = lambda n: filled(n["id"]) & n["label"].isNotNull() & n["file_type"].isin("code", "document", "concept") & safe_path(n["source_file"])
    edge = lambda e: e["source"].isNotNull() & e["target"].isNotNull() & e["relation"].isNotNull() & e["type"].isin("PHYSICAL", "COGNITIVE", "SUSPICIOUS") & e["score"].between(0.0, 1.0) & known(e["metadata"])
    ok = lambda c: F.coalesce(c, F.lit(False))
    return ok(nodes.isNotNull() & edges.isNotNull() & F.forall(nodes, lambda n: ok(node(n))) & F.forall(edges, lambda e: ok(edge(e))))


def valid_tour(beats: Column) -> Column:
    """At least one beat, each with something to say and node ids that are all there."""
    beat = lambda b: (F.trim(F.coalesce(b["say"], F.lit(""))) != "") & b["nodes"].isNotNull() & F.forall(b["nodes"], lambda n: n.isNotNull())
    return F.coalesce((F.size(beats) > 0) & F.forall(beats, lambda b: F.coalesce(beat(b), F.lit(False))), F.lit(False))


def route_chunks(texts: DataFrame, files: DataFrame | None = None, strict_metadata: bool = True, keep: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """(path, text) of insight files to (path, chunk, status), and columns to keep: ok, corrupt, invalid or missing_source. Inputs stay as they are."""
    parsed = texts.select("path", *keep, F.from_json("text", f"{CHUNK}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("chunk"))
    ok = valid_chunk(F.col("chunk.nodes"), F.col("chunk.edges"), strict_metadata)
    out = parsed.withColumn("status", F.when(F.col("chunk").isNull() | F.col("chunk._corrupt_record").isNotNull(), "corrupt").when(~ok, "invalid").otherwise("ok"))
    if files is None:
        return out
    named = out.where("status = 'ok'").select("path", F.explode("chunk.nodes").alias("n")).select("path", F.col("n.source_file").alias("file")).distinct()
    gone = named.join(files.select(F.col("source_file").alias("file")).distinct(), "file", "left_anti").select("path").distinct().withColumn("gone", F.lit(True))
    return out.join(gone, "path", "left").withColumn("status", F.when(F.col("gone"), "missing_source").otherwise(F.col("status"))).drop("gone")


def chunk_graph(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the chunks that are ok; an edge's metadata as a struct of rationale and source_doc."""
    good = chunks.where("status = 'ok'")
    known = F.struct(*[F.col("metadata")[k].alias(k) for k in ("rationale", "source_doc")])
    edges = good.select(F.explode("chunk.edges").alias("x")).select("x.*").withColumn("metadata", known)
    return good.select(F.explode("chunk.nodes").alias("x")).select("x.*").distinct(), edges.distinct()


def derive_documents(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A document node for each file that concepts name, and `contains` edges to them. Ids that other nodes have are skipped, as are concepts without a file."""
    concepts = nodes.where("file_type = 'concept' AND source_file IS NOT NULL AND source_file <> ''")
    taken = nodes.where("file_type <> 'document'").select(F.col("id").alias("_taken"))
    docs = concepts.select("source_file").distinct().withColumn("id", document_id(F.col("source_file")))
    docs = docs.join(taken, docs["id"] == taken["_taken"], "left_anti")
    made = docs.select("id", F.element_at(F.split("source_file", "/"), -1).alias("label"), F.lit("document").alias("file_type"), "source_file")
    edges = concepts.select(F.col("id").alias("target"), "source_file").join(docs, "source_file").select(F.col("id").alias("source"), "target", F.lit("contains").alias("relation"), F.lit("COGNITIVE").alias("type"), F.lit(1.0).alias("score"))
    return made, edges.distinct()


def reconcile(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without nodes of files that are gone. An edge stays if its source does and its target does or is no concept or document."""
    there = nodes.join(files.select("source_file").distinct(), "source_file", "left_semi").select(*nodes.columns)
    ids = there.select(F.col("id").alias("_id")).distinct()
    kept = edges.join(ids, edges["source"] == ids["_id"], "left_semi")
    target = kept.join(ids.withColumnRenamed("_id", "_target"), F.col("target") == F.col("_target"), "left")
    return there, target.where(F.col("_target").isNotNull() | ~(F.col("target").startswith("concept_") | F.col("target").startswith("doc_"))).drop("_target")


def reconcile_chunks(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """(path, chunk) of insight files to (path, nodes, edges, action), each chunk by itself.

    Nodes without a file that is there go. An edge stays if its source is one of the chunk's nodes left, and its target
    is too or is no concept or document. action: keep, rewrite (something went), remove (no node is left), or null for a
    chunk without nodes, which stays as it is.
    """
    flat = chunks.select("path", F.explode("chunk.nodes").alias("n")).select("path", F.col("n.source_file").alias("file")).distinct()
    there = flat.join(files.select(F.col("source_file").alias("file")).distinct(), "file", "left_semi").groupBy("path").agg(F.collect_set("file").alias("there"))
    out = chunks.join(there, "path", "left").withColumn("there", F.coalesce("there", F.array().cast("array<string>")))
    out = out.withColumn("nodes", F.filter("chunk.nodes", lambda n: F.coalesce(F.array_contains(F.col("there"), n["source_file"]), F.lit(False))))
    out = out.withColumn("ids", F.transform("nodes", lambda n: n["id"]))
    inside = lambda c: F.coalesce(F.array_contains(F.col("ids"), c), F.lit(False))
    code = lambda c: c.isNotNull() & (c != "") & ~c.startswith("concept_") & ~c.startswith("doc_")
    out = out.withColumn("edges", F.filter("chunk.edges", lambda e: inside(e["source"]) & (inside(e["target"]) | F.coalesce(code(e["target"]), F.lit(False)))))
    same = (F.size("nodes") == F.size("chunk.nodes")) & (F.col("chunk.edges").isNull() | (F.size("edges") == F.size("chunk.edges")))
    action = F.when(F.col("chunk.nodes").isNull(), None).when(same, "keep").when(F.size("nodes") == 0, "remove").otherwise("rewrite")
    return out.select("path", "nodes", "edges", action.alias("action"))


def reconciled(routed: DataFrame, files: DataFrame) -> DataFrame:
    """Routed insights (path, chunk, status) without what names files that are gone: chunks that lose all nodes get status removed."""
    good = routed.where("status = 'ok'")
    kept = reconcile_chunks(good, files).select("path", F.col("nodes").alias("_nodes"), F.col("edges").alias("_edges"), "action")
    out = routed.join(kept, "path", "left")
    own = F.col("action").isNotNull()
    chunk = F.when(own, F.col("chunk").withField("nodes", F.col("_nodes")).withField("edges", F.col("_edges"))).otherwise(F.col("chunk"))
    return out.select("path", chunk.alias("chunk"), F.when(F.col("action") == "remove", "removed").otherwise(F.col("status")).alias("status"))


def ingest_status(entries: DataFrame, watched: bool) -> DataFrame:
    """(path, text) to (path, status, refresh): what a batch of insights is answered."""
    routed = route_chunks(entries)
    return routed.select("path", F.when(F.col("status") == "ok", "ok").otherwise("invalid_schema").alias("status"), F.lit("queued" if watched else "cache_only").alias("refresh"))


def newest(rows: DataFrame, time: str, key: str, most: int = 50) -> DataFrame:
    """The newest rows, a null time as 0, ties by key: a bounded top-k."""
    return rows.orderBy(F.coalesce(F.col(time), F.lit(0)).desc(), key).limit(most)


def beat_offsets(beats: DataFrame, tour: str = "tour", pos: str = "pos", say: str = "say") -> DataFrame:
    """With duration (90 ms a character, at least 2500) and start_ms of each beat within its tour."""
    out = beats.withColumn("duration_ms", F.greatest(F.lit(2500), F.length(say) * 90).cast("long"))
    before = Window.partitionBy(tour).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("start_ms", F.coalesce(F.sum("duration_ms").over(before), F.lit(0)).cast("long"))


def active_focus(events: DataFrame, now_ms: int, clamp: bool = True) -> DataFrame:
    """(file, activity, timestamp, ttl) of the last event to arrive for each file that has not run out. A ttl of 0 or none means a minute."""
    ttl = F.coalesce(F.nullif(F.col("ttl"), F.lit(0)), F.lit(60_000)).cast("long")
    ttl = F.least(F.greatest(ttl, F.lit(1_000)), F.lit(3_600_000)) if clamp else ttl
    last = events.withColumn("ttl", ttl).groupBy("file").agg(F.max_by(F.struct("activity", "timestamp", "ttl"), "arrival").alias("x"))
    return last.select("file", "x.*").where(F.lit(now_ms) - F.col("timestamp") <= F.col("ttl"))


def focus_nodes(nodes: DataFrame, events: DataFrame) -> DataFrame:
    """(id, activity) of the nodes of focused files (file, activity)."""
    files = events.select(F.col("file").alias("source_file"), "activity")
    return nodes.select("id", "source_file").join(files, "source_file").select("id", "activity")


def beat_nodes(beats: DataFrame, nodes: DataFrame, tour: str = "tour", pos: str = "pos") -> DataFrame:
    """(tour, pos, id): the nodes that beats (tour, pos, nodes) light, unknown ids left out, each once a beat."""
    named = beats.select(tour, pos, F.explode("nodes").alias("id")).distinct()
    return named.join(nodes.select("id").distinct(), "id", "left_semi").select(tour, pos, "id")


def beat_edges(lit: DataFrame, edges: DataFrame, tour: str = "tour", pos: str = "pos") -> DataFrame:
    """(tour, pos, source, target, relation): edges with both ends among the nodes that one beat lights.

    Edges to or from nodes that no beat lights go first. A lit source then meets the fewer of its edges and its beat's
    nodes, so a node of many edges costs a beat no more than the nodes that it lights.
    """
    lit = settle(lit)
    ids = lit.select("id").distinct()
    ends = edges.select("source", "target", "relation")
    for end in ("target", "source"):
        ends = ends.join(ids.withColumnRenamed("id", end), end, "left_semi")
    ends = settle(ends)
    own, others = lit.withColumnRenamed("id", "source"), lit.withColumnRenamed("id", "target")
    own = own.withColumn("_lit", F.count(F.lit(1)).over(Window.partitionBy(tour, pos)))
    own = own.join(ends.groupBy("source").agg(F.count(F.lit(1)).alias("_out")), "source")
    along = own.where("_out <= _lit").join(ends, "source").join(others, [tour, pos, "target"])
    across = own.where("_out > _lit").join(others, [tour, pos]).join(ends, ["source", "target"])
    names = [tour, pos, "source", "target", "relation"]
    return along.select(*names).unionByName(across.select(*names))


def settled(first: DataFrame, second: DataFrame) -> DataFrame:
    """The rows of a second poll (source_file, size, mtime) that a first one, the settling time before, saw just so: files that are written."""
    return second.join(first.select("source_file", "size", "mtime").distinct(), ["source_file", "size", "mtime"], "left_semi")


def immediate_focus(changes: DataFrame) -> DataFrame:
    """(file) of changes (file, op) to light before anything is compiled anew: all but deletions, each once."""
    return changes.where("op <> 'delete'").select("file").distinct()


def bursts(events: DataFrame, key: str, time: str, gap: str) -> DataFrame:
    """(key, start, n): changes of a key that follow each other within the gap."""
    return events.groupBy(F.col(key), F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), "n")


def any_of(conditions: list[Column]) -> Column:
    return functools.reduce(operator.or_, conditions, F.lit(False))
