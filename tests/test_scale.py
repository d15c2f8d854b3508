"""What operators do for large tables: rows that joins make, and what goes through the driver."""

import os
import random

from pyspark.sql import functions as F

from graphloom.functions.lineage import settle
from graphloom.operators import change, cycles, graph, reach, resolve, rules


def rows_made(spark, run):
    """The most rows that one step of any plan makes while run() goes on, and the plans' steps: (name, rows)."""
    store = spark._jsparkSession.sharedState().statusStore()
    bus = spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty(30_000)
    before = store.executionsCount()
    run()
    bus.waitUntilEmpty(30_000)
    most, steps = 0, []
    for i in range(before, store.executionsCount()):
        held = store.executionsList(i, 1).head()
        values = store.executionMetrics(held.executionId())
        nodes = store.planGraph(held.executionId()).allNodes()
        for j in range(nodes.size()):
            node = nodes.apply(j)
            rows = 0
            for k in range(node.metrics().size()):
                metric = node.metrics().apply(k)
                said = values.get(metric.accumulatorId())
                if metric.name() == "number of output rows" and said.isDefined():
                    rows = int(said.get().replace(",", ""))
            steps.append((node.name(), rows))
            most = max(most, rows)
    return most, steps


def test_beats_at_a_node_of_many_edges(spark):
    """A source of 4000 edges, all of whose targets some beat lights, in 1000 beats: a beat meets its own nodes, not all edges."""
    edges = spark.range(4000).select(F.lit("hub").alias("source"), F.concat(F.lit("n"), "id").alias("target"), F.lit("contains").alias("relation"))
    beats = spark.range(1000).select(F.lit("t").alias("tour"), F.col("id").alias("pos"), F.array(F.lit("hub"), *[F.concat(F.lit("n"), (F.col("id") * 4 + k).cast("string")) for k in range(4)]).alias("at"))
    lit = beats.select("tour", "pos", F.explode("at").alias("id")).unionByName(spark.createDataFrame([("t", -1, "n0"), ("t", -1, "lone"), (None, 0, "hub")], "tour string, pos long, id string"))
    got = []
    most, _ = rows_made(spark, lambda: got.extend(map(tuple, change.beat_edges(lit, edges.union(edges.where("target = 'n7'"))).collect())))
    want = [("t", i // 4, "hub", f"n{i}", "contains") for i in range(4000)] + [("t", 1, "hub", "n7", "contains")]
    assert sorted(got) == sorted(want)
    assert most <= 50_000


def test_no_table_of_a_loop_is_broadcast(spark):
    """Components of chains, rings and a coloured rest, and counts of dependents: nothing but offsets, a row a partition, is broadcast."""
    n = F.col("id")
    rows = spark.range(60).select((n % 7 + 1000).alias("source"), ((n * 5 + 1) % 7 + 1000).alias("target"))
    rows = settle(rows.union(spark.range(40).select(n, n + 1)).union(spark.range(20).select(n + 500, (n + 1) % 20 + 500)))
    found = []
    steps = rows_made(spark, lambda: found.append(cycles.strong_components(rows)))[1]
    assert (500, 20) in {(r.component, r.size) for r in found[0].collect()}
    assert any("Join" in name for name, _ in steps) and not any("Broadcast" in name for name, _ in steps)
    imports = rows.where("source < 1000").select(F.col("source").cast("string").alias("source"), F.col("target").cast("string").alias("target"), F.lit("imports").alias("relation"), F.lit("PHYSICAL").alias("type"))
    steps = rows_made(spark, lambda: found.append(reach.dependent_counts(imports)))[1]
    assert {r.node: r.dependents for r in found[1].collect()}["40"] == 40
    assert all(rows <= 4 for name, rows in steps if name == "BroadcastExchange")


def test_rules_make_rows_for_matches_only(spark):
    """Two hundred rules over a thousand files, each matched by two patterns of all."""
    listed = rules.parse_rules({"boundaries": [{"from": f"*/a{k}", "to": "none", "except": "none/x"} for k in range(199)] + [{"from": "/b[0-9]+$", "to": "c/a7*", "pathKind": "glob"}, {"from": "a7$", "to": "b", "pathKind": "regex"}]}, spark)
    files = spark.range(1000).select(F.concat(F.lit("c/a"), (F.col("id") % 199).cast("string"), F.when(F.col("id") >= 199, F.concat(F.lit("/"), F.col("id").cast("string"))).otherwise("")).alias("file"))
    got = []
    most, _ = rows_made(spark, lambda: got.extend(rules.file_bitmaps(files, listed).collect()))
    bits = {r.file: (list(r.from_bits), list(r.to_bits)) for r in got}
    assert bits["c/a7"][0] == [1 << 7, 0, 0, 1 << 200 % 62] and bits["c/a7"][1] == [0, 0, 0, 1 << 199 % 62]
    assert {f for f, (a, _) in bits.items() if any(a)} == {f"c/a{i}" for i in range(199)}
    assert most <= 5_000


def test_degrees_keep_each_pair_once(spark):
    """Nulls, loops and both directions count as before, and pairs aren't told apart from both ends."""
    pairs = [("a", "b"), ("b", "a"), ("a", "a"), ("a", None), (None, "a"), (None, None), ("c", "a"), ("c", "a")]
    df = spark.createDataFrame([(a, b, "PHYSICAL") for a, b in pairs] + [("z", "a", "SUSPICIOUS")], "source string, target string, type string")
    want = {r.node: r.n for r in graph.both_ways(df.where("type = 'PHYSICAL'")).distinct().groupBy("node").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {r.node: r.degree for r in graph.degree_distinct(df).collect()} == want == {"a": 4, "b": 1, "c": 1, None: 2}
    many = spark.range(4000).select(F.concat(F.lit("s"), F.col("id") % 400).alias("source"), F.concat(F.lit("t"), "id").alias("target"), F.lit("PHYSICAL").alias("type"))
    assert sum(rows for name, rows in rows_made(spark, lambda: graph.degree_distinct(many).collect())[1] if name == "HashAggregate") < 20_000


def test_edges_are_not_shuffled_for_a_few_lost_ends(spark):
    """Sizes and layout edges where all, or all but a few, ends are nodes; the same as by joins with all nodes."""
    base = spark.range(3000).select(F.concat(F.lit("n"), F.col("id") % 1500).alias("source"), F.concat(F.lit("n"), (F.col("id") * 7 + 1) % 1500).alias("target"))
    odd = spark.createDataFrame([("n1", "lost"), ("lost", "n2"), (None, "n1"), ("n3", None)], "source string, target string")
    nodes = settle(spark.range(1500).select(F.concat(F.lit("n"), "id").alias("id")))
    for edges in (base, base.union(odd)):
        want = sorted(map(tuple, graph.prune_dangling(nodes, edges).collect()))
        for most in (0, 10):
            assert sorted(map(tuple, graph.prune_few(nodes, edges, most).collect())) == want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        held = settle(base.union(odd))
        steps = rows_made(spark, lambda: graph.prune_few(nodes, held).write.format("noop").mode("overwrite").save())[1]
        assert sum(name == "SortMergeJoin" for name, _ in steps) <= 1
        whole = held.withColumns({"type": F.lit("PHYSICAL"), "relation": F.lit("imports"), "score": F.lit(1.0)})
        hubs = spark.createDataFrame([("n1",)], "node string")
        steps = rows_made(spark, lambda: graph.layout_edges(nodes, whole, hubs).write.format("noop").mode("overwrite").save())[1]
        assert sum(name == "SortMergeJoin" for name, _ in steps) <= 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_coverage_meets_in_one_aggregation(spark):
    """Nulls, repeats and files of one id; edges aren't sorted for joins."""
    pairs = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "c"), ("a", None), (None, "b"), ("A", "b")], "caller string, target_file string")
    nodes = spark.createDataFrame([("1", "a"), ("1", "A"), ("2", "b"), ("3", "c"), ("4", None)], "id string, source_file string")
    edges = spark.createDataFrame([("1", "2"), ("1", "2"), ("2", "1"), ("4", "2"), ("1", "9"), (None, "2")], "source string, target string").withColumns({"relation": F.lit("imports"), "type": F.lit("PHYSICAL")})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = []
        steps = rows_made(spark, lambda: got.extend(resolve.coverage(pairs, nodes, edges).collect()))[1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [tuple(r) for r in got] == [(2, 4, 0.5)]
    assert not any(name == "SortMergeJoin" for name, _ in steps)


def test_ended_pointers_go_no_further(spark):
    """A long path beside many short ones: later rounds only write what still goes."""
    path = spark.range(64).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    short = spark.range(5000).select((F.col("id") + 1000).alias("a"), F.lit(-1).cast("long").alias("b"))
    pointers = settle(path.union(short))
    got = []
    _, steps = rows_made(spark, lambda: got.append(resolve._ends(pointers)))
    assert {r.a: r.end for r in got[0].collect()} == {i: 64 for i in range(64)} | {i + 1000: -1 for i in range(5000)}
    assert sum(rows for name, rows in steps if name.endswith("Join")) < 15_000


def test_estimates_do_not_grow_with_rounds(spark, monkeypatch):
    """Pointers into rings and a chain of stars: right ends, no estimate of size that rounds multiply, and rounds as paths are long, not as pointers are many."""
    bits = lambda df: int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()).bit_length()
    rng = random.Random(5)
    to = {i: rng.randrange(330) for i in range(300)} | {1000 + i: 1000 + (i + 1) % 3000 for i in range(3000)} | {5000: 1000, 5001: 5000}
    to = {a: b for a, b in to.items() if a != b}

    def end(a):
        seen = set()
        while a in to and a not in seen:
            seen.add(a)
            a = to[a]
        return a

    got = resolve._ends(settle(spark.createDataFrame(list(to.items()), "a long, b long")))
    assert bits(got) < 64
    assert {r.a: r.end for r in got.collect()} == {a: end(a) for a in to}
    stars = [(f"s{i}", None, f"s{i + 1}", None, 0) for i in range(6)] + [("s6", "x", "u", "y", None)]
    asks = spark.createDataFrame([(0, "s0", "x"), (1, "s5", "x"), (2, "u", "x")], "req_id int, file string, symbol string")
    got = resolve.unwrap_reexports(asks, spark.createDataFrame(stars, "file string, symbol string, target_file string, target_symbol string, star_pos int"))
    assert bits(got) < 128
    assert {tuple(r) for r in got.collect()} == {(0, "u", "y"), (1, "u", "y"), (2, "u", "x")}
    kept = []
    monkeypatch.setattr(resolve, "drop_folder", lambda _, path: kept.append(path))
    ring = settle(spark.createDataFrame([(a, b) for a, b in to.items() if a >= 1000], "a long, b long"))
    assert resolve._ends(ring).where("end = 1000").count() == 3
    assert sum(name.startswith("round=") for name in os.listdir(f"{kept[0].removeprefix('file:')}/all")) <= 4
