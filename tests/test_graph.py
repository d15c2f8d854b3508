"""Graph operators on small literal graphs: cycles, walks, hubs, rules, communities, suppression, insights, resolution."""

import hashlib
import itertools
import json
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom import queries
from graphloom.functions import connect, ids
from graphloom.functions.lineage import running, settle
from graphloom.operators import change, community, cycles, graph, louvain, reach, resolve, rules
from graphloom.plans import projections
from graphloom.plans.serve import Graph, clamp
from graphloom.sources import extract

from .plain_louvain import louvain as plain_louvain
from .plain_louvain import modularity


def edges(spark, pairs, kind="PHYSICAL", relation="imports", score=1.0):
    return spark.createDataFrame([(a, b, relation, kind, score) for a, b in pairs], "source string, target string, relation string, type string, score double")


@pytest.mark.parametrize("limit", [0, 1000])
@pytest.mark.parametrize(("pairs", "count", "score"), [("AB BA", 2, 0.6), ("AB BC CA", 3, 0.7), ("AB BC", 0, None), ("AA", 0, None), ("AB BA AA", 3, 0.6), ("AB BC CD DE EF FG GA", 7, 1.0)])
def test_cycles(spark, pairs, count, score, limit):
    got = graph.cycle_edges(edges(spark, [tuple(p) for p in pairs.split()]), limit).collect()
    assert len(got) == count and all(abs(r.score - score) < 1e-9 for r in got)


def test_distributed_components_equal_tarjan(spark):
    rng = random.Random(4)
    pairs = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(70)]
    df = edges(spark, pairs)
    one = {r.node: r.component for r in graph.components(df, 10_000).collect()}
    assert one and {r.node: r.component for r in graph.components(df, 0).collect()} == one


def test_warning_groups_and_walks(spark):
    cycles = graph.cycle_edges(edges(spark, [("A", "B"), ("B", "C"), ("C", "A"), ("C", "D"), ("X", "Y"), ("Y", "X")]))
    got = {r.key: r.walk for r in graph.warning_groups(cycles, walks=True).collect()}
    assert got == {"cycle_A_B_C": ["A", "B", "C", "A"], "cycle_X_Y": ["X", "Y", "X"]}
    with pytest.raises(ValueError, match="closed walk"):
        graph.warning_groups(cycles, walks=True, longest_walk=2)
    every = edges(spark, [("A", "B"), ("B", "A"), ("Q", "Q"), ("A", "Z")], "SUSPICIOUS", "circular_dependency", 0.6).unionByName(edges(spark, [("A", "B")], "SUSPICIOUS", "violates_boundary", 0.9)).unionByName(edges(spark, [("A", "B")], "SUSPICIOUS", "odd", 0.1))
    assert [(r.type, r.key, r.n_edges) for r in graph.all_warning_groups(every).collect()] == [("boundary", "sus_A->B_violates_boundary", 1), ("cycle", "cycle_A_B", 2), ("cycle", "cycle_Q", 1), ("other", "sus_A->B_odd", 1)]


def plain_walk(nodes, pairs):
    """A closed walk by breadth-first search, written apart from the operator."""
    after = {}
    for a, b in sorted(pairs):
        after.setdefault(a, []).append(b)
    walk = [nodes[0]]
    for a, b in itertools.pairwise([*nodes, nodes[0]]):
        paths, seen = [[a]], {a}
        while paths and (len(paths[0]) == 1 or paths[0][-1] != b):
            path = paths.pop(0)
            for y in after.get(path[-1], []):
                if y == b or y not in seen:
                    seen.add(y)
                    paths.append([*path, y])
                    if y == b:
                        paths.insert(0, paths.pop())
                        break
        walk += paths[0][1:]
    return walk


def test_walks_of_the_query(spark):
    sf = "/root/testdata/sf0.001"
    rings = {}
    for r in graph.cycle_edges(projections.trade_edges(spark, sf)).collect():
        rings.setdefault(r.component, []).append((r.source, r.target))
    want = {}
    for pairs in rings.values():
        nodes = sorted({x for p in pairs for x in p})
        want["cycle_" + "_".join(nodes)] = ",".join(plain_walk(nodes, pairs))
    got = {r.key: r.walk for r in queries.cycle_walk(spark, sf).collect()}
    assert got.keys() == want.keys()
    for key, walk in got.items():
        steps = walk.split(",")
        assert len(steps) == len(want[key].split(",")) and steps[0] == steps[-1] and set(steps) == set(key[6:].replace("_nation", ",nation").split(","))
        assert set(itertools.pairwise(steps)) <= {p for pairs in rings.values() for p in pairs}


def test_hubs(spark):
    star = [p for i in range(1, 100) for p in (("n0", f"n{i}"), (f"n{i}", "n0"))]
    assert [r.node for r in graph.hubs(edges(spark, star)).collect()] == ["n0"]
    assert graph.hubs(edges(spark, [("a", "b"), ("b", "c")])).collect() == []


def test_reach(spark):
    e = edges(spark, [("w", "app"), ("app", "db"), ("db", "w"), ("x", "app")])
    assert {r.node for r in graph.dependents(e, "db").collect()} == {"app", "w", "x", "db"}
    assert {(r.root, r.node) for r in graph.all_dependents(e).collect()} == {(a, b) for a in ("w", "app", "db") for b in ("w", "app", "db", "x")}
    near = {r.node: r.distance for r in graph.neighbourhood(e, "x", 2).collect()}
    assert near == {"x": 0, "app": 1, "w": 2, "db": 2}


def test_suppression(spark):
    both = edges(spark, [("a", "b"), ("c", "d")]).unionByName(edges(spark, [("b", "a")], "SUSPICIOUS"))
    assert {(r.source, r.type) for r in graph.suppress_covered(both).collect()} == {("b", "SUSPICIOUS"), ("c", "PHYSICAL")}
    assert {r.source for r in graph.suppress_covered(both, False).collect()} == {"a", "b", "c"}
    assert {r.source for r in graph.layers(both, suspicious=False).collect()} == {"a", "c"} and graph.layers(both).count() == 3
    core = spark.createDataFrame([("a",), ("b",)], "id string")
    assert {(r.source, r.tier) for r in graph.edge_tiers(both, core).collect()} == {("a", 2), ("b", 2), ("c", 0)}


def test_hit_tests(spark):
    points = spark.createDataFrame([("a", 0.0, 0.0, 5.0, True), ("b", 100.0, 0.0, 5.0, False)], "id string, x double, y double, size double, hub boolean")
    assert graph.nearest_node(points, 7.0, 0.0).first().id == "a" and graph.nearest_node(points, 9.0, 0.0).isEmpty()
    lines = spark.createDataFrame([("a", "b", 0.0, 0.0, 10.0, 0.0), ("a", "a", 5.0, 5.0, 5.0, 5.0)], "source string, target string, x1 double, y1 double, x2 double, y2 double")
    assert graph.nearest_edge(lines, 5.0, 2.0).first().target == "b" and graph.nearest_edge(lines, 5.0, 40.0).isEmpty()
    assert graph.nearest_node(points, 8.0, 0.0).isEmpty() and graph.nearest_edge(lines, 15.0, 0.0, 2.4).isEmpty() and graph.nearest_edge(lines, 5.0, 0.0, 0.05).isEmpty()
    seen = lambda *a: [(r.id, r.labelled) for r in graph.in_view(points, *a).orderBy("id").collect()]
    assert seen((0.0, 0.0), 1.0, 1200, 800) == [("a", True), ("b", False)] and seen((0.0, 0.0), 1.4, 1200, 800) == [("a", True), ("b", True)]
    assert seen((0.0, 0.0), 1.0, 182, 100) == [("a", True), ("b", False)] and seen((0.0, 0.0), 1.0, 178, 100) == [("a", True)]
    assert seen((0.0, 0.0), 0.44, 1200, 800)[0] == ("a", False) and seen((0.0, 0.0), 0.3, 2400, 800)[0] == ("a", True)


def test_rules(spark):
    assert [rules.glob_pattern(g) for g in ("src/hud/**", "src/*.ts", "a.b/c?")] == ["^src/hud/.*$", r"^src/[^/]*\.ts$", r"^a\.b/c[^/]$"]
    raw = [{"from": "a"}, {"from": "a", "to": "b", "severity": "bad"}, {"from": "(", "to": "b", "pathKind": "regex"}, {"from": "a", "to": "b", "pathKind": "x"}, {"from": "a", "to": "b", "except": [1, 2]}, {"from": "a/**", "to": "b/**", "except": "c/**"}]
    for session in (spark, None):
        assert [r["except"] for r in rules.parse_rules({"boundaries": raw}, session)] == [["c/**"]]
    assert rules.parse_rules(raw) == rules.parse_rules({"boundaries": {}}) == rules.parse_rules({"rules": raw}) == rules.parse_rules({"boundaries": [{"from": "a", "to": "b", "reason": 1}, {"from": "a", "to": "b", "severity": None}]}) == []
    assert rules.parse_rules({"boundaries": [{"from": "a", "to": ""}]}) == [{"from": "a", "to": "", "except": [], "pathKind": "glob", "severity": "error", "reason": ""}]
    listed = rules.parse_rules({"boundaries": [{"from": "hud/**", "to": "server/**", "except": ["server/types.ts"]}, {"from": "**", "to": "server/**", "severity": "warn", "reason": "no"}]}, spark)
    e = spark.createDataFrame([("hud/a.ts", "server/x.ts"), ("hud/a.ts", "server/types.ts"), ("lib/q.ts", "hud/z.ts")], "from_file string, to_file string")
    assert [(r.rule_pos, r.violation_score, r.reason) for r in rules.violations(e, listed).orderBy("rule_pos").collect()] == [(0, 0.9, "Forbidden import: hud/** must not import server/**"), (1, 0.5, "no")]
    assert rules.violations(e, []).collect() == []
    made, notes = rules.from_dependency_rules({"forbidden": [{"name": "ok", "severity": "error", "from": {"path": ["^a", "^b"]}, "to": {"path": "^c", "pathNot": "^c/d"}}, {"name": "back", "from": {"path": "^(a)"}, "to": {"path": "$1"}}, {"name": "orphan", "from": {"orphan": True}, "to": {}}]})
    assert made == [{"from": "(?:^a|^b)", "to": "^c", "pathKind": "regex", "severity": "error", "reason": "ok", "except": ["^c/d"]}] and len(notes) == 2


def test_many_rules(spark):
    """Beyond a word of them, rules meet as bitmaps: first matches as of plain patterns, and each file meets only what its folders allow."""
    rng = random.Random(6)
    name = lambda: "/".join(rng.choice("abc") + str(rng.randrange(3)) for _ in range(rng.randrange(1, 4)))
    glob = lambda: rng.choice([name() + "/**", "**/" + name(), name(), name(), name(), "*/" + name(), name()[:-1] + "?"])
    listed = [{"from": glob(), "to": glob(), "except": [glob() for _ in range(rng.randrange(2))], "severity": rng.choice(["warn", "error"])} for _ in range(400)]
    listed += [{"from": "a", "to": "0$", "pathKind": "regex"}]
    checked = rules.parse_rules({"boundaries": listed}, spark)
    pairs = [(name(), name()) for _ in range(300)] + [(None, "a0"), ("a0", None)]
    got = {(r.from_file, r.to_file): (r.rule_pos, r.severity) for r in rules.violations(spark.createDataFrame(pairs, "from_file string, to_file string"), checked).collect()}
    hit = lambda p, r, f: bool(re.search(rules.pattern_of(p, r["pathKind"]), f))
    want = {}
    for a, b in pairs[:300]:
        for i, r in enumerate(checked):
            if hit(r["from"], r, a) and hit(r["to"], r, b) and not any(hit(p, r, b) for p in r["except"]):
                want[a, b] = (i, r["severity"])
                break
    assert got == want
    assert max(i for i, _ in want.values()) > 62
    assert [rules.literal_folder(p, "glob") for p in ("a/b/**", "a/b", "a*/c", "**", "x")] == ["a/b/".removesuffix("/") + "/", "a/", "", "", ""]


def test_budget_by_partitions(spark):
    """A budget of 10 million tokens, which no task ranks alone, keeps what one task would."""
    rng = random.Random(2)
    rows = [(f"k{i:06}", rng.randrange(1, 9000)) for i in range(9000)]
    df = spark.createDataFrame(rows, "id string, cost long").repartition(6)
    far = graph.within_budget(df, [F.col("id")], F.col("cost"), 10_000_000, 1)
    total = 0
    for (name, cost), r in zip(sorted(rows), far.orderBy("rank").collect(), strict=False):
        total += cost
        assert (r.id, r.spent, r.kept) == (name, total, total <= 10_000_000)
    assert 0 < far.where("kept").count() < 9000


def test_communities(spark):
    cliques = [p for g in ("abc", "xyz") for p in itertools.combinations(g, 2)]
    every = edges(spark, cliques).unionByName(edges(spark, [("c", "x")], "COGNITIVE", "implements", 0.9))
    nodes = spark.createDataFrame([(n,) for n in "abcxyzq"], "id string")
    got = {r.node: r.community for r in community.detect(nodes, every).collect()}
    assert len({got[n] for n in "abc"}) == len({got[n] for n in "xyz"}) == 1 and len({got["a"], got["x"], got["q"]}) == 3
    assert community.detect(nodes.limit(0), every.limit(0)).collect() == []
    assert community.match_greedily([(0, 7, 0.9), (1, 7, 0.5)], [0, 1, 2]) == {0: 7, 1: 0, 2: 1}
    both = lambda m: spark.createDataFrame(list(m.items()), "node string, community long")
    assert {r.node: r.community for r in community.stabilize(both({"a": 5, "b": 5, "c": 6}), both({"a": 0, "b": 0, "c": 1})).collect()} == {"a": 0, "b": 0, "c": 1}
    assert {r.node: r.community for r in community.stabilize(both({"a": 5}), both({"z": 3})).collect()} == {"a": 0}
    assert community.stabilize(both({"a": 5}).limit(0), both({"z": 3})).collect() == []


def connected_parts(pairs, label):
    """How many parts the communities have when only links within them count."""
    top = {n: n for n in label}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b, _ in pairs:
        if label[a] == label[b]:
            top[root(a)] = root(b)
    return len({root(n) for n in label})


@pytest.mark.parametrize("block", [1 << 17, 12])
def test_louvain_over_tables(spark, block):
    """Planted groups are found, a hub (in small blocks one with more links than a block) has its leaves, modularity is that of the plain way, nearly."""
    rng = random.Random(5)
    group = {f"n{i}": i // 8 for i in range(24)}
    pairs = {tuple(sorted(rng.sample(sorted(group), 2))) for _ in range(12)} | {tuple(sorted(p)) for g in range(3) for p in itertools.combinations([n for n in group if group[n] == g], 2) if rng.random() < 0.6}
    listed = sorted((a, b, rng.choice([0.5, 1.0, 2.0])) for a, b in pairs) + [("p", "q", 1.0), ("s", "s", 1.0)] + [("hub", f"leaf{i}", 1.0) for i in range(19)]
    weights = spark.createDataFrame(listed, "a string, b string, weight double")
    got = {r.node: r.label for r in louvain.louvain(weights, block=block).collect()}
    assert set(got) == {x for a, b, _ in listed for x in (a, b)} and got["p"] == got["q"] and len({got[f"leaf{i}"] for i in range(19)} | {got["hub"]}) == 1
    assert modularity(listed, got) > modularity(listed, plain_louvain(listed)) - 0.01
    assert connected_parts(listed, got) == len(set(got.values()))


def test_louvain_of_parts(spark):
    """Over the parts of sf0.01, in one block and in many: within 0.01 of the plain way."""
    weights = settle(community.pair_weights(community.clustering_edges(projections.next_edges(spark, "/root/testdata/sf0.01"))))
    listed = [tuple(r) for r in weights.orderBy("a", "b").collect()]
    want = modularity(listed, plain_louvain(listed))
    got = {r.node: r.label for r in louvain.louvain(weights, block=500).collect()}
    assert modularity(listed, got) > want - 0.01
    assert connected_parts(listed, got) == len(set(got.values()))


def test_connected_in_many_tasks(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1200)]
    top = {}

    def root(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        top[max(x, y)] = min(x, y)
    want = {x: root(x) for a, b in links if a != b for x in (a, b)}
    df = spark.createDataFrame(links, "u long, v long").repartition(7)
    for most in (50, 1 << 17):
        assert {r.node: r.root for r in connect.connected(df, most).collect()} == want


def test_running_sums(spark):
    """Over many partitions as a window over one, ties and a budget of 10 million included."""
    rng = random.Random(9)
    rows = [(rng.randrange(50), f"k{i}", rng.randrange(2000)) for i in range(20_000)]
    df = spark.createDataFrame(rows, "o int, k string, cost long").repartition(5)
    got = running(df, [F.col("o"), F.col("k")], F.col("cost"), "spent").where("spent <= 10000000").collect()
    total, want = 0, []
    for i, (o, k, cost) in enumerate(sorted(rows)):
        total += cost
        if total <= 10_000_000:
            want.append((o, k, cost, i, total))
    assert sorted((r.o, r.k, r.cost, r["rank"], r.spent) for r in got) == want
    assert running(df.limit(0), [F.col("o")], F.col("cost")).collect() == []


@pytest.mark.parametrize(("nodes", "links", "seed"), [(30, 33, 1), (40, 120, 2), (24, 30, 3), (60, 75, 4)])
def test_strong_components_of_random_graphs(spark, nodes, links, seed):
    rng = random.Random(seed)
    pairs = [(f"v{rng.randrange(nodes):02}", f"v{rng.randrange(nodes):02}") for _ in range(links)]
    found = graph.tarjan([p for p in pairs if p[0] != p[1]])
    sizes = Counter(found.values())
    got = cycles.strong_components(spark.createDataFrame(pairs, "source string, target string"))
    assert sorted(map(tuple, got.collect())) == sorted((n, c, sizes[c]) for n, c in found.items() if sizes[c] > 1)


def test_rounds_follow_logarithms(spark):
    """A ring and a path of 2000 nodes, and a ladder of rings joined by long chains."""
    ring = [(f"r{i}", f"r{(i + 1) % 2000}") for i in range(2000)] + [(f"p{i}", f"p{i + 1}") for i in range(2000)]
    chains = [(f"c{k}_{i}", f"c{k}_{i + 1}") for k in range(3) for i in range(500)] + [("a", "c0_0"), ("a", "c1_0"), ("c0_500", "b"), ("c1_500", "b"), ("b", "c2_0"), ("c2_500", "a")]
    pairs, rounds = ring + chains, cycles.Rounds()
    got = cycles.strong_components(spark.createDataFrame(pairs, "source string, target string"), rounds)
    sizes = Counter(r.component for r in got.collect())
    assert sizes == {"r0": 2000, "a": 3 * 501 + 2}
    assert rounds.doubling + rounds.spreading <= 60


def plain_dependents(pairs):
    back = defaultdict(set)
    for a, b in pairs:
        back[b].add(a)
    out = {}
    for start in {x for p in pairs for x in p}:
        seen, todo = set(), list(back[start])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += back[x]
        out[start] = len(seen)
    return out


@pytest.mark.parametrize(("nodes", "links", "seed"), [(30, 33, 1), (40, 60, 2), (60, 200, 3)])
def test_dependent_counts(spark, nodes, links, seed):
    """Cycles, loops, trees, chains and meeting points; what is no physical import doesn't count."""
    rng = random.Random(seed)
    pairs = [(f"v{a:02}", f"v{b:02}") for a, b in ((rng.randrange(nodes), rng.randrange(nodes)) for _ in range(links)) if a <= b or rng.random() < 0.2]
    df = edges(spark, pairs).unionByName(edges(spark, [("z", "v01")], "COGNITIVE")).unionByName(edges(spark, [("y", "v02")], relation="calls"))
    got = {r.node: (r.dependents, r.exact) for r in reach.dependent_counts(df).collect()}
    assert got == {n: (c, True) for n, c in plain_dependents(pairs).items()}


def test_dependent_counts_estimated(spark):
    """Small sketches: counts to half their size are exact, others within five times the stated deviation; a path of diamonds has many levels."""
    pairs = [e for i in range(120) for e in ((f"d{i:03}", f"l{i:03}"), (f"d{i:03}", f"r{i:03}"), (f"l{i:03}", f"d{i + 1:03}"), (f"r{i:03}", f"d{i + 1:03}"))][: 4 * 12] + [(f"leaf{i}", "d000") for i in range(900)] + [("d012", f"out{i}") for i in range(3)]
    got = {r.node: (r.dependents, r.exact) for r in reach.dependent_counts(edges(spark, pairs), lg_entries=8).collect()}
    want = plain_dependents(pairs)
    assert set(got) == set(want)
    for node, (n, exact) in got.items():
        assert n == want[node] if exact else abs(n - want[node]) <= 5 / 2**4 * want[node] and want[node] > 100


def test_edges_of_other_types_are_no_dependence(spark):
    e = edges(spark, [("a", "b")]).unionByName(edges(spark, [("z", "b")], "COGNITIVE")).unionByName(edges(spark, [("y", "b")], relation="calls"))
    assert {r.node for r in graph.dependents(e, "b").collect()} == {"a"}
    assert {(r.root, r.node) for r in graph.all_dependents(e).collect()} == {("b", "a")}


def test_stabilize_like_greedy_matching(spark):
    rng = random.Random(8)
    new, old = ({f"n{i}": rng.randrange(k) for i in range(200)} for k in (14, 9))
    table = lambda m: spark.createDataFrame(list(m.items()), "node string, community long")
    sides = lambda m: {c: {n for n in m if m[n] == c} for c in set(m.values())}
    a, b = sides(new), sides(old)
    overlaps = [(x, y, len(a[x] & b[y]) / len(a[x] | b[y])) for x in a for y in b if a[x] & b[y]]
    plan = community.match_greedily(overlaps, list(a))
    assert {r.node: r.community for r in community.stabilize(table(new), table(old)).collect()} == {n: plan[c] for n, c in new.items()}
    sf = "/root/testdata/sf0.001"
    new, old = ({r.node: r.community for r in df.collect()} for df in queries._clusterings(spark, sf))
    a, b = sides(new), sides(old)
    plan = community.match_greedily([(x, y, len(a[x] & b[y]) / len(a[x] | b[y])) for x in a for y in b if a[x] & b[y]], list(a))
    assert {r.node: r.community for r in queries.stabilize(spark, sf).collect()} == {n: plan[c] for n, c in new.items()}


def test_louvain_of_the_query(spark):
    """Each node has a community, and no two communities would be better as one, nor all nodes as their own."""
    sf = "/root/testdata/sf0.001"
    nodes, every = queries.trade(spark, sf)
    label = {r.node: r.community for r in queries.louvain(spark, sf).collect()}
    assert set(label) == {r.id for r in nodes.collect()} and set(label.values()) == set(range(len(set(label.values()))))
    pairs = [tuple(r) for r in community.pair_weights(community.clustering_edges(every)).collect()]
    top = modularity(pairs, label)
    assert top >= max(0.0, modularity(pairs, {n: n for n in label}))
    for x, y in itertools.combinations(set(label.values()), 2):
        assert modularity(pairs, {n: y if c == x else c for n, c in label.items()}) <= top + 1e-9


def test_ids(spark):
    row = spark.createDataFrame([("./Src\\My File.ts", "Bar.do-It", "héllo 😀")], "p string, n string, t string")
    path = ids.normal_path(F.col("p"))
    got = row.select(path, ids.file_id(path), ids.symbol_id(path, F.col("n")), ids.content_hash(F.col("t")), ids.document_id(F.lit("docs/Über Uns.md"))).first()
    units = "héllo 😀".encode("utf-16-be")
    h = 5381
    for i in range(0, len(units), 2):
        h = (h * 33 + int.from_bytes(units[i : i + 2], "big")) % 2**32
    digits = ""
    while h:
        h, d = divmod(h, 36)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + digits
    assert got[:4] == ("Src/My File.ts", "src_my_file.ts", "src_my_file.ts:bar.do_it", digits)
    assert got[4] == "doc_docs_ber_uns_md_" + hashlib.sha256("docs/Über Uns.md".encode()).hexdigest()[:8]
    assert [extract.text_hash(t) for t in ("héllo 😀", "", "x" * 70000)] == [r[0] for r in spark.createDataFrame([("héllo 😀",), ("",), ("x" * 70000,)], "t string").select(ids.content_hash(F.col("t"))).collect()]
    assert row.select(ids.document_id(F.lit("---"))).first()[0].startswith("doc_source_")


def test_insights(spark):
    good = '{"nodes":[{"id":"concept_a","label":"A","file_type":"concept","source_file":"docs/a.md"}],"edges":[{"source":"concept_a","target":"x","relation":"implements","type":"COGNITIVE","score":0.9,"metadata":{"rationale":"r"}}]}'
    bad = {"path": good.replace("docs/a.md", "../a.md"), "absolute": good.replace("docs/a.md", "/a.md"), "score": good.replace("0.9", "1.5"), "kind": good.replace('"concept","s', '"image","s'), "type": good.replace("COGNITIVE", "OTHER"), "metadata": good.replace("rationale", "provenance"), "id": good.replace('"id":"concept_a"', '"id":""'), "null": good.replace('"rationale":"r"', '"rationale":null'), "no nodes": '{"edges":[]}'}
    rows = [("ok", good), ("blank ends", good.replace('"target":"x"', '"target":""')), ("corrupt", "{"), ("gone", good.replace("docs/a.md", "docs/b.md")), *bad.items()]
    files = spark.createDataFrame([("docs/a.md",)], "source_file string")
    got = {r.path: r.status for r in change.route_chunks(spark.createDataFrame(rows, "path string, text string"), files).collect()}
    assert got == {"ok": "ok", "blank ends": "ok", "corrupt": "corrupt", "gone": "missing_source", **dict.fromkeys(bad, "invalid")}
    loose = change.route_chunks(spark.createDataFrame([("m", bad["metadata"])], "path string, text string"), strict_metadata=False)
    assert loose.first().status == "ok"
    assert change.ingest_status(spark.createDataFrame([rows[0], rows[2]], "path string, text string"), True).orderBy("path").first()[1:] == ("invalid_schema", "queued")
    tours = spark.createDataFrame([([("hi", ["a"])],), ([(" ", ["a"])],), ([],), (None,)], "beats array<struct<say:string,nodes:array<string>>>")
    assert [r[0] for r in tours.select(change.valid_tour(F.col("beats"))).collect()] == [True, False, False, False]


def test_reconciliation(spark):
    node = lambda i, f: {"id": i, "label": i, "file_type": "concept", "source_file": f}
    edge = lambda a, b: {"source": a, "target": b, "relation": "r", "type": "COGNITIVE", "score": 1.0}
    texts = {
        "same": {"nodes": [node("concept_a", "a.md")], "edges": [edge("concept_a", "src_x"), edge("concept_a", "concept_a")]},
        "part": {"nodes": [node("concept_a", "a.md"), node("concept_b", "gone.md"), node("concept_c", None)], "edges": [edge("concept_a", "concept_b"), edge("concept_b", "src_x"), edge("concept_a", "doc_z"), edge("concept_a", "code")]},
        "gone": {"nodes": [node("concept_b", "gone.md")], "edges": []},
        "none": {"edges": []},
        # concept_b is there in another chunk only, which doesn't help.
        "other": {"nodes": [node("concept_q", "a.md")], "edges": [edge("concept_q", "concept_a")]},
    }
    rows = spark.createDataFrame([(k, json.dumps(v)) for k, v in texts.items()], "path string, text string")
    files = spark.createDataFrame([("a.md",), ("a.md",)], "source_file string")
    got = {r.path: r for r in change.reconcile_chunks(change.route_chunks(rows), files).collect()}
    assert {p: r.action for p, r in got.items()} == {"same": "keep", "part": "rewrite", "gone": "remove", "none": None, "other": "rewrite"}
    assert [n.id for n in got["part"].nodes] == ["concept_a"] and [e.target for e in got["part"].edges] == ["code"] and got["other"].edges == []


def test_focus(spark):
    rows = [("d", "v", 0, 0, 5), ("a", "x", 0, 10, 1), ("a", "y", 5000, 10, 2), ("b", "z", 0, 10**9, 3), ("c", "w", 0, None, 4)]
    df = spark.createDataFrame(rows, "file string, activity string, timestamp long, ttl long, arrival long")
    assert {r.file: (r.activity, r.ttl) for r in change.active_focus(df, 6000).collect()} == {"a": ("y", 1000), "b": ("z", 3_600_000), "c": ("w", 60_000), "d": ("v", 60_000)}


def test_module_resolution(spark):
    files = spark.createDataFrame([(f,) for f in ("src/a.ts", "src/a/index.ts", "src/dirOnly/index.ts", "src/caller.ts", "lib/foo.ts")], "source_file string")
    specs = ["./a.js", "./a", "./dirOnly", "react", "@/foo", "../../out", "@/a", "./missing"]
    imports = spark.createDataFrame([(i, "src/caller.ts", s) for i, s in enumerate(specs)], "import_id int, caller string, specifier string")
    got = {r.import_id: r.target_file for r in resolve.resolve_modules(imports, files, [("@/*", ["src/*", "lib/*"])]).collect()}
    assert [got[i] for i in range(len(specs))] == ["src/a.ts", "src/a.ts", "src/dirOnly/index.ts", None, "lib/foo.ts", None, "src/a.ts", None]
    # A pattern without a star is a prefix, the first target that is a file counts, and `.` is no relative specifier.
    specs = ["lib", "library/foo", "lib/foo", ".", "..", "x" * 20_000, None]
    imports = spark.createDataFrame([(i, "src/caller.ts", s) for i, s in enumerate(specs)], "import_id int, caller string, specifier string")
    got = {r.import_id: r.target_file for r in resolve.resolve_modules(imports, files, [("lib", ["none", "lib/foo"]), ("x*", ["no/*"])]).collect()}
    assert [got[i] for i in range(len(specs))] == ["lib/foo.ts", "lib/foo.ts", "lib/foo.ts", None, None, None, None]


def test_reexports(spark):
    rows = [("i", "f", "a", "g", None), ("i", "*", "m", None, 0), ("m", "*", "d", None, 0), ("d", "x", "d2", "x", None), ("p", "l", "q", "l", None), ("q", "l", "p", "l", None)]
    exports = spark.createDataFrame(rows, "file string, symbol string, target_file string, target_symbol string, star_pos int")
    asks = spark.createDataFrame([(0, "i", "f"), (1, "i", "x"), (2, "p", "l"), (3, "z", "k")], "req_id int, file string, symbol string")
    got = {r.req_id: (r.file, r.symbol) for r in resolve.unwrap_reexports(asks, exports).collect()}
    assert got == {0: ("a", "g"), 1: ("d2", "x"), 2: ("p", "l"), 3: ("z", "k")}
    twice = spark.createDataFrame([("i", "f", "z", "z", None, 1), ("i", "f", "a", "a", None, 2)], "file string, symbol string, target_file string, target_symbol string, star_pos int, pos int")
    assert resolve.unwrap_reexports(asks.limit(1), twice).first()[1:] == ("a", "a")


def test_namespace_members(spark):
    """A namespace's member is followed through what its file exports, a default to the file's default symbol."""
    symbols = spark.createDataFrame([("deep:go", "Go", "deep", 0), ("deep:main", "main", "deep", 1), ("lib:own", "own", "lib", 0)], "id string, label string, source_file string, pos int")
    binds = spark.createDataFrame([("me", "ns", "lib", None, "namespace"), ("me", "n", "lib", "own", "named")], "caller string, local_key string, target_file string, target_symbol string, kind string")
    exports = spark.createDataFrame([("lib", "run", "deep", "Go", None, 0), ("lib", "start", "deep", "default", None, 1)], "file string, symbol string, target_file string, target_symbol string, star_pos int, pos int")
    calls = spark.createDataFrame([("me", c, "." in c, i) for i, c in enumerate(["ns.run", "NS.start", "ns.own", "ns.none", "n.own", "ns.map", "map", "n"])], "caller_file string, callee string, is_member boolean, pos int")
    defaults = spark.createDataFrame([("deep", "main")], "df string, default_symbol string")
    got = {(r.source_file, r.target) for r in resolve.call_edges(calls, symbols, binds, exports, defaults).collect()}
    assert got == {("me", "deep:go"), ("me", "deep:main"), ("me", "lib:own")}


def test_serving(spark):
    rows = [("src_a_ts", "a.ts", "src/a.ts", None, 0), ("src_a_ts:foo", "foo", "src/a.ts", "L1", 0), ("src_a_ts:bar.baz", "baz", "src/a.ts", "L5", 0), ("src_a_ts:other.baz", "baz", "src/a.ts", "L9", 0), ("src_b_ts", "b.ts", "src/b.ts", None, 1), ("src_b_ts:qux", "qux", "src/b.ts", "L2", 1)]
    nodes = spark.createDataFrame([(a, b, "code", c, d, e) for a, b, c, d, e in rows], "id string, label string, file_type string, source_file string, source_location string, community int")
    e = edges(spark, [("src_a_ts", f"src_a_ts:{x}") for x in ("foo", "bar.baz", "other.baz")] + [("src_b_ts", "src_b_ts:qux")], relation="contains").unionByName(edges(spark, [("src_a_ts:foo", "src_b_ts:qux")], relation="calls")).unionByName(edges(spark, [("src_a_ts", "src_b_ts")], "SUSPICIOUS", "violates_boundary", 0.5))
    g = Graph(nodes, e, spark.createDataFrame([("src_a_ts",), ("src_b_ts",)], "node string"))
    assert g.overview_text().splitlines()[0] == "GRAPH 6 nodes, 6 edges, 2 communities"
    text = g.neighbourhood_text("src_a_ts:foo", 1)
    assert "NODE src_b_ts:qux | qux [L2]" in text and "violates" not in text
    assert text.splitlines()[0] == "NEIGHBORHOOD root=src_a_ts:foo depth=1 | 3 nodes, 2 edges" and "EDGE src_a_ts:foo --calls--> src_b_ts:qux" in text
    assert g.overview_text().splitlines()[1:] == ["COMMUNITY 0 (4 nodes) hub=a.ts | a.ts, foo, baz, baz", "COMMUNITY 1 (2 nodes) hub=b.ts | qux, b.ts"]
    assert g.overview_json()["communities"][0]["hub_id"] == "src_a_ts"
    assert g.neighbourhood_text("src_a_ts", 5, 1).splitlines()[1] == "NODE src_a_ts | a.ts [file]"
    many = Graph(nodes.unionByName(nodes.limit(1).select(F.explode(F.array([F.lit(f"x{i:03}") for i in range(200)])).alias("id"), *nodes.columns[1:])), e.unionByName(edges(spark, [("src_a_ts", f"x{i:03}") for i in range(200)])), g.hubs)
    lines = many.neighbourhood_text("src_a_ts", 1, 100).splitlines()
    assert lines[0].endswith("(truncated to budget)") and 400 - 40 < sum(len(x) + 1 for x in lines if x.startswith("NODE")) <= 400
    said = g.neighbourhood_json("src_a_ts:foo", 1)
    assert not said["truncated"] and {n["id"] for n in said["nodes"]} == {"src_a_ts:foo", "src_a_ts", "src_b_ts:qux"} and len(said["edges"]) == 2
    assert many.neighbourhood_json("src_a_ts", 1, 100)["truncated"]
    assert g.resolve("src/a.ts", "baz").count() == 2 and g.resolve("src/b.ts", "BarClass.qux").first().id == "src_b_ts:qux"
    assert g.resolve("./src/a.ts").collect()[0].id == "src_a_ts" and g.resolve("src\\a.ts").count() == 1 and g.resolve("src/a.ts", "none").isEmpty()
    assert g.violations().first().severity == "warn" and g.violations().first().reason == ""
    for wrong, error in ((lambda: g.neighbourhood("none"), KeyError), (lambda: g.neighbourhood(""), ValueError), (lambda: g.resolve(""), ValueError), (lambda: g.resolve("no.ts"), KeyError), (lambda: g.boundaries(""), ValueError)):
        with pytest.raises(error):
            wrong()
    cycle = e.unionByName(edges(spark, [("src_a_ts", "src_b_ts")], "SUSPICIOUS", "circular_dependency", 0.6))
    assert Graph(nodes, cycle, g.hubs).boundaries("src/a.ts")["violations"].count() == 1 and Graph(nodes, cycle, g.hubs).violations().count() == 2
    assert [clamp(v, 2, 1, 5) for v in (0, "x", 9, "3", None, "3abc", "4.0", " 5", "-7", "+1", "0x4", "", "1e3")] == [2, 2, 5, 3, 2, 3, 4, 5, 1, 1, 2, 2, 1]


def test_reexports_like_plain_walks(spark):
    rng = random.Random(3)
    exports = [(f"f{rng.randrange(60)}", rng.choice("abc"), f"f{rng.randrange(60)}", rng.choice(["a", "b", "c", None]), None) for _ in range(70)]
    exports += [(f"g{i}", "a", f"g{i + 1}", None, None) for i in range(40)] + [("ring0", "a", "ring1", None, None), ("ring1", "a", "ring2", None, None), ("ring2", "a", "ring0", None, None), ("into", "a", "ring1", None, None), ("own", "a", "own", "a", None)]
    exports += [(f"f{rng.randrange(60)}", None, f"f{rng.randrange(60)}", None, k) for k in range(25)] + [("s0", None, "s1", None, 100), ("s1", None, "s2", None, 101), ("s2", None, "g0", None, 102)]
    named, stars = {}, {}
    for f, s, tf, ts, star in exports:
        if star is None:
            named[f, s] = max(named.get((f, s), ("", "")), (tf, ts or s))
        else:
            stars.setdefault(f, []).append((star, tf))

    def walk(place):
        seen = [place]
        while True:
            f, s = seen[-1]
            via = [src for _, src in sorted(stars.get(f, [])) if (src, s) in named or src in stars]
            after = named.get((f, s)) or ((via[0], s) if via else None)
            if after is None:
                return f, s
            if after in seen:
                return after
            seen.append(after)

    asks = [(str(i), f, s) for i, (f, s) in enumerate([(f"f{i}", s) for i in range(62) for s in "abcd"] + [(f, "a") for f in ("g0", "g39", "ring0", "ring2", "into", "own", "s0", "none")])]
    got = resolve.unwrap_reexports(spark.createDataFrame(asks + [("null", None, "a")], "req_id string, file string, symbol string"), spark.createDataFrame(exports, "file string, symbol string, target_file string, target_symbol string, star_pos int"))
    assert {r.req_id: (r.file, r.symbol) for r in got.collect()} == {i: walk((f, s)) for i, f, s in asks} | {"null": (None, "a")}
