"""From source trees to graphs, and streams."""

import json
import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from graphloom.operators import change, resolve, rules
from graphloom.functions.lineage import settle
from graphloom.plans import incremental
from graphloom.plans.compile import Config, code_nodes, compile_graph, diff_graphs
from graphloom.sources import extract, files
from graphloom.streaming import state

TREE = {
    "src/a.ts": "export function foo() { return bar() }\nexport function bar() { return 1 }\nexport default function main() { foo() }\n",
    "src/caller.ts": "import { foo as f } from '@/a'\nimport './setup'\nimport * as ns from './a.js'\nimport type { T } from './types'\nimport Main from './a'\nexport function go() { f(); ns.bar(); Main() }\n",
    "src/setup.ts": "export const x = 1\n",
    "src/types.ts": "export type T = number\n",
    "src/index.ts": "export { foo as renamed } from './a'\nexport * from './deep'\n",
    "src/deep.ts": "export * from './deeper'\n",
    "src/deeper.ts": "export function far() { }\nclass K { go(x) { return far() } }\n",
    "src/barrel.ts": "import { renamed, far } from './index'\nexport function use() { renamed(); far() }\n",
    "src/loop1.ts": "import { b } from './loop2'\nexport function a() { b() }\n",
    "src/loop2.ts": "import { a } from './loop1'\nexport function b() { a() }\n",
    "tool/run.py": "import os\nclass Job:\n    def start(self):\n        return helper()\n\ndef helper():\n    return os.getcwd()\n",
    "tool/main.go": "package main\n\nfunc Run(x int) int {\n\treturn x\n}\n\ntype Box struct {\n}\n",
    "node_modules/dep/i.ts": "export const no = 1\n",
    "notes.txt": "nothing",
}


@pytest.fixture
def tree(tmp_path):
    for name, text in TREE.items():
        path = tmp_path / "repo" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    (tmp_path / "repo/tsconfig.json").write_text('{ // comment\n "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*", "lib/*"],}, }}')
    (tmp_path / "insights").mkdir()
    chunk = {"nodes": [{"id": "concept_flow", "label": "Flow", "file_type": "concept", "source_file": "docs/arch.md"}], "edges": [{"source": "concept_flow", "target": "src_a.ts", "relation": "implements", "type": "COGNITIVE", "score": 0.9}]}
    (tmp_path / "insights/one.json").write_text(json.dumps(chunk))
    (tmp_path / "repo/docs").mkdir()
    (tmp_path / "repo/docs/arch.md").write_text("# Flow")
    concept = lambda name, file: {"id": f"concept_{name}", "label": name, "file_type": "concept", "source_file": file}
    half = {"nodes": [concept("stays", "docs/arch.md"), concept("goes", "docs/gone.md")], "edges": [{"source": "concept_stays", "target": t, "relation": "references", "type": "COGNITIVE", "score": 0.5} for t in ("src_a.ts", "concept_goes")]}
    (tmp_path / "insights/half.json").write_text(json.dumps(half))
    (tmp_path / "insights/gone.json").write_text(json.dumps({"nodes": [concept("lost", "docs/gone.md")], "edges": []}))
    return tmp_path


def test_compile(spark, tree):
    root = f"{tree}/repo"
    cfg = Config(root, aliases=files.find_aliases(root), insights=f"{tree}/insights", cache=f"{tree}/cache", state=f"{tree}/state", rules=[{"from": "src/barrel.ts", "to": "src/a.ts", "except": [], "pathKind": "glob", "severity": "error", "reason": ""}])
    g = compile_graph(spark, cfg)
    nodes = {r.id: r for r in g.nodes.collect()}
    links = {(r.source, r.relation, r.target) for r in g.edges.collect()}
    assert {"src_a.ts", "src_a.ts:foo", "src_deeper.ts:k", "src_deeper.ts:k.go", "tool_run.py:job.start", "tool_main.go:run", "tool_main.go:box", "concept_flow"} <= set(nodes)
    assert not any("node_modules" in n or "notes" in n for n in nodes)
    assert not {"concept_stays", "concept_goes", "concept_lost"} & set(nodes)  # an insight of which a source is gone is left out whole
    assert all(s in nodes and t in nodes for s, _, t in links)
    assert ("src_caller.ts", "imports", "src_a.ts") in links and ("src_caller.ts", "imports", "src_setup.ts") in links and ("src_caller.ts", "imports", "src_types.ts") not in links
    assert {("src_caller.ts", "calls", "src_a.ts:foo"), ("src_caller.ts", "calls", "src_a.ts:bar"), ("src_caller.ts", "calls", "src_a.ts:main")} <= links
    assert {("src_barrel.ts", "imports", "src_a.ts"), ("src_barrel.ts", "calls", "src_a.ts:foo"), ("src_barrel.ts", "imports", "src_deeper.ts"), ("src_barrel.ts", "calls", "src_deeper.ts:far")} <= links
    assert {("src_loop1.ts", "circular_dependency", "src_loop2.ts"), ("src_loop2.ts", "circular_dependency", "src_loop1.ts"), ("src_barrel.ts", "violates_boundary", "src_a.ts")} <= links
    assert ("concept_flow", "implements", "src_a.ts") in links and any(s.startswith("doc_docs_arch_md_") and r == "contains" for s, r, _ in links)
    said = g.boundaries("./src/a.ts")
    assert said["dependents"] == 2 and said["violations"].count() == 1 and len(said["rules"]) == 1
    why = {(r.source, r.relation): r.reason for r in g.violations().collect()}
    assert why["src_barrel.ts", "violates_boundary"] == "Forbidden import: src/barrel.ts must not import src/a.ts" and why["src_loop1.ts", "circular_dependency"] == "Circular dependency: loop1.ts ↔ loop2.ts"
    assert nodes["src_a.ts"].content_hash is None and nodes["src_a.ts:bar"].content_hash == extract.text_hash("function bar() { return 1 }") and nodes["tool_run.py:job.start"].content_hash == extract.text_hash("def start(self):\n        return helper()")
    local = {(r.caller, r.local_key): (r.target_file, r.target_symbol, r.kind) for r in g.bindings.collect()}
    assert local["src/caller.ts", "ns"] == ("src/a.ts", None, "namespace") and local["src/barrel.ts", "renamed"] == ("src/a.ts", "foo", "named")
    assert {r.symbol for r in g.default_exports.where("file = 'src/a.ts'").collect()} and g.imports.where("caller = 'src/caller.ts'").count() == 5
    assert {(r.symbol, r.target_file) for r in g.exports.where("file = 'src/index.ts'").collect()} == {("renamed", "src/a.ts"), ("*", "src/deep.ts")}
    assert {r.node for r in g.communities.collect()} == set(nodes)
    real = resolve.coverage(spark.createDataFrame([("src/barrel.ts", "src/a.ts"), ("src/loop1.ts", "src/loop2.ts"), ("src/a.ts", "src/none.ts"), ("src/a.ts", None)], "caller string, target_file string"), g.nodes, g.edges).first()
    assert (real.found, real.expected) == (2, 3)
    again = compile_graph(spark, cfg, previous=g.nodes.select(F.col("id").alias("node"), "community"))
    changed, moved = diff_graphs(g, again)
    assert changed.collect() == [] and moved.collect() == []
    (tree / "repo/src/setup.ts").write_text("export function fresh() { return 12345 }\n")
    (tree / "repo/src/deep.ts").write_text("\n// moved\nexport * from './deeper'\n")
    (tree / "repo/src/deeper.ts").write_text("export function far() { return 7 }\nclass K { go(x) { return far() } }\n")
    os.unlink(tree / "repo/tool/main.go")
    changed, _ = diff_graphs(again, compile_graph(spark, cfg, previous=again.nodes.select(F.col("id").alias("node"), "community")))
    got = {r.id: r.op for r in changed.collect()}
    assert got["src_setup.ts:fresh"] == "added" and got["tool_main.go"] == "removed"
    assert got["src_deeper.ts:far"] == "updated" and not {"src_deeper.ts", "src_deeper.ts:k", "src_deeper.ts:k.go"} & {k for k, v in got.items() if v == "added"}
    cfg.startup = True  # insights lose what names files that are gone, and are there without it
    started = compile_graph(spark, cfg)
    ids = {r.id for r in started.nodes.collect()}
    assert "concept_stays" in ids and not {"concept_goes", "concept_lost"} & ids
    assert {r.target for r in started.edges.where("source = 'concept_stays'").collect()} == {"src_a.ts"}
    assert len([p for p in os.listdir(f"{tree}/cache/version=1.1.0") if p.startswith("gen=")]) == 1


def test_extractors():
    one = lambda path, text: extract.extract_file(path, text)
    names = lambda r: [s["name"] for s in r["symbols"]]
    ts = one("a.tsx", "import d, * as ns from 'x'\nimport { type A, b as c } from 'y'\n/* f() */ const s = `g(${h})`; // i()\nexport default class extends Z { constructor() { super() } get v() { return this.w() } }\nexport const k = async (a, b = (1)) => a\nexport * as all from './q'\nexport type { T } from './t'\n")
    assert [(i["kind"], i["local"]) for i in ts["imports"]] == [("namespace", "ns"), ("type-named", "A"), ("named", "c")]
    assert ts["default_symbol"] == "default" and "k" in names(ts) and [e["kind"] for e in ts["exports"]].count("namespace") == 1
    assert not {"f", "g", "i"} & {c["callee"] for c in ts["calls"]}
    ident = one("b.ts", "function m() {}\nexport default m;\n")
    assert ident["default_symbol"] == "m"
    half = one("c.py", "import os\n\ndef good(x):\n    return os.path(x)\n\ndef (\n\nclass Late:\n    def m(self): pass\n")
    assert names(half) == ["good", "Late", "Late.m"] and half["error"].startswith("SyntaxError") and [s["line"] for s in half["symbols"]] == [3, 8, 9]
    passed = one("p.ts", "import x from './x'\nexport default x\n")
    assert passed["default_symbol"] is None and [(e["symbol"], e["alias"], e["specifier"]) for e in passed["exports"]][-1] == ("default", "default", "./x") and passed["error"]
    hashes = lambda body: {s["name"]: s["content_hash"] for s in one("h.ts", body)["symbols"]}
    was, now = hashes("function a() { return 1 }\nconst b = (x) => x + 1\nclass C { m() { a() } n() {} }\n"), hashes("\n\nfunction a() { return 1 }\nconst b = (x) => x + 2\nclass C { m() { a() } n() { a() } }\n")
    assert {k for k in was if was[k] != now[k]} == {"b", "C", "C.n"} and was["a"] == extract.text_hash("function a() { return 1 }")
    assert one("c.py", "def (")["error"].startswith("SyntaxError") and one("x.zig", "fn") ["symbols"] == []
    assert names(one("d.rs", "pub fn go() {}\nstruct S;\n")) == ["go", "S"] and names(one("E.java", "public class E {\n  public int run(int x) {\n  }\n}\n")) == ["E", "run"]
    assert names(one("f.c", "int main(int c) {\n}\nstruct P {\n};\n/* int no(void) {\n */")) == ["main", "P"]
    extract.register(".toy", lambda text: extract.empty() | {"symbols": [{"name": text, "kind": "function", "line": 1, "pos": 0}]})
    assert names(one("g.toy", "hi")) == ["hi"]
    del extract.EXTRACTORS[".toy"]


def test_files(spark, tmp_path):
    for i in range(4):
        files.save_tour(str(tmp_path), {"id": f"t-{i}", "timestamp": i, "beats": [{"say": "hi", "nodes": ["a"]}]}, keep=3)
    beat = {"say": "x", "nodes": []}
    wrong = [None, {}, {"beats": []}, {"beats": [beat], "title": 1}, {"beats": [beat | {"lang": 2}]}, {"beats": [beat | {"nodes": [1]}]}, {"beats": [{"say": " ", "nodes": []}]}]
    assert files.valid_tour({"beats": [beat | {"lang": "en"}], "title": "t"}) and not any(map(files.valid_tour, wrong))
    (tmp_path / "bad.json").write_text("{")
    assert [t["id"] for t in files.list_tours(str(tmp_path))] == ["t-3", "t-2", "t-1"]
    files.delete_tour(str(tmp_path), "t-3")
    files.delete_tour(str(tmp_path), "t-3")
    with pytest.raises(ValueError, match="tour id"):
        files.delete_tour(str(tmp_path), "../x")
    with pytest.raises(PermissionError):
        files.inside(str(tmp_path), "../..")
    assert files.canonical_config_hash('{"b": 1, /* x */ "a": [1,],}', ".jsonc") == files.canonical_config_hash('{"a":[1],"b":1}', ".json")
    log = files.error_log(str(tmp_path / "e.log"))
    log.error("once")
    assert (tmp_path / "e.log").read_text() == "once\n"
    files.write_insights(spark.createDataFrame([("a", "1"), ("b", "2")], "path string, text string"), f"{tmp_path}/store")
    files.write_insights(spark.createDataFrame([("a", "3"), *[(f"n{i}", "4") for i in range(900)]], "path string, text string"), f"{tmp_path}/store")
    assert {(r.path, r.text) for r in spark.read.parquet(f"{tmp_path}/store").collect()} == {("a", "3"), ("b", "2")} | {(f"n{i}", "4") for i in range(900)}
    assert len([p for p in os.listdir(f"{tmp_path}/store") if p.startswith("bucket=")]) <= 256
    for part in ("old", "new"):
        (tmp_path / part).mkdir()
    for name, when in (("old/a.json", 9), ("new/a.json", 5), ("old/b.json", 1), ("new/b.json", 5), ("old/c.json", 1)):
        (tmp_path / name).write_text(name)
        os.utime(tmp_path / name, (when, when))
    assert files.migrate_insights(f"{tmp_path}/old", f"{tmp_path}/new") == 2 and not os.path.exists(f"{tmp_path}/old")
    assert [(tmp_path / "new" / f"{n}.json").read_text() for n in "abc"] == ["old/a.json", "new/b.json", "old/c.json"]
    status = spark.createDataFrame([(f"{tmp_path}/new/{n}.json", s) for n, s in (("a", "ok"), ("b", "invalid"), ("c", "corrupt"))], "path string, status string")
    assert files.clean_insights(spark, status, f"{tmp_path}/odd") == {"removed": 1, "quarantined": 1}
    assert sorted(p for p in os.listdir(f"{tmp_path}/new") if p.endswith(".json")) == ["a.json"] and "b.json" in os.listdir(f"{tmp_path}/odd")
    with pytest.raises(FileNotFoundError):
        rules.import_config(str(tmp_path / "new"))
    (tmp_path / "new/.dependency-cruiser.js").write_text("module.exports = {}")
    with pytest.raises(ValueError, match="not JSON"):
        rules.import_config(str(tmp_path / "new"))


def test_streams(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = [("a", "x", 0, 1000), ("b", "y", 0, 3_600_000)]
    spark.createDataFrame(rows, "file string, activity string, timestamp long, ttl long").write.parquet(path)
    stream = spark.readStream.schema("file string, activity string, timestamp long, ttl long").parquet(path)
    q = state.focus_state(stream).writeStream.outputMode("update").format("memory").queryName("focus").start()
    try:
        end = time.time() + 40
        while time.time() < end and spark.sql("SELECT * FROM focus WHERE NOT active").isEmpty():
            time.sleep(1)
        assert [r.file for r in spark.sql("SELECT file FROM focus WHERE NOT active").collect()] == ["a"]
    finally:
        q.stop()

    changes = str(tmp_path / "changes")
    df = spark.createDataFrame([(0.0, "a", "change"), (0.05, "b", "change"), (0.05, "a", "change"), (5.0, "c", "delete"), (2000.0, "z", "change")], "s double, file string, op string").select(F.timestamp_millis((F.col("s") * 1000).cast("long")).alias("ts"), F.lit("r").alias("root"), "file", "op")
    df.coalesce(1).write.parquet(changes)
    out = state.change_bursts(spark.readStream.schema(df.schema).parquet(changes))
    q = out.writeStream.outputMode("append").format("memory").queryName("bursts").start()
    q.processAllAvailable()
    q.stop()
    assert {(tuple(r.changed), tuple(r.deleted)) for r in spark.sql("SELECT * FROM bursts").collect()} == {(("a", "b"), ()), ((), ("c",))}

    lit = []
    q = state.change_feed(spark.readStream.schema(df.schema).parquet(changes), lambda batch: batch.groupBy("file").agg(F.count("*").alias("n")), "file", str(tmp_path / "feed"), str(tmp_path / "ck"), lambda focus: lit.append({r.file for r in focus.collect()}))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(f"{tmp_path}/feed/feed/epoch=0").where("op = 'added'").count() == 4
    assert lit == [{"a", "b", "z"}] * 2
    snapshot, epoch = state.latest(spark, f"{tmp_path}/feed")
    assert epoch == 0 and snapshot.count() == 4


def test_poll(spark, tree):
    root = f"{tree}/repo"
    before = spark.createDataFrame(files.scan(spark, root).select("source_file", "size", "mtime").collect(), "source_file string, size long, mtime timestamp")
    os.unlink(f"{root}/src/types.ts")
    got, _ = state.poll_changes(spark, root, before)
    assert [(r.source_file, r.op) for r in got.collect()] == [("src/types.ts", "removed")]
    estimate = files.size_estimate(files.scan(spark, root)).first()
    assert estimate.files == 11 and estimate.words == sum(len(re.split(r"\s+", t)) for n, t in TREE.items() if n.endswith((".ts", ".py", ".go")) and not n.startswith("node") and "types" not in n)
    assert files.top_folders(files.scan(spark, root)).first()[:2] == ("src", 9)
    assert [tuple(r) for r in files.top_folders(spark.createDataFrame([("z.ts",), ("a/b.ts",), ("a/c.ts",), ("y.ts",)], "source_file string")).collect()] == [("a", 2), ("y.ts", 1), ("z.ts", 1)]
    assert files.size_estimate(spark.createDataFrame([("a", " x y "), ("b", ""), ("c", None)], "source_file string, text string")).first()[:2] == (3, 6)
    assert files.size_estimate(spark.createDataFrame([], "source_file string, text string")).first()[:2] == (0, 0)
    assert change.settled(before, files.scan(spark, root)).count() == 11


def test_ingest(spark, tmp_path):
    good = {"nodes": [{"id": "n", "label": "l", "file_type": "concept", "source_file": "d.md"}], "edges": []}
    rows = [("docs\\a.md", json.dumps(good)), ("docs/b.md", json.dumps(good | {"nodes": [{"id": ""}]})), ("docs/c.md", "{"), ("docs/a.md", json.dumps(good | {"edges": []}))]
    df = spark.createDataFrame(rows, "path string, text string").coalesce(1)
    folder = f"{tmp_path}/insights"
    said = [(r.path, r.status, r.refresh) for r in files.ingest(df, folder, True).orderBy("path", "status").collect()]
    assert said == [("docs/a.md", "ok", "queued"), ("docs/a.md", "ok", "queued"), ("docs/b.md", "invalid_schema", "queued"), ("docs/c.md", "invalid_schema", "queued")]
    assert [r.path for r in spark.read.parquet(folder).collect()] == ["docs/a.md"]
    assert {r.refresh for r in files.ingest(df.where("path = 'docs/c.md'"), folder, True).collect()} == {"cache_only"}
    blocked = tmp_path / "file"
    blocked.write_text("no folder")
    assert {r.status for r in files.ingest(df.where("path = 'docs/a.md'"), f"{blocked}/x", True).collect()} == {"lock_failed"}


def test_code_changes_and_tours(spark):
    row = "id string, label string, source_file string, content_hash string, community long"
    before = spark.createDataFrame([("a", "a", "f", "1", 1), ("b", "b", "f", None, 1), ("c", "c", "f", "1", 1), ("d", "d", "f", "1", 1)], row)
    after = spark.createDataFrame([("a", "a", "f", "1", 2), ("b", "b", "f", "2", 1), ("c", "x", "f", "1", 1), ("e", "e", None, None, 1)], row)
    assert {r.id: (r.op, r.changed) for r in change.code_changes(before, after).collect()} == {"a": ("updated", False), "b": ("updated", True), "c": ("updated", True), "e": ("added", True)}
    tours = spark.createDataFrame([("x", "old", 5), ("y", "old", None)], "id string, title string, timestamp long")
    came = spark.createDataFrame([("x", "one", 9, 1), ("x", "two", 1, 2), ("z", "new", 3, 3)], "id string, title string, timestamp long, arrival long")
    assert [(r.id, r.title) for r in change.upsert_tours(tours, came).collect()] == [("z", "new"), ("x", "two"), ("y", "old")]


def test_extraction_of_nulls_and_many_files(spark):
    rows = [(None, "def f(): pass"), ("a.py", None), ("b.py", ""), ("c.none", "x"), ("bad.py", "def (")] + [(f"m{i}.py", f"def f{i}():\n    return g()\n") for i in range(600)]
    got = {r.source_file: r for r in extract.extract(spark.createDataFrame(rows, "source_file string, text string")).collect()}
    assert len(got) == len(rows) and got[None].symbols == [] and got["a.py"].symbols == [] and got["bad.py"].error
    assert all(got[f"m{i}.py"].symbols[0].name == f"f{i}" and len(got[f"m{i}.py"].calls) == 1 for i in range(600))


def test_registered_extractors_reach_workers(spark):
    extract.register(".toy", lambda text: extract.empty() | {"symbols": [{"name": text, "kind": "function", "line": 1, "pos": 0}]})
    try:
        got = extract.extract(spark.createDataFrame([("a.toy", "hello")], "source_file string, text string")).first()
    finally:
        del extract.EXTRACTORS[".toy"]
    assert got.symbols[0].name == "hello"


def random_tree(rng, n):
    """Files that import, re-export (by name, alias and star), call and declare; paths with and without index files."""
    paths = [f"src/m{i}.ts" if i % 4 else f"src/d{i}/index.ts" for i in range(n)]
    spec = lambda i: f"@/m{i}" if i % 4 else f"@/d{i}"

    def text(i):
        others = [rng.randrange(n + 2) for _ in range(3)]
        lines = [f"import {{ f{o % 7} as g{k}, h{o} }} from '{spec(o)}'" for k, o in enumerate(others)]
        lines += [f"import * as ns{i} from '{spec(others[0])}'", f"import D from '{spec(others[1])}'"][: rng.randrange(3)]
        lines += rng.sample([f"export * from '{spec(others[2])}'", f"export {{ f{rng.randrange(7)} }} from '{spec(others[1])}'", f"export {{ f1 as f2 }} from '{spec(others[0])}'", "export default function main() { }"], 2)
        lines += [f"export function f{rng.randrange(7)}() {{ g0(); g1(); ns{i}.f{rng.randrange(7)}(); D(); only{rng.randrange(n)}() }}", f"export function h{i}() {{ h{others[0]}() }}", f"function only{i + rng.randrange(2)}() {{ }}"]
        return "\n".join(lines)

    return paths, text


def test_incremental_equals_full(spark, tmp_path):
    rng = random.Random(11)
    paths, text = random_tree(rng, 16)
    root = tmp_path / "repo"
    aliases = [("@/*", ["src/*"])]

    def put(i):
        (root / paths[i]).parent.mkdir(parents=True, exist_ok=True)
        (root / paths[i]).write_text(text(i) + f"\n// {rng.random()}")

    for i in range(14):
        put(i)

    def look(state):
        there = settle(files.scan(spark, str(root)))
        found = settle(extract.extract(there))
        symbols = settle(code_nodes(found, there)[1])
        return incremental.resolved(spark, found, there, symbols, aliases, state)

    state = f"{tmp_path}/state"
    look(state)
    touched = []
    for step in ([("put", 3), ("put", 14), ("drop", 7)], [("drop", 4), ("put", 15)], []):
        for act, i in step:
            put(i) if act == "put" else os.unlink(root / paths[i])
        some, full = look(state), look(None)
        for name in ("targets", "exports", "brought", "binds", "called"):
            got, want = (sorted(map(tuple, getattr(x, name).collect()), key=repr) for x in (some, full))
            assert got == want, (step, name)
        touched.append(some.touched.count())
    assert touched[-1] == 0 and min(touched[:-1]) < 14


def test_incremental_leaves_importers_alone(spark, tmp_path):
    """A path that comes touches files that look for it, and importers of those that hand it on, but not of those that import it."""
    root, aliases = tmp_path / "repo/src", [("@/*", ["src/*"])]
    root.mkdir(parents=True)
    texts = {
        "a": "import { f1 } from '@/b'\nexport function own() { f1() }",
        "b": "import { g } from '@/late'\nexport function f1() { g() }",
        "c": "import { g as x } from '@/d'\nexport function other() { x() }",
        "d": "export { g } from '@/late'",
    }
    for name, text in texts.items():
        (root / f"{name}.ts").write_text(text)

    def look(state):
        there = settle(files.scan(spark, str(tmp_path / "repo")))
        found = settle(extract.extract(there))
        return incremental.resolved(spark, found, there, settle(code_nodes(found, there)[1]), aliases, state)

    look(f"{tmp_path}/state")
    (root / "late.ts").write_text("export function g() { }")
    some, full = look(f"{tmp_path}/state"), look(None)
    for name in ("targets", "exports", "brought", "binds", "called"):
        got, want = (sorted(map(tuple, getattr(x, name).collect()), key=repr) for x in (some, full))
        assert got == want, name
    assert {r.source_file for r in some.touched.collect()} == {f"src/{x}.ts" for x in ("b", "c", "d", "late")}
    assert any(r.target_file == "src/late.ts" and r.caller == "src/c.ts" for r in some.brought.collect())
