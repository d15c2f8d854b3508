"""From raw imports, exports and calls to edges: module probing, re-exports, bindings and the call cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import drop_folder, gathered, settle, shared_folder, tabled

# Source extensions in the order they are tried, and what a JavaScript name may stand for.
EXTENSIONS = (".ts", ".tsx", ".js", ".jsx", ".py", ".go", ".rs", ".java", ".c", ".cpp", ".h")
STANDS_FOR = {".js": (".ts", ".tsx"), ".jsx": (".tsx", ".ts")}
# Callees too common to mean one function.
GENERIC = (
    "map", "get", "set", "init", "push", "pop", "foreach", "filter", "reduce",
    "find", "some", "every", "includes", "slice", "splice", "concat", "join",
    "sort", "reverse", "flat", "flatmap", "keys", "values", "entries", "length",
    "tostring", "valueof", "constructor", "prototype", "apply", "call", "bind",
    "then", "catch", "finally", "resolve", "reject", "all", "race",
    "assign", "freeze", "isarray", "parse", "stringify",
)


def joined_path(base: Column, relative: Column) -> Column:
    """A file's relative specifier as a path from the root; null if it leads out of it."""
    folder = F.slice(F.split(base, "/"), F.lit(1), F.greatest(F.size(F.split(base, "/")) - 1, F.lit(0)))
    start = F.struct(folder.alias("at"), F.lit(True).alias("inside"))

    def step(s: Column, part: Column) -> Column:
        up = F.struct(F.slice(s["at"], F.lit(1), F.greatest(F.size(s["at"]) - 1, F.lit(0))).alias("at"), (s["inside"] & (F.size(s["at"]) > 0)).alias("inside"))
        on = F.struct(F.concat(s["at"], F.array(part)).alias("at"), s["inside"].alias("inside"))
        return F.when((part == ".") | (part == ""), s).when(part == "..", up).otherwise(on)

    return F.aggregate(F.split(relative, "/"), start, step, lambda s: F.when(s["inside"], F.array_join(s["at"], "/")))


def candidates(path: Column) -> Column:
    """The files that a path may mean, the first choice first: what .js and .jsx stand for, itself, with an extension, as a folder's index."""
    swaps = [F.when(path.endswith(a), F.concat(F.regexp_replace(path, r"\.[^.]*$", ""), F.lit(b))) for a, bs in STANDS_FOR.items() for b in bs]
    return F.array_compact(F.array(*swaps, path, *[F.concat(path, F.lit(e)) for e in EXTENSIONS], *[F.concat(path, F.lit(f"/index{e}")) for e in EXTENSIONS]))


def probes(specs: DataFrame, aliases: list[tuple[str, list[str]]] = ()) -> DataFrame:
    """(folder, specifier, alias_pos, probe_pos, file): the places where different specifiers of (folder, specifier) are looked for, in their order.

    Relative specifiers (./ and ../) start at the caller; others only resolve through aliases (pattern, targets), all
    that match in their order. A pattern is a prefix, without the * it may end with; a target's first * stands for the
    rest. Each alias is a branch of the plan, so no pairs of rows are compared.
    """
    spec = F.col("specifier")
    relative = spec.startswith("./") | spec.startswith("../")
    found = [F.when(relative, F.struct(F.lit(0).alias("alias_pos"), joined_path(F.col("folder"), spec).alias("path")))]
    n = 0
    for pattern, targets in aliases:
        head = pattern.removesuffix("*")
        rest = F.substr(spec, F.lit(len(head) + 1))
        for t in targets:
            n += 1
            before, star, after = t.partition("*")
            path = F.concat(F.lit(before), rest, F.lit(after)) if star else F.lit(t)
            found.append(F.when(~relative & spec.startswith(head), F.struct(F.lit(n).alias("alias_pos"), joined_path(F.lit("x"), path).alias("path"))))
    kinds = specs.select("folder", "specifier").where("specifier IS NOT NULL").distinct()
    tries = kinds.select("folder", "specifier", F.explode(F.array_compact(F.array(*found))).alias("t")).where("t.path IS NOT NULL")
    return tries.select("folder", "specifier", "t.alias_pos", F.posexplode(candidates(F.col("t.path"))).alias("probe_pos", "file"))


def with_folder(imports: DataFrame) -> DataFrame:
    """imports (caller, specifier) with the folder that a relative specifier starts from; null for others."""
    relative = F.col("specifier").startswith("./") | F.col("specifier").startswith("../")
    return imports.withColumn("folder", F.when(relative, F.regexp_replace("caller", "[^/]*$", "")))


def resolve_modules(imports: DataFrame, files: DataFrame, aliases: list[tuple[str, list[str]]] = ()) -> DataFrame:
    """(import_id, caller, specifier) to (import_id, target_file): the first of its probes that is a file; null if none is.

    Places are made once for each folder and specifier, not for each import.
    """
    asked = with_folder(imports).select("import_id", "folder", "specifier")
    tries = probes(asked, aliases)
    there = files.select(F.col("source_file").alias("file")).distinct()
    best = tries.join(there, "file").groupBy("folder", "specifier").agg(F.min_by("file", F.struct("alias_pos", "probe_pos")).alias("target_file"))
    best = best.withColumnsRenamed({"folder": "bf", "specifier": "bs"})
    return asked.join(best, asked["folder"].eqNullSafe(best["bf"]) & (asked["specifier"] == best["bs"]), "left").select("import_id", "target_file")


def _followed(pointers: DataFrame, folder: str, rings: bool = True) -> tuple[DataFrame, bool]:
    """(a, b, on) pointers followed to their ends, and whether some have none: each round doubles the steps taken.

    `on` tells that b still points on. A pointer that has come to its end is looked up by others but goes no further
    itself. Where those that go on come to as many places as a round before, all these places are on cycles: what a
    round leads to is part of what the one before led to, so the steps map these places onto themselves. Rounds grow with
    the logarithm of the longest path to an end or a cycle. rings: whether there may be cycles.

    Each round is a table below the folder: a checkpoint's estimate of size would be squared by each round's join.
    """
    spark, turn, before = pointers.sparkSession, 0, None
    schema = pointers.select("a", "b").schema.add("round", "integer").add("on", "boolean")
    pointers.select("a", "b", F.lit(True).alias("on")).write.partitionBy("on").parquet(f"{folder}/round=0")
    while True:
        far = spark.read.schema(schema).parquet(folder).where((F.col("round") == turn) | ~F.col("on"))
        going = far.where("on")
        now = going.select("b").distinct().count() if rings else int(not going.isEmpty())
        if not now or (rings and now == before):
            return far.select("a", "b", "on"), now > 0
        before, turn = now, turn + 1
        ahead = far.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("on").alias("more"))
        step = going.hint("merge").join(ahead, F.col("b") == F.col("x"), "left").select("a", F.coalesce("y", "b").alias("b"), F.coalesce("more", F.lit(False)).alias("on"))
        step.write.partitionBy("on").parquet(f"{folder}/round={turn}")


def _ends(pointers: DataFrame) -> DataFrame:
    """(a, b) of unique a to (a, end): where its path ends, or the first place of a cycle that it comes to."""
    spark = pointers.sparkSession
    folder = shared_folder(spark, "ends")
    far, cycles = _followed(pointers, f"{folder}/all")
    if cycles:
        ring = tabled(far.where("on").select(F.col("b").alias("r")).distinct(), folder)
        to_ring = pointers.join(ring, pointers["a"] == ring["r"], "left_anti")
        far = _followed(to_ring, f"{folder}/to_ring", rings=False)[0].select("a", "b").union(ring.select("r", "r"))
    out = settle(far.select("a", F.col("b").alias("end")))
    drop_folder(spark, folder)
    return out


def unwrap_reexports(requests: DataFrame, exports: DataFrame) -> DataFrame:
    """(req_id, file, symbol) to where the symbol comes from, through exports (file, symbol, target_file, target_symbol, star_pos, pos).

    A named export leads to its target, the last by pos if a file exports a name more than once; else the first star
    source that names the symbol or has a star itself does. A request ends where nothing leads on, where an export is the
    file's own, or at the first place that it comes to again. Where a place leads does not hang on the request, so places
    are linked once and their paths followed by doubling: rounds grow with the logarithm of the longest chain of named
    exports. Star sources are linked by rounds as long as the longest chain of stars. Rounds are tables in the shared folder.
    """
    exports = settle(exports if "pos" in exports.columns else exports.withColumn("pos", F.lit(0)))
    named = exports.where("star_pos IS NULL").select(F.col("file").alias("f"), F.col("symbol").alias("s"), F.col("target_file").alias("tf"), F.coalesce("target_symbol", "symbol").alias("ts"), "pos")
    named = named.groupBy("f", "s").agg(F.max_by(F.struct("tf", "ts"), F.struct("pos", "tf", "ts")).alias("named"))
    stars = exports.where("star_pos IS NOT NULL").select(F.col("file").alias("f"), F.col("target_file").alias("src"), "star_pos")
    has_star = stars.select(F.col("f").alias("src")).distinct().withColumn("starred", F.lit(True))
    names = named.select(F.col("f").alias("src"), F.col("s").alias("symbol")).withColumn("names", F.lit(True))

    def leads(places: DataFrame) -> DataFrame:
        """(file, symbol, nf, ns): the next place of each, null where nothing leads on."""
        by_name = places.join(named, (F.col("file") == F.col("f")) & (F.col("symbol") == F.col("s")), "left").drop("f", "s")
        offers = by_name.where("named IS NULL").select("file", "symbol").join(stars, F.col("file") == F.col("f")).join(has_star, "src", "left")
        offers = offers.join(names, ["src", "symbol"], "left").where("starred OR names")
        offers = offers.groupBy("file", "symbol").agg(F.min_by("src", "star_pos").alias("via"))
        step = by_name.join(offers, ["file", "symbol"], "left")
        symbol = F.when(F.col("named").isNotNull(), F.col("named.ts")).otherwise(F.col("symbol"))
        return step.select("file", "symbol", F.coalesce(F.col("named.tf"), F.col("via")).alias("nf"), symbol.alias("ns"))

    asked = requests.select("file", "symbol").union(named.select("f", "s")).union(named.select("named.tf", "named.ts"))
    folder = shared_folder(requests.sparkSession, "reexports")
    fresh = tabled(asked.where("file IS NOT NULL AND symbol IS NOT NULL").distinct(), f"{folder}/places")
    while True:
        step = tabled(leads(fresh).where("nf IS NOT NULL AND ns IS NOT NULL"), f"{folder}/linked")
        ahead = step.select(F.col("nf").alias("file"), F.col("ns").alias("symbol")).distinct()
        fresh = tabled(ahead.join(gathered(fresh, f"{folder}/places"), ["file", "symbol"], "left_anti"), f"{folder}/places")
        if fresh.isEmpty():
            break
    place = lambda file, symbol: F.struct(F.col(file).alias("file"), F.col(symbol).alias("symbol"))
    linked = gathered(step, f"{folder}/linked").select(place("file", "symbol").alias("a"), place("nf", "ns").alias("b"))
    ends = _ends(linked.where("a <> b"))
    drop_folder(requests.sparkSession, folder)
    ends = ends.select(F.col("a.file").alias("f"), F.col("a.symbol").alias("s"), "end")
    out = requests.select("req_id", "file", "symbol").join(ends, (F.col("file") == F.col("f")) & (F.col("symbol") == F.col("s")), "left")
    return out.select("req_id", F.coalesce("end.file", "file").alias("file"), F.coalesce("end.symbol", "symbol").alias("symbol"))


def _namespace_members(calls: DataFrame, target: DataFrame, exports: DataFrame | None, defaults: DataFrame | None) -> DataFrame:
    """(ns_file, callee, ns_id) of two-part member calls: where each namespace's member is declared."""
    asked = calls.where("is_member AND parts = 2 AND ns_file IS NOT NULL").select("ns_file", "callee").distinct()
    asked = asked.select("ns_file", "callee", F.col("ns_file").alias("file"), F.element_at(F.split("callee", r"\."), -1).alias("symbol"))
    if exports is not None and not asked.isEmpty():
        requests = asked.select(F.struct("ns_file", "callee").alias("req_id"), "file", "symbol")
        asked = unwrap_reexports(requests, exports).select("req_id.*", "file", "symbol")
    if defaults is not None:
        asked = asked.join(defaults, (F.col("file") == F.col("df")) & (F.col("symbol") == "default"), "left").withColumn("symbol", F.coalesce("default_symbol", "symbol"))
    return asked.join(target, (F.col("file") == F.col("tf")) & (F.lower("symbol") == F.col("tn"))).select("ns_file", "callee", F.col("target_id").alias("ns_id"))


def coverage(pairs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(found, expected, ratio): of the different (caller, target_file) pairs that imports resolve to, those with an import edge between their files' nodes.

    Pairs and edges meet in one aggregation; files are the side that joins hash, so edges aren't sorted.
    """
    files = settle(nodes.select("id", "source_file"))
    of = lambda end, file: files.select(F.col("id").alias(end), F.col("source_file").alias(file)).hint("shuffle_hash")
    made = edges.where("relation = 'imports' AND type = 'PHYSICAL'").select("source", "target")
    made = made.join(of("source", "caller"), "source").join(of("target", "target_file"), "target").where("caller IS NOT NULL AND target_file IS NOT NULL")
    wanted = pairs.where("target_file IS NOT NULL").select("caller", "target_file", F.lit(1).alias("wanted"), F.lit(0).alias("made"))
    both = wanted.union(made.select("caller", "target_file", F.lit(0), F.lit(1))).groupBy("caller", "target_file").agg(F.max("wanted").alias("wanted"), F.max("made").alias("made")).where("wanted = 1")
    sums = both.agg(F.coalesce(F.sum("made"), F.lit(0)).cast("long").alias("found"), F.count(F.lit(1)).alias("expected"))
    return sums.select("found", "expected", F.when(F.col("expected") > 0, F.col("found") / F.col("expected")).alias("ratio"))


def bindings(imports: DataFrame) -> DataFrame:
    """(caller, local_key) to target_file and target_symbol: the last import of a name counts; type-only and side-effect ones bind nothing."""
    real = imports.where("kind IN ('default', 'named', 'namespace') AND target_file IS NOT NULL")
    last = real.groupBy("caller", F.lower("local").alias("local_key")).agg(F.max_by(F.struct("target_file", "target_symbol", "kind"), "pos").alias("x"))
    return last.select("caller", "local_key", "x.*")


def call_edges(calls: DataFrame, symbols: DataFrame, binds: DataFrame, exports: DataFrame | None = None, defaults: DataFrame | None = None) -> DataFrame:
    """(caller_file, callee, is_member, pos) to (source_file, target, score): tiers in order, and the first that matches decides.

    1. a two-part member call through a namespace binding, its member followed through the exports, `default` to the
       file's default symbol (df, default_symbol); other two-part member calls are dropped
    2. a symbol of the same file, the last of its name   3. a binding of the file
    4. for plain calls, the only symbol of that name anywhere (score 0.8, others 1.0)
    Callees too common to mean one function pass the first tier only; calls of oneself give no edge. A plain call of a
    namespace's name matches its binding, which means no symbol, so it gives no edge either.
    """
    last = F.lower(F.element_at(F.split("callee", r"\."), -1))
    parts = F.size(F.split("callee", r"\."))
    c = calls.select("caller_file", "callee", "is_member", "pos", last.alias("name"), F.lower(F.element_at(F.split("callee", r"\."), 1)).alias("head"), parts.alias("parts"))
    local = symbols.groupBy(F.col("source_file").alias("lf"), F.lower("label").alias("ln")).agg(F.max_by("id", "pos").alias("local_id"))
    b = binds.select(F.col("caller").alias("bf"), "local_key", "target_file", "target_symbol", "kind")
    target = symbols.groupBy(F.col("source_file").alias("tf"), F.lower("label").alias("tn")).agg(F.max_by("id", "pos").alias("target_id"))
    only = symbols.groupBy(F.lower("label").alias("gn")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("only_id")).where("n = 1")
    c = c.join(b.where("kind = 'namespace'").select("bf", F.col("local_key").alias("nk"), F.col("target_file").alias("ns_file")), (F.col("caller_file") == F.col("bf")) & (F.col("head") == F.col("nk")), "left").drop("bf", "nk")
    c = c.join(_namespace_members(c, target, exports, defaults), ["ns_file", "callee"], "left")
    c = c.join(local, (F.col("caller_file") == F.col("lf")) & (F.col("name") == F.col("ln")), "left").drop("lf", "ln")
    c = c.join(b, (F.col("caller_file") == F.col("bf")) & (F.col("name") == F.col("local_key")), "left").drop("bf", "local_key")
    c = c.join(target, (F.col("target_file") == F.col("tf")) & (F.lower(F.coalesce("target_symbol", "name")) == F.col("tn")), "left").drop("tf", "tn")
    c = c.join(only, F.col("name") == F.col("gn"), "left")
    two = F.col("is_member") & (F.col("parts") == 2)
    usual = ~F.col("name").isin(*GENERIC)
    tier = F.when(two & F.col("ns_file").isNotNull(), 1).when(two, 0).when(~usual, 0).when(F.col("local_id").isNotNull(), 2).when(F.col("target_file").isNotNull(), 3).when(~F.col("is_member") & F.col("only_id").isNotNull(), 4).otherwise(0)
    c = c.withColumn("tier", tier)
    found = F.when(F.col("tier") == 1, F.col("ns_id")).when(F.col("tier") == 2, F.col("local_id")).when((F.col("tier") == 3) & (F.col("kind") != "namespace"), F.col("target_id")).when(F.col("tier") == 4, F.col("only_id"))
    out = c.select(F.col("caller_file").alias("source_file"), found.alias("target"), F.when(F.col("tier") == 4, 0.8).otherwise(1.0).alias("score"), "pos").where("target IS NOT NULL")
    return out.groupBy("source_file", "target").agg(F.min_by("score", "pos").alias("score"))
