"""Resolution of imports and calls, anew only for files that a change can touch.

What was resolved stays in a table with the files it was resolved from. A file is looked at again if it changed, if a path
came or went that one of its specifiers is looked for at, if a file it imports from, or one that hands on to that,
changed or has a re-export that leads elsewhere now, or if it calls a name whose symbols changed. Everything else is taken over, with the same result.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import drop_folder, settle
from ..operators import resolve
from ..sources import files as sources


@dataclass
class Resolved:
    """Tables of one compilation; touched has the files that it looked at."""

    stat: DataFrame  # source_file, size, mtime
    symbols: DataFrame  # id, label, source_file, pos
    targets: DataFrame  # caller, spec, target_file
    exports: DataFrame  # file, symbol, target_file, target_symbol, star_pos, pos
    brought: DataFrame  # caller, pos, kind, local, target_file, target_symbol
    binds: DataFrame  # caller, local_key, target_file, target_symbol, kind
    called: DataFrame  # source_file, target, score
    touched: DataFrame  # source_file


def raw_imports(extracted: DataFrame) -> DataFrame:
    return extracted.select(F.col("source_file").alias("caller"), F.explode("imports").alias("i")).select("caller", "i.*")


def handed_specifiers(extracted: DataFrame) -> DataFrame:
    """(caller, specifier) of re-exports."""
    return extracted.select(F.col("source_file").alias("caller"), F.explode("exports").alias("e")).select("caller", F.col("e.specifier").alias("specifier")).where("specifier IS NOT NULL")


def specifiers(extracted: DataFrame) -> DataFrame:
    """(caller, specifier) of imports and re-exports, each once a file."""
    return raw_imports(extracted).select("caller", "specifier").where("specifier IS NOT NULL").unionByName(handed_specifiers(extracted)).distinct()


def raw_calls(extracted: DataFrame) -> DataFrame:
    return extracted.select(F.col("source_file").alias("caller_file"), F.explode("calls").alias("c")).select("caller_file", "c.callee", "c.is_member", "c.pos")


def export_table(extracted: DataFrame, targets: DataFrame) -> DataFrame:
    """What files export: (file, symbol, target_file, target_symbol, star_pos, pos). An alias of an own symbol is passed over, as is a namespace made of another file."""
    every = extracted.select(F.col("source_file").alias("file"), F.explode("exports").alias("e")).select("file", "e.*").where("kind <> 'namespace'")
    mine = every.where("specifier IS NULL").select("file", F.when(F.col("kind") == "default", "default").otherwise(F.col("symbol")).alias("symbol"), F.col("file").alias("target_file"), F.when(F.col("kind") == "default", "default").otherwise(F.col("symbol")).alias("target_symbol"), F.lit(None).cast("int").alias("star_pos"), "pos")
    e = every.where("specifier IS NOT NULL")
    e = e.join(targets, (e["file"] == targets["caller"]) & (e["specifier"] == targets["spec"])).where("target_file IS NOT NULL")
    star = F.col("kind") == "star"
    led = e.select("file", F.when(star, "*").otherwise(F.coalesce("alias", "symbol")).alias("symbol"), "target_file", F.when(~star, F.col("symbol")).alias("target_symbol"), F.when(star, F.col("pos")).alias("star_pos"), "pos")
    return mine.unionByName(led)


def _looked_up(extracted: DataFrame, files: DataFrame, symbols: DataFrame, aliases: list, old: Resolved | None, touched: DataFrame | None) -> Resolved:
    """The tables of the touched files, or of all, and of others from the old ones."""
    mine = lambda df, c="source_file": df if touched is None else df.join(touched.select(F.col("source_file").alias(c)), c, "left_semi")

    def with_old(name: str, made: DataFrame, c: str) -> DataFrame:
        if old is None:
            return settle(made)
        there = getattr(old, name).join(files.select(F.col("source_file").alias(c)), c, "left_semi")
        return settle(there.join(touched.select(F.col("source_file").alias(c)), c, "left_anti").unionByName(made))

    rows = settle(mine(extracted))
    specs = specifiers(rows).withColumn("import_id", F.struct("caller", "specifier"))
    targets = resolve.resolve_modules(specs, files, aliases).select(F.col("import_id.caller").alias("caller"), F.col("import_id.specifier").alias("spec"), "target_file")
    targets = with_old("targets", targets, "caller")
    exports = with_old("exports", export_table(rows, mine(targets, "caller")), "file")
    real = raw_imports(rows).where("kind NOT LIKE 'type%'")
    real = real.join(mine(targets, "caller").withColumnRenamed("caller", "c"), (F.col("caller") == F.col("c")) & (F.col("specifier") == F.col("spec"))).where("target_file IS NOT NULL").drop("c", "spec")
    real = settle(real)
    # Exports that the touched files' imports can lead to; the rest is not followed.
    used = exports
    if touched is not None:
        used = settle(exports.join(_handed_on(exports, real.select(F.col("target_file").alias("source_file")), "file", "target_file").withColumnRenamed("source_file", "file"), "file", "left_semi"))
    # Only names are followed through exports: a namespace or a side effect is that of the file itself.
    requests = real.where("kind IN ('default', 'named')").select(F.struct("caller", "pos").alias("req_id"), F.col("target_file").alias("file"), F.col("imported").alias("symbol"))
    origin = resolve.unwrap_reexports(requests, used)
    real = real.join(origin.select("req_id.caller", "req_id.pos", F.col("file").alias("final_file"), F.col("symbol").alias("final_symbol")), ["caller", "pos"], "left")
    fresh = settle(real.select("caller", "pos", "kind", "local", F.coalesce("final_file", "target_file").alias("target_file"), F.col("final_symbol").alias("target_symbol")))
    defaults = extracted.where("default_symbol IS NOT NULL").select(F.col("source_file").alias("df"), "default_symbol")
    binds = resolve.bindings(fresh).join(defaults, (F.col("target_file") == F.col("df")) & (F.col("target_symbol") == "default"), "left")
    binds = settle(binds.withColumn("target_symbol", F.coalesce("default_symbol", "target_symbol")).drop("df", "default_symbol"))
    called = resolve.call_edges(raw_calls(rows), symbols, binds, used, defaults)
    seen = rows.select("source_file") if touched is None else touched
    return Resolved(files.select("source_file", "size", "mtime"), symbols.select("id", "label", "source_file", "pos"), targets, exports, with_old("brought", fresh, "caller"), with_old("binds", binds, "caller"), with_old("called", called, "source_file"), settle(seen))


def _handed_on(exports: DataFrame, start: DataFrame, here: str, there: str) -> DataFrame:
    """(source_file) of the start and all that exports lead to from there, from column `here` to column `there`, frontier by frontier."""
    steps = exports.select(F.col(here).alias("source_file"), F.col(there).alias("next")).where("source_file <> next").distinct()
    front = seen = settle(start.select("source_file").distinct())
    while not front.isEmpty():
        after = steps.join(front, "source_file").select(F.col("next").alias("source_file")).distinct()
        front = settle(after.join(seen, "source_file", "left_anti"))
        seen = seen.unionByName(front)
    return seen


def touched_files(old: Resolved, extracted: DataFrame, files: DataFrame, symbols: DataFrame, aliases: list) -> DataFrame:
    """(source_file) of the files there that must be resolved anew."""
    was = old.stat.select("source_file", F.struct("size", "mtime").alias("was"))
    now = files.select("source_file", F.struct("size", "mtime").alias("now"))
    moved = settle(was.join(now, "source_file", "full_outer").where("NOT (was <=> now)"))
    if moved.isEmpty():
        return moved.select("source_file")
    names = moved.select("source_file")
    # A path that came or went, where some specifier is looked for.
    paths = moved.where("was IS NULL OR now IS NULL").select(F.col("source_file").alias("file"))
    asked = resolve.with_folder(specifiers(extracted))
    hit = resolve.probes(asked, aliases).join(F.broadcast(paths) if paths.count() <= 10_000 else paths, "file", "left_semi").select(F.col("folder").alias("f"), F.col("specifier").alias("s")).distinct()
    hit = settle(hit)
    led_there = lambda df: settle(df.join(hit, df["folder"].eqNullSafe(hit["f"]) & (df["specifier"] == hit["s"]), "left_semi").select(F.col("caller").alias("source_file")).distinct())
    probed, handing = led_there(asked), led_there(resolve.with_folder(handed_specifiers(extracted)))
    # Files that hand on what a changed one, or one whose re-exports lead elsewhere now, exports; before or after. Where
    # only imports lead elsewhere, what the file exports is what it was.
    exports = old.exports.select("file", "target_file").unionByName(export_table(extracted.join(names, "source_file", "left_semi"), old.targets).select("file", "target_file"))
    reach = _handed_on(exports, names.unionByName(handing), "target_file", "file")
    users = old.targets.join(reach.withColumnRenamed("source_file", "target_file"), "target_file", "left_semi").select(F.col("caller").alias("source_file"))
    # Names of which symbols came or went.
    mine = lambda df, x: df.join(names, "source_file", "left_semi").select("id", F.lower("label").alias(x))
    labels = mine(old.symbols, "a").join(mine(symbols, "b"), "id", "full_outer").where("NOT (a <=> b)").select(F.explode(F.array_compact(F.array("a", "b"))).alias("name")).distinct()
    last = F.lower(F.element_at(F.split("callee", r"\."), -1))
    callers = raw_calls(extracted).select(F.col("caller_file").alias("source_file"), last.alias("name")).join(labels, "name", "left_semi").select("source_file")
    every = names.unionByName(probed).unionByName(users).unionByName(callers).distinct()
    return settle(every.join(files.select("source_file"), "source_file", "left_semi"))


def resolved(spark: SparkSession, extracted: DataFrame, files: DataFrame, symbols: DataFrame, aliases: list, folder: str | None = None) -> Resolved:
    """Imports and calls of all files; with a folder, from what it has of the last time, and written there for the next.

    Other aliases than the last time's mean that everything is looked up.
    """
    old, n = None, None
    mark = str(aliases)
    if folder:
        n = sources.generation(spark, folder)
        if n is not None and spark.read.parquet(f"{folder}/gen={n}").first()["aliases"] == mark:
            old = Resolved(*[spark.read.parquet(f"{folder}/gen={n}/{f.name}.table") for f in fields(Resolved)])
    touched = None if old is None else touched_files(old, extracted, files, symbols, aliases)
    out = _looked_up(extracted, files, symbols, aliases, old, touched)
    if folder:
        at = f"{folder}/gen={0 if n is None else n + 1}"
        drop_folder(spark, at)  # what a failed attempt left
        for f in fields(Resolved):
            getattr(out, f.name).write.parquet(f"{at}/{f.name}.table")
        spark.createDataFrame([(mark,)], "aliases string").write.mode("append").parquet(at)  # whole from here on
        if n is not None:
            drop_folder(spark, f"{folder}/gen={n}")
    return out
