"""Reading and writing: source trees, project settings, insight files, tours, caches and logs."""

from __future__ import annotations

import hashlib
import importlib.util
import json
import logging
import os
import re
import time
from logging.handlers import RotatingFileHandler

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import drop_folder, ranked, settle
from ..operators.change import route_chunks
from .extract import supported

# What parts words: all Unicode blanks and the byte order mark.
BLANKS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"
# Folders that are never read, and the size from which a project wants a scope.
SKIPPED = ("node_modules", ".git", ".graphloom", "dist", "build", ".next")
MOST_FILES, MOST_WORDS = 500, 2_000_000


def scan(spark: SparkSession, root: str, scope: str = "") -> DataFrame:
    """(source_file, size, mtime, text) of the source files below a root (any file system that Spark reads)."""
    top = f"{root.rstrip('/')}/{scope}".rstrip("/")
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(top)
    base = df.select(F.regexp_extract("path", "^[a-z]+:/*(/.*)$", 1).alias("full"), "length", "modificationTime", "content")
    plain = re.sub("^[a-z]+:/*(?=/)", "", root).rstrip("/")
    rows = base.select(F.regexp_replace("full", "^" + re.escape(plain) + "/", "").alias("source_file"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")
    odd = "(^|/)(" + "|".join(re.escape(s) for s in SKIPPED) + ")/"
    known = "(" + "|".join(re.escape(e) for e in supported()) + ")$"
    return rows.where(F.col("source_file").rlike(known) & ~F.col("source_file").rlike(odd)).select("source_file", "size", "mtime", F.decode("content", "UTF-8").alias("text"))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(source_file) of all files below a root, of whatever kind; none is opened."""
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root.rstrip("/")).select(F.regexp_extract("path", "^[a-z]+:/*(/.*)$", 1).alias("full"))
    plain = re.sub("^[a-z]+:/*(?=/)", "", root).rstrip("/")
    return paths.select(F.regexp_replace("full", "^" + re.escape(plain) + "/", "").alias("source_file"))


def size_estimate(files: DataFrame, most: int = 100) -> DataFrame:
    """(files, words): words of every k-th file by path, k so that `most` to twice as many are read, carried over to all.

    Words are what blanks part, so a blank in front or behind makes an empty one that counts, as an empty text does.
    Only paths are ranked; texts are read of the chosen files.
    """
    paths, n = ranked(files.select("source_file"), [F.col("source_file")], "nth")
    step = max(1, n // max(1, min(most, n)))
    chosen = paths.where(F.col("nth") % step == 0).select("source_file")  # below 2 * most rows
    sample = files.join(F.broadcast(chosen), "source_file", "left_semi")
    words = F.size(F.split(F.coalesce("text", F.lit("")), BLANKS))
    return sample.agg(F.lit(n).cast("long").alias("files"), F.coalesce(F.round(F.avg(words) * n), F.lit(0)).cast("long").alias("words"))


def top_folders(files: DataFrame, most: int = 5) -> DataFrame:
    """(folder, n) of the first path segment, a file's own name at the root, the largest first."""
    parts = files.groupBy(F.split("source_file", "/")[0].alias("folder"))
    return parts.agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "folder").limit(most)


def strip_jsonc(text: str) -> str:
    """JSON with comments and trailing commas to JSON."""
    bare = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    return re.sub(r'("(?:\\.|[^"\\])*")|,(\s*[}\]])', lambda m: m[1] or m[2], bare)


def find_aliases(root: str) -> list[tuple[str, list[str]]]:
    """paths of the nearest tsconfig.json or jsconfig.json from the root upwards, with baseUrl, in their order."""
    at = os.path.abspath(root)
    while True:
        for name in ("tsconfig.json", "jsconfig.json"):
            try:
                with open(os.path.join(at, name), encoding="utf-8") as f:
                    options = json.loads(strip_jsonc(f.read())).get("compilerOptions", {})
            except (OSError, ValueError):
                continue
            base = os.path.relpath(os.path.join(at, options.get("baseUrl", ".")), root).replace("\\", "/")
            join = lambda t, base=base: os.path.normpath(f"{base}/{t}").replace("\\", "/")
            return [(p, [join(t) for t in ts]) for p, ts in options.get("paths", {}).items()]
        if os.path.dirname(at) == at:
            return []
        at = os.path.dirname(at)


def canonical_config_hash(text: str, kind: str) -> str:
    """SHA-256 of a JSON, JSONC or (where a YAML reader is installed) YAML text with sorted keys and no blanks; of any other text as it is."""
    parsed = None
    if kind in (".json", ".jsonc"):
        parsed = json.loads(strip_jsonc(text))
    elif kind in (".yaml", ".yml") and importlib.util.find_spec("yaml"):
        parsed = importlib.import_module("yaml").safe_load(text)
    if parsed is not None:
        text = json.dumps(parsed, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)
    return hashlib.sha256(text.encode()).hexdigest()


def read_insights(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of the JSON files of a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).select("path", F.decode("content", "UTF-8").alias("text"))


def ingest(entries: DataFrame, folder: str, watched: bool) -> DataFrame:
    """A batch of insights (path, text), checked and written in one step; (path, status, refresh) of each.

    status is ok, invalid_schema, or lock_failed where the batch could not be written; refresh is queued if something
    was written and someone watches, else cache_only. Of entries with one path the last of the table stays.
    """
    routed = settle(route_chunks(entries.select(F.translate("path", "\\", "/").alias("path"), "text").withColumn("_nth", F.monotonically_increasing_id()), keep=["text", "_nth"]))
    good = routed.where("status = 'ok'")
    wrote, failed = not good.isEmpty(), False
    if wrote:
        try:
            write_insights(good.groupBy("path").agg(F.max_by("text", "_nth").alias("text")), folder)
        except (Py4JJavaError, OSError):
            failed = True
    said = F.when(F.col("status") != "ok", "invalid_schema").otherwise("lock_failed" if failed else "ok")
    return routed.select("path", said.alias("status"), F.lit("queued" if wrote and not failed and watched else "cache_only").alias("refresh"))


def write_insights(entries: DataFrame, folder: str) -> None:
    """Documents (path, text) by hash into at most 256 folders; only those that a written document falls into are replaced, its older text with them."""
    spark = entries.sparkSession
    rows = settle(entries.withColumn("bucket", F.substring(F.sha2(F.col("path").cast("binary"), 256), 1, 2)))
    if exists(spark, folder):
        old = spark.read.schema(rows.schema).parquet(folder)
        touched = rows.select("bucket").distinct()
        old = old.join(F.broadcast(touched), "bucket", "left_semi").join(rows.select("path"), "path", "left_anti")
        rows = settle(rows.unionByName(old.select(*rows.columns)))
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, asked of the file system that Spark reads it with."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def write_generation(rows: DataFrame, folder: str) -> None:
    """Writes rows as the next generation of a table and only then drops the older ones, so a failure leaves the last."""
    spark, n = rows.sparkSession, generation(rows.sparkSession, folder)
    rows.write.mode("overwrite").parquet(f"{folder}/gen={0 if n is None else n + 1}")
    if n is not None:
        drop_folder(spark, f"{folder}/gen={n}")


def read_generation(spark: SparkSession, folder: str) -> DataFrame | None:
    """The newest whole generation of a table; none if there is none."""
    n = generation(spark, folder)
    return None if n is None else spark.read.parquet(f"{folder}/gen={n}")


def generation(spark: SparkSession, folder: str) -> int | None:
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    whole = [int(x[4:]) for x in names if x.startswith("gen=") and exists(spark, f"{folder}/{x}/_SUCCESS")]
    return max(whole, default=None)


def clean_insights(spark: SparkSession, routed: DataFrame, quarantine: str) -> dict[str, int]:
    """Acts on routed insight files (path, status) and counts the acts: corrupt files and those of missing sources go, invalid ones move to quarantine.

    A file is one act on its file system; the driver takes the paths one after the other, never all at once.
    """
    done = {"removed": 0, "quarantined": 0}
    path_of, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    for row in routed.where("status <> 'ok'").select("path", "status").toLocalIterator():
        at = path_of(row.path)
        fs = at.getFileSystem(conf)
        if row.status == "invalid":
            fs.mkdirs(path_of(quarantine))
            fs.rename(at, path_of(f"{quarantine}/{at.getName()}"))
            done["quarantined"] += 1
        else:
            fs.delete(at, False)
            done["removed"] += 1
    return done


def newest_files(files: DataFrame, name: str = "name", folder: str = "folder", time: str = "mtime", home: str = "insights") -> DataFrame:
    """(name, folder, time): of files of one name in several folders the one written last; where times are equal, that in the home folder."""
    return files.groupBy(name).agg(F.max_by(F.struct(folder, time), F.struct(F.col(time), F.col(folder) == home, F.col(folder))).alias("x")).select(name, "x.*")


def migrate_insights(legacy: str, target: str) -> int:
    """Moves a project's JSON files from a legacy folder, where the target has none of that name or an older one; the others go. Files moved."""
    moved = 0
    os.makedirs(target, exist_ok=True)
    for name in sorted(os.listdir(legacy)) if os.path.isdir(legacy) else []:
        if not name.endswith(".json"):
            continue
        old, new = f"{legacy}/{name}", f"{target}/{name}"
        if not os.path.exists(new) or os.path.getmtime(old) > os.path.getmtime(new):
            os.replace(old, new)
            moved += 1
        else:
            os.unlink(old)
    if os.path.isdir(legacy) and not os.listdir(legacy):
        os.rmdir(legacy)
    return moved


def write_atomic(path: str, content: str, stale_s: float = 10, tries: int = 30) -> None:
    """A driver's small state file: a lock file that goes stale, a temporary file, and a rename."""
    lock = f"{path}.lock"
    for n in range(tries):
        try:
            os.close(os.open(lock, os.O_CREAT | os.O_EXCL))
            break
        except FileExistsError:
            if time.time() - os.path.getmtime(lock) > stale_s:
                os.unlink(lock)
            elif n == tries - 1:
                raise TimeoutError(lock) from None
            time.sleep(0.05)
    try:
        with open(f"{path}.tmp", "w", encoding="utf-8") as f:
            f.write(content)
        os.replace(f"{path}.tmp", path)
    finally:
        os.unlink(lock)


# ---- tours -------------------------------------------------------------------------------------------------------

TOUR_ID = re.compile(r"[a-z0-9-]+")


def save_tour(folder: str, tour: dict, keep: int = 50) -> str:
    """Writes a tour and drops all but the newest `keep`. Its id, or one from the time. ValueError for a tour that is none."""
    if not valid_tour(tour):
        raise ValueError("a tour has beats with something to say and a list of node ids")
    os.makedirs(folder, exist_ok=True)
    name = tour.get("id") or f"tour-{int(time.time() * 1000):x}"
    if not TOUR_ID.fullmatch(name):
        raise ValueError("a tour id has small letters, digits and dashes")
    write_atomic(f"{folder}/{name}.json", json.dumps(tour | {"id": name, "timestamp": tour.get("timestamp", int(time.time() * 1000))}))
    for old in list_tours(folder)[keep:]:
        delete_tour(folder, old["id"])
    return name


def valid_tour(tour: object) -> bool:
    """At least one beat; say, nodes, and title and lang where there are any, of the right types."""
    text = lambda x, k: k not in x or isinstance(x[k], str)
    beat = lambda b: isinstance(b, dict) and isinstance(b.get("say"), str) and b["say"].strip() and isinstance(b.get("nodes"), list) and all(isinstance(n, str) for n in b["nodes"]) and text(b, "lang")
    beats = tour.get("beats") if isinstance(tour, dict) else None
    return isinstance(beats, list) and bool(beats) and text(tour, "title") and all(beat(b) for b in beats)


def list_tours(folder: str) -> list[dict]:
    """All readable tours, the newest first."""
    out = []
    for name in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
        if name.endswith(".json"):
            try:
                with open(f"{folder}/{name}", encoding="utf-8") as f:
                    tour = json.load(f)
            except ValueError:
                continue
            if isinstance(tour, dict):
                out.append(tour)
    return sorted(out, key=lambda t: -(t.get("timestamp") or 0))


def delete_tour(folder: str, name: str) -> None:
    if not TOUR_ID.fullmatch(name):
        raise ValueError("a tour id has small letters, digits and dashes")
    try:
        os.unlink(f"{folder}/{name}.json")
    except FileNotFoundError:
        pass


def error_log(path: str) -> logging.Logger:
    """5 MiB a file, three of them."""
    log = logging.getLogger(f"graphloom.{hashlib.md5(path.encode()).hexdigest()}")
    if not log.handlers:
        log.addHandler(RotatingFileHandler(path, maxBytes=5 << 20, backupCount=3, delay=True))
    return log


def inside(root: str, path: str) -> str:
    """The real path, which must be below the real root."""
    top, real = os.path.realpath(root), os.path.realpath(os.path.join(root, path))
    if real != top and not real.startswith(top + os.sep):
        raise PermissionError(path)
    return real
