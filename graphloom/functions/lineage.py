"""Cutting lineage, shared folders, and ranks over a whole table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_top(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir or the context names. Only local mode, in tests, may go without: it gets a temporary one."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    held = sc._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="graphloom-"))
        held = sc._jsc.sc().getCheckpointDir()
    return named or held.get()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new place below the shared folder."""
    return f"{shared_top(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder, by the file system that Spark reads it with."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def settle(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read from there: no lineage, safe when executors go."""
    shared_top(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, folder: str) -> DataFrame:
    """The rows as a table below a shared folder, read from there.

    For loops of many joins: a checkpoint keeps its plan's estimate of size, which such a loop multiplies each round
    until the estimate itself fills the driver; a table has the size that it has.
    """
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tabled(df: DataFrame, folder: str) -> DataFrame:
    """As written, for tables of which loops make many: no join sends one through the driver.

    A table that takes little room in its file would be broadcast, by each join of each round, and fill the driver.
    """
    return written(df, folder).hint("merge")


def gathered(one: DataFrame, folder: str) -> DataFrame:
    """The rows of all tables that tabled has made in a folder so far, of which one is given."""
    return one.sparkSession.read.schema(one.schema).option("recursiveFileLookup", "true").parquet(folder).hint("merge")


def ranked(df: DataFrame, order: list[Column], to: str = "rank") -> tuple[DataFrame, int]:
    """df (narrow rows) with each row's place from 0 in the order, and the number of rows.

    The rows are range-sorted, so no key, however frequent, meets in one task: equal rows are told apart by where
    they were read. Only a count for each partition goes to the driver.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = settle(df).withColumn("_rank_tie", F.monotonically_increasing_id())
    at = at.repartitionByRange(parts, *order, F.col("_rank_tie")).sortWithinPartitions(*order, F.col("_rank_tie")).drop("_rank_tie")
    at = settle(at.withColumn("_rank_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_rank_at", 33), F.col("_rank_at").bitwiseAND(F.lit((1 << 33) - 1))
    starts, total = [], 0
    for row in at.groupBy(part.alias("part")).count().orderBy("part").collect():
        starts.append((row["part"], total))
        total += row["count"]
    table = spark.createDataFrame(starts or [(0, 0)], "_rank_part long, _rank_first long")  # a row for each partition
    at = at.withColumn("_rank_part", part).join(F.broadcast(table), "_rank_part")
    return at.withColumn(to, F.col("_rank_first") + place).drop("_rank_part", "_rank_first", "_rank_at"), total


def with_rank(df: DataFrame, order: list[Column], to: str = "rank") -> DataFrame:
    """Places from 0 in the order."""
    return ranked(df, order, to)[0]


def small(df: DataFrame, most: int) -> bool:
    """Whether the table has at most so many rows; a broadcast or a collect may follow only then."""
    return df.limit(most + 1).count() <= most


def running(df: DataFrame, order: list[Column], value: Column, to: str = "running", rank: str = "rank") -> DataFrame:
    """df (narrow rows) with each row's place from 0 in the order and the sum of the values up to it, itself included.

    Rows are range-sorted and summed a partition at a time; a count and a sum for each partition go to the driver and
    out again as offsets, so no task holds more than a partition.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [*order, F.col("_run_tie")]
    at = settle(df.withColumn("_run_value", value)).withColumn("_run_tie", F.monotonically_increasing_id())
    at = settle(at.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("_run_tie").withColumn("_run_at", F.monotonically_increasing_id()))
    at = at.withColumn("_run_part", F.shiftright("_run_at", 33))
    starts, n, total = [], 0, 0
    for row in at.groupBy("_run_part").agg(F.count(F.lit(1)).alias("n"), F.sum("_run_value").alias("sum")).orderBy("_run_part").collect():
        starts.append((row["_run_part"], n, total))
        n, total = n + row["n"], total + (row["sum"] or 0)
    kind = at.schema["_run_value"].dataType.simpleString()
    table = spark.createDataFrame(starts or [(0, 0, 0)], f"_run_part long, _run_first long, _run_sum {kind}")  # a row for each partition
    own = F.sum("_run_value").over(Window.partitionBy("_run_part").orderBy("_run_at").rowsBetween(Window.unboundedPreceding, 0))
    out = at.withColumn("_run_own", F.coalesce(own, F.lit(0))).join(F.broadcast(table), "_run_part")
    out = out.withColumn(rank, F.col("_run_first") + F.col("_run_at").bitwiseAND(F.lit((1 << 33) - 1))).withColumn(to, F.col("_run_sum") + F.col("_run_own"))
    return out.drop("_run_part", "_run_at", "_run_value", "_run_own", "_run_first", "_run_sum")
