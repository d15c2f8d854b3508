"""Graphs made of the driver's tables, for tests and benchmarks of the graph operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _named(kind: str, key: str):
    return F.concat(F.lit(f"{kind}_"), F.col(key).cast("string"))


def _physical(df: DataFrame, relation: str = "imports") -> DataFrame:
    return df.select("source", "target", F.lit(relation).alias("relation"), F.lit("PHYSICAL").alias("type"), F.lit(1.0).alias("score"))


def trade_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(_named("nation", "n_nationkey").alias("id"), F.col("n_name").alias("label"), F.lit("code").alias("file_type"), F.concat_ws("/", "r_name", "n_name").alias("source_file"), F.lit(None).cast("string").alias("source_location"), F.col("n_regionkey").alias("community"))


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each customers' nation to the two other nations whose suppliers sold it most."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    sold = line.join(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    sold = sold.join(read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("cn")), F.col("o_custkey") == F.col("c_custkey"))
    sold = sold.join(read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("sn")), F.col("l_suppkey") == F.col("s_suppkey"))
    sums = sold.where("cn <> sn").groupBy("cn", "sn").agg(F.sum("l_quantity").alias("q"))
    sums = sums.join(read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("sn"), "n_name"), "sn")
    top = sums.withColumn("r", F.row_number().over(Window.partitionBy("cn").orderBy(F.desc("q"), "n_name"))).where("r <= 2")
    return _physical(top.select(_named("nation", "cn").alias("source"), _named("nation", "sn").alias("target")))


def next_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each part to the part that most often follows it in an order."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    after = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    pairs = line.withColumn("b", after).where("b IS NOT NULL").groupBy(F.col("l_partkey").alias("a"), "b").agg(F.count(F.lit(1)).alias("n"))
    best = pairs.groupBy("a").agg(F.min_by("b", F.struct(-F.col("n"), "b")).alias("b"))
    return _physical(best.select(_named("part", "a").alias("source"), _named("part", "b").alias("target")))


def market_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From suppliers and from customers to their parts, told apart by their keys before they have names."""
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    sells = line.select("l_suppkey", "l_partkey").distinct().select(_named("supplier", "l_suppkey").alias("source"), _named("part", "l_partkey").alias("target"))
    buys = line.join(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    buys = buys.select("o_custkey", "l_partkey").distinct().select(_named("customer", "o_custkey").alias("source"), _named("part", "l_partkey").alias("target"))
    return _physical(sells.unionByName(buys))


def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, n = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    rn = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", "n_name", "r_name", "n_regionkey")
    make = lambda df, kind, key, label, path: df.select(_named(kind, key).alias("id"), F.col(label).alias("label"), F.lit("code").alias("file_type"), path.alias("source_file"), F.col("n_regionkey").alias("community"))
    out = make(r.withColumnRenamed("r_regionkey", "n_regionkey"), "region", "n_regionkey", "r_name", F.col("r_name"))
    out = out.unionByName(make(rn, "nation", "n_nationkey", "n_name", F.concat_ws("/", "r_name", "n_name")))
    for table, kind, p in (("supplier", "supplier", "s"), ("customer", "customer", "c")):
        t = read(spark, sf_dir, table).join(rn, F.col(f"{p}_nationkey") == F.col("n_nationkey"))
        key = f"{p}_suppkey" if p == "s" else f"{p}_custkey"
        out = out.unionByName(make(t, kind, key, f"{p}_name", F.concat_ws("/", "r_name", "n_name", F.col(f"{p}_name"))))
    return out


def tree_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s, c = (read(spark, sf_dir, t) for t in ("nation", "supplier", "customer"))
    parts = [
        n.select(_named("region", "n_regionkey").alias("source"), _named("nation", "n_nationkey").alias("target")),
        s.select(_named("nation", "s_nationkey").alias("source"), _named("supplier", "s_suppkey").alias("target")),
        c.select(_named("nation", "c_nationkey").alias("source"), _named("customer", "c_custkey").alias("target")),
    ]
    return _physical(parts[0].unionByName(parts[1]).unionByName(parts[2]), "contains")
