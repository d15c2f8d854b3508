"""Connected components of links over tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import drop_folder, settle, shared_folder, written

#: Links that one task unites, and nodes after which it gives what it has.
LINKS, HELD = 1 << 17, 1 << 19


def united(links: DataFrame, parts: int, held: int = HELD) -> DataFrame:
    """Links (u, v), u > v, from each node to its smallest one within a partition, of so many; they connect what the given links connect."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[int, int] = {}

        def root(x: int) -> int:
            path = []
            while (up := top.setdefault(x, x)) != x:
                path.append(x)
                x = up
            for y in path:
                top[y] = x
            return x

        def give() -> pa.RecordBatch:
            pairs = np.array([(x, r) for x in list(top) if (r := root(x)) != x], dtype=np.int64).reshape(-1, 2)
            top.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(u), root(v)
                if a != b:
                    top[max(a, b)] = min(a, b)
            if len(top) > held:
                yield give()
        yield give()

    return links.select("u", "v").coalesce(parts).mapInArrow(work, "u long, v long")


def connected(links: DataFrame, most: int = LINKS) -> DataFrame:
    """(node, root) of every node of the links (u, v), longs: root is the smallest node that can be reached.

    Links are united within partitions of about `most`. Where that leaves more partitions than one, rounds follow in
    which each node's neighbours are hung below the smallest of them (larger ones in one half, smaller ones in the
    other), until nothing changes. A round is a table, and the one before goes.
    """
    spark = links.sparkSession
    folder = shared_folder(spark, "connected")
    raw = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), folder)
    parts = 1 + raw.count() // most
    edges, before, turn = written(united(raw, parts), f"{folder}/0"), None, 0
    while parts > 1:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.union(least.select("u", F.col("m").alias("v"))).distinct().coalesce(parts), f"{folder}/{turn + 1}")
        drop_folder(spark, f"{folder}/{turn}")
        turn += 1
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = settle(nodes.union(nodes.select("root", "root").distinct()))
    drop_folder(spark, folder)
    return out
