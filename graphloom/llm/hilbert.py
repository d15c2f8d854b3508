"""Sharding along a Hilbert curve: metadata is quantised, rows are sorted by curve index, and runs of that order become shards.

Files cut this way span a small box in all dimensions, so their min/max statistics prune filters on any of them.
Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import with_global_rank


def _cuts(df: DataFrame, dims: list[str], bits: int, dictionary: int = 1024) -> dict[str, list]:
    """For each dimension at most 2**bits - 1 ascending values that part its rows about evenly.

    Numbers by approximate quantiles of all rows. Other columns, as strings, by the counts of their `dictionary` most
    frequent values (counts of all rows): a bounded summary, which only moves borders; every value gets a cell.
    """
    kinds, n, cuts = {f.name: f.dataType for f in df.schema.fields}, 1 << bits, {}
    numeric = [d for d in dims if isinstance(kinds[d], T.NumericType)]
    if numeric:
        row = df.agg(*[F.percentile_approx(F.col(d).cast("double"), [k / n for k in range(1, n)], 10_000).alias(d) for d in numeric]).first()
        cuts |= {d: sorted(set(row[d] or ())) for d in numeric}
    for d in (x for x in dims if x not in numeric):
        top = df.where(F.col(d).isNotNull()).groupBy(F.col(d).cast("string").alias("v")).count().orderBy(F.desc("count"), "v").limit(dictionary)
        top = sorted((r["v"].encode(), r["count"]) for r in top.collect())
        total, before, found, last = sum(c for _, c in top), 0, [], 0
        for v, c in top:
            if before * n // total > last:
                found.append(v.decode())
                last = before * n // total
            before += c
        cuts[d] = found
    return cuts


def _cell(value: Column, cuts: list, kind: str) -> Column:
    """How many cuts are at or below the value; 0 for null."""
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= value.cast(kind)))


def curve_index(cells: list[Column], bits: int) -> Column:
    """Place of a cell on the Hilbert curve through a cube of 2**bits cells a side (axes to transpose form, then bits interleaved)."""
    dims = len(cells)

    def flip(x: Column, step: Column) -> Column:
        q, i = step["q"], step["i"]
        p, here, first = q - 1, F.get(x, i), F.get(x, F.lit(0))
        swap = first.bitwiseXOR(here).bitwiseAND(p)
        invert = here.bitwiseAND(q) != 0
        return F.transform(x, lambda v, j: F.when(invert, F.when(j == 0, v.bitwiseXOR(p)).otherwise(v)).otherwise(F.when((j == 0) | (j == i), v.bitwiseXOR(swap)).otherwise(v)))

    steps = [(1 << b, i) for b in range(bits - 1, 0, -1) for i in range(dims)]
    x = F.array(*[c.cast("long") for c in cells])
    if steps:
        x = F.aggregate(F.array(*[F.struct(F.lit(q).cast("long").alias("q"), F.lit(i).alias("i")) for q, i in steps]), x, flip)
    # Gray code: each axis is combined with all before it, then all with what the last axis says of the higher bits.
    x = F.aggregate(x, F.array().cast("array<bigint>"), lambda s, v: F.concat(s, F.array(v.bitwiseXOR(F.coalesce(F.get(s, F.size(s) - 1), F.lit(0).cast("long"))))))
    spread = lambda last: F.aggregate(F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)]), F.lit(0).cast("long"), lambda t, q: F.when(last.bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
    done = F.transform(F.array(x), lambda a: F.transform(F.array(spread(a[dims - 1])), lambda t: F.transform(a, lambda v: v.bitwiseXOR(t)))[0])[0]
    picks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(1 << b).cast("long").alias("q")) for b in range(bits - 1, -1, -1) for i in range(dims)])
    return F.transform(F.array(done), lambda a: F.aggregate(picks, F.lit(0).cast("long"), lambda s, k: s * 2 + F.when(F.get(a, k["i"]).bitwiseAND(k["q"]) != 0, 1).otherwise(0)))[0]


def hilbert_shards(df: DataFrame, dims: list[str], n_shards: int = 24, bits: int = 6, key: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """The carried columns (all, unless listed) with _curve, _shard and _slot.

    Rows in curve order, ties by key, are cut into n_shards runs whose counts differ by one at most; the slot is the
    place in the run. Nulls of a dimension share the lowest cell, a null key comes first; equal rows get places of
    their own; an empty table gives no rows. Carry narrow columns only: they are sorted.
    """
    if len(dims) * bits > 62:
        raise ValueError("the curve index has 62 bits at most")
    cuts = _cuts(df.select(*dims), dims, bits)
    kinds = {f.name: "double" if isinstance(f.dataType, T.NumericType) else "string" for f in df.schema.fields}
    index = curve_index([_cell(F.col(d), cuts[d], kinds[d]) for d in dims], bits)
    names = [c for c in (carry if carry is not None else df.columns) if c not in ("_curve", "_shard", "_slot", "_rank")]
    rows = df.select(*[F.col(f"`{c}`") for c in names], index.alias("_curve"))
    ranked, total = with_global_rank(rows, [F.col("_curve"), F.col(f"`{key}`")], "_rank")
    shard = F.expr(f"_rank * {n_shards} div {max(total, 1)}")
    ranked = ranked.withColumn("_shard", shard.cast("int"))
    start = F.expr(f"(_shard * {total}L + {n_shards - 1}) div {n_shards}")
    return ranked.withColumn("_slot", (F.col("_rank") - start).cast("long")).drop("_rank")


def write_shards(df: DataFrame, path: str) -> None:
    """One folder of Parquet a shard, its rows by slot, so that row groups keep the order of the curve."""
    df.repartition("_shard").sortWithinPartitions("_shard", "_slot").write.mode("overwrite").partitionBy("_shard").parquet(path)
