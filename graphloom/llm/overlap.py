"""Texts whose sets of word shingles overlap: candidates by MinHash bands, each checked by exact Jaccard similarity.

Two sets of similarity J meet in one band at least with probability 1 - (1 - J^ROWS)^BANDS: all but 3 in 100,000 pairs
at 0.8, and more the more alike they are. No other pair is left out: in each bucket all are compared with one member and,
once what that linked is put together, with further ones, until that links nothing; then all that are still apart with
each other. Sets with too many shingles that no other set has can't reach 0.8, so they leave before pairs are made.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import drop_folder, shared_folder, written
from . import simhash
from .common import kept_columns, map_texts

WIDTH, ROWS, BANDS = 5, 4, 20
_RNG = np.random.default_rng(simhash.SEED)
_FLIP = _RNG.integers(0, 1 << 64, ROWS * BANDS, dtype=np.uint64)
_TIMES = _RNG.integers(0, 1 << 64, ROWS * BANDS, dtype=np.uint64) | np.uint64(1)
#: Shingles that are hashed anew at once.
SLICE = 1 << 14
#: Ids that may be broadcast.
MOST = 1 << 18
#: Longs of sets that may be broadcast.
MOST_LONGS = 1 << 21
#: Longs of a set's bitmap: shingles are dealt to its bits.
LONGS = 16
#: Members of a bucket that all others are compared with in one round.
SPEAKERS = 8
#: Members of a bucket to a part of it, once all that are left are compared.
DEALT = 256


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted hashes of the distinct word shingles of a text, with the words of simhash(); one of all words if they are fewer."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))
    lo, hi = starts[: max(1, len(words) - width + 1)].tolist(), (ends[min(width, len(words)) - 1 :] - 1).tolist()
    return np.unique(np.fromiter((digest(joined[a:b], simhash.SEED) for a, b in zip(lo, hi, strict=True)), dtype=np.uint64, count=len(lo)))


def band_values(hashes: np.ndarray) -> list[int]:
    """A value for each band: equal where the least hashes of its rows are. None for the empty set."""
    import xxhash

    if not len(hashes):
        return []
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), SLICE):
        least = np.minimum(least, ((hashes[at : at + SLICE, None] ^ _FLIP) * _TIMES).min(axis=0))
    raw, size = least.tobytes(), 8 * ROWS
    return [xxhash.xxh64_intdigest(raw[i : i + size], i) for i in range(0, len(raw), size)]


def sketches(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The kept columns with _fp (the fingerprint of op8), _set (a digest of the set of shingles), _n (its size) and _bands."""
    kept = kept_columns(df, keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            prints, digests, sizes, bands = [], [], [], []
            for x in batch.column(batch.num_columns - 1).to_pylist():
                h = shingles(x)
                prints.append(simhash.simhash(x))
                digests.append(xxhash.xxh3_128_digest(h.tobytes()))
                sizes.append(len(h))
                bands.append(np.array(band_values(h), dtype=np.uint64).view(np.int64))
            made = [pa.array(np.array(prints, dtype=np.uint64).view(np.int64)), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], "_fp", "_set", "_n", "_bands"])

    return map_texts(df, text, kept, work, "_fp long, _set binary, _n long, _bands array<long>")


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """Which of 64 * LONGS places the hashes fall on."""
    out = np.zeros(64 * LONGS, dtype=np.uint8)
    out[(hashes >> np.uint64(20)) % np.uint64(len(out))] = 1
    return np.packbits(out, bitorder="little").view(np.int64)


def hash_sets(df: DataFrame, text: str, key: str) -> DataFrame:
    """(key, hashes, bits): the hashes of the shingles of each text, and their bitmap."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingles(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h.view(np.int64) for h in made], pa.list_(pa.int64())), pa.array([bitmap(h) for h in made], pa.list_(pa.int64()))], names=[key, "hashes", "bits"])

    return map_texts(df, text, [F.col(key)], work, "hashes array<long>, bits array<long>")


def alike(a: Column, b: Column) -> Column:
    """Whether two sets have Jaccard similarity 0.8 or more, in whole numbers."""
    return 9 * F.size(F.array_intersect(a, b)) >= 4 * (F.size(a) + F.size(b))


def checked(pairs: DataFrame, sets: DataFrame, folder: str) -> DataFrame:
    """The pairs (u, v, ...) of ids whose sets (id, hashes) are alike.

    Where few v stand against many u, their sets are broadcast, so that no set is moved once a pair.
    """
    pairs = written(pairs.distinct(), folder)
    a, b = (sets.select(F.col("id").alias(x), F.col("hashes").alias(f"_{x}")) for x in "uv")
    b = b.join(pairs.select("v").distinct(), "v", "left_semi")
    longs = b.agg(F.sum(F.size("_v") + 2)).first()[0] or 0
    b = F.broadcast(b) if longs <= MOST_LONGS else b
    return written(pairs.join(a, "u").join(b, "v").where(alike(F.col("_u"), F.col("_v"))).select(*pairs.columns), folder)


def shared_counts(sets: DataFrame) -> DataFrame:
    """(id, shared): how many shingles of each set (id, hashes) some other of the sets has."""
    once = sets.select("id", F.explode("hashes").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("id")).where("k = 1")
    alone = once.groupBy(F.col("id").alias("of")).agg(F.count(F.lit(1)).alias("alone"))
    return sets.join(alone, sets["id"] == alone["of"], "left").select("id", (F.size("hashes") - F.coalesce("alone", F.lit(0))).alias("shared"))


def enough(most: Column, n: str, m: str) -> Column:
    """Whether sets of n and m shingles of which at most so many are common can have similarity 0.8."""
    return 9 * most >= 4 * (F.col(n) + F.col(m))


def bits_allow(n: str, bits: str, m: str, places: str) -> Column:
    """Whether bitmaps of sets of n and m shingles allow similarity 0.8.

    A place that one bitmap has and the other lacks is a shingle at least that the other lacks.
    """
    lacks = lambda a, b: functools.reduce(operator.add, [F.bit_count(F.get(a, F.lit(i)).bitwiseAND(F.bitwise_not(F.get(b, F.lit(i))))) for i in range(LONGS)])
    return enough(F.col(n) - lacks(bits, places), n, m) & enough(F.col(m) - lacks(places, bits), n, m)


def overlap_groups(distinct: DataFrame, known: DataFrame, rows: DataFrame, key: str, text: str) -> DataFrame:
    """(node, root): the smallest id that known links (u, v), u > v, and links of ids whose sets are alike reach; only of ids with links.

    distinct has a row (id, _n, _bands) for each set; ids are keys of the rows (key, text). Tables go to the shared
    folder, those of a round until the next is done; the result, in a checkpoint, needs none of them.
    """
    spark = distinct.sparkSession
    folder = shared_folder(spark, "overlap")
    turns = [f"{folder}/round-0"]  # where the round at work keeps its own
    keep = lambda df: written(df, f"{folder}/all")
    hold = lambda df: written(df, turns[-1])
    bucket = ["band", "value"]
    members = distinct.select("id", F.col("_n").alias("n"), F.posexplode("_bands").alias("band", "value"))
    first = keep(members.groupBy(*bucket).agg(F.min(F.struct("id", "n")).alias("f"), F.count(F.lit(1)).alias("k")).where("k > 1").select(*bucket, F.col("f.id").alias("v"), F.col("f.n").alias("m")))
    members = hold(members.join(first, bucket))
    ids = keep(members.select(F.col("id").alias(key)).distinct())
    few = ids.count() <= MOST
    sets = keep(hash_sets(rows.select(key, text).join(F.broadcast(ids) if few else ids, key, "left_semi"), text, key).withColumnRenamed(key, "id"))
    near = 5 * F.least("n", "m") >= 4 * F.greatest("n", "m")  # of sizes that leave 0.8 possible
    roots = simhash.components(known.union(checked(members.where((F.col("id") != F.col("v")) & near).select(F.col("id").alias("u"), "v"), sets, turns[-1])))

    def apart(members: DataFrame, groups: DataFrame, of: str) -> DataFrame:
        """The members of buckets that hold several groups by now, each with its group's root."""
        out = members.join(groups.withColumnRenamed("root", "now"), F.col(of) == F.col("node"), "left").withColumn("root", F.coalesce("now", of)).drop("now", "node")
        mixed = hold(out.groupBy(*bucket).agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select(*bucket))
        return hold(out.join(mixed, bucket, "left_semi"))

    def alike_pairs(left: DataFrame, right: DataFrame, on: list[str], more: Column | None = None) -> DataFrame:
        """Links (u, v), u > v, of the groups whose members (id, root) of the one and (v, of) of the other side are alike.

        Sizes, shared shingles and bitmaps are part of the join's condition, so it gives no pair that they rule out.
        """
        possible = near & enough(F.least("shared", "common"), "n", "m") & (F.col("root") != F.col("of")) & bits_allow("n", "bits", "m", "places")
        pairs = left.join(right, on).where(possible if more is None else possible & more)  # a pair may meet in many bands
        pairs = pairs.select(F.col("id").alias("u"), "v", F.greatest("root", "of").alias("a"), F.least("root", "of").alias("b"))
        return keep(checked(pairs, sets, turns[-1]).select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())

    members = apart(members.select(*bucket, "id", "n"), roots, "id")
    counts = shared_counts(sets.join(members.select("id").distinct(), "id", "left_semi"))
    members = members.join(counts, "id").where("5 * shared >= 4 * n").join(sets.select("id", "bits"), "id")  # with less shared no set at all can be alike
    members = hold(members)
    glue = spoken = None
    while not members.isEmpty():
        free = members if spoken is None else members.join(spoken, [*bucket, "id"], "left_anti")
        speaks = keep(free.groupBy(*bucket, F.pmod(F.xxhash64("id"), F.lit(SPEAKERS))).agg(F.max(F.struct("shared", "id", "n", "root", "bits")).alias("s")).select(*bucket, F.col("s.id").alias("v"), F.col("s.n").alias("m"), F.col("s.shared").alias("common"), F.col("s.root").alias("of"), F.col("s.bits").alias("places")))
        found = alike_pairs(members, speaks, bucket)
        if found.isEmpty():
            break
        glue = found if glue is None else glue.union(found)
        turns.append(f"{folder}/round-{len(turns)}")
        members = apart(members, simhash.components(found), "root")
        drop_folder(spark, turns[-2])
        own = speaks.select(*bucket, F.col("v").alias("id"))
        spoken = own if spoken is None else spoken.union(own)
    # What is left: each member outside its bucket's largest group against all of other groups.
    # A large bucket is dealt to parts: each member to one of them, its partners to all.
    top = members.groupBy(*bucket, "root").agg(F.count(F.lit(1)).alias("k")).groupBy(*bucket).agg(F.max(F.struct("k", "root")).alias("t"), F.sum("k").alias("all"))
    top = hold(top.select(*bucket, F.col("t.root").alias("top"), (1 + F.floor(F.col("all") / DEALT)).cast("int").alias("parts")))
    members = hold(members.join(top, bucket))
    other = members.select(*bucket, F.col("id").alias("v"), F.col("n").alias("m"), F.col("shared").alias("common"), F.col("root").alias("of"), F.col("bits").alias("places"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    one = members.where("root <> top").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    found = alike_pairs(one, other, [*bucket, "part"], (F.col("of") == F.col("top")) | (F.col("id") > F.col("v")))
    glue = found if glue is None else glue.union(found)
    joined = simhash.components(glue)
    drop_folder(spark, folder)
    alone = joined.join(roots, "node", "left_anti").select("node", F.col("node").alias("root"))
    # A frequent root's nodes are dealt to copies of where it ends.
    last = joined.select(F.col("node").alias("at"), F.col("root").alias("end"), F.explode(F.sequence(F.lit(0), F.lit(simhash.COPIES - 1))).alias("part"))
    dealt = roots.union(alone).withColumn("copy", F.pmod(F.xxhash64("node"), F.lit(simhash.COPIES)).cast("int"))
    return dealt.join(last, (F.col("root") == F.col("at")) & (F.col("copy") == F.col("part")), "left").select("node", F.coalesce("end", "root").alias("root"))
