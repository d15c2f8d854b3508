"""Prefix trie of conversations, level by level.

At each depth live conversations are grouped by (parent node, next turn); a group is a node, named by its smallest
conversation. Equal conversations go down as one, with their number as weight, and a conversation that is alone in
its node leaves: what follows is a chain, which is written at once. So rounds go as deep as different conversations
agree. Then joins from the deepest level back to the root roll up leaves and savings.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lineage import written
from .common import drop_folder, placed, settle, shared_folder

#: Turns of one conversation, and ids of one class, that one task or row may hold.
CHUNK, LISTED = 1 << 14, 512


def ordered_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, place, sha, n_bytes): every turn by its place from 0, as the SHA-256 of role and text and the text's UTF-8 bytes.

    Turns ascend by number, nulls first; equal numbers by that hash, so repeated rows are turns of their own. A null
    role or text counts as empty. Rows without a conversation id belong to none and are left out.
    """
    who, what = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text))
    sha = F.unhex(F.sha2(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, what).cast("binary"), 256))
    rows = df.where(F.col(f"`{conv}`").isNotNull()).select(F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("turn"), sha.alias("sha"), F.octet_length(what).cast("long").alias("n_bytes"))
    return settle(placed(rows, "conv", [F.col("turn"), F.col("sha")], "place").select("conv", "place", "sha", "n_bytes"))


def lengths(turns: DataFrame) -> DataFrame:
    """(conv, n): each conversation and its turns."""
    return turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))


def chunked(convs: DataFrame) -> DataFrame:
    """A row for each chunk of a conversation's places, so that a long one is dealt to several tasks."""
    return convs.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor(F.greatest(F.col("n") - 1, F.lit(0)) / CHUNK).cast("int"))))


def rebuilt(turns: DataFrame, family: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Turns and (conv, n) of conversations that begin with h turns of their family's first one: h is the id's CRC-32 modulo heads.

    Then come their own turns after the first h. The family's first id is the next multiple of `family` downwards,
    also below zero; where there is no such conversation, nothing comes before the own turns.
    """
    all_ = settle(lengths(turns))
    h = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(heads))
    convs = all_.select("conv", "n", h.alias("h"), (F.col("conv") - F.pmod("conv", F.lit(family))).alias("first"))
    convs = convs.join(all_.select(F.col("conv").alias("first"), F.col("n").alias("n_first")), "first", "left")
    convs = settle(convs.select("conv", "n", "h", "first", F.least("h", F.coalesce("n_first", F.lit(0))).alias("taken")))
    own = turns.withColumn("chunk", F.floor(F.col("place") / CHUNK).cast("int")).join(chunked(convs.select("conv", "n", "h", "taken")), ["conv", "chunk"])
    own = own.where("place >= h").select("conv", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "sha", "n_bytes")
    head = turns.where(F.col("place") < heads - 1).withColumnRenamed("conv", "first").join(convs.select("first", "conv", "h"), "first")
    head = head.where("place < h").select("conv", "place", "sha", "n_bytes")
    made = settle(own.unionByName(head))
    return made, convs.select("conv", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"))


def classes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, n, rep): the smallest of the conversations with the same turns, told by two 64-bit hashes of places and turns."""
    marks = [F.bit_xor(F.xxhash64(F.lit(k), "place", "sha")).alias(f"x{k}") for k in (1, 2)]
    known = convs.join(turns.groupBy("conv").agg(*marks), "conv", "left").na.fill(0, ["x1", "x2"])
    known = settle(known)
    return known.join(known.groupBy("n", "x1", "x2").agg(F.min("conv").alias("rep"), F.count(F.lit(1)).alias("w")), ["n", "x1", "x2"]).select("conv", "n", "rep", "w")


def id_hashes(members: DataFrame) -> DataFrame:
    """(rep, ends): SHA-256 of the ascending comma-joined ids of each class of members (rep, conv).

    Ids are joined in pieces over the cluster; a class's pieces then stream through one task, which holds one at a time.
    """
    pieces = placed(members.select("rep", "conv"), "rep", [F.col("conv")], "place")
    pieces = pieces.groupBy("rep", F.floor(F.col("place") / LISTED).alias("piece")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, out = None, None, []
        for batch in batches:
            for rep, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if rep != last:
                    if last is not None:
                        out.append((last, state.hexdigest()))
                    last, state = rep, sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pydict({"rep": pa.array([r for r, _ in out], pa.int64()), "ends": pa.array([e for _, e in out], pa.string())})
            out = []
        if last is not None:
            yield pa.RecordBatch.from_pydict({"rep": [last], "ends": [state.hexdigest()]})

    return pieces.repartition("rep").sortWithinPartitions("rep", "piece").select("rep", "ids").mapInArrow(work, "rep long, ends string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each distinct sequence of first turns (the root: none) of the turns (conv, place, sha, n_bytes) of convs (conv, n).

    conv (the smallest conversation that begins with it), depth, parent (the parent's conv; root: null), n_convs,
    n_children, n_leaves (childless nodes of its subtree, which includes itself), saved (over the subtree: conversations
    but one, times the bytes of the node's last text), ends_sha256 (of the ids of conversations that end there) and
    turn_sha (of the last turn; root: null). Conversations without turns are the root's. No conversations: no rows.
    """
    spark = turns.sparkSession
    folder = shared_folder(spark, "trie")
    members = written(classes(turns, convs), folder)
    reps = members.where("conv = rep").select("conv", "n", "w")
    whole = members.agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.min(F.when(F.col("n") == 0, F.col("rep"))).alias("ender"), F.max(F.when(F.col("n") == 0, F.col("w"))).alias("ended")).first()
    if not whole["n_convs"]:
        drop_folder(spark, folder)
        return spark.createDataFrame([], "conv long, depth long, parent long, n_convs long, n_children long, n_leaves long, saved long, ends_sha256 string, turn_sha binary")
    rows = turns.withColumn("chunk", F.floor(F.col("place") / CHUNK).cast("int")).join(chunked(reps), ["conv", "chunk"])
    rows = written(rows.sortWithinPartitions("place"), folder)  # a round's places lie together in the files

    group = T.StructType.fromDDL("node long, parent long, sha binary, n_convs long, alone boolean, n_max long, n_bytes long, ender long, ended long, w long")
    kept = lambda part, schema: spark.read.schema(T.StructType([*schema.fields, T.StructField("depth", T.LongType())])).parquet(f"{folder}/{part}")
    live, depth = None, 0
    while True:
        depth += 1
        at = rows.where(F.col("place") == depth - 1).select("conv", "n", "w", "sha", "n_bytes")
        at = at.withColumn("parent", F.lit(whole["conv"])) if live is None else at.join(live, "conv")
        ends = F.col("n") == depth
        groups = at.groupBy("parent", "sha").agg(
            F.min("conv").alias("node"), F.sum("w").alias("n_convs"), (F.count(F.lit(1)) == 1).alias("alone"), F.max("n").alias("n_max"), F.max("n_bytes").alias("n_bytes"),
            F.max(F.when(ends, F.col("conv"))).alias("ender"), F.max(F.when(ends, F.col("w"))).alias("ended"), F.max("w").alias("w"),
        )
        groups.select(*group.names).write.parquet(f"{folder}/nodes/depth={depth}")
        shared = spark.read.schema(group).parquet(f"{folder}/nodes/depth={depth}").where("NOT alone")
        live = written(at.where(~ends).join(shared.select("parent", "sha", "node"), ["parent", "sha"]).select("conv", F.col("node").alias("parent")), folder)
        if live.isEmpty():
            break
    nodes = kept("nodes", group)

    # Chains: what follows the nodes that one conversation, or equal ones, are alone in.
    tails = nodes.where("alone AND n_max > depth").select(F.col("node").alias("conv"), F.col("depth").alias("from"), F.col("n_max").alias("n"))
    chain = written(rows.drop("n").join(chunked(tails), ["conv", "chunk"]).where(F.col("place") >= F.col("from")), folder)
    many = chain.where("w > 1")
    sums = many.groupBy("conv", "chunk").agg(F.sum("n_bytes").alias("sum"))
    after = F.sum("sum").over(Window.partitionBy("conv").orderBy(F.desc("chunk"))) - F.col("sum")
    many = many.join(sums.select("conv", "chunk", after.alias("after")), ["conv", "chunk"])
    below = F.col("after") + F.sum("n_bytes").over(Window.partitionBy("conv", "chunk").orderBy(F.desc("place")))
    cols = ["conv", "place", "sha", "n", "w", "from"]
    chain = written(chain.where("w = 1").select(*cols, F.lit(0).cast("long").alias("saved")).unionByName(many.select(*cols, ((F.col("w") - 1) * below).alias("saved"))), folder)
    last = F.col("place") + 1 == F.col("n")
    one = F.lit(1).cast("long")
    chain_nodes = chain.select((F.col("place") + 1).alias("depth"), "conv", F.col("conv").alias("parent"), F.col("w").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"), "saved", F.when(last, F.col("conv")).alias("ender"), F.when(last, F.col("w")).alias("ended"), "sha")
    tops = chain.where((F.col("w") > 1) & (F.col("place") == F.col("from"))).select(F.col("conv").alias("node"), F.col("from").alias("depth"), F.col("saved").alias("chain_saved"))

    sums = None
    for d in range(depth, 0, -1):
        own = spark.read.schema(group).parquet(f"{folder}/nodes/depth={d}").join(tops.where(F.col("depth") == d).drop("depth"), "node", "left")
        own = own.join(sums, "node", "left") if sums is not None else own.withColumns({"children": F.lit(None).cast("long"), "leaves": F.lit(None).cast("long"), "below": F.lit(None).cast("long")})
        tail = F.col("alone") & (F.col("n_max") > d)
        saved = (F.col("n_convs") - 1) * F.col("n_bytes") + F.coalesce("below", F.lit(0)) + F.coalesce("chain_saved", F.lit(0))
        own = own.select(F.col("node").alias("conv"), "parent", "n_convs", F.when(tail, 1).otherwise(F.coalesce("children", F.lit(0))).cast("long").alias("n_children"), F.coalesce("leaves", one).alias("n_leaves"), saved.alias("saved"), "ender", "ended", "sha")
        own.write.parquet(f"{folder}/done/depth={d}")
        sums = spark.read.schema(own.schema).parquet(f"{folder}/done/depth={d}").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("below"))
    top = spark.createDataFrame([(whole["conv"], whole["n_convs"], whole["ender"], whole["ended"])], "node long, n_convs long, ender long, ended long").join(F.broadcast(sums), "node", "left")  # one row
    top = top.select(F.lit(0).cast("long").alias("depth"), F.col("node").alias("conv"), F.lit(None).cast("long").alias("parent"), "n_convs", F.coalesce("children", F.lit(0).cast("long")).alias("n_children"), F.coalesce("leaves", one).alias("n_leaves"), F.coalesce("below", F.lit(0).cast("long")).alias("saved"), "ender", "ended", F.lit(None).cast("binary").alias("sha"))
    names = chain_nodes.columns
    done = kept("done", own.schema).select(*names)
    found = done.unionByName(chain_nodes.select(*names)).unionByName(top.select(*names))
    ends = F.when(F.col("ender").isNull(), F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.sha2(F.col("ender").cast("string").cast("binary"), 256))
    several = F.coalesce("ended", F.lit(0)) > 1
    hashes = id_hashes(members.where("w > 1"))
    out = found.where(~several).withColumn("ends_sha256", ends).unionByName(found.where(several).join(hashes, F.col("ender") == F.col("rep")).withColumn("ends_sha256", F.col("ends")).select(*names, "ends_sha256"))
    out = settle(out.select("conv", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256", F.col("sha").alias("turn_sha")))
    drop_folder(spark, folder)
    return out
