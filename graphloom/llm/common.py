"""What several of the operators share."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lineage import drop_folder, settle, shared_folder
from ..functions.lineage import ranked as with_global_rank

__all__ = ["drop_folder", "settle", "shared_folder", "with_global_rank"]


def release(spark) -> None:
    """Lets go of what finished rounds hold: Spark deletes their shuffle files once the driver has no reference left."""
    gc.collect()
    spark._jvm.System.gc()


#: Characters of `[\x20\x09-\x0D]`, between words.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body) -> Column:
    """body(value), in which value is computed once, however often body names it (also inside lambdas)."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text, none for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return let(bare, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "[ \\t-\\r]+")))


def kept_columns(df: DataFrame, keep: list[str] | None, *added: str) -> list[Column]:
    """The columns to keep (all, unless listed), without those that an operator is about to add."""
    return [F.col(f"`{c}`") for c in (df.columns if keep is None else keep) if c not in added]


#: Rows and bytes of text that an operator gets at once, but for a larger text, which comes alone.
ROWS, BYTES = 512, 1 << 22


def small_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, whose last column is a text, cut so that none has more than ROWS rows or BYTES of text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy()
        start = total = 0
        for i, n in enumerate(sizes.tolist()):
            if i > start and (total + n > BYTES or i - start == ROWS):
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(sizes):
            yield batch.slice(start)


def map_texts(df: DataFrame, text: str, kept: list[Column], work, added: str) -> DataFrame:
    """mapInArrow over the kept columns and, last, the text, in small batches; the result has the kept and the added columns."""
    rows = df.select(*kept)
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL(added).fields])
    return df.select(*kept, F.col(f"`{text}`").cast("string").alias("_text_in")).mapInArrow(lambda batches: work(small_batches(batches)), schema)


def placed(df: DataFrame, key: str, order: list[Column], to: str = "_place") -> DataFrame:
    """df (narrow rows, no null key) with each row's place from 0 among the rows of its key, in the order.

    The rows are range-sorted by key and order, so a frequent key is dealt to many tasks; equal rows are told apart by
    where they were read. Of each partition only its first and last key and the last one's rows go to the driver.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(key), *order, F.col("_place_tie")]
    at = settle(df).withColumn("_place_tie", F.monotonically_increasing_id())
    at = at.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("_place_tie")
    at = settle(at.withColumn("_place_part", F.spark_partition_id()))
    kind = df.schema[key].dataType.simpleString()

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = first = last = None
        n = 0
        for batch in batches:
            if batch.num_rows:
                part, keys = batch.column(0)[0], batch.column(1)
                same = pc.sum(pc.equal(keys, keys[-1])).as_py()
                n = n + same if last is not None and last.equals(keys[-1]) else same
                first, last = first or keys[0], keys[-1]
        if last is not None:
            yield pa.RecordBatch.from_pylist([{"part": part.as_py(), "first": first.as_py(), "last": last.as_py(), "n": n}], pa.schema([("part", pa.int32()), ("first", first.type), ("last", last.type), ("n", pa.int64())]))

    starts, held, count = {}, None, 0
    for row in sorted(at.select("_place_part", key).mapInArrow(ends, f"part int, first {kind}, last {kind}, n long").collect()):
        starts[row["part"]] = count if row["first"] == held else 0
        count = count + row["n"] if row["last"] == held else row["n"]
        held = row["last"]
    col, own = at.columns.index(key), at.columns.index("_place_part")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(col)
            if last is None:
                last, n = keys[0], starts[batch.column(own)[0].as_py()]
            begins = np.concatenate(([0], np.flatnonzero(pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)).to_numpy(zero_copy_only=False)) + 1))
            sizes = np.diff(np.append(begins, len(keys)))
            place = np.arange(len(keys), dtype=np.int64) - np.repeat(begins, sizes)
            if keys[0].equals(last):
                place[: sizes[0]] += n
            last, n = keys[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], names=[*batch.schema.names, to])

    return at.mapInArrow(number, T.StructType([*at.schema.fields, T.StructField(to, T.LongType())])).drop("_place_part")
