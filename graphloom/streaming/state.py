"""Streams: focus with time to live, bursts of changes, and a feed of graph changes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.lineage import drop_folder
from ..operators.change import immediate_focus, snapshot_diff
from ..sources.files import exists, scan

LOW, HIGH, USUAL = 1_000, 3_600_000, 60_000


def focus_state(events: DataFrame, clamp: bool = True) -> DataFrame:
    """A stream of (file, activity, timestamp, ttl) to (file, activity, timestamp, ttl, active).

    The last event to arrive counts. A row comes when a file is focused, and one with active = false when its time has
    run out by the clock; state goes then.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = lambda activity, at, ttl, on: pd.DataFrame({"file": [key[0]], "activity": [activity], "timestamp": [at], "ttl": [ttl], "active": [on]})
        if state.hasTimedOut:
            activity, at, ttl = state.get
            state.remove()
            yield out(activity, at, ttl, False)
            return
        last = None
        for batch in batches:
            if len(batch):
                last = batch.iloc[-1]
        if last is None:
            return
        ttl = USUAL if pd.isna(last["ttl"]) else int(last["ttl"]) or USUAL
        ttl = max(LOW, min(HIGH, ttl)) if clamp else ttl
        state.update((last["activity"], int(last["timestamp"]), ttl))
        state.setTimeoutDuration(max(1, ttl))
        yield out(last["activity"], int(last["timestamp"]), ttl, True)

    schema = "file string, activity string, timestamp long, ttl long, active boolean"
    return events.groupBy("file").applyInPandasWithState(step, schema, "activity string, timestamp long, ttl long", "update", GroupStateTimeout.ProcessingTimeTimeout)


def change_bursts(changes: DataFrame, key: str = "root", time: str = "ts", quiet: str = "100 milliseconds", late: str = "10 minutes") -> DataFrame:
    """A stream of (root, ts, file, op) to a row for each burst of a root: its files changed and deleted, once no change came for `quiet`."""
    burst = changes.withWatermark(time, late).groupBy(key, F.session_window(time, quiet).alias("w"))
    files = lambda op: F.array_sort(F.collect_set(F.when(F.col("op") == op, F.col("file"))))
    return burst.agg(files("change").alias("changed"), files("delete").alias("deleted")).select(key, "w.start", "w.end", "changed", "deleted")


def change_feed(stream: DataFrame, rebuild: Callable[[DataFrame], DataFrame], key: str, out: str, checkpoint: str, on_focus: Callable[[DataFrame], None] | None = None):
    """For each micro-batch: rebuild(batch) gives the snapshot after it; its difference from the last goes to a Parquet feed.

    A batch that runs again after a failure writes the same (epoch, key, op) rows into its own folder. Only the last two
    snapshots are kept; `latest` reads the newest. on_focus is called with the files of a batch (file, op) that are not
    deleted, before the snapshot is made and again after it.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        focus = immediate_focus(batch) if on_focus else None
        if on_focus:
            on_focus(focus)
        now = rebuild(batch)
        last = f"{out}/snapshot={epoch - 1}"
        before = spark.read.parquet(last) if exists(spark, f"{last}/_SUCCESS") else now.limit(0)
        now.write.mode("overwrite").parquet(f"{out}/snapshot={epoch}")
        now = spark.read.parquet(f"{out}/snapshot={epoch}")
        snapshot_diff(before, now, key).withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/feed/epoch={epoch}")
        if epoch >= 2 and exists(spark, f"{out}/snapshot={epoch - 2}"):
            drop_folder(spark, f"{out}/snapshot={epoch - 2}")
        if on_focus:
            on_focus(focus)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()


def latest(spark: SparkSession, out: str) -> tuple[DataFrame, int] | None:
    """The newest whole snapshot of a feed and its epoch: where one who joins late begins, to follow the feed from the next epoch on."""
    where = spark._jvm.org.apache.hadoop.fs.Path(out)
    names = [s.getPath().getName() for s in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)]
    whole = [int(n[9:]) for n in names if n.startswith("snapshot=") and exists(spark, f"{out}/{n}/_SUCCESS")]
    return (spark.read.parquet(f"{out}/snapshot={max(whole)}"), max(whole)) if whole else None


def poll_changes(spark: SparkSession, root: str, before: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source_file, op) since an earlier stat table, and the new one: deletions too, which a file stream can't see."""
    now = scan(spark, root).select("source_file", "size", "mtime")
    return snapshot_diff(before, now, "source_file"), now
