"""Watcher events as a stream: bursts, suppression of repeats, and late data that never overwrites newer rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def debounced(events: DataFrame, key: str = "path", time: str = "ts", gap: str = "2 seconds", late: str = "10 minutes") -> DataFrame:
    """One row per burst of a key: events less than ``gap`` apart; works on streams and on tables."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    out = rows.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.max_by("event_type", time).alias("last_type"), F.count(F.lit(1)).alias("events"))
    return out.select(key, F.col("w.start").alias("first_at"), F.col("w.end").alias("closed_at"), "last_type", "events")


def suppressed(events: DataFrame, keys: list[str], time: str = "ts", within: str = "10 seconds") -> DataFrame:
    """Events of a stream without those that repeat a key within the time after one that was let through."""
    return events.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)


def newest(rows: DataFrame, key: str, time: str) -> DataFrame:
    """The row of each key with the largest time: an older parse never overwrites a newer one. Of equal times the larger hash of the row stays, at every run."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(time), F.desc(F.xxhash64(*rows.columns))))
    return rows.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def apply_changes(stream: DataFrame, target: str, key: str, time: str, checkpoint: str, after: Callable[[DataFrame, int], None] | None = None):
    """Start a query that merges each batch of changed rows into the Parquet folders below ``target``.

    Each batch writes a new version folder, so a batch that is run again after a failure gives the same rows; versions that no batch can
    need again are removed. ``after`` gets the changed rows.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        changed = newest(batch, key, time)
        older = f"{target}/v={number - 1}"
        rows = newest(spark.read.parquet(older).unionByName(changed), key, time) if number else changed
        rows.write.mode("overwrite").parquet(f"{target}/v={number}")
        if number >= 2:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/v={number - 2}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
        if after:
            after(changed, number)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
