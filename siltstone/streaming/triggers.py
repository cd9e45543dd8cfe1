"""Index triggers as a stream: statuses, a bounded log of recent events, coalesced requests.

Statuses and the log are what a queue of triggers keeps; coalescing by watermark and the
micro-batch indexer are additions of this engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

RECENT = 100


def trigger_status(path: Column, group: Column, repository: Column, error: Column) -> Column:
    """A request for a path or group runs, and fails with its error; for a repository alone it waits; for nothing it is rejected."""
    some = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    runs = some(path) | some(group)
    return F.when(runs & some(error), "Failed").when(runs, "Completed").when(some(repository), "Queued").otherwise("Rejected")


def recent(events: DataFrame, keep: int = RECENT, time: str = "ts", tie: str = "event_id") -> DataFrame:
    """The last events in order, newest first; the limit is what the log is."""
    best = events.orderBy(F.col(time).desc(), F.col(tie).desc()).limit(keep)
    return best.withColumn("position", F.row_number().over(Window.orderBy(F.col(time).desc(), F.col(tie).desc())))


def merged_log(log: DataFrame, new: DataFrame, keep: int = RECENT) -> DataFrame:
    """The log after more events; an event that came twice counts once."""
    return recent(log.unionByName(new.select(*log.columns)).dropDuplicates(["event_id"]), keep).drop("position")


def file_stream(spark: SparkSession, folder: str, schema: Ty.StructType | str, files_per_batch: int = 16) -> DataFrame:
    """Requests that arrive as Parquet files in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def coalesced(requests: DataFrame, delay: str = "10 minutes", time: str = "ts", key: str = "repository_url") -> DataFrame:
    """One request for each key within the watermark; later ones of the same key are dropped."""
    return requests.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes", time: str = "ts") -> DataFrame:
    """Events by type and window, with late data up to ``delay``; the same on a table or a stream."""
    stream = events.withWatermark(time, delay) if events.isStreaming else events
    return stream.groupBy(F.window(time, width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def run_stream(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Hand each micro-batch to ``handle`` with its number, which makes repeated batches harmless to it."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    query = (writer.trigger(availableNow=True) if once else writer).start()
    if once:
        query.awaitTermination()
    return query


def status_sink(folder: str) -> Callable[[DataFrame, int], None]:
    """A handler that writes each batch's statuses under its number, so that a repeated batch replaces itself."""

    def handle(batch: DataFrame, number: int) -> None:
        status = trigger_status(F.col("workspace_path"), F.col("workspace_group"), F.col("repository_url"), F.col("error"))
        batch.withColumn("status", status).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return handle
