"""Change streams over the index: coalescing, debouncing, the event feed and the log tail."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FEED_TYPES = ("page.changed", "page.saved", "index.started", "index.completed")
LOG_TAIL = 50


def last_operation(events: DataFrame) -> DataFrame:
    """(path, op, ts): the last operation of each path in (path, op, ts, seq); ``seq`` parts equal times."""
    last = F.struct("ts", "seq")
    return events.groupBy("path").agg(F.max_by("op", last).alias("op"), F.max("ts").alias("ts"))


def bursts(events: DataFrame, quiet: str = "500 milliseconds", watermark: str = "10 minutes") -> DataFrame:
    """Debounced flushes of a stream (path, ts): a session of changes ends when nothing comes for ``quiet``."""
    return events.withWatermark("ts", watermark).groupBy(F.session_window("ts", quiet).alias("burst")).agg(F.count("*").alias("changes"), F.approx_count_distinct("path").alias("paths"))


def read_changes(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """Stream of a change-log folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def apply_batches(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Hand each micro-batch, coalesced, to ``apply``; runs over what is there, and resumes after a failure."""
    return changes.writeStream.foreachBatch(lambda batch, n: apply(last_operation(batch), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_state(state: DataFrame, batch: DataFrame) -> DataFrame:
    """State (path, op, ts) after a coalesced batch: later operations win, unlinked paths go."""
    both = state.unionByName(batch.select(*state.columns))
    n = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("ts")))
    return both.withColumn("n", n).where("n = 1 and op <> 'unlink'").drop("n")


def feed(events: DataFrame) -> DataFrame:
    """Events of known types in order: (at, type, path)."""
    return events.where(F.col("type").isin(*FEED_TYPES)).select("at", "type", "path").orderBy("at", "path")


def log_tail(log: DataFrame, level: str | None = None, limit: int = LOG_TAIL) -> DataFrame:
    """The newest entries, of one level if asked."""
    rows = log if level is None else log.where(F.col("level") == level)
    return rows.orderBy(F.desc("at"), F.desc("seq")).limit(limit)
