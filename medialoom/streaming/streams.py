"""Streaming jobs.

Every sink writes under ``batch_id=N`` below its path and overwrites that folder when a batch is run again,
so a restarted or repeated batch never counts twice. Readers combine the batches.
"""

from __future__ import annotations

import os

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from medialoom.operators.ingest import daily_counts, job_counts, job_status, latest_rows
from medialoom.session import scratch_path
from medialoom.streaming.buckets import BucketTable  # noqa: F401
from medialoom.streaming.jobs import current_jobs, run_job_states  # noqa: F401


def file_stream(spark: SparkSession, folder: str, pattern: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """Parquet files of a folder as a stream."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def _write_batch(path: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(path, f"batch_id={batch_id}"))

    return write


def run_to_end(df: DataFrame, write_batch, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process everything available and stop."""
    query = (
        df.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write_batch)
        .start()
    )
    query.awaitTermination()
    return query


def closed_daily_counts(stream: DataFrame, time: str, delay: str = "1 day") -> DataFrame:
    """Events per day and type; a day is emitted once the watermark has passed it, later rows are dropped."""
    windows = stream.withWatermark(time, delay).groupBy(F.window(time, "1 day"), "event_type")
    return windows.agg(F.count(F.lit(1)).alias("n")).select(F.to_date("window.start").alias("day"), "event_type", "n")


def daily_stream(spark: SparkSession, stream: DataFrame, time: str) -> DataFrame:
    out = scratch_path(spark, "daily")
    run_to_end(closed_daily_counts(stream, time), _write_batch(out), scratch_path(spark, "daily-state"))
    return spark.read.parquet(out).drop("batch_id")


def dedupe_stream(spark: SparkSession, stream: DataFrame, time: str, keys: list[str], horizon: str) -> DataFrame:
    """First arrival of each key within the horizon; older keys leave the state."""
    fresh = stream.withWatermark(time, horizon).dropDuplicatesWithinWatermark(keys).select(*keys)
    out = scratch_path(spark, "dedupe")
    run_to_end(fresh, _write_batch(out), scratch_path(spark, "dedupe-state"))
    return spark.read.parquet(out).drop("batch_id")


def upsert_stream(spark: SparkSession, stream: DataFrame, key: list[str], order: list[str], created: str) -> DataFrame:
    """Current rows of a table fed by a stream of versions.

    Each batch is reduced to one row per key before it is written; the current state is the same reduction
    over the batches, so no batch rewrites the table.
    """
    out = scratch_path(spark, "upsert")

    def write(batch: DataFrame, batch_id: int) -> None:
        _write_batch(out)(latest_rows(batch, key, order, created), batch_id)

    run_to_end(stream, write, scratch_path(spark, "upsert-state"))
    stored = spark.read.parquet(out).drop("batch_id")
    merged = latest_rows(stored.drop("created_at"), key, order, created)
    oldest = stored.groupBy(*key).agg(F.min("created_at").alias("created_at"))
    return merged.drop("created_at").join(oldest, key)


def compact(spark: SparkSession, path: str, key: list[str], order: list[str], created: str) -> DataFrame:
    """Merged copy of an upsert table under a new path."""
    merged = latest_rows(spark.read.parquet(path).drop("batch_id", "created_at"), key, order, created)
    target = scratch_path(spark, "compact")
    merged.write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def job_stream(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """Counters and state per request: every batch adds its own counts, the reader sums them."""
    out = scratch_path(spark, "jobs")

    def write(batch: DataFrame, batch_id: int) -> None:
        _write_batch(out)(job_counts(batch), batch_id)

    run_to_end(stream.select("request_id", "outcome"), write, scratch_path(spark, "jobs-state"))
    counters = ["queued_count", "success_count", "failed_count", "skipped_count"]
    totals = spark.read.parquet(out).groupBy("request_id").agg(*[F.sum(c).alias(c) for c in counters])
    return totals.withColumn("status", job_status())


def log_stream(spark: SparkSession, stream: DataFrame, time: str, path: str, fallback: str, keep_days: int) -> DataFrame:
    """Request log appended by day; a batch that can't be written goes to the second place; old days are dropped.

    Readers see the days of both places within ``keep_days`` of the newest one. A batch that succeeds at the second try
    leaves nothing in the other place, so it isn't read twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("day", F.to_date(time)).persist()
        rows.count()  # an error of the batch itself is no reason to try another place
        name = f"batch_id={batch_id}"
        for place in (path, fallback):
            try:
                rows.write.mode("overwrite").partitionBy("day").parquet(os.path.join(place, name))
            except Exception:
                remove(spark, os.path.join(place, name))
                if place == fallback:
                    raise
            else:
                if place == path:
                    remove(spark, os.path.join(fallback, name))
                break
        rows.unpersist()

    run_to_end(stream, write, scratch_path(spark, "log-state"))
    return read_log(spark, [path, fallback], StructType([*stream.schema.fields]).add("day", "date"), keep_days)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder, if it can be reached."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    try:
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Py4JJavaError:
        pass


def read_log(spark: SparkSession, places: list[str], schema: StructType, keep_days: int) -> DataFrame:
    """The rows of all places that hold any, after days that are too old have been dropped everywhere."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    held = []
    for place in places:
        root = hadoop.Path(place)
        if root.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop.Path(root, "batch_id=*/day=*")):
            held.append(place)
    if not held:
        return spark.createDataFrame([], schema)
    logs = [spark.read.schema(StructType([*schema.fields]).add("batch_id", "long")).parquet(p) for p in held]
    newest = max(log.agg(F.max("day")).first()[0] for log in logs)
    out = None
    for place, log in zip(held, logs, strict=True):
        drop_old_days(spark, place, newest.toordinal() - keep_days)
        rows = log.filter(F.col("day") >= F.lit(newest) - F.expr(f"INTERVAL {keep_days} DAYS")).drop("batch_id")
        out = rows if out is None else out.unionByName(rows)
    return out


def drop_old_days(spark: SparkSession, path: str, oldest: int) -> int:
    """Remove the day folders of a log older than the ordinal day ``oldest``; returns how many."""
    from datetime import date

    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    dropped = 0
    for folder in fs.globStatus(hadoop.Path(root, "batch_id=*/day=*")) or []:
        day = folder.getPath().getName().split("=", 1)[1]
        if date.fromisoformat(day).toordinal() < oldest:
            dropped += bool(fs.delete(folder.getPath(), True))
    return dropped


def daily_batch(df: DataFrame, time: str) -> DataFrame:
    """The batch twin of ``daily_stream``."""
    return daily_counts(df, time)
