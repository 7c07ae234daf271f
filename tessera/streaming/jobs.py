"""Structured Streaming forms of the incremental operators. Each result equals that of the batch operator on the same input.

State and progress live in the shared folder; a restarted query continues from there. Sinks written in
``foreachBatch`` publish whole versions, so a batch that is run again changes nothing.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.runtime import shared_dir
from tessera.sources.readers import VersionedTable


def file_stream(spark: SparkSession, folder: str, name: str, schema, files_per_trigger: int = 64) -> DataFrame:
    """Parquet files of a folder as a stream, by file-name pattern."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", name).parquet(folder)


def table_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of a data directory, one file or a folder of files, as a stream."""
    path = f"{sf_dir}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return file_stream(spark, path, "*.parquet", schema) if fs.getFileStatus(p).isDirectory() else file_stream(spark, sf_dir, f"{table}.parquet", schema)


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], mode: str = "append", checkpoint: str | None = None) -> None:
    """Process what is there now, then stop."""
    spark = stream.sparkSession
    at = checkpoint or f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.foreachBatch(each).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", at).start()
    q.awaitTermination()


def run_with_retries(start: Callable[[], None], attempts: int = 6, first: float = 0.1, most: float = 5.0) -> None:
    """Restart a failed query with doubling pauses."""
    pause = first
    for i in range(attempts):
        try:
            return start()
        except Exception:
            if i == attempts - 1:
                raise
            time.sleep(pause)
            pause = min(pause * 2, most)


def poll(once: Callable[[], bool], every: float, rounds: int | None = None) -> int:
    """Ask again and again, with pauses of ``every`` seconds, whether something changed (``once`` refreshes what did); returns how often it had."""
    n = changed = 0
    while rounds is None or n < rounds:
        if n:
            time.sleep(every)
        changed += bool(once())
        n += 1
    return changed


def collect_versions(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there; the last published version is the result."""
    spark = stream.sparkSession
    out = VersionedTable(spark, f"{shared_dir(spark)}/out-{uuid.uuid4().hex}")
    run_available(stream, lambda batch, _: out.publish(batch), mode)
    got = out.load()
    return got if got is not None else spark.createDataFrame([], stream.schema)


def windowed_counts(events: DataFrame, time_col: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, key, events): counts in event-time windows; rows later than the watermark no longer change a closed window."""
    w = events.withWatermark(time_col, late).groupBy(F.window(time_col, width), key).agg(F.count("*").alias("events"))
    return w.select(F.col("window.start").alias("start"), key, "events")


def windowed_sessions(events: DataFrame, time_col: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    w = events.withWatermark(time_col, late).groupBy(key, F.session_window(time_col, gap)).agg(F.count("*").alias("events"), F.max(time_col).alias("end"))
    return w.select(key, F.col("session_window.start").alias("start"), "end", "events")


def deduplicated(events: DataFrame, time_col: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """First row of each key; state of a key is dropped once the watermark has passed it."""
    return events.withWatermark(time_col, late).dropDuplicatesWithinWatermark(keys)


def upsert_stream(stream: DataFrame, root: str, keys: list[str], order: list[Column], checkpoint: str | None = None) -> VersionedTable:
    """Latest row of each key, kept as a versioned table that each batch is merged into."""
    out = VersionedTable(stream.sparkSession, root)
    run_available(stream, lambda batch, _: out.upsert(batch, keys, order), "append", checkpoint)
    return out


def refresh_changed(stream: DataFrame, root: str, key: str, text_col: str, build: Callable[[DataFrame], DataFrame], checkpoint: str | None = None, live: DataFrame | None = None) -> VersionedTable:
    """A derived table by key: of each batch only rows whose text hash differs from the stored one are built again. With ``live`` (key), the
    keys that still exist, stored rows of other keys go."""
    out = VersionedTable(stream.sparkSession, root)

    def merge(batch: DataFrame, _: int) -> None:
        rows = batch.withColumn("_hash", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
        old = out.load()
        if old is None:
            out.publish(build(rows))
            return
        changed = rows.join(old.select(key, "_hash").distinct(), [key, "_hash"], "left_anti")
        fresh = build(changed)
        kept = old.join(changed.select(key).distinct(), key, "left_anti").unionByName(fresh)
        out.publish(kept if live is None else kept.join(live.select(key).distinct(), key, "left_semi"))

    run_available(stream, merge, "append", checkpoint)
    return out
