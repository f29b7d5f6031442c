"""Structured Streaming over the event log: distinct feedback, counts by window, sessions, and per-user state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def source(spark: SparkSession, path: str, schema: StructType, per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, oldest files first; ts becomes a timestamp with the session's zone."""
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
    return files.withColumn("ts", F.col("ts").cast("timestamp"))


def distinct(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event_id once, as long as its copies come within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def counts(events: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) by tumbling or sliding window; events later than the watermark are dropped."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n) of runs of events with no pause over the gap."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def boxes(events: DataFrame) -> DataFrame:
    """Learning boxes as state per user: a purchase moves one box up (5 at most), an error back to 0. Emits (user_id, box, seen)
    after each micro-batch."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        box, seen = state.get if state.exists else (0, 0)
        for f in frames:
            for kind in f.sort_values(["ts", "event_id"])["event_type"]:
                seen += 1
                box = min(5, box + 1) if kind == "purchase" else 0 if kind == "error" else box
        state.update((box, seen))
        yield pd.DataFrame({"user_id": [key[0]], "box": [box], "seen": [seen]})

    schema = "user_id long, box int, seen long"
    return events.groupBy("user_id").applyInPandasWithState(step, schema, "box int, seen long", "update", GroupStateTimeout.NoTimeout)


def drain(df: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what there is now and gives its result as a table."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def written(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs an aggregated stream over what there is now; each micro-batch replaces the result table at path, so that a batch that
    is run again leaves the same."""
    schema, spark = df.schema, df.sparkSession

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    q = df.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(path)
