"""Ledger streams: numbers that continue over micro-batches, counts by time window, several sinks for one stream."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet", files_at_once: int = 100) -> DataFrame:
    """New files of a folder as they come."""
    rows = spark.readStream.schema(EVENTS).option("pathGlobFilter", name).option("maxFilesPerTrigger", files_at_once).parquet(folder)
    return rows.select(F.col("event_id").alias("entry_id"), F.col("user_id").alias("execution_id"), "event_type", "ts", "value")


def numbered(entries: DataFrame) -> DataFrame:
    """entry_id, execution_id and sequence: an execution's entries numbered from 1 as they arrive, without gaps, also
    over restarts. What is kept for an execution is its last number."""

    def number(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else 0
        for part in parts:
            yield pd.DataFrame({"entry_id": part["entry_id"], "execution_id": key[0], "sequence": range(last + 1, last + 1 + len(part))})
            last += len(part)
        state.update((last,))

    columns = "entry_id long, execution_id long, sequence long"
    return entries.select("entry_id", "execution_id").groupBy("execution_id").applyInPandasWithState(number, columns, "last long", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(entries: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of each kind in a time window; entries later than late are dropped."""
    timed = entries.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    rows = timed.groupBy(F.window("at", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def to_files(rows: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs what is there now, exactly once for each row, into a Parquet table, and returns the table."""
    rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def fan_out(rows: DataFrame, sinks: Iterable[Callable[[DataFrame, int], None]], checkpoint: str) -> None:
    """Runs what is there now into every sink; each gets the same rows and the number of the batch, by which it can tell
    a repetition."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        for sink in sinks:
            sink(batch, number)
        batch.unpersist()

    rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
