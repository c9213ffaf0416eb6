"""Structured Streaming over event files: windowed counts, late data, month states, sliding means.

An extension: the batch operators above do not need it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(events: DataFrame, window: str = "1 day", slide: str | None = None, late: str = "2 days", ts: str = "ts", by: tuple = ("event_type",)) -> DataFrame:
    """Tumbling or sliding counts and sums with a watermark; the same expression works on a batch table."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    rows = rows.withWatermark(ts, late) if events.isStreaming else rows
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return rows.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "2 days", ts: str = "ts", by: str = "user_id") -> DataFrame:
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    rows = rows.withWatermark(ts, late) if events.isStreaming else rows
    return rows.groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


#: Allowed steps of a month's state; a finished month only ever becomes incomplete.
STEPS = {0: {2, 3, 5}, 2: {3}, 3: {1, 2, 4}, 4: {3}, 5: {3}, 1: {2}}


def month_states(changes: DataFrame) -> DataFrame:
    """Stream of (month, state) to accepted changes (month, state, accepted): one state per month is kept."""

    def step(key, batches: Iterator[pd.DataFrame], kept) -> Iterator[pd.DataFrame]:
        now = kept.get[0] if kept.exists else 0
        out = []
        for pdf in batches:
            for s in pdf["state"]:
                ok = int(s) in STEPS[now]
                now = int(s) if ok else now
                out.append((key[0], now, ok))
        kept.update((now,))
        yield pd.DataFrame(out, columns=["month", "state", "accepted"])

    return changes.groupBy("month").applyInPandasWithState(step, "month string, state int, accepted boolean", "state int", "append", "NoTimeout")


def write_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Start an exactly-once file sink that handles what is there and ends."""
    return df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
