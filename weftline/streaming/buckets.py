"""Size batches over an unbounded stream: a buffer a bucket, given out when full."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def size_batches(stream: DataFrame, size: int, idle_ms: int | None = None) -> DataFrame:
    """stream: (bucket string, sample_id long). Batches (bucket, batch, sample_ids) of ``size``; with
    ``idle_ms``, a bucket that has been idle gives what it holds. No sample is lost or given twice; the state of a bucket is below ``size`` ids.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, given = state.get if state.exists else ([], 0)
        held = list(held)
        out = []
        if state.hasTimedOut:
            if held:
                out.append((key[0], given, held))
            state.remove()
        else:
            for part in parts:
                held += part["sample_id"].tolist()
            while len(held) >= size:
                out.append((key[0], given, held[:size]))
                held, given = held[size:], given + 1
            state.update((held, given))
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["bucket", "batch", "sample_ids"])

    return stream.groupBy("bucket").applyInPandasWithState(step, "bucket string, batch long, sample_ids array<long>", "held array<long>, given long", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def tumbling(stream: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """events (ts without zone, event_type, value): counts and sums by window, late rows dropped after the watermark."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def deduplicated(stream: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
