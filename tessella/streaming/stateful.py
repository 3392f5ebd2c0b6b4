"""Stateful streams: rate windows, idempotent events, dead letters and watermarked counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def rate_limited(events: DataFrame, limit: int = 30, window_s: float = 60.0) -> DataFrame:
    """event_id, user_id, allowed for a stream of (event_id, user_id, ts); the state of a user is its window's start and count."""

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, used = state.get if state.exists else (-(1 << 62), 0)
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        allowed = []
        for at in rows["at"]:
            if start < at - window_s * 1e6:
                start, used = int(at), 0
            ok = used + 1 <= limit
            used += int(ok)
            allowed.append(ok)
        state.update((start, used))
        yield pd.DataFrame({"event_id": rows["event_id"].to_numpy(), "user_id": key[0], "allowed": allowed})

    timed = events.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return timed.groupBy("user_id").applyInPandasWithState(decide, "event_id long, user_id long, allowed boolean", "start long, used long", "append", GroupStateTimeout.NoTimeout)


def idempotent(events: DataFrame, key: str = "event_id", time: str = "ts", keep: str = "30 days") -> DataFrame:
    """The first of events with equal keys; keys are forgotten after ``keep``."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, keep).dropDuplicatesWithinWatermark([key])


def dead_letters(failures: DataFrame, most: int = 2) -> DataFrame:
    """key, failures and status of each failing key as failures (key, and previous if there is such a column) stream in; from ``most`` on it is abandoned.

    previous: failures that whoever reports one knows of; each failure makes
    the larger of that and what is known here one more.
    """
    reported = F.coalesce("previous", F.lit(0)).cast("long") if "previous" in failures.columns else F.lit(0).cast("long")

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, rows, most_reported = state.get[0] if state.exists else 0, 0, 0
        for b in batches:
            rows, most_reported = rows + len(b), max(most_reported, int(b["previous"].max()))
        # In whatever order they come: all of them one by one, and one at least after the largest number reported.
        n = max(n + rows, most_reported + 1)
        state.update((n,))
        yield pd.DataFrame({"key": [key[0]], "failures": [n], "status": ["abandoned" if n >= most else "pending"]})

    return failures.select("key", reported.alias("previous")).groupBy("key").applyInPandasWithState(count, "key long, failures long, status string", "n long", "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of each type in tumbling windows; rows later than ``late`` are left out."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Write what a stream has now to Parquet files and stop."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
