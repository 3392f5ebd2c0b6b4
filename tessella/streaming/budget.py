"""Message windows of users and one token budget of all, over a stream of requests.

Each user has a window of messages; requests that pass it draw on a budget of
tokens, whose windows are kept in ten shards by a hash of the user: a shard's
window starts anew when it is too old, and a request passes if the tokens of
all windows that are not too old and its own are within the limit.

Requests are decided in the order of their times within a batch of the
stream, and batches in turn.  State is two levels: a row for each user, which
a timer removes when its window has passed, and a row of the shards.  The
budget is one number that every request may change, so its decisions are a
sequence under one key; what gets there is four numbers for each request that
its user's window has let through, in batches as large as the trigger makes
them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Messages a minute of users and of administrators, tokens a minute of all, shards, milliseconds of a window.
USER_LIMIT, ADMIN_LIMIT, TOKEN_LIMIT, SHARDS, WINDOW_MS = 30, 100, 200_000, 10, 60_000
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
REQUEST = "event_id long, user_id string, ts timestamp, at long, tokens long, counted boolean, admin boolean"


def shard_of(user: Column, shards: int = SHARDS) -> Column:
    """The sum of a user's UTF-16 code units modulo the shards, as far as they are in the basic plane."""
    return F.aggregate(F.transform(F.filter(F.split(user, ""), lambda c: c != ""), lambda c: F.ascii(c)), F.lit(0), lambda s, v: s + v) % shards


def _ordered(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    parts = list(batches)
    rows = parts[0] if len(parts) == 1 else pd.concat(parts)
    return rows.take(np.lexsort((rows["event_id"].to_numpy(), rows["at"].to_numpy()))) if len(rows) > 1 else rows


class UserWindows(StatefulProcessor):
    """A user's window: its start and messages.  The timer at its end removes it."""

    def __init__(self, user_limit: int, admin_limit: int, window_ms: int):
        self.limits, self.window_ms = (user_limit, admin_limit), window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "start long, used long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        own = _ordered(rows)
        start, used = self.window.get() if self.window.exists() else (None, 0)
        before, passed = start, []
        for at, counted, admin in zip(own["at"].tolist(), own["counted"].tolist(), own["admin"].tolist(), strict=True):
            if not counted:
                passed.append(True)
                continue
            limit = self.limits[bool(admin)]
            if start is None or start < at - self.window_ms:
                ok = limit >= 1
                if ok:
                    start, used = at, 1
            else:
                ok = used + 1 <= limit
                used += ok
            passed.append(ok)
        if start is not None:
            self.window.update((start, used))
            if start != before:
                if before is not None:
                    self.handle.deleteTimer(before + self.window_ms + 1)
                self.handle.registerTimer(start + self.window_ms + 1)
        yield pd.DataFrame({"event_id": own["event_id"].array, "user_id": key[0], "ts": own["ts"].array, "at": own["at"].array, "tokens": own["tokens"].array, "user_ok": passed})

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        self.window.clear()
        yield from ()

    def close(self) -> None:
        pass


class TokenBudget(StatefulProcessor):
    """The windows of all shards: their starts and tokens."""

    def __init__(self, limit: int, shards: int, window_ms: int):
        self.limit, self.shards, self.window_ms = limit, shards, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.windows = handle.getValueState("windows", "starts array<long>, counts array<long>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        own = _ordered(rows)
        if self.windows.exists():
            starts, counts = (list(x) for x in self.windows.get())
        else:
            starts, counts = [-(1 << 62)] * self.shards, [0] * self.shards
        passed = np.zeros(len(own), bool)
        asked = np.flatnonzero(own["user_ok"].to_numpy(bool))  # what its user's window has held back changes nothing
        some = own.take(asked)
        # Times only grow within a batch, so the windows that count change when one starts or the oldest of them passes.
        used, oldest = 0, None
        for place, at, shard, tokens in zip(asked.tolist(), some["at"].tolist(), some["shard"].tolist(), some["tokens"].tolist(), strict=True):
            since = at - self.window_ms
            if oldest is None or oldest < since:
                live = [k for k in range(self.shards) if starts[k] >= since]
                used, oldest = sum(counts[k] for k in live), min((starts[k] for k in live), default=at)
            if used + tokens <= self.limit:
                if starts[shard] >= since:
                    counts[shard] += tokens
                else:
                    starts[shard], counts[shard] = at, tokens
                used += tokens
                passed[place] = True
        self.windows.update((starts, counts))
        yield own.assign(allowed=passed)[["event_id", "user_id", "user_ok", "allowed"]]

    def close(self) -> None:
        pass


def budgeted(requests: DataFrame, user_limit: int = USER_LIMIT, admin_limit: int = ADMIN_LIMIT, token_limit: int = TOKEN_LIMIT, shards: int = SHARDS, window_ms: int = WINDOW_MS, late: str = "0 seconds") -> DataFrame:
    """event_id, user_id, user_ok and allowed of a stream of requests (event_id, user_id, ts, tokens, counted, admin).

    counted: whether it counts as a message of its user (answers do not).
    Rows that come ``late`` behind the newest of earlier batches are left out.
    The session's state store must be that of ``STORE``.
    """
    spark = requests.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != STORE:
        raise ValueError(f"spark.sql.streaming.stateStore.providerClass must be {STORE}")
    timed = requests.select("event_id", F.col("user_id").cast("string").alias("user_id"), F.col("ts").cast("timestamp").alias("ts"), "tokens", "counted", "admin")
    timed = timed.withColumn("at", F.unix_millis("ts")).withWatermark("ts", late)
    users = UserWindows(user_limit, admin_limit, window_ms)
    decided = timed.groupBy("user_id").transformWithStateInPandas(users, "event_id long, user_id string, ts timestamp, at long, tokens long, user_ok boolean", "Append", "EventTime", eventTimeColumnName="ts")
    one = decided.withColumn("shard", shard_of(F.col("user_id"), shards)).withColumn("budget", F.lit(0))
    return one.groupBy("budget").transformWithStateInPandas(TokenBudget(token_limit, shards, window_ms), "event_id long, user_id string, user_ok boolean, allowed boolean", "Append", "None")
