"""Streams whose state ends by itself: sessions that expire, and a response cache with a time to live and a bounded size.

Spark keeps the state by key (value and map state, event-time timers) between the batches of a stream and over restarts.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# What an action makes of a session, and how long one lasts.
STATUS = {"started": "awaiting_user_login", "verifying": "verifying", "verified": "active", "activated": "active", "login_required": "awaiting_user_login", "error": "error", "revoked": "revoked"}
LASTS = timedelta(hours=8)


def use_keyed_state(spark: SparkSession) -> None:
    """The state store that timers and map state need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _millis(t) -> int:
    return int(pd.Timestamp(t).tz_localize("UTC").timestamp() * 1000)


class Sessions(StatefulProcessor):
    """Status and time of verification; an active session has a timer for its end, and a revoked one stays revoked."""

    def __init__(self, key: str):
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("session", "status string, verified long")

    def _row(self, key, status: str, at) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]], "status": [status], "at": [at]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, verified = self.state.get() if self.state.exists() else ("disconnected", None)
        last = None
        for r in pd.concat(list(rows)).sort_values(["at", "event_id"]).itertuples():
            last = r.at
            if status == "revoked":
                continue
            status = STATUS.get(r.action, "disconnected")
            if r.action in ("verified", "activated"):
                if verified is not None:
                    self.handle.deleteTimer(verified + _ms(LASTS))
                verified = _millis(r.at)
                self.handle.registerTimer(verified + _ms(LASTS))
        self.state.update((status, verified))
        yield self._row(key, status, last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, verified = self.state.get()
        end = expiredTimerInfo.getExpiryTimeInMs()
        if status == "active" and verified is not None and verified + _ms(LASTS) <= end:
            self.state.update(("expired", verified))
            yield self._row(key, "expired", datetime.fromtimestamp(end / 1000, timezone.utc).replace(tzinfo=None))

    def close(self) -> None:
        pass


def _ms(t: timedelta) -> int:
    return int(t.total_seconds() * 1000)


def session_stream(log: DataFrame, key: str = "session_id", late: str = "0 seconds") -> DataFrame:
    """(key, status, at) of each session that a batch of ``log`` (key, event_id, action, at) changes, and ``expired`` for active
    ones once the watermark has passed their end."""
    d = log.withWatermark("at", late)
    return d.groupBy(key).transformWithStateInPandas(Sessions(key), f"`{key}` {dict(log.dtypes)[key]}, status string, at timestamp", "Update", "EventTime")


class Responses(StatefulProcessor):
    """Map state: for each call the time of its answer and the number of its last use."""

    def __init__(self, key: str, ttl: float, entries: int):
        self.key, self.ttl, self.entries = key, ttl, entries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.calls = handle.getMapState("calls", "call string", "answered double, used long")
        self.clock = handle.getValueState("clock", "used long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        used = self.clock.get()[0] if self.clock.exists() else 0
        before = {k[0]: tuple(v) for k, v in self.calls.iterator()}
        held = OrderedDict((k, before[k]) for k in sorted(before, key=lambda k: before[k][1]))
        ids, hits = [], []
        for r in pd.concat(list(rows)).sort_values(["at", "event_id"]).itertuples():
            used += 1
            hit = r.call in held and self.ttl > 0 and r.at - held[r.call][0] <= self.ttl
            held[r.call] = (held[r.call][0] if hit else r.at, used)
            held.move_to_end(r.call)
            while len(held) > self.entries:
                held.popitem(last=False)
            ids.append(r.event_id)
            hits.append(hit)
        for k in before.keys() - held.keys():
            self.calls.removeKey((k,))
        for k, v in held.items():
            if before.get(k) != v:
                self.calls.updateValue((k,), v)
        self.clock.update((used,))
        yield pd.DataFrame({self.key: [key[0]] * len(ids), "event_id": ids, "cached": hits})

    def close(self) -> None:
        pass


def response_stream(calls: DataFrame, scope: str, ttl: float, entries: int) -> DataFrame:
    """(scope, event_id, cached) for each of ``calls`` (scope, event_id, call, at in seconds): whether the same call of its scope was
    answered at most ``ttl`` seconds before and is still held. A scope holds ``entries`` answers, and the one longest unused goes
    first; a miss stores its answer. State is at most ``entries`` rows a scope; rows are ordered by time inside a batch."""
    d = calls.select(scope, "event_id", F.col("call").cast("string").alias("call"), F.col("at").cast("double").alias("at"))
    return d.groupBy(scope).transformWithStateInPandas(Responses(scope, ttl, entries), f"`{scope}` {dict(calls.dtypes)[scope]}, event_id long, cached boolean", "Append", "None")
