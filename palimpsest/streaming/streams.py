"""The same operators on streams: idempotent delivery, windows and admission; `state` has context and the fold."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def once(messages: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each message key once within the watermark; `created_at` is the event time."""
    return messages.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["user_id", "message_key"])


def tumbling(events: DataFrame, key: str, size: str, delay: str, ts: str = "ts") -> DataFrame:
    """Counts and sums by window and key; late rows beyond `delay` are left out."""
    own = events.withWatermark(ts, delay).groupBy(F.window(ts, size), key).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return own.select(F.col("window.start").alias("window_start"), key, "n", "total")


def sessions(events: DataFrame, key: str, gap: str, delay: str, ts: str = "ts") -> DataFrame:
    own = events.withWatermark(ts, delay).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))
    return own.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), key, "n")


def admitted(requests: DataFrame, limit: int = 60, seconds: int = 60) -> DataFrame:
    """(user_id, ts, allowed, remaining): a request passes while fewer than `limit` admitted ones lie in the last `seconds`."""

    def admit(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        log = json.loads(state.get[0]) if state.exists else []
        rows = []
        for f in frames:
            for t in sorted(f.ts):
                micros = t.value // 1000
                log = [x for x in log if x > micros - seconds * 1_000_000]
                ok = len(log) < limit
                if ok:
                    log.append(micros)
                rows.append((key[0], t, ok, limit - len(log)))
        state.update((json.dumps(log),))
        yield pd.DataFrame(rows, columns=["user_id", "ts", "allowed", "remaining"])

    return requests.groupBy("user_id").applyInPandasWithState(admit, "user_id string, ts timestamp, allowed boolean, remaining long", "log string", "append", GroupStateTimeout.NoTimeout)
