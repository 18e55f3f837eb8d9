"""Keyed state of streams: short-term context that expires, and the memory's fold, with typed state.

Both use `transformWithStateInPandas`; the session's state store must be RocksDB's. State is a map for each user, so a
batch reads and writes the entries that it touches, not all that a user has. Times in state are microseconds.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from palimpsest.operators import fold
from palimpsest.sources.schemas import ITEM, names

#: The state store that maps and timers need.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ShortTerm(StatefulProcessor):
    """A user's context: key to value, when written, when over. An entry leaves the state when the watermark passes its end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getMapState("known", "key string", "value string, written long, over long")

    def _awake(self) -> None:
        """One timer, at the end of what ends first."""
        ends = [v[2] for v in self.known.values() if v[2] is not None] if self.known.exists() else []
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if ends:
            self.handle.registerTimer(-(-min(ends) // 1000))

    def _row(self, user: str, key: str, value: str | None, over: int | None) -> dict[str, Any]:
        return {"user_id": user, "key": key, "value": value, "over": over}

    def _frame(self, rows: list[dict[str, Any]]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["user_id", "key", "value", "over"], dtype=object)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        out: dict[str, dict[str, Any]] = {}
        for f in rows:
            for r in f.sort_values(["written", "value"]).astype(object).where(f.notna(), None).itertuples():
                written = int(r.written)
                if r.key is None:  # the user is cleared of what is not newer
                    for (k,), v in list(self.known.iterator()):
                        if v[1] <= written:
                            self.known.removeKey((k,))
                            out[k] = self._row(key[0], k, None, None)
                    continue
                old = self.known.getValue((r.key,)) if self.known.exists() else None
                if old is not None and old[1] > written:
                    continue
                over = None if r.over is None else int(r.over)
                if r.value is None or (over is not None and over <= now):
                    if old is not None:
                        self.known.removeKey((r.key,))
                        out[r.key] = self._row(key[0], r.key, None, None)
                else:
                    self.known.updateValue((r.key,), (r.value, written, over))
                    out[r.key] = self._row(key[0], r.key, r.value, over)
        self._awake()
        yield self._frame([out[k] for k in sorted(out)])

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        gone = [k for (k,), v in self.known.iterator() if v[2] is not None and v[2] <= now]
        for k in gone:
            self.known.removeKey((k,))
        self._awake()
        yield self._frame([self._row(key[0], k, None, None) for k in sorted(gone)])

    def close(self) -> None:
        pass


def context(entries: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Changes of each user's context after each batch: (user_id, key, value, expires_at), value null for what is over or deleted.

    `entries`: user_id, key, value, written_at, expires_at. The last write of a key wins; a null value deletes a key, a null key
    all of a user's. An entry that is over by the watermark of `written_at` leaves the state, and is told as gone.
    """
    own = entries.withWatermark("written_at", delay)
    own = own.select("user_id", "key", "value", "written_at", F.unix_micros("written_at").alias("written"), F.unix_micros("expires_at").alias("over"))
    done = own.groupBy("user_id").transformWithStateInPandas(ShortTerm(), "user_id string, key string, value string, over long", "Update", "EventTime")
    return done.select("user_id", "key", "value", F.timestamp_micros("over").alias("expires_at"))


_TIMES = fold._TIMES
#: An item in state: ITEM without its user and with times as microseconds.
HELD = ", ".join(f"{n} {'long' if n in _TIMES else k}" for n, k in (x.strip().split(" ", 1) for x in ITEM.split(", ")) if n not in ("user_id", "id", "type"))
_HELD = names(HELD)


class Folding(StatefulProcessor):
    """A user's active items by type and id, and the next id. A batch reads the types it has candidates of (all of them for a
    correction or revocation, which may name any) and writes the items it changes; what is over leaves the state.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getMapState("items", "type string, id long", HELD)
        self.following = handle.getValueState("following", "id long")

    def _loaded(self, user: str, types: set[str] | None) -> list[fold.Item]:
        out = []
        for kind, id in list(self.items.keys()) if self.items.exists() else []:
            if types is None or kind in types:
                x = dict(zip(_HELD, self.items.getValue((kind, id)), strict=True)) | {"type": kind, "id": id, "user_id": user}
                out.append(x | {t: None if x[t] is None else pd.Timestamp(x[t], unit="us") for t in _TIMES} | {k: list(x[k] or []) for k in fold._LISTS})
        return sorted(out, key=lambda x: x["id"])

    def _kept(self, x: fold.Item) -> tuple:
        plain = {**x, **{t: None if x[t] is None or pd.isna(x[t]) else pd.Timestamp(x[t]).value // 1000 for t in _TIMES}}
        one = lambda v: v if v is None or isinstance(v, (str, list, bool)) else float(v) if isinstance(v, float) else int(v)
        return tuple(one(plain.get(n)) for n in _HELD)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        told = [c for f in rows for c in fold._plain(f)]
        told.sort(key=lambda c: c["seq"])
        any_type = any(c["revoked_target"] is not None or c["old_value"] is not None for c in told)
        items = self._loaded(key[0], None if any_type else {c["type"] for c in told})
        had = {(x["type"], x["id"]): self._kept(x) for x in items}
        following = self.following.get()[0] if self.following.exists() else 1
        out = fold.run(key[0], iter(told), items, following)
        new = int(out[(out.kind == "action") & out.action.isin(["create", "supersede"])].shape[0])
        if new:
            self.following.update((following + new,))
        for x in items:
            at, now = (x["type"], x["id"]), self._kept(x)
            if x["status"] != "active":
                if at in had:
                    self.items.removeKey(at)
            elif had.get(at) != now:
                self.items.updateValue(at, now)
        yield out[out.kind == "action"][["user_id", "seq", "action", "reason", "id", "content"]]

    def close(self) -> None:
        pass


def folded(ready: DataFrame) -> DataFrame:
    """The fold over a stream of prepared candidates, in the order of their arrival, within a batch by `seq`: its actions."""
    kind = "user_id string, seq long, action string, reason string, id long, content string"
    return ready.groupBy("user_id").transformWithStateInPandas(Folding(), kind, "Append", "None")
