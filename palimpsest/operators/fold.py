"""The memory's ordered fold: each user's candidates, one after another, against the user's items.

What a candidate does depends on the contents that earlier ones made, so a user's candidates are folded in one
group (sorted rows of a task that pass by, or keyed state in a stream); users spread over all tasks. `step` is the pure rule both share.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from palimpsest.functions.facts import content_topic
from palimpsest.functions.scoring import candidate_scores, gain_of, similarity_of
from palimpsest.sources.schemas import ITEM, names
from palimpsest.sources.tables import spread_by

Item = dict[str, Any]

#: Rows of a fold: an `item` of the final state, or an `action` in the order of the candidates with its item and correction.
ROW = f"kind string, seq long, action string, reason string, corrected_from string, corrected_to string, {ITEM}"
_NAMES = names(ROW)
_TIMES = ["valid_from", "valid_until", "created_at", "updated_at"]
_LISTS = ["source_message_ids", "contradicts_ids", "related_ids"]
_WORDS = re.compile(r"[a-z0-9]+")


def may_supersede(c: Item, x: Item) -> bool:
    if c["authority"] == "speculation" and (x["type"] == "decision" and x["confidence"] >= 0.85 or x["confidence"] >= c["confidence"]):
        return False
    return not (x["type"] == "decision" and c["type"] != "decision" and not c["is_correction"] and c["authority"] != "user")


def revoked(c: Item, active: list[Item]) -> list[Item]:
    value, target = c["revoked_value"].lower().strip(), set(_WORDS.findall(c["revoked_target"].lower()))
    words = lambda x: set(_WORDS.findall(x["content"].lower())) | set(_WORDS.findall((x["topic_key"] or "").lower()))
    return [x for x in active if value and value in x["content"].lower() or target & words(x)]


def corrected(c: Item, active: list[Item]) -> Item | None:
    old = (c["old_value"] or "").lower().strip()
    if not old:
        return None
    within = next((x for x in active if old in x["content"].lower()), None)
    if within is not None or not active:
        return within
    best = max(active, key=lambda x: similarity_of(old, x["content"]))
    return best if similarity_of(old, best["content"]) >= 0.75 else None


def step(items: list[Item], c: Item, new_id: int) -> tuple[str, str, Item | None, tuple[str, str] | None]:
    """Applies a candidate to a user's items in place: (action, reason, item written, what a correction changed from and to)."""
    active = [x for x in items if x["status"] == "active"]
    alike = [x for x in active if x["type"] == c["type"]]
    near = {x["id"]: similarity_of(c["content"], x["content"]) for x in alike}
    gain = gain_of(max(near.values(), default=None))
    now = c.get("as_of")
    told = {k: c[k] for k in ("content", "type", "topic_key", "subject", "predicate", "value", "scope", "confidence", "importance", "stability", "freshness")}

    def changed(x: Item, status: str) -> None:
        x["status"], x["changed_at"], x["updated_at"], x["version"] = status, c["seq"], now, x["version"] + 1

    def written(over: Item | None) -> Item:
        item = told | {
            "user_id": c["user_id"], "id": new_id, "information_gain": gain, "source_message_ids": list(c["source_message_ids"]), "status": "active", "changed_at": c["seq"],
            "supersedes_id": over["id"] if over else None, "version": over["version"] + 1 if over else 1, "relationship": "supersedes" if over else None,
            "contradicts_ids": [over["id"]] if over else [], "related_ids": [over["id"]] if over else [],
            "valid_from": c.get("valid_from") or now, "valid_until": c.get("valid_until"), "created_at": now, "updated_at": now,
        }
        if over:
            changed(over, "superseded")
        items.append(item)
        return item

    if c["revoked_target"] is not None:
        hit = revoked(c, active)
        for x in hit:
            changed(x, "revoked")
        return ("revoke", "revocation", None, None) if hit else ("skip", "no_revocation_target", None, None)
    if c["old_value"] is not None:
        x = corrected(c, active)
        if x is not None and may_supersede(c, x):
            return "supersede", "correction", written(x), (c["old_value"], c["new_value"])
    for x in alike:
        if near[x["id"]] >= 0.9:
            x["source_message_ids"] = list(dict.fromkeys([*x["source_message_ids"], *c["source_message_ids"]]))
            for k in ("confidence", "importance", "freshness"):
                x[k] = max(x[k], c[k])
            x["stability"] = min(1.0, max(x["stability"], c["stability"]) + 0.08)
            x["information_gain"] = gain
            x.update({k: c[k] for k in ("subject", "predicate", "value", "scope") if c[k]})
            changed(x, "active")
            return "merge", "near_duplicate", x, None
    for x in alike:
        if c["topic_key"] and (x["topic_key"] or "").strip() == c["topic_key"]:
            if not may_supersede(c, x):
                return "reject", "speculation_cannot_overwrite_decision", x, None
            change = (c["old_value"], c["new_value"]) if c["old_value"] is not None else (x["content"], c["content"]) if c["is_correction"] else None
            return "supersede", "topic_contradiction", written(x), change
    if gain < 0.15:
        return "skip", "low_information_gain", None, None
    return "create", "new_topic", written(None), None


def applied(user: str, rows: Iterator[Item], items: list[Item], following: int | None = None, apart: int | None = None) -> list[Item]:
    """Folds a user's candidates, in order, and lists the actions and the final items; new ids go on from the highest.

    `apart`: these are a part of the user's candidates; new ids are this and the candidate's place, and an information gain
    that other parts may lower is left open.
    """
    out = []
    following = following or max((x["id"] for x in items), default=0) + 1
    for c in rows:
        action, reason, item, change = step(items, c, following if apart is None else apart + c["seq"])
        new = action in ("create", "supersede")
        following += new
        if apart is not None and new and item["information_gain"] >= 0.8:
            item["information_gain"] = None
        known = {k: item[k] for k in ("id", "content", "type", "topic_key")} if item else {}
        out.append({"kind": "action", "seq": c["seq"], "action": action, "reason": reason, "user_id": user, "corrected_from": change and change[0], "corrected_to": change and change[1]} | known)
    return out + [{"kind": "item"} | x for x in items]


def run(user: str, rows: Iterator[Item], items: list[Item], following: int | None = None, apart: int | None = None) -> pd.DataFrame:
    """The rows of `applied` as a frame."""
    frame = pd.DataFrame([[r.get(n) for n in _NAMES] for r in applied(user, rows, items, following, apart)], columns=_NAMES, dtype=object)
    for t in _TIMES:
        frame[t] = pd.to_datetime(frame[t])
    return frame


def prepared(candidates: DataFrame, order: list[str], as_of: Column | None = None) -> DataFrame:
    """Routed candidates as the fold reads them: scores, flat correction and revocation, and `seq` by user in `order`.

    `as_of`: when they are applied, else their own `as_of`, if they have one; `valid_from` and `valid_until` are theirs.
    Candidates that have a `seq` (from `dependencies.numbered`) keep it.
    """
    if "seq" not in candidates.columns:
        candidates = spread_by(candidates, "user_id")
    time = lambda n: (F.col(n) if n in candidates.columns else F.lit(None)).cast("timestamp")
    s = candidate_scores(F.col("content"), F.col("type"), F.col("authority"), F.col("is_correction"))
    rows = candidates.withColumn("s", s).withColumn("topic_key", F.coalesce(F.nullif("topic_key", F.lit("")), content_topic(F.col("content"), F.col("type"))))
    return rows.select(
        "user_id", "seq" if "seq" in candidates.columns else F.row_number().over(Window.partitionBy("user_id").orderBy(*order)).cast("long").alias("seq"), "content", "type", "topic_key", "authority", "is_correction",
        "subject", "predicate", "value", "scope", "s.confidence", "s.importance", "s.stability", "s.freshness", F.array("message_key").alias("source_message_ids"),
        F.col("correction.old_value").alias("old_value"), F.col("correction.new_value").alias("new_value"), F.col("revocation.target").alias("revoked_target"),
        F.coalesce("revocation.value", F.lit("")).alias("revoked_value"), (time("as_of") if as_of is None else as_of.cast("timestamp")).alias("as_of"),
        time("valid_from").alias("valid_from"), time("valid_until").alias("valid_until"),
    )


def _plain(frame: pd.DataFrame) -> list[Item]:
    rows = frame.astype(object).where(frame.notna(), None).to_dict("records")
    for r in rows:
        for k in _LISTS:
            r[k] = list(r[k]) if r.get(k) is not None else []
        r["supersedes_id"] = int(r["supersedes_id"]) if r.get("supersedes_id") is not None else None
    return rows


#: Rows that a Python worker turns into candidates at once, and that it returns at once.
SLICE = 512


def grouped(ready: DataFrame, items: DataFrame | None, *by: str, apart: int | None = None) -> DataFrame:
    """Rows of ROW: `applied` to each group `by` (the user first) of `ready` and of `items`.

    Groups are dealt to all shuffle partitions and pass by in order, so a task holds one group and no frame is made for each.
    """
    own = lambda f: F.struct(*[F.col(c) for c in f.columns if c not in by[1:]])
    rows = ready.select(*by, F.lit(1).alias("side"), F.col("seq").alias("pos"), own(ready).alias("told"))
    if items is not None:
        have = items.select(*by, F.lit(0).alias("side"), F.col("id").alias("pos"), own(items).alias("known"))
        rows = rows.unionByName(have, allowMissingColumns=True)
    rows = spread_by(rows, *by).sortWithinPartitions(*by, "side", "pos")
    layout = to_arrow_schema(StructType.fromDDL(ROW))
    held = rows.columns.index("told")

    def batch(found: list[Item]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(x.name) for r in found], x.type) for x in layout], schema=layout)

    def pass_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, told, known, found = None, [], [], []
        for whole in batches:
            for b in (whole.slice(i, SLICE) for i in range(0, whole.num_rows, SLICE)):
                keys = list(zip(*(b.column(i).to_pylist() for i in range(len(by))), strict=True))
                sides = b.column(len(by)).to_pylist()
                both = [b.column(i).to_pylist() for i in range(held, b.num_columns)]
                for i, key in enumerate(keys):
                    if key != at:
                        if at is not None:
                            found += applied(at[0], iter(told), known, apart=apart)
                        at, told, known = key, [], []
                        while len(found) >= SLICE:
                            yield batch(found[:SLICE])
                            found = found[SLICE:]
                    if sides[i]:
                        told.append(both[0][i])
                    else:
                        known.append(both[1][i] | {k: both[1][i][k] or [] for k in _LISTS})
        if at is not None:
            found += applied(at[0], iter(told), known, apart=apart)
        for i in range(0, len(found), SLICE):
            yield batch(found[i : i + SLICE])

    return rows.mapInArrow(pass_by, ROW)


def fold(ready: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Rows of ROW for every user of `ready` (from `prepared`) and of `items` (ITEM), which the fold starts from."""
    if items is not None:
        items = items.select(*[F.col(n) if n in items.columns else F.lit(None).cast(k).alias(n) for n, k in (x.strip().split(" ", 1) for x in ITEM.split(", "))])
    return grouped(ready, items, "user_id")


def state(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'item'").select(*names(ITEM))


def actions(rows: DataFrame) -> DataFrame:
    return rows.where("kind = 'action'").select("user_id", "seq", "action", "reason", "id", "content", "type", "topic_key")


def corrections(rows: DataFrame) -> DataFrame:
    """The log: what each superseding correction changed."""
    return rows.where("kind = 'action' and action = 'supersede' and corrected_to is not null").select("user_id", "seq", F.col("topic_key").alias("target"), F.col("corrected_from").alias("old_value"), F.col("corrected_to").alias("new_value"), F.lit("active").alias("status"))
