"""Repair of conversations' turn structure: the cheapest edits that make the roles read `(s?(ua)+)?`.

A conversation's rows, in the order of their turns, become a signature: one letter a row, of its role's initial and its
first fault. Signatures are many times fewer than conversations. The distinct ones are dealt by ranges and walked in
sorted order, which is the depth-first walk of their prefix trie: a node's layer of the dynamic programme (the least cost
of each state of the wanted pattern) is computed once for all signatures that share the prefix, and only the layers of the
present path are held. At a terminal node the layers are followed back for the edits on some cheapest way, and forward
for the ASCII-least of these.

Texts take no part in that. They are shuffled once, to be hashed in the order of the audit: the conversation's rows
follow its audit in a sorted partition and are read as a stream. A digest is sequential by nature, so one conversation's
texts pass through one task, but never stand in it together: a batch of rows at a time, and a byte a row for
signature and audit.

Defined results: nulls are one space, also in the key that is damaged; null ids are a conversation of their own. Rows of
one turn are ordered by role, then by the SHA-256 of their text; rows alike are counted and are duplicates of the first.
A role of no initial s, u or a can't be kept. A conversation of which no row is left has zeros, an empty audit and
the digest of nothing. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from palimpsest.llm.base import cut, table

#: What surrounds words, as in the contracts.
SPACES = " \t\n\x0b\x0c\r"
ROLES = "sua"
OK, TRUNCATED, DUPLICATE, BLANK = range(4)

KEEP, INSERT, REROLE, DELETE, LEFT_TRUNCATED = 0, 2, 2, 3, 1
FAR = 1 << 60

# states of the pattern: nothing yet, after s, after u, after a
STATES, ACCEPTS = 4, (0, 3)
#: The state that a row of role s, u, a or any other leads to (-1: none), by state.
KEPT = ((1, 2, -1, -1), (-1, 2, -1, -1), (-1, -1, 3, -1), (-1, 2, -1, -1))
#: The state after a row that is inserted or given another role: u goes on from everywhere but after u.
MADE = (2, 2, 3, 2)


def letter(role: int, fault: int) -> str:
    return chr(65 + 4 * fault + role)


def closed(f: list[int]) -> list[int]:
    """Costs of the states with what inserted rows reach."""
    f[2] = min(f[2], f[0] + INSERT, f[1] + INSERT, f[3] + INSERT)
    f[3] = min(f[3], f[2] + INSERT)
    return f


def layer(f: list[int], code: int) -> list[int]:
    """The costs after one more row from those before it."""
    fault, role = divmod(code, 4)
    out = [x + DELETE for x in f]
    if fault < DUPLICATE:
        extra = LEFT_TRUNCATED if fault == TRUNCATED else 0
        for q in range(STATES):
            to = KEPT[q][role]
            if to >= 0:
                out[to] = min(out[to], f[q] + KEEP + extra)
            out[MADE[q]] = min(out[MADE[q]], f[q] + REROLE + extra)
    return closed(out)


def moves(q: int, code: int) -> Iterator[tuple[str, int, int, bool]]:
    """(initial, next state, cost, whether it takes the row) from a state before a row, in the ASCII order of initials."""
    fault, role = divmod(code, 4)
    yield "D", q, DELETE, True
    yield "I", MADE[q], INSERT, False
    if fault < DUPLICATE:
        extra = LEFT_TRUNCATED if fault == TRUNCATED else 0
        if KEPT[q][role] >= 0:
            yield "K", KEPT[q][role], KEEP + extra, True
        yield "R", MADE[q], REROLE + extra, True


def _inserts(own: int, f: array | list, at: int) -> int:
    """States of one layer, as bits, from which inserted rows lead at least cost into those of `own`."""
    for _ in range(STATES):
        for q in range(STATES):
            if own >> MADE[q] & 1 and f[at + q] + INSERT == f[at + MADE[q]]:
                own |= 1 << q
    return own


def audit(codes: bytes, layers: array) -> tuple[int, str]:
    """Cost and ASCII-least edits of a path, from its layers (4 costs each)."""
    n = len(codes)
    best = min(layers[4 * n + q] for q in ACCEPTS)
    live = bytearray(n + 1)  # the states that lie on a cheapest way, as bits
    live[n] = _inserts(sum(1 << q for q in ACCEPTS if layers[4 * n + q] == best), layers, 4 * n)
    for i in range(n - 1, -1, -1):
        own = 0
        for q in range(STATES):
            for _, to, cost, takes in moves(q, codes[i]):
                if takes and live[i + 1] >> to & 1 and layers[4 * i + q] + cost == layers[4 * i + 4 + to]:
                    own |= 1 << q
        live[i] = _inserts(own, layers, 4 * i)
    out, q, i, spent = [], 0, 0, 0
    while i < n:
        for initial, to, cost, takes in moves(q, codes[i]):
            at = i + takes
            if live[at] >> to & 1 and spent + cost == layers[4 * at + to]:
                out.append(initial)
                q, i, spent = to, at, spent + cost
                break
        else:
            raise AssertionError("a marked state has a cheapest way on")
    while spent < best:
        out.append("I")
        q, spent = MADE[q], spent + INSERT
    return best, "".join(out)


def walk(signatures: Iterator[str]) -> Iterator[tuple[int, str]]:
    """(cost, audit) of each signature of a sorted stream; what two neighbours share is computed once."""
    held = b""
    layers = array("q", closed([0, FAR, FAR, FAR]))
    for s in signatures:
        codes = bytes(x - 65 for x in s.encode("ascii"))
        shared = min(len(held), len(codes))
        if held[:shared] != codes[:shared]:
            shared = int(np.flatnonzero(np.frombuffer(held, np.uint8, shared) != np.frombuffer(codes, np.uint8, shared))[0])
        del layers[4 * (shared + 1) :]
        f = list(layers[-4:])
        for code in codes[shared:]:
            f = layer(f, code)
            layers.extend(f)
        held = codes
        yield audit(codes, layers)


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped): rows after damage; a dropped row stays as a mark of its conversation."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    which = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    own = rows.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), which.alias("__which"))
    text = F.when(F.col("__which") == 1, "").when(F.col("__which") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("__which") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("__which") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    out = own.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("__which") == 0).alias("dropped"), times.alias("__n"))
    return out.drop("__n")


def marked(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, n, code): rows of (conv_id, turn, role, text, dropped) without their texts, those alike as one with
    their number `n` and the code of the first of them; the code of the others is that of a duplicate.
    """
    said = F.rtrim(F.col("text"), F.lit(SPACES))
    fault = F.when(said == "", BLANK).when(~F.right(said, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(OK)
    role = F.coalesce(F.nullif(F.instr(F.lit(ROLES), F.substring("role", 1, 1)), F.lit(0)), F.lit(4)) - 1
    role = F.when(F.col("role") == "", 3).otherwise(role)
    own = rows.select("conv_id", "turn", "role", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), fault.alias("fault"), role.alias("initial"), "dropped")
    alike = own.groupBy("conv_id", "turn", "role", "digest", "fault", "initial", "dropped").agg(F.count("*").alias("n"))
    # where a role and text stand first; nulls are less than any turn, as the order wants it
    first = alike.where("not dropped").groupBy(F.col("conv_id").alias("__c"), F.col("role").alias("__r"), F.col("digest").alias("__d")).agg(F.min(F.struct("turn")).alias("__first"))
    met = alike.join(first, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("role") == F.col("__r")) & (F.col("digest") == F.col("__d")), "left")
    again = (F.col("fault") != BLANK) & ~F.struct("turn").eqNullSafe(F.col("__first"))
    code = 4 * F.when(again, DUPLICATE).otherwise(F.col("fault")) + F.col("initial")
    return met.select("conv_id", "turn", "role", "digest", "n", F.when(F.col("dropped"), -1).otherwise(code).cast("int").alias("code"))


def _sorted(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def _batches(columns: list[list], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _streamed(rows: DataFrame, schema: str, key: str, begin: Callable[[], dict], add: Callable[[dict, tuple], None], end: Callable[[int | None, dict], tuple]) -> DataFrame:
    """A row of `schema` for each run of equal `key` in a partition: `add(state, row)` over its rows, a batch at a time."""
    arrow = to_arrow_schema(T._parse_datatype_string(schema))
    at = rows.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done = []
            # a slice at a time, so that few texts are Python strings together
            for piece in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                for row in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                    if state is None or row[at] != now:
                        if state is not None:
                            done.append(end(now, state))
                        now, state = row[at], begin()
                    add(state, row)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), arrow, strict=True)], schema=arrow)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(end(now, state), arrow, strict=True)], schema=arrow)

    return rows.mapInArrow(run, schema)


def signatures(marks: DataFrame) -> DataFrame:
    """(conv_id, signature, gaps) of every conversation of `marked` rows."""

    def begin() -> dict:
        return {"letters": bytearray(), "low": None, "turn": None, "turns": 0}

    def add(s: dict, row: tuple) -> None:
        _, turn, n, code = row
        if code < 0:
            return
        s["letters"].append(65 + code)
        again = code if code // 4 == BLANK else 4 * DUPLICATE + code % 4
        s["letters"] += bytes([65 + again]) * (n - 1)
        if turn is not None and turn != s["turn"]:
            s["low"] = turn if s["low"] is None else s["low"]
            s["turn"], s["turns"] = turn, s["turns"] + 1

    def end(conv: int | None, s: dict) -> tuple:
        return conv, s["letters"].decode("ascii"), s["turn"] - s["low"] + 1 - s["turns"] if s["turns"] else 0

    rows = _sorted(marks, "turn", "role", "digest").select("conv_id", "turn", "n", "code")
    return _streamed(rows, "conv_id long, signature string, gaps long", "conv_id", begin, add, end)


def answered(distinct: DataFrame) -> DataFrame:
    """(signature, blank, duplicate, truncated, illegal, cost, audit) of distinct signatures."""
    names = ["signature", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    kinds = [pa.string(), *[pa.int64()] * 5, pa.string()]

    def counts(s: str) -> tuple[int, int, int, int]:
        codes = np.frombuffer(s.encode("ascii"), np.uint8) - 65
        of = np.bincount(codes >> 2, minlength=4)
        pair = (codes[:-1] & 3) * 4 + (codes[1:] & 3)
        return int(of[BLANK]), int(of[DUPLICATE]), int(of[TRUNCATED]), int((~np.isin(pair, (1, 6, 9))).sum())  # all but su, ua, au

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[str] = []

        def stream() -> Iterator[str]:
            for b in batches:
                for s in b.column(0).to_pylist():
                    seen.append(s)
                    yield s

        out, size = [], 0
        for cost, edits in walk(stream()):
            s = seen.pop()
            out.append((s, *counts(s), cost, edits))
            size += len(s)
            if size > 1 << 22 or len(out) >= 10_000:
                yield _batches(list(zip(*out, strict=True)), kinds, names)
                out, size = [], 0
        if out:
            yield _batches(list(zip(*out, strict=True)), kinds, names)

    ordered = distinct.select("signature").repartitionByRange("signature").sortWithinPartitions("signature")
    return ordered.mapInArrow(run, "signature string, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): the rows of (conv_id, turn, role, text, dropped) with the edits of (conv_id, audit) applied, hashed."""
    none = lambda t: F.lit(None).cast(t)
    own = rows.where("not dropped").select("conv_id", F.lit(1).alias("kind"), "turn", "role", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "text")
    told = audits.select("conv_id", F.lit(0).alias("kind"), none("long").alias("turn"), none("string").alias("role"), none("string").alias("digest"), F.col("audit").alias("text"))

    def begin() -> dict:
        return {"hash": hashlib.sha256(), "edits": "", "at": 0, "state": 0, "some": False}

    def write(s: dict, role: str, text: str) -> None:
        if s["some"]:
            s["hash"].update(b"\n")
        s["some"] = True
        s["hash"].update(role.encode("utf-8", "surrogatepass") + b":")
        s["hash"].update(text.encode("utf-8", "surrogatepass"))

    def made(s: dict, text: str) -> None:
        s["state"] = MADE[s["state"]]
        write(s, "user" if s["state"] == 2 else "assistant", text)

    def inserts(s: dict) -> None:
        while s["at"] < len(s["edits"]) and s["edits"][s["at"]] == "I":
            s["at"] += 1
            made(s, "")

    def add(s: dict, row: tuple) -> None:
        _, kind, role, text = row
        if kind == 0:
            s["edits"] = text
            return
        inserts(s)
        edit = s["edits"][s["at"]]
        s["at"] += 1
        if edit == "R":
            made(s, text)
        elif edit == "K":
            s["state"] = KEPT[s["state"]][ROLES.index(role[0])]
            write(s, role, text)

    def end(conv: int | None, s: dict) -> tuple:
        inserts(s)
        return conv, s["hash"].hexdigest()

    both = _sorted(own.unionByName(told), "kind", "turn", "role", "digest").select("conv_id", "kind", "role", "text")
    return _streamed(both, "conv_id long, repaired_sha256 string", "conv_id", begin, add, end)


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of all conversations of `damaged` rows."""
    rows = rows.withColumns({"conv_id": F.col("conv_id").cast("long"), "turn": F.col("turn").cast("long")})
    signed = cut(signatures(marked(rows)))
    answers = answered(signed.groupBy("signature").agg(F.count("*").alias("n")))
    known = cut(signed.join(answers, "signature").drop("signature"))
    hashes = repaired(rows, known.select("conv_id", "audit"))
    out = known.join(hashes.withColumnRenamed("conv_id", "__c"), F.col("conv_id").eqNullSafe(F.col("__c")))
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))


def _sql() -> str:
    """The same in DuckDB: the programme as a recursion over a conversation's rows, a state's value its cost and edits as text."""

    def more(state: str, cost: str | int, edit: str) -> str:
        return f"(lpad((substr({state}, 1, 9)::INTEGER + {cost})::VARCHAR, 9, '0') || substr({state}, 10) || '{edit}')"

    def least(*x: str) -> str:
        return f"least({', '.join(x)})"

    when = lambda cond, x: f"CASE WHEN r.fault < 2 AND {cond} THEN {x} END"
    t = "r.extra"
    s0 = more("p.s0", 3, "D")
    s1 = least(more("p.s1", 3, "D"), when("r.ini = 's'", more("p.s0", t, "K")))
    s2 = least(more("p.s2", 3, "D"), *[x for s in ("p.s0", "p.s1", "p.s3") for x in (when("r.ini = 'u'", more(s, t, "K")), when("TRUE", more(s, f"2 + {t}", "R")))])
    s3 = least(more("p.s3", 3, "D"), when("r.ini = 'a'", more("p.s2", t, "K")), when("TRUE", more("p.s2", f"2 + {t}", "R")))
    close2 = least("s2", more("s0", 2, "I"), more("s1", 2, "I"), more("s3", 2, "I"))
    return f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')) AS k
  FROM conversations),
crc AS (
  SELECT *, xor(list_reduce(flatten(list_prepend([4294967295::BIGINT], list_transform(range(octet_length(k)),
      lambda j: [('0x' || substr(hex(k), 2 * j + 1, 2))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295) % 20 AS which
  FROM keyed),
hurt AS (
  SELECT conv_id, turn, CASE WHEN which = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN which = 1 THEN '' WHEN which = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN which = 0 THEN []::INTEGER[] WHEN which = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM crc),
placed AS (
  SELECT conv_id, dense_rank() OVER (ORDER BY conv_id) AS conv, turn, role, text, row_number() OVER w AS i,
         CASE WHEN substr(role, 1, 1) IN ('s', 'u', 'a') THEN substr(role, 1, 1) ELSE 'x' END AS ini,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said
  FROM hurt WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text))),
faults AS (
  SELECT *, CASE WHEN said = '' THEN 3 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2 WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS fault,
         lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS pair
  FROM placed),
r AS (SELECT *, CASE WHEN fault = 1 THEN 1 ELSE 0 END AS extra FROM faults),
dp AS (
  SELECT DISTINCT conv, 0::BIGINT AS i, '000000000' AS s0, NULL::VARCHAR AS s1, '000000002I' AS s2, '000000004II' AS s3 FROM r
  UNION ALL
  SELECT conv, i, s0, s1, s2, {least('s3', more('s2', 2, 'I'))} AS s3 FROM (
    SELECT conv, i, s0, s1, {close2} AS s2, s3 FROM (
      SELECT r.conv, r.i, {s0} AS s0, {s1} AS s1, {s2} AS s2, {s3} AS s3 FROM dp p JOIN r ON r.conv = p.conv AND r.i = p.i + 1) a) b),
ends AS (SELECT conv, least(s0, s3) AS best FROM dp QUALIFY row_number() OVER (PARTITION BY conv ORDER BY i DESC) = 1),
edits AS (SELECT conv, substr(best, 1, 9)::BIGINT AS cost, substr(best, 10) AS audit FROM ends),
chars AS (
  SELECT conv, unnest(range(1, length(audit) + 1)) AS p, audit, length(replace(audit, 'D', '')) AS total FROM edits),
steps AS (
  SELECT conv, p, substr(audit, p, 1) AS e, total,
         p - length(replace(substr(audit, 1, p), 'I', '')) AS inserts,
         length(replace(substr(audit, 1, p), 'D', '')) AS nth
  FROM chars),
lines AS (
  SELECT s.conv, s.p,
         CASE WHEN s.e = 'K' THEN r.role
              WHEN (s.nth - s.total % 2) % 2 = 1 THEN 'user' ELSE 'assistant' END
         || ':' || CASE WHEN s.e = 'I' THEN '' ELSE r.text END AS line
  FROM steps s LEFT JOIN r ON s.e <> 'I' AND r.conv = s.conv AND r.i = s.p - s.inserts
  WHERE s.e <> 'D'),
said AS (SELECT conv, string_agg(line, chr(10) ORDER BY p) AS whole FROM lines GROUP BY conv),
stats AS (
  SELECT conv_id, conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 3) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 1) AS truncated,
         count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM r GROUP BY conv_id, conv)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN stats t ON o.conv_id IS NOT DISTINCT FROM t.conv_id
LEFT JOIN edits e ON e.conv = t.conv
LEFT JOIN said s ON s.conv = t.conv
"""


OP12_SQL = _sql()
