"""Conversation repair: cheapest edits by trying all ways, damage and digests in plain Python, the SQL, and the odd cases."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import repair

SPACE = " \t\n\x0b\x0c\r"
WANTED = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """(cost, edits) of rows (initial, fault) by a search over outputs: least cost, then ASCII-least."""
    seen, heap = set(), [(0, "", 0, "")]
    while heap:
        cost, edits, i, out = heapq.heappop(heap)
        if i == len(rows) and WANTED.fullmatch(out):
            return cost, edits
        if (edits, i) in seen or len(out) > 2 * len(rows) + 4:
            continue
        seen.add((edits, i))
        last = out[-1:]
        fits = lambda c: (c == "s" and not out) or (c == "u" and last in ("", "s", "a")) or (c == "a" and last == "u")  # noqa: B023, E731
        for c in "ua":
            if fits(c):
                heapq.heappush(heap, (cost + 2, edits + "I", i, out + c))
        if i < len(rows):
            initial, fault = rows[i]
            heapq.heappush(heap, (cost + 3, edits + "D", i + 1, out))
            if fault < repair.DUPLICATE:
                extra = int(fault == repair.TRUNCATED)
                if initial in "sua" and fits(initial):
                    heapq.heappush(heap, (cost + extra, edits + "K", i + 1, out + initial))
                for c in "ua":
                    if fits(c):
                        heapq.heappush(heap, (cost + 2 + extra, edits + "R", i + 1, out + c))
    raise AssertionError


def signature(rows):
    return "".join(repair.letter("suax".index(r), f) for r, f in rows)


ROWS = st.lists(st.tuples(st.sampled_from("suax"), st.integers(0, 3)), max_size=5)


@settings(max_examples=150, deadline=None)
@given(st.lists(ROWS, min_size=1, max_size=8))
def test_walk_equals_search(many):
    ordered = sorted({signature(r): r for r in many}.items())
    got = list(repair.walk(iter(s for s, _ in ordered)))
    assert got == [cheapest(r) for _, r in ordered]


def test_shared_prefixes_are_computed_once(monkeypatch):
    calls = []
    plain = repair.layer
    monkeypatch.setattr(repair, "layer", lambda f, code: calls.append(code) or plain(f, code))
    list(repair.walk(iter(["ABAB", "ABABA", "ABC", "B"])))
    assert len(calls) == 4 + 1 + 1 + 1


def test_long_signature():
    rows = [("u", 0), ("a", 1), ("x", 0), ("a", 2)] * 25_000
    cost, edits = next(repair.walk(iter([signature(rows)])))
    assert len(edits.replace("I", "")) == 100_000 and cost > 0


def brute(rows):
    """The query's rows by conversation, in plain Python."""
    hurt, ids = {}, set()
    for conv, turn, role, text in rows:
        ids.add(conv)
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = (" " if role is None else role), (" " if text is None else text)
        k = zlib.crc32(key.encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        hurt.setdefault(conv, []).extend([(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1))
    out = {}
    for conv in ids:
        own = sorted(hurt.get(conv, []), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, marks = set(), []
        for _, role, text in own:
            said = text.rstrip(SPACE)
            fault = repair.BLANK if not said else repair.DUPLICATE if (role, text) in seen else repair.TRUNCATED if said[-1] not in ".!?" else repair.OK
            seen.add((role, text))
            marks.append((role[:1] if role[:1] in ("s", "u", "a") else "x", fault))
        cost, edits = cheapest(marks)
        lines, at, state = [], 0, ""
        for e in edits:
            role, text = own[at][1:] if e != "I" else ("", "")
            at += e != "I"
            if e == "D":
                continue
            if e in "IR":
                role = "assistant" if state == "u" else "user"
            state = role[0]
            lines.append(f"{role}:{text}")
        turns = [t for t, _, _ in own if t is not None]
        pairs = [a[0] + b[0] for a, b in zip(marks, marks[1:], strict=False)]
        n = lambda f: sum(m[1] == f for m in marks)  # noqa: B023, E731
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, n(repair.BLANK), n(repair.DUPLICATE), n(repair.TRUNCATED), sum(p not in ("su", "ua", "au") for p in pairs), cost, edits, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def planted(seed, n):
    rng = random.Random(seed)
    said = ["Hello.", "What?", "no end", " \t", "", "ok!", "ok! ", "é ü.", None]
    out = []
    for conv in [*range(n), None]:
        for _ in range(rng.randrange(1, 6)):
            out.append((conv, rng.choice([0, 1, 2, 3, 4, 9, None]), rng.choice(["user", "assistant", "system", "tool", "", "User", None]), rng.choice(said)))
    return out


SCHEMA = "conv_id long, turn long, role string, text string, code int, audit string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA)


@pytest.mark.parametrize("seed", [1, 2])
def test_repair(spark, seed):
    rows = planted(seed, 60)
    rows += rows[:20]  # repeated rows
    want = brute(rows)
    got = {r[0]: tuple(r[1:]) for r in repair.repair(repair.damaged(frame(spark, rows))).collect()}
    assert got == want


def test_sql(spark):
    rows = planted(3, 50)
    want = brute(rows)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert {r[0]: tuple(r[1:]) for r in con.execute(repair.OP12_SQL).fetchall()} == want


def test_hot_conversation_and_long_texts(spark):
    """One conversation of most rows, one row repeated very often, and a text of 2 MB."""
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"said {i}.") for i in range(20_000)]
    rows += [(2, 5, "user", "again and again.")] * 5000 + [(3, 0, "user", "long " * 400_000 + "."), (3, 1, "assistant", "ok.")]
    got = {r.conv_id: r for r in repair.repair(repair.damaged(frame(spark, rows))).collect()}
    assert got[2].duplicate in (4999, 9999, 0) and set(got[2].audit) <= set("KID")
    assert len(got[1].audit) >= 18_000 and len(got) == 3


def test_dropped_and_empty(spark):
    gone = next((c, t) for c in range(100) for t in range(20) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    got = repair.repair(repair.damaged(frame(spark, [(*gone, "user", "Hi.")]))).collect()
    assert [tuple(r) for r in got] == [(gone[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert repair.repair(repair.damaged(frame(spark, []))).collect() == []
