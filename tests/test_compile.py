"""Compiled requests with short-term context, with and without a system message; functions named for SQL."""

from datetime import datetime

from palimpsest import api
from palimpsest.functions import names

NOW, LATER, BEFORE = datetime(2024, 1, 1), datetime(2024, 1, 2), datetime(2023, 12, 31)


def requests(spark):
    long = "\n".join(f"line {i} of the output of a tool" for i in range(60))
    rows = [("a", 0, "system", "Be brief."), ("a", 1, "user", "Which database do we use?"), ("b", 0, "user", "hello there"), ("c", 0, "tool", long), ("c", 1, "user", "What does it say?"), ("d", 0, "tool", long), ("d", 1, "user", "Go on.")]
    return spark.createDataFrame(rows, "user_id string, ordinal int, role string, content string")


def context(spark):
    rows = [("a", "current_task", "fix the build", NOW, LATER), ("b", "current_error", "401", NOW, LATER), ("b", "old", "gone", BEFORE, NOW), ("d", "x", "y", NOW, LATER)]
    return spark.createDataFrame(rows, "user_id string, key string, value string, written_at timestamp, expires_at timestamp")


def test_short_term_text_and_untouched_requests(spark):
    at = datetime(2024, 1, 1, 12)
    done = api.compile_context(requests(spark), None, 8000, context(spark), at)
    sent = {(r.user_id, r.position): (r.role, r.content) for r in done["messages"].collect()}
    title = "[Short-Term Context (current state)]\n"
    assert sent["a", 1] == ("system", f"Be brief.\n\n{title}• current_task: fix the build") and sent["a", 2] == ("user", "Which database do we use?")
    assert sent["b", 0] == ("system", f"{title}• current_error: 401") and sent["b", 1] == ("user", "hello there")
    assert "truncated" not in sent["c", 1][1] and "60 lines total" in sent["d", 1][1]
    stats = {r.user_id: r for r in done["statistics"].collect()}
    assert {u: (r.messages_in, r.selected, r.memory_used, r.short_items or 0, r.overflow_tokens) for u, r in stats.items()} == {"a": (2, 2, 0, 1, 0), "b": (1, 1, 0, 1, 0), "c": (2, 2, 0, 0, 0), "d": (2, 2, 0, 1, 0)}
    assert stats["c"].tokens_in == stats["c"].tokens_out and stats["d"].tokens_out < stats["d"].tokens_in


def test_sql_names(spark):
    names.register(spark)
    r = spark.sql("SELECT lcs_ratio('abcd', ' ABxd ') AS a, lcs_ratio('a', cast(null AS string)) AS b, nfkc('ﬁve １') AS c").first()
    assert (r.a, r.b, r.c) == (0.75, None, "five 1")
