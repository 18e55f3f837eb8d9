"""Text and identity functions as column expressions: normalising, classifying, hashing, tokens and keywords."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions import lexicons as L

_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def pattern(p: str, ignore_case: bool = True) -> str:
    """The pattern for Java's engine, its word boundaries ASCII as in the source."""
    return ("(?i)" if ignore_case else "") + p.replace(r"\b", _EDGE)


def matches(c: Column, p: str) -> Column:
    return F.coalesce(c.rlike(pattern(p)), F.lit(False))


def group(c: Column, p: str, k: int) -> Column:
    return F.regexp_extract(c, pattern(p), k)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once however often f names it: expressions nest without growing."""
    return F.element_at(F.transform(F.array(value), f), 1)


def first_match(c: Column, rules: list[tuple[str, str]], default: Column) -> Column:
    """The name of the first rule whose pattern the text matches."""

    def chain(x: Column) -> Column:
        out = None
        for p, name in rules:
            out = F.when(matches(x, p), name) if out is None else out.when(matches(x, p), name)
        return out.otherwise(default)

    return let(c, chain)


def nfkc(c: Column) -> Column:
    """Compatibility composition, which Spark has no function for; an Arrow function. ASCII texts need none."""

    def compose(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFKC")

    return F.pandas_udf(compose, "string")(c)


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


# identity -------------------------------------------------------------------------------------------------------


def content_hash(role: Column, content: Column, ordinal: Column | None = None) -> Column:
    """sha-256 of the message as compact JSON; a null ordinal is left out."""
    fields = [role.alias("role"), F.coalesce(content, F.lit("")).alias("content")]
    return F.sha2(F.to_json(F.struct(*fields, *([] if ordinal is None else [ordinal.alias("ordinal")]))), 256)


def client_id(id_: Column, message_id: Column, tool_call_id: Column) -> Column:
    """The first id that is not blank; a tool call's is marked."""
    full = lambda c: F.nullif(trimmed(c), F.lit(""))
    return F.coalesce(full(id_), full(message_id), F.concat(F.lit("tool:"), full(tool_call_id)))


def message_key(role: Column, content: Column, ordinal: Column, client: Column) -> Column:
    """id:<client id>, else hash:<hash with the ordinal>."""
    with_ordinal, without = content_hash(role, content, ordinal), content_hash(role, content)
    return F.when(client.isNotNull(), F.concat(F.lit("id:"), client)).otherwise(F.concat(F.lit("hash:"), F.when(client.isNull(), with_ordinal).otherwise(without)))


def session_scope(user: Column, session: Column) -> Column:
    """The scope of a user's session; the user itself if the session id is missing or malformed."""
    s = trimmed(session)
    scoped = F.concat(F.lit("sess:"), F.substring(user, 1, 16), F.lit(":"), F.substring(F.sha2(F.concat(user, F.lit(":"), s), 256), 1, 40))
    return F.when(F.coalesce(s.rlike(L.SESSION_ID), F.lit(False)), scoped).otherwise(user)


def session_marker(message: Column) -> tuple[Column, Column]:
    """(session id or null, message without a leading marker)."""
    found = F.regexp_extract(message, L.SESSION_MARKER, 1)
    return F.nullif(found, F.lit("")), F.regexp_replace(message, L.SESSION_MARKER, "")


def with_session_marker(session: Column, message: Column) -> Column:
    return F.concat(F.lit("___$$("), session, F.lit(")$$___"), message)


def resolved_session(explicit: Column, message: Column) -> Column:
    """The explicit id, else the marker's; null if it is malformed."""
    given = F.coalesce(F.nullif(explicit, F.lit("")), session_marker(message)[0])
    return F.when(given.rlike(L.SESSION_ID), given)


# normalising ----------------------------------------------------------------------------------------------------


def utterance(c: Column) -> Column:
    """Lower case, runs of other than word characters and + to a space, single spaces. NFKC, where wanted, comes before."""
    return F.trim(F.regexp_replace(F.regexp_replace(trimmed(F.lower(F.coalesce(c, F.lit("")))), r"[^\w\s+]+", " "), r"\s+", " "))


#: Contractions and what they stand for, and typographic marks.
CONTRACTIONS = {
    "doesn't": "does not", "don't": "do not", "can't": "cannot", "won't": "will not", "isn't": "is not", "aren't": "are not", "wasn't": "was not", "weren't": "were not",
    "haven't": "have not", "hasn't": "has not", "hadn't": "had not", "didn't": "did not", "wouldn't": "would not", "couldn't": "could not", "shouldn't": "should not",
    "mustn't": "must not", "i'm": "i am", "i've": "i have", "i'll": "i will", "i'd": "i would", "you're": "you are", "you've": "you have", "you'll": "you will", "we're": "we are",
    "we've": "we have", "we'll": "we will", "that's": "that is", "it's": "it is", "there's": "there is", "here's": "here is", "what's": "what is", "let's": "let us",
}
_APOSTROPHES, _QUOTES = "\u2019\u2018\u201b\u02bc\u02bb", "\u201c\u201d\u201e\u201f"


def plain_quotes(c: Column) -> Column:
    return F.translate(c, _APOSTROPHES + _QUOTES, "'" * len(_APOSTROPHES) + '"' * len(_QUOTES))


def expanded(c: Column) -> Column:
    """Contractions written out, in lower case or with a capital."""
    for a, b in CONTRACTIONS.items():
        c = F.replace(F.replace(c, F.lit(a), F.lit(b)), F.lit(a.capitalize()), F.lit(b.capitalize()))
    return c


def normal(c: Column) -> Column:
    """Plain quotes, contractions written out, repeated stops and white space single, lower case. NFKC, where wanted, comes before."""
    return F.lower(trimmed(F.regexp_replace(F.regexp_replace(expanded(plain_quotes(c)), r"([.!?])\1+", "$1"), r"\s+", " ")))


def spelling(c: Column) -> Column:
    out = F.lower(c)
    for a, b in (("favourite", "favorite"), ("colour", "color"), ("organise", "organize")):
        # a whole word; the literal stands first, so that the engine can skip to it
        out = F.regexp_replace(out, rf"{a}(?<![A-Za-z0-9_]{a})(?![A-Za-z0-9_])", b)
    return out


def slug(c: Column) -> Column:
    """The first six runs of letters and digits, joined by underscores; `item` if there is none."""
    runs = F.slice(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), 1, 6)
    return F.coalesce(F.nullif(F.array_join(runs, "_"), F.lit("")), F.lit("item"))


def clean_value(c: Column) -> Column:
    """Without quotes at the ends, then without trailing full stops, exclamation and question marks."""
    return trimmed(F.regexp_replace(F.regexp_replace(trimmed(c), "^['\"`]+|['\"`]+$", ""), r"[.!?]+$", ""))


def sentences(c: Column) -> Column:
    parts = F.transform(F.split(c, r"(?<=[.;!?])\s+(?=[A-Z\"'(])"), trimmed)
    return F.filter(parts, lambda x: x != "")


def clauses(c: Column) -> Column:
    """Parts between commas, `and`, `with`."""
    return F.filter(F.transform(F.split(c, pattern(r",|\band\b|\bwith\b")), trimmed), lambda x: x != "")


def boundary_sentences(c: Column) -> Column:
    """Sentences, cut further before `but now`, after a comma before I, we or now, and before `and` with I, we or my."""
    cut = r"(?<=[.;!?])\s+(?=[A-Z\"'(])|\s*,?\s+but\s+(?=now\b)|\s*,\s+(?=(?:i|we|now)\b)|\s+and\s+(?=(?:i|we|my)\b)"
    return F.filter(F.transform(F.split(c, pattern(cut)), trimmed), lambda x: x != "")


def strip_correction_prefix(c: Column) -> tuple[Column, Column]:
    """(text without a correction's opening, whether it had one)."""
    had = matches(c, L.CORRECTION_PREFIX)
    return F.when(had, trimmed(F.regexp_replace(c, pattern(L.CORRECTION_PREFIX), ""))).otherwise(c), had


def smallest_clause(source: Column, value: Column) -> Column:
    """The shortest clause that names the value, or all of its words; else the first clause."""

    def find(g: Column) -> Column:
        words = F.regexp_extract_all(g["value"], F.lit("[a-z0-9+#.-]+"), F.lit(0))
        names = lambda x: F.contains(F.lower(x), g["value"]) | ((F.size(words) > 0) & F.forall(words, lambda w: F.contains(F.lower(x), w)))
        ranked = F.array_sort(F.transform(F.filter(g["parts"], names), lambda x: F.struct(F.length(x).alias("n"), F.array_position(g["parts"], x).alias("at"), x.alias("text"))))
        return F.coalesce(F.try_element_at(ranked, F.lit(1))["text"], F.try_element_at(g["parts"], F.lit(1)))

    return let(F.struct(boundary_sentences(source).alias("parts"), F.lower(value).alias("value")), find)


def json_text(c: Column) -> Column:
    """The JSON in a model's answer: inside a fence, else from the first bracket or brace to its last counterpart."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    bare = F.regexp_extract(c, r"(?s)(\[.*\]|\{.*\})", 1)
    return F.coalesce(F.nullif(trimmed(fenced), F.lit("")), F.nullif(bare, F.lit("")), trimmed(c))


def ids(c: Column, kind: str = "long") -> Column:
    """The distinct ids of a JSON list, in its order; none if it is malformed."""
    return F.array_distinct(F.coalesce(F.from_json(c, f"array<{kind}>"), F.array().cast(f"array<{kind}>")))


def ids_text(c: Column) -> Column:
    return F.to_json(F.array_distinct(c))


# classifying ----------------------------------------------------------------------------------------------------


def low_info(content: Column, role: Column) -> Column:
    """Whether a user's or assistant's message says nothing: blank, a phrase of the list, or only words of it."""
    said = let(utterance(content), lambda n: (n == "") | n.isin(L.LOW_INFO) | F.forall(F.split(n, " "), lambda w: w.isin(L.LOW_INFO)))
    return role.isin("user", "assistant") & said


def interrogative(c: Column) -> Column:
    asks = lambda t: (t != "") & (matches(t, L.ENDS_WITH_QUESTION) | utterance(t).isin(L.QUESTION_WORDS) | any_of([matches(t, p) for p in L.QUESTIONS]))
    return F.coalesce(let(trimmed(c), asks), F.lit(False))


def speculative(c: Column) -> Column:
    return matches(c, L.SPECULATIVE)


def correction_like(c: Column) -> Column:
    return matches(c, L.CORRECTION)


def noise(c: Column) -> Column:
    n = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\w\s+]+", " "), r"\s+", " "))
    return let(n, lambda x: (x == "") | F.forall(F.split(x, " "), lambda w: w.isin(L.NOISE_WORDS)))


def preference_noise(c: Column) -> Column:
    """Whether a preference's value says nothing durable: no words, a question word, or only placeholder nouns."""
    v = trimmed(F.regexp_replace(F.regexp_replace(F.lower(trimmed(c)), r"^(?:a|an|the)\s+", ""), r"[.!?]+$", ""))

    def empty(words: Column) -> Column:
        lead = F.try_element_at(words, F.lit(1)).isin("this", "that", "these", "those", "it")
        return (F.size(words) == 0) | F.exists(words, lambda w: w.isin(L.INVALID_KEYS)) | lead | F.forall(words, lambda w: w.isin(L.PREFERENCE_NOISE))

    return let(F.regexp_extract_all(v, F.lit("[a-z0-9+#.-]+"), F.lit(0)), empty)


def authority(role: Column, content: Column) -> Column:
    return F.when(speculative(content), "speculation").when(role == "user", "user").when(role == "assistant", "assistant").otherwise("speculation")


def wants_history(c: Column) -> Column:
    return matches(c, L.HISTORY)


# tokens, keywords, relevance ------------------------------------------------------------------------------------


def tokens(c: Column) -> Column:
    """Estimated tokens: the larger of the runs of word or other characters and a count by length; blank: 0."""
    t = trimmed(F.coalesce(c, F.lit("")))
    runs = F.size(F.regexp_extract_all(t, F.lit(r"\w+|[^\w\s]+"), F.lit(0)))
    by_length = F.floor(F.length(t).cast("double") / F.lit(3.8).cast("double") + 0.5)
    return F.when(t == "", 0).otherwise(F.greatest(F.lit(1), runs, by_length)).cast("long")


def message_tokens(content: Column, name: Column | None = None, tool_call_id: Column | None = None, tool_calls: Column | None = None) -> Column:
    """Tokens of a message with its overhead; tool calls: array of structs (name, arguments)."""
    out = tokens(content) + 3
    for c in (name, tool_call_id):
        if c is not None:
            out = out + F.when(F.coalesce(c, F.lit("")) != "", tokens(c) + 1).otherwise(0)
    if tool_calls is not None:
        calls = F.aggregate(tool_calls, F.lit(0).cast("long"), lambda acc, x: acc + tokens(x["name"]) + tokens(x["arguments"]) + 3)
        out = out + F.coalesce(calls, F.lit(0))
    return out


def keywords(c: Column) -> Column:
    """Distinct word runs of over two characters that are no stop words, in the order of their first places."""
    words = F.regexp_extract_all(spelling(F.coalesce(c, F.lit(""))), F.lit(r"\w{3,}"), F.lit(0))
    return F.array_except(words, F.array(*[F.lit(w) for w in L.STOPWORDS]))  # distinct, in the order of `words`


def ranked_keywords(words: Column, k: int = 12) -> Column:
    """The k longest, ties in code-point order."""
    order = F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))
    return F.transform(F.slice(F.array_sort(order), 1, k), lambda x: x["w"])


def relevance(item_words: Column, query_words: Column) -> Column:
    overlap = F.size(F.array_intersect(item_words, query_words))
    share = F.least(F.lit(1.0), F.lit(0.4) + overlap / F.size(query_words) * F.lit(0.6))
    return F.when(F.size(query_words) == 0, 0.5).when(F.size(item_words) == 0, 0.3).when(overlap == 0, 0.25).otherwise(share)


def tool_output(content: Column) -> Column:
    """A tool's long output cut to its first ten lines, with a note."""
    lines = F.split(content, "\n")
    note = F.concat(F.array_join(F.slice(lines, 1, 10), "\n"), F.lit("\n... [tool output truncated for context budget: "), F.size(lines).cast("string"), F.lit(" lines total]"))
    return F.when(F.length(content) > 1000, note).otherwise(content)
