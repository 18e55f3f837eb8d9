"""License scans against a plain search for every phrase and a recursive reading of expressions."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from palimpsest.llm import licenses as L

_PARTS = [
    *L.BASE, *[p for _, _, phrases in L.FAMILIES.values() for p in phrases], "public", "license", "cc", "by", "the", "é", "spdx license identifier", "SPDX-License-Identifier: MIT\n",
    "SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0 OR MIT) AND EPL-2.0\n", "SPDX-License-Identifier: Unknown-1.0 AND zlib\r", "spdx-license-identifier:LGPL-2.1+ and\n",
    "SPDX-License-Identifier:MPL-2.0 text after it\n", "SPDX.License.Identifier: MIT\n", "SPDX-License-Identifier", "\n",
]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))


def places(said, phrase):
    p = phrase.split(" ")
    return [i for i in range(len(said)) if said[i : i + len(p)] == p]


def read(tokens):
    """The value of an expression by recursive descent: or over and over with; None if it is malformed."""
    at = 0

    def peek():
        return tokens[at].lower() if at < len(tokens) else None

    def one():
        nonlocal at
        if peek() == "(":
            at += 1
            v = any_()
            if v is None or peek() != ")":
                return None
            at += 1
            return v
        if peek() in (None, ")", "and", "or", "with"):
            return None
        label = L.label_of(tokens[at])
        at += 1
        return L.FREEDOM[label] if label else 0.5

    def granted():
        nonlocal at
        v = one()
        while v is not None and peek() == "with":
            at += 1
            if peek() in (None, "(", ")", "and", "or", "with"):
                return None
            v = (v + 1) / 2 if L.is_exception(tokens[at]) else v
            at += 1
        return v

    def all_():
        nonlocal at
        v = granted()
        while v is not None and peek() == "and":
            at += 1
            w = granted()
            v = None if w is None else min(v, w)
        return v

    def any_():
        nonlocal at
        v = all_()
        while v is not None and peek() == "or":
            at += 1
            w = all_()
            v = None if w is None else max(v, w)
        return v

    v = any_()
    # words after a complete expression end it; an operator or a bracket after it breaks it
    return v if at == len(tokens) or peek() not in ("(", ")") else None


def brute(text):
    said = words(text)
    spots = sorted(i for p in L.BASE for i in places(said, p))
    base = {label for p, label in L.BASE.items() if places(said, p)}
    more = {label for p, label in L.NOTICES.items() if places(said, p)}
    named, scored, scores = set(), set(), []
    for e in re.findall(r"(?<![0-9A-Za-z\x80-\U0010FFFF])SPDX-License-Identifier:([^\r\n]*)", text, re.IGNORECASE):
        tokens = re.findall(r"[()]|[A-Za-z0-9.+:\-]+", e)
        value = read(tokens)
        if value is None:
            named |= {x for t in tokens if (x := L.label_of(t))}
            continue
        labels, _ = L.evaluate(e)
        named |= labels
        scored |= labels
        scores.append(value)
    scores += [L.FREEDOM[x] for x in base | (more - scored)]
    return len(said), len(spots), spots[0] if spots else None, spots[-1] if spots else None, ",".join(sorted(base)), ",".join(sorted(base | more | named)), min(scores, default=0.5)


@given(st.lists(st.tuples(st.sampled_from(_PARTS), st.sampled_from([" ", "  ", "-", ", ", "", "_"])), max_size=12))
@settings(max_examples=400, deadline=None)
def test_scan(parts):
    text = "".join(p + s for p, s in parts)
    assert L.scan(text) == brute(text)


@pytest.mark.parametrize(
    ("identifier", "label"),
    [("EPL-2.0", "epl"), ("Zlib", "zlib"), ("MIT-0", "mit-0"), ("MIT", "mit"), ("LGPL-2.1-or-later", "lgpl"), ("CC-BY-SA-4.0", "cc-by-sa"), ("CC-BY-4.0", "cc-by"), ("GPL-3.0+", "gpl"), ("Mitigated", None)],
)
def test_labels(identifier, label):
    assert L.label_of(identifier) == label


def test_notices_and_exceptions():
    assert L.scan("Eclipse Public License")[5:] == ("epl", 0.65)
    assert L.evaluate("GPL-2.0-only WITH Classpath-exception-2.0")[1] == pytest.approx(0.7)
    assert L.evaluate("GPL-2.0-only WITH something")[1] == pytest.approx(0.4)
    text = "SPDX License Identifier see below. cc by nc public domain"
    assert L.scan(text)[-1] == L.scan("cc by nc public domain")[-1] == 0.2


def test_the_query(spark, tmp_path):
    rows = [(1, "CC BY\x01general Public LICENSE"), (1, None), (None, "é cc by"), (2, "x " * 50000 + "all rights reserved")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in L.op7_license_scans(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted(((d, *brute(t or "")) for d, t in rows), key=repr)
