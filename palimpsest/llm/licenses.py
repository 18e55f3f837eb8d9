"""License scans: Aho-Corasick finds identifier tags and notice phrases, a shunting-yard parser evaluates expressions.

A text is lower-cased (A-Z) and cut into words; phrases and the words of a tag are found where they stand one after
another, all of them in one pass of an automaton over the whole text. Where the words of a tag are written as
`SPDX-License-Identifier:`, the rest of the line in the original text is parsed as an expression: `with` binds closer
than `and`, `and` closer than `or`.

Score: how freely the text may be used, 0 to 1, as FAMILIES has it for a label. An expression scores its parts' minimum for
`and`, maximum for `or`, and the mean of its part and 1 for `with` a known exception (it grants more). A text scores the
minimum over its expressions and the labels of its phrases, but for notices whose label an expression names, and 0.5 if
it has neither. An identifier of no known family has no label and counts as 0.5.

Defined results: a null or empty text has no words, no labels ('') and the score 0.5; a malformed expression adds the
labels of its known identifiers, without a score. Rows with equal or null ids are scanned each by itself. An empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm.base import per_batch, table

#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Families of licences by label: how freely a text under them may be used, what their identifiers are
#: or begin with (before a hyphen), and the words of their notices.
FAMILIES: dict[str, tuple[float, list[str], list[str]]] = {
    "0bsd": (1.0, ["0bsd"], []),
    "beerware": (1.0, ["beerware"], ["beer ware license"]),
    "cc0": (1.0, ["cc0"], ["cc0", "creative commons zero"]),
    "mit-0": (1.0, ["mit-0"], []),
    "public-domain": (1.0, ["public-domain", "pddl"], ["public domain"]),
    "unlicense": (1.0, ["unlicense"], ["unlicense"]),
    "wtfpl": (1.0, ["wtfpl"], ["do what the fuck you want to public license"]),
    "bsd": (0.95, ["bsd"], ["bsd license", "redistribution and use in source and binary forms"]),
    "bsl-1.0": (0.95, ["bsl-1.0"], ["boost software license"]),
    "isc": (0.95, ["isc"], ["isc license"]),
    "mit": (0.95, ["mit"], ["mit license", "permission is hereby granted free of charge"]),
    "mulan": (0.95, ["mulanpsl"], ["mulan psl"]),
    "ncsa": (0.95, ["ncsa"], ["university of illinois ncsa open source license"]),
    "postgresql": (0.95, ["postgresql"], ["postgresql license"]),
    "unicode": (0.95, ["unicode"], ["unicode license"]),
    "upl": (0.95, ["upl"], ["universal permissive license"]),
    "w3c": (0.95, ["w3c"], ["w3c software notice and license"]),
    "x11": (0.95, ["x11", "xfree86"], ["x11 license"]),
    "zlib": (0.95, ["zlib", "libpng"], ["zlib license", "zlib libpng license"]),
    "apache-1": (0.9, ["apache-1.0", "apache-1.1"], ["apache license version 1 0", "apache license version 1 1", "apache software license"]),
    "apache-2.0": (0.9, ["apache-2.0"], ["apache license version 2 0", "apache license 2 0"]),
    "cecill-b": (0.9, ["cecill-b"], ["cecill b"]),
    "php": (0.9, ["php"], ["php license"]),
    "python": (0.9, ["python", "psf"], ["python software foundation license"]),
    "ruby": (0.9, ["ruby"], ["ruby license"]),
    "afl": (0.85, ["afl"], ["academic free license"]),
    "cc-by": (0.85, ["cc-by"], []),
    "ecl": (0.85, ["ecl"], ["educational community license"]),
    "odc-by": (0.85, ["odc-by"], ["open data commons attribution license"]),
    "ofl": (0.85, ["ofl"], ["sil open font license"]),
    "openssl": (0.85, ["openssl"], ["openssl license"]),
    "artistic": (0.8, ["artistic", "clartistic"], ["artistic license"]),
    "json": (0.8, ["json"], ["the software shall be used for good not evil"]),
    "ms-pl": (0.8, ["ms-pl"], ["microsoft public license"]),
    "mpl": (0.7, ["mpl"], ["mozilla public license"]),
    "vim": (0.7, ["vim"], ["vim license"]),
    "cddl": (0.65, ["cddl"], ["common development and distribution license"]),
    "cpl": (0.65, ["cpl"], ["common public license"]),
    "epl": (0.65, ["epl"], ["eclipse public license"]),
    "ipl": (0.65, ["ipl"], ["ibm public license"]),
    "apsl": (0.6, ["apsl"], ["apple public source license"]),
    "cc-by-sa": (0.6, ["cc-by-sa"], ["cc by sa", "creative commons attribution sharealike", "creative commons attribution share alike"]),
    "cecill-c": (0.6, ["cecill-c"], ["cecill c"]),
    "lgpl": (0.6, ["lgpl", "lgpllr"], ["lesser general public license", "library general public license"]),
    "ms-rl": (0.6, ["ms-rl"], ["microsoft reciprocal license"]),
    "odbl": (0.6, ["odbl"], ["open database license"]),
    "eupl": (0.5, ["eupl"], ["european union public licence", "european union public license"]),
    "gfdl": (0.5, ["gfdl"], ["gnu free documentation license"]),
    "cecill": (0.45, ["cecill"], ["cecill"]),
    "osl": (0.45, ["osl"], ["open software license"]),
    "qpl": (0.45, ["qpl"], ["q public license"]),
    "sleepycat": (0.45, ["sleepycat"], ["sleepycat license"]),
    "gpl": (0.4, ["gpl"], []),
    "agpl": (0.3, ["agpl"], ["affero general public license"]),
    "cc-by-nc": (0.2, ["cc-by-nc"], ["cc by nc", "creative commons attribution noncommercial"]),
    "cc-by-nd": (0.2, ["cc-by-nd"], ["cc by nd", "creative commons attribution noderivatives"]),
    "commons-clause": (0.2, [], ["commons clause"]),
    "elastic": (0.2, ["elastic"], ["elastic license"]),
    "polyform": (0.2, ["polyform"], ["polyform noncommercial license"]),
    "busl": (0.15, ["busl"], ["business source license"]),
    "sspl": (0.15, ["sspl"], ["server side public license"]),
    "confidential": (0.0, [], ["proprietary and confidential"]),
    "reserved": (0.0, [], []),
}
FREEDOM = {label: freedom for label, (freedom, _, _) in FAMILIES.items()}
NOTICES = {phrase: label for label, (_, _, phrases) in FAMILIES.items() for phrase in phrases}
#: Identifiers' beginnings, the longer first.
_NAMES = sorted(((name, label) for label, (_, names, _) in FAMILIES.items() for name in names), key=lambda x: (-len(x[0]), x[0]))
#: Exceptions are named so, or are one of these.
_EXCEPTION = re.compile(r"[a-z0-9.-]+-exception(?:-[0-9.]+)?")
_OTHER_EXCEPTIONS = {"gpl-cc-1.0", "linux-syscall-note", "shl-2.0", "shl-2.1"}

_TAG = " spdx license identifier "
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:\-]+")
_RANK = {"or": 1, "and": 2, "with": 3}

#: Bytes to letters and digits, all others to spaces.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


#: A word in the original text.
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def label_of(identifier: str) -> str | None:
    """The label of an SPDX identifier: the family whose name it has or, before a hyphen, begins with."""
    x = identifier.lower().rstrip("+")
    return next((label for name, label in _NAMES if x == name or x.startswith(name + "-")), None)


def is_exception(identifier: str) -> bool:
    x = identifier.lower()
    return x in _OTHER_EXCEPTIONS or _EXCEPTION.fullmatch(x) is not None


def postfix(expression: str) -> list[str] | None:
    """The expression's identifiers and operators in postfix order (shunting-yard); None if it is malformed."""
    out: list[str] = []
    stack: list[str] = []
    operand = False
    for token in _TOKEN.findall(expression):
        low = token.lower()
        if token == "(":
            if operand:
                return None
            stack.append(token)
        elif token == ")":
            if not operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif low in _RANK:
            if not operand:
                return None
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = False
        elif operand:
            break  # words after a complete expression, such as the end of a comment
        else:
            out.append(token)
            operand = True
    if not operand or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(expression: str) -> tuple[set[str], float | None]:
    """(labels of the expression's known identifiers, its score or None)."""
    order = postfix(expression)
    if order is None:
        return {x for t in _TOKEN.findall(expression) if (x := label_of(t))}, None
    labels: set[str] = set()
    stack: list[float] = []
    for i, token in enumerate(order):
        if token in _RANK:
            b, a = stack.pop(), stack.pop()
            stack.append(min(a, b) if token == "and" else max(a, b) if token == "or" else (a + b) / 2 if b else a)
        elif i + 1 < len(order) and order[i + 1] == "with":
            stack.append(float(is_exception(token)))  # no licence: 1 grants more, 0 nothing
        else:
            name = label_of(token)
            labels |= {name} if name else set()
            stack.append(FREEDOM[name] if name else 0.5)
    return labels, stack[0]


_automaton = None


def automaton():
    """Of all phrases, as words between spaces; built once in a process."""
    global _automaton
    if _automaton is None:
        import ahocorasick

        a = ahocorasick.Automaton()
        for phrase, label in {**NOTICES, **BASE}.items():
            a.add_word(f" {phrase} ", (len(phrase) + 1, label, phrase in BASE))
        a.add_word(_TAG, (len(_TAG) - 1, None, False))
        a.make_automaton()
        _automaton = a
    return _automaton


def expressions(raw: bytes, firsts: list[int]) -> list[str]:
    """What follows the tags whose first words have these numbers, where they are written as tags, up to the line's end."""
    out = []
    wanted = iter(firsts)
    at = next(wanted, None)
    spans: list[tuple[int, int]] = []
    for i, m in enumerate(_WORD.finditer(raw)):
        if at is None:
            break
        if i >= at:
            spans.append(m.span())
        if len(spans) == 3:
            (_, a), (b, c), (d, e) = spans
            if raw[a:b] == raw[c:d] == b"-" and raw[e : e + 1] == b":":
                out.append(re.split(rb"[\r\n]", raw[e + 1 :], maxsplit=1)[0].decode("utf-8", "replace"))
            spans, at = [], next(wanted, None)
    return out


def scan(text: str | None) -> tuple[int, int, int | None, int | None, str, str, float]:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of a whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.translate(_WORDS).split()
    flat = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    base: set[str] = set()
    more: set[str] = set()
    named: set[str] = set()
    said: set[str] = set()
    scores: list[float] = []
    starts: list[int] = []
    tags: list[int] = []
    for end, (back, label, is_base) in automaton().iter(flat):
        if label is None:
            tags.append(end - back)
        elif is_base:
            base.add(label)
            starts.append(end - back)
        else:
            more.add(label)
    for expression in expressions(raw, [flat.count(" ", 0, x) for x in tags]) if tags else ():
        labels, score = evaluate(expression)
        named |= labels
        if score is not None:
            scores.append(score)
            said |= labels
    # a notice's label counts by itself unless an expression has said how it combines
    scores += [FREEDOM[x] for x in base] + [FREEDOM[x] for x in more - said]
    more |= named
    first = last = None
    if starts:
        lo, hi = min(starts), max(starts)
        first = flat.count(" ", 0, lo)
        last = first + flat.count(" ", lo, hi)
    return len(words), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(base | more)), min(scores, default=0.5)


def license_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row of `docs` (doc_id, text)."""
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")

    def scans(batch: dict[str, list]) -> dict[str, list]:
        return {"doc_id": batch["doc_id"], **dict(zip(names, zip(*map(scan, batch["text"]), strict=True), strict=True))}

    return per_batch(docs.select("doc_id", "text"), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double", scans)


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
