"""Extractors of facts, corrections and revocations as column expressions over a sentence.

An extractor returns a struct of FACT's fields, null where the sentence is not of its form.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions import lexicons as L
from palimpsest.functions.text import any_of, clauses, clean_value, first_match, group, interrogative, let, matches, pattern, preference_noise, slug, spelling, trimmed

FACT = "struct<entity:string,attribute:string,value:string,memory_type:string,fact_key:string,scope:string,preferred_over:string,is_update:boolean>"
_WORDS = "[a-z0-9+#.-]+"


def fact(entity: Column, attribute: Column, value: Column, kind: Column | str, key: Column, scope: Column | str, over: Column | None = None, update: bool = False) -> Column:
    s = lambda c: (F.lit(c) if isinstance(c, str) else c).cast("string")
    return F.struct(
        s(entity).alias("entity"), s(attribute).alias("attribute"), s(value).alias("value"), s(kind).alias("memory_type"), s(key).alias("fact_key"), s(scope).alias("scope"),
        (F.lit(None) if over is None else F.nullif(over, F.lit(""))).cast("string").alias("preferred_over"), F.lit(update).alias("is_update"),
    )


def _words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(_WORDS), F.lit(0))


def _has(words: Column, names: list[str]) -> Column:
    return F.arrays_overlap(words, F.array(*[F.lit(x) for x in names]))


def _usable(c: Column) -> Column:
    return (c != "") & ~F.lower(c).isin(L.INVALID_KEYS)


def domain(choice: Column, other: Column | None = None) -> Column:
    """The attribute of a preference's domain; `preference` if it is of none."""

    def find(x: Column) -> Column:
        out = None
        for names, parts, exact, attribute in L.DOMAINS:
            hit = any_of([_has(x["words"], names + exact), *[F.contains(x["text"], F.lit(p)) for p in parts]])
            out = F.when(hit, attribute) if out is None else out.when(hit, attribute)
        return out.otherwise("preference")

    text = spelling(choice if other is None else F.concat_ws(" ", choice, other))
    return let(let(text, lambda t: F.struct(t.alias("text"), _words(t).alias("words"))), find)


def domain_topic(choice: Column) -> Column:
    return F.concat(F.lit("preference:"), let(choice, lambda c: let(domain(c), lambda d: F.when(d == "preference", slug(c)).otherwise(d))))


def value_attribute(v: Column) -> Column:
    return first_match(F.lower(v), L.VALUE_ATTRIBUTES, F.lit("technology"))


def purpose_attribute(p: Column) -> Column:
    """Null if the purpose is of no known kind."""
    return first_match(F.lower(p), L.PURPOSE_ATTRIBUTES, F.lit(None).cast("string"))


def _when(t: Column, p: str, parts: dict[str, Column], make: Callable[[Column], Column]) -> Column:
    """make(parts) where the text matches, with each part computed once."""
    return F.when(matches(t, p), let(F.struct(*[v.alias(k) for k, v in parts.items()]), make))


def _key(scope: Column | str, attribute: Column) -> Column:
    return F.concat(F.lit(scope) if isinstance(scope, str) else scope, F.lit("."), slug(attribute))


def building(t: Column) -> Column:
    def make(g: Column) -> Column:
        called = group(g["value"], r"\bcalled\s+([A-Za-z0-9_-]+)", 1)
        name = F.coalesce(F.nullif(called, F.lit("")), g["value"])
        return F.when(_usable(g["value"]), let(name, lambda n: fact(n, F.lit("project"), n, "fact", F.lit("project.name"), "project")))

    return _when(t, L.BUILDING, {"value": clean_value(group(t, L.BUILDING, 1))}, make)


def location(t: Column) -> Column:
    def one(p: str) -> Column:
        return _when(trimmed(t), p, {"value": clean_value(group(trimmed(t), p, 1))}, lambda g: F.when(_usable(g["value"]), fact(F.lit("user"), F.lit("location"), g["value"], "fact", F.lit("user.location"), "user")))

    return F.coalesce(*[one(p) for p in L.LOCATIONS])


def uses(t: Column) -> Column:
    def make(g: Column) -> Column:
        name = F.when(F.lower(g["entity"]).startswith("the "), trimmed(F.substr(g["entity"], F.lit(5)))).otherwise(g["entity"])
        parts = F.struct(name.alias("name"), trimmed(group(g["value"], r"^(.+?)\s+for\s+(.+)$", 2)).alias("purpose"), value_attribute(g["value"]).alias("known"), _words(g["value"]).alias("words"))

        def tell(x: Column) -> Column:
            meant = (x["purpose"] != "") & ~matches(x["purpose"], r"\b(project|production|staging|dev|testing)\b")
            attribute = (
                F.when(meant, F.coalesce(purpose_attribute(x["purpose"]), slug(x["purpose"]))).when(x["known"] != "technology", x["known"]).when(_has(x["words"], L.UI), "ui_library")
                .when(_has(x["words"], L.FRONTEND), "frontend").when(_has(x["words"], L.WORKFLOW), "workflow").when(F.lower(x["name"]) == "team", "workflow").otherwise("technology")
            )
            kind = F.when(meant | (x["known"] != "technology") | _has(x["words"], L.UI) | _has(x["words"], L.FRONTEND), "decision").otherwise("fact")
            scope = F.when(F.lower(x["name"]).isin("user", "my"), "user").otherwise("project")
            return let(F.struct(attribute.alias("a"), kind.alias("k"), scope.alias("s")), lambda y: fact(x["name"], y["a"], g["value"], y["k"], _key(y["s"], y["a"]), y["s"]))

        return F.when((g["value"] != "") & _usable(g["entity"]), let(parts, tell))

    return _when(t, L.USES, {"entity": trimmed(group(t, L.USES, 1)), "value": clean_value(group(t, L.USES, 2))}, make)


def possessive(t: Column) -> Column:
    def make(g: Column) -> Column:
        low = F.lower(g["attribute"])
        kind = F.when(low.contains("architecture") | low.contains("design"), "architecture").when(low.contains("goal") | low.contains("objective"), "goal").otherwise("fact")
        scope = F.when(F.lower(g["entity"]) == "user", "user").otherwise("project")
        return F.when(_usable(g["entity"]) & _usable(g["attribute"]) & (g["value"] != ""), fact(g["entity"], g["attribute"], g["value"], kind, _key(scope, g["attribute"]), scope))

    return _when(t, L.POSSESSIVE, {"entity": trimmed(group(t, L.POSSESSIVE, 1)), "attribute": trimmed(group(t, L.POSSESSIVE, 2)), "value": clean_value(group(t, L.POSSESSIVE, 3))}, make)


def preference(t: Column) -> Column:
    def make(g: Column) -> Column:
        choice = F.when(F.lower(g["first"]).startswith("use "), trimmed(F.substr(g["first"], F.lit(5)))).otherwise(g["first"])
        return F.when(_usable(g["first"]), let(choice, lambda c: let(domain(c, g["other"]), lambda a: fact(F.lit("user"), a, c, "preference", _key("user.preference", a), "user", g["other"]))))

    return _when(t, L.PREFER, {"first": clean_value(group(t, L.PREFER, 1)), "other": clean_value(F.concat(group(t, L.PREFER, 2), group(t, L.PREFER, 3)))}, make)


def favorite(t: Column) -> Column:
    def make(g: Column) -> Column:
        name = F.concat(F.when(F.lower(g["kind"]) == "preferred", "preferred").otherwise("favorite"), F.lit("_"), g["attribute"])
        return F.when(_usable(g["attribute"]) & ~preference_noise(g["value"]), let(name, lambda n: fact(F.lit("user"), n, g["value"], "preference", F.concat(F.lit("user."), n), "user")))

    value = trimmed(F.regexp_replace(clean_value(group(t, L.FAVORITE, 3)), pattern(L.TRAILING_TIME), ""))
    return _when(t, L.FAVORITE, {"kind": group(t, L.FAVORITE, 1), "attribute": slug(spelling(trimmed(group(t, L.FAVORITE, 2)))), "value": value}, make)


def affection(t: Column) -> Column:
    def make(g: Column) -> Column:
        against = (g["denied"] != "") | F.lower(g["verb"]).isin("hate", "dislike")

        def tell(d: Column) -> Column:
            base = F.when(d == "preference", slug(g["value"])).otherwise(d)
            attribute = F.when(against, F.concat(F.lit("disliked_"), F.when(d == "favorite_color", "color").otherwise(base))).otherwise(base)
            return let(attribute, lambda a: fact(F.lit("user"), a, g["value"], "preference", F.concat(F.lit("user."), a), "user"))

        return F.when(~preference_noise(g["value"]), let(domain(g["value"]), tell))

    value = trimmed(F.regexp_replace(clean_value(group(t, L.AFFECT, 3)), pattern(L.TRAILING_TIME), ""))
    value = trimmed(F.regexp_replace(value, pattern(r"^(?:a|an|the)\s+"), ""))
    return _when(t, L.AFFECT, {"denied": group(t, L.AFFECT, 1), "verb": group(t, L.AFFECT, 2), "value": value}, make)


def the_is(t: Column) -> Column:
    def make(g: Column) -> Column:
        words = _words(g["attribute"])
        kind = (
            F.when(matches(F.lower(g["attribute"]), r"\b(target|deployment|database|db|provider|stack|hosting)\b"), "decision").when(_has(words, ["architecture", "design"]), "architecture")
            .when(_has(words, ["goal", "objective"]), "goal").when(_has(words, ["preference", "prefer"]), "preference").otherwise("fact")
        )
        entity, shown = F.when(g["named"], "user").otherwise(g["attribute"]), F.when(g["named"], "name").otherwise(g["attribute"])
        scope = F.when(F.lower(entity) == "user", "user").otherwise("project")
        return F.when(_usable(g["attribute"]) & (g["value"] != "") & ~g["value"].endswith("?"), fact(entity, shown, g["value"], kind, _key(scope, shown), scope))

    return _when(t, L.THE_IS, {"attribute": trimmed(group(t, L.THE_IS, 1)), "value": clean_value(group(t, L.THE_IS, 2)), "named": F.lower(trimmed(t)).startswith("my name")}, make)


def single_fact(t: Column) -> Column:
    """The first extractor that finds a fact, in the fixed order."""
    return let(t, lambda x: F.coalesce(building(x), location(x), possessive(x), favorite(x), preference(x), affection(x), uses(x), the_is(x)))


def uses_list(t: Column) -> Column:
    """An array of facts, one for each listed thing, the first of each key; null unless there are two parts."""
    as_, for_ = r"^(.+?)\s+as\s+(?:the\s+|its\s+|our\s+)?([a-z0-9 _-]+?)\s*$", r"^(.+?)\s+for\s+(.+)$"

    def make(g: Column) -> Column:
        subject = F.when(F.lower(g["raw"]).isin(L.PRONOUN_SUBJECTS), "project").otherwise(g["raw"])
        scope = F.when(F.lower(subject) == "user", "user").otherwise("project")

        def one(x: Column) -> Column:
            purpose = let(trimmed(group(x, for_, 2)), lambda p: F.coalesce(purpose_attribute(p), slug(p)))
            attribute = F.when(matches(x, as_), slug(trimmed(group(x, as_, 2)))).when(matches(x, for_), purpose).otherwise(value_attribute(x))
            value = F.when(matches(x, as_), group(x, as_, 1)).when(matches(x, for_), group(x, for_, 1)).otherwise(x)
            return let(attribute, lambda a: fact(subject, a, clean_value(value), "decision", _key(scope, a), scope))

        def firsts(found: Column) -> Column:
            return F.filter(found, lambda x, i: F.array_position(F.transform(found, lambda y: y["fact_key"]), x["fact_key"]) == i + 1)

        return F.when(_usable(subject) & (F.size(g["parts"]) >= 2), let(F.filter(F.transform(g["parts"], one), lambda x: x["value"] != ""), firsts))

    c = trimmed(t)
    return _when(c, L.USES_LIST, {"raw": trimmed(group(c, L.USES_LIST, 1)), "parts": clauses(trimmed(group(c, L.USES_LIST, 2)))}, make)


def switch(t: Column) -> Column:
    """An update from `switched X to Y` or `switched to Y`."""
    new = lambda c: trimmed(F.regexp_replace(trimmed(c), pattern(L.SWITCH_TAIL), ""))

    def make(g: Column) -> Column:
        entity = F.when((g["target"] == "") | matches(g["target"], L.SWITCH_PRONOUN), "project").otherwise(g["target"])
        attribute = first_match(F.lower(g["value"]), L.SWITCH_ATTRIBUTES, F.lit("technology"))
        return let(attribute, lambda a: fact(entity, a, g["value"], "decision", _key("project", a), "project", update=True))

    full, bare = L.SWITCHED
    return F.coalesce(
        _when(t, full, {"target": trimmed(group(t, full, 1)), "value": new(group(t, full, 2))}, make),
        _when(t, bare, {"target": F.lit(""), "value": new(group(t, bare, 1))}, make),
    )


def correction(t: Column) -> Column:
    """struct(target, old_value, new_value), or null."""
    out = None
    for p, at in L.CORRECTIONS:
        parts = [(clean_value(group(t, p, k)) if k else F.lit("")).alias(n) for k, n in zip(at, ("target", "old_value", "new_value"), strict=True)]
        out = F.when(matches(t, p), F.struct(*parts)) if out is None else out.when(matches(t, p), F.struct(*parts))
    return out


def revocation(t: Column) -> Column:
    """struct(target, value), or null."""

    def make(g: Column) -> Column:
        own = F.regexp_extract_all(F.lower(g["target"]), F.lit("[a-z0-9]+"), F.lit(0))
        values = F.transform(F.regexp_extract_all(g["text"], F.lit(pattern(L.REVOKED_VALUE)), F.lit(1)), clean_value)
        values = F.filter(values, lambda v: ~F.lower(v).isin(L.COMMON_WORDS) & ~F.array_contains(own, F.lower(v)))
        return F.when(g["target"].isNotNull(), F.struct(clean_value(g["target"]).alias("target"), F.coalesce(F.try_element_at(values, F.lit(1)), F.lit("")).alias("value")))

    found = lambda s: F.struct(s.alias("text"), F.coalesce(*[F.nullif(trimmed(group(s, p, 1)), F.lit("")) for p in L.REVOCATIONS]).alias("target"))
    return let(let(trimmed(t), found), make)


def content_of(x: Column) -> Column:
    """A fact as a line of text."""
    attribute = x["attribute"]
    title = F.when(attribute != "", F.concat(F.upper(F.substring(attribute, 1, 1)), F.replace(F.substr(attribute, F.lit(2)), F.lit("_"), F.lit(" ")))).otherwise("Item")
    return F.when(x["memory_type"] == "preference", x["value"]).when(attribute == "project", F.concat(F.lit("Project: "), x["value"])).otherwise(F.concat(title, F.lit(": "), x["value"]))


def topic_of(x: Column) -> Column:
    """A fact's topic key."""
    attribute = spelling(F.coalesce(x["attribute"], F.lit("")))
    prefer = F.when(~attribute.isin("", "preference"), F.concat(F.lit("preference:"), slug(attribute))).otherwise(domain_topic(x["value"]))
    scope = F.coalesce(x["scope"], F.when(F.lower(x["entity"]).isin("user", "my"), "user").otherwise("project"))
    key = F.coalesce(x["fact_key"], F.concat(scope, F.lit("."), slug(x["attribute"])))
    return F.when(x["memory_type"] == "preference", prefer).when(x["attribute"] == "project", "project.name").otherwise(key)


def content_topic(content: Column, kind: Column) -> Column:
    """The topic of a text without a fact: its key, its decision's purpose or body, else its first three words."""
    t = trimmed(content)
    body = group(t, L.DECISION_TEXT, 1)
    purpose = group(body, r"(.+?)\s+for\s+(.+)$", 2)
    words = F.regexp_extract_all(F.lower(content), F.lit("[a-z0-9]+"), F.lit(0))
    told = F.slice(F.filter(words, lambda w: ~w.isin(L.TOPIC_STOP)), 1, 3)
    head = F.concat(F.coalesce(F.concat(kind, F.lit(":")), F.lit("")), F.array_join(told, "_"))
    return (
        F.when(kind == "preference", domain_topic(content)).when(matches(t, L.KEY_VALUE), slug(group(t, L.KEY_VALUE, 1)))
        .when(matches(t, L.DECISION_TEXT), slug(F.when(purpose != "", purpose).otherwise(body)))
        .when(F.size(told) == 0, slug(F.substring(content, 1, 48))).otherwise(head)
    )


def labelled(c: Column) -> tuple[Column, Column]:
    """(type that a leading label names or null, the text behind the label or the whole)."""
    has = matches(c, L.PREFIX)
    label = F.lower(trimmed(F.concat(group(c, L.PREFIX, 1), group(c, L.PREFIX, 2))))
    types = F.create_map(*[F.lit(x) for kv in L.LABELS.items() for x in kv])
    return F.when(has, F.try_element_at(types, label)), F.when(has, trimmed(group(c, L.PREFIX, 3))).otherwise(c)


def classified(c: Column) -> Column:
    """struct(memory_type, body, fact) of a text that no other extractor has read, or null."""
    none = F.lit(None).cast(FACT)
    made = lambda k, b, f=none: F.struct((F.lit(k) if isinstance(k, str) else k).alias("memory_type"), b.alias("body"), f.alias("fact"))

    def plain(x: Column) -> Column:
        t, out = trimmed(x), None
        for p, name in L.TYPED_TEXT:
            b = trimmed(group(t, p, 1))
            if name == "decision":
                b = let(b, lambda y: F.when(F.lower(y).startswith("use "), y).otherwise(F.concat(F.lit("Use "), y)))
                b = let(b, lambda y: F.concat(F.upper(F.substring(y, 1, 1)), F.substr(y, F.lit(2))))
            out = F.when(matches(t, p), made(name, b)) if out is None else out.when(matches(t, p), made(name, b))
        parts = F.struct(trimmed(group(t, L.KEY_VALUE, 1)).alias("key"), trimmed(group(t, L.KEY_VALUE, 2)).alias("value"))
        named = lambda g: F.when(matches(g["key"], r"\b(database|db|provider|stack|hosting)\b"), "decision").otherwise("fact")
        pair = let(parts, lambda g: F.when(~g["value"].endswith("?") & _usable(g["key"]), made(named(g), F.concat(g["key"], F.lit(" = "), g["value"]))))
        return out.when(matches(t, L.KEY_VALUE), pair)

    def read(x: Column) -> Column:
        kind, body = labelled(x)
        named = kind.isNotNull() & (body != "")
        parts = F.struct(F.when(named, kind).alias("kind"), F.when(named, body).otherwise(x).alias("text"), x.alias("whole"))

        def tell(g: Column) -> Column:
            own = lambda f: F.when(g["kind"].isNotNull(), made(g["kind"], g["text"], f)).when(f.isNotNull(), made(f["memory_type"], content_of(f), f)).otherwise(plain(g["whole"]))
            return F.when(~interrogative(g["text"]), let(single_fact(g["text"]), own))

        return let(parts, tell)

    return let(c, read)
