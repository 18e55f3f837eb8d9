"""URL filters: rules on host and path, and gradient-boosted trees on lexical features for what no rule fits.

DataFrame functions only. Rules label urls, and the trees learn from the labelled ones: lengths, depth, digit ratio, entropy,
parameter counts and suffix statistics. A suffix statistic is the share of blocked urls among all labelled ones whose host
ends alike (last one, two and three names) or whose path has the same extension, drawn towards a half; suffixes are
counted in BUCKETS hash buckets, so that the table of shares has a fixed size whatever the corpus, and stands in the plan.

Trees and suffixes say nothing about a url that is as likely under either verdict: labels weigh alike, and such a url is allowed.

The trees are fitted on at most `per_label` labelled urls of each verdict (a documented bound), picked by a hash. Features
become bins by their exact quantiles in that sample. A level of a tree is one aggregation: gradients and curvatures, as
whole numbers so that their sums don't depend on the order, by leaf, feature and bin; the driver gets these sums (at most
leaves x features x bins rows) and picks the splits. A fitted model is a column expression, so scoring is a part of
the scan's stage and shuffles nothing.

Defined results: a null url, and one without `://`, has an empty host and path; no rule fits it, and the trees judge the
empty text. Where no labelled url is there, or all have one verdict, nothing can be learnt: the verdict is that one, or
allow. Repeated rows are judged alike. An empty table gives an empty result. Extra columns of the input stay out of it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.base import cut, table

#: (verdict, host, path): fixed by the query's contract.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

#: Buckets of each suffix statistic, and the weight of the half that each starts with.
BUCKETS, PRIOR = 1024, 8.0
#: A url that is learnt from has the shares of the other folds, so that its own label is not in them.
FOLDS = 4
#: What gradients are multiplied by to be whole numbers.
UNIT = 1 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Shape:
    """Fixed sizes and rates of the trees; none of them follows the corpus."""

    trees: int = 10
    depth: int = 3
    bins: int = 24
    rate: float = 0.3
    l2: float = 1.0
    least: int = 10  # rows on either side of a split


@dataclass(frozen=True)
class Tree:
    """Splits by the number of their node (1: the root; 2n and 2n + 1 below n): feature and the greatest value that goes left. Leaves' values."""

    splits: dict[int, tuple[int, float]] = field(default_factory=dict)
    leaves: dict[int, float] = field(default_factory=dict)


@dataclass(frozen=True)
class Model:
    shares: tuple[tuple[float, ...], ...]  # by suffix statistic and bucket
    trees: tuple[Tree, ...]


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without it."""
    return F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.instr(url, F.lit("://"))
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


def fitting(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null; ties go to the longer host, then by the text.

    Rules are parameters and stand in the plan: for lists of up to some hundreds.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]), r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def suffixes(host: Column, path: Column) -> list[Column]:
    """The suffixes that have statistics, as bucket numbers."""
    names = F.split(host, r"\.")
    last = lambda n: F.array_join(F.slice(names, F.greatest(F.size(names) - n + 1, F.lit(1)), n), ".")
    ends = [last(1), last(2), last(3), F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)]
    return [F.pmod(F.xxhash64(x, F.lit(i)), F.lit(BUCKETS)).cast("int") for i, x in enumerate(ends)]


def _entropy(text: Column) -> Column:
    """Bits a character."""
    n = F.length(text)
    chars = F.array_distinct(F.split(text, ""))
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    bits = F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))
    return F.when(n == 0, 0.0).otherwise(F.round(bits, 6))


def lexical(url: Column, host: Column, path: Column) -> list[Column]:
    """The lexical features of a url; a null one counts as empty."""
    u = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern))
    ratio = lambda text: count(text, "[0-9]") / F.greatest(F.length(text), F.lit(1))
    return [x.cast("double") for x in (
        F.length(u), F.length(host), F.length(path), F.length(query), count(path, "/[^/]"), count(host, r"\.") + 1, count(query, "[^&]+"), count(u, "-"),
        ratio(u), ratio(host), _entropy(u), _entropy(host), F.startswith(u, F.lit("https:")).cast("int"), F.contains(u, F.lit("#")).cast("int"),
    )]


def _named(urls: DataFrame) -> DataFrame:
    """`urls` (url and whatever else) with `__host`, `__path`."""
    return urls.withColumns({"__host": host_of(F.col("url")), "__path": path_of(F.col("url"))})


def suffix_counts(labelled: DataFrame) -> list[tuple[int, int, int, int, int]]:
    """(stat, bucket, fold, n, ones) over all rows of `labelled` (url, label): at most 4 * BUCKETS * FOLDS rows."""
    rows = _named(labelled).withColumn("fold", _fold())
    each = F.posexplode(F.array(*suffixes(F.col("__host"), F.col("__path")))).alias("stat", "bucket")
    sums = rows.select("label", "fold", each).groupBy("stat", "bucket", "fold").agg(F.count("*").alias("n"), F.sum("label").alias("ones"))
    return [tuple(r) for r in sums.collect()]


def shares_of(counts: Sequence[tuple[int, int, int, int, int]], without: int | None = None) -> tuple[tuple[float, ...], ...]:
    """By suffix statistic and bucket: the share of label 1 in all folds but one, both labels weighing alike, drawn towards a half."""
    ones = sum(c[4] for c in counts if c[0] == 0)
    total = sum(c[3] for c in counts if c[0] == 0)
    w1, w0 = total / (2 * max(1, ones)), total / (2 * max(1, total - ones))
    sums = [[[PRIOR / 2, PRIOR / 2] for _ in range(BUCKETS)] for _ in range(4)]
    for stat, bucket, fold, n, y in counts:
        if fold != without:
            sums[stat][bucket][1] += w1 * y
            sums[stat][bucket][0] += w0 * (n - y)
    return tuple(tuple(y / (x + y) for x, y in stat) for stat in sums)


def _fold() -> Column:
    return F.pmod(F.xxhash64("url", F.lit(31)), F.lit(FOLDS)).cast("int")


def features(url: Column, host: Column, path: Column, shares: Sequence[Sequence[float]]) -> list[Column]:
    # one literal a statistic, folded by the optimizer
    held = lambda s: F.split(F.lit(" ".join(map(repr, s))), " ").cast("array<double>")
    looked_up = [F.element_at(held(s), b + 1) for s, b in zip(shares, suffixes(host, path), strict=True)]
    return lexical(url, host, path) + looked_up


def sampled(labelled: DataFrame, per_label: int, seed: int = 9) -> DataFrame:
    """At most `per_label` rows of either label of (url, label), picked by a hash of the url; repeated urls count once."""
    own = labelled.groupBy("url").agg(F.max("label").alias("label")).withColumn("__pos", F.xxhash64("url", F.lit(seed)))
    there = {r.label: r.n for r in own.groupBy("label").agg(F.count("*").alias("n")).collect()}
    out = None
    for y in (0, 1):
        # hashes below this are about twice as many as are wanted, so that the limit's one task reads no more than that
        top = min(1.0, 2 * per_label / max(1, there.get(y, 0)))
        near = F.lit(True) if top == 1.0 else F.col("__pos") < F.lit(int((top - 0.5) * 2**64))
        part = own.where((F.col("label") == y) & near).orderBy("__pos", "url").limit(per_label)
        out = part if out is None else out.unionByName(part)
    return out.select("url", "label")


def expression(tree: Tree, values: Sequence[Column], node: int = 1) -> Column:
    """A tree's value as a column; `values`: the features, by the trees' numbers."""
    if node not in tree.splits:
        return F.lit(float(tree.leaves.get(node, 0.0)))
    at, most = tree.splits[node]
    return F.when(values[at] <= F.lit(most), expression(tree, values, 2 * node)).otherwise(expression(tree, values, 2 * node + 1))


def _leaf(tree: Tree, values: Sequence[Column], node: int = 1) -> Column:
    """The number of the node that a row has come to."""
    if node not in tree.splits:
        return F.lit(node)
    at, most = tree.splits[node]
    return F.when(values[at] <= F.lit(most), _leaf(tree, values, 2 * node)).otherwise(_leaf(tree, values, 2 * node + 1))


Sums = dict[int, dict[int, tuple[int, int, int]]]


def split(by: Sums, edges: Sequence[Sequence[float]], shape: Shape) -> tuple[int, float, tuple[int, int], tuple[int, int]] | None:
    """Feature, threshold and the children's (gradient, curvature) of the split of greatest gain; `by`: feature, bin to (gradient, curvature, rows).

    Ties go to the first feature, then to the least threshold.
    """
    worth = lambda g, h: g * g / (h + shape.l2 * UNIT)
    best, found = 1e-6 * UNIT, None
    for f in sorted(by):
        g, h, n = (sum(x[i] for x in by[f].values()) for i in range(3))
        gl = hl = nl = 0
        for b in sorted(by[f])[:-1]:
            x = by[f][b]
            gl, hl, nl = gl + x[0], hl + x[1], nl + x[2]
            if min(nl, n - nl) >= shape.least and (gain := worth(gl, hl) + worth(g - gl, h - hl) - worth(g, h)) > best:
                best, found = gain, (f, edges[f][b], (gl, hl), (g - gl, h - hl))
    return found


def fitted(labelled: DataFrame, per_label: int = 20_000, shape: Shape = Shape()) -> Model | None:
    """Trees from urls (url, label: 1 for block), either label weighing as much; None where there is nothing to tell apart."""
    counts = suffix_counts(labelled)
    few = _named(sampled(labelled, per_label)).withColumn("fold", _fold())
    folds = [features(F.col("url"), F.col("__host"), F.col("__path"), shares_of(counts, k)) for k in range(FOLDS)]
    plain = lexical(F.col("url"), F.col("__host"), F.col("__path"))
    # the shares of a row's own fold
    picked = [F.coalesce(*[F.when(F.col("fold") == k, v[i]) for k, v in enumerate(folds)]) for i in range(len(plain), len(folds[0]))]
    names = [f"f{i}" for i in range(len(folds[0]))]
    rows = cut(few.select("label", *[v.alias(n) for v, n in zip([*plain, *picked], names, strict=True)]))
    quantiles = [i / shape.bins for i in range(shape.bins + 1)]
    head = rows.agg(F.count("*").alias("n"), F.sum("label").alias("ones"), *[F.percentile(n, F.lit(quantiles)).alias(n) for n in names]).first()
    if not head.n or head.ones in (0, head.n):
        return None
    # thresholds lie halfway between values that occur
    edges = [[(a + b) / 2 for a, b in zip(q, q[1:], strict=False)] for q in (sorted(set(head[n])) for n in names)]
    bins = [sum(((F.col(n) > F.lit(x)).cast("int") for x in e), F.lit(0)) for n, e in zip(names, edges, strict=True)]
    weight = F.when(F.col("label") == 1, head.n / (2 * head.ones)).otherwise(head.n / (2 * (head.n - head.ones)))
    rows = cut(rows.select("label", weight.alias("weight"), *names, F.array(*bins).alias("bins")).coalesce(8))  # at most 2 * per_label rows
    values, trees = [F.col(n) for n in names], []
    for _ in range(shape.trees):
        margin = F.lit(0.0)
        for t in trees:
            margin = margin + expression(t, values)
        p = 1 / (1 + F.exp(-F.col("margin")))
        own = rows.withColumn("margin", margin).withColumn("p", p)
        g, h = (F.round(x * F.col("weight") * UNIT).cast("long") for x in (F.col("p") - F.col("label"), F.col("p") * (1 - F.col("p"))))
        own = own.select(*names, "bins", g.alias("g"), h.alias("h"))
        tree, open_ = Tree(), {1}
        for _ in range(shape.depth):
            each = own.select(_leaf(tree, values).alias("node"), "g", "h", F.posexplode("bins").alias("f", "bin"))
            sums: dict[int, Sums] = {}
            # at most nodes x features x bins rows
            for r in each.where(F.col("node").isin(*open_)).groupBy("node", "f", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n")).collect():
                sums.setdefault(r.node, {}).setdefault(r.f, {})[r.bin] = (r.g, r.h, r.n)
            open_ = set()
            for node, by in sums.items():
                if found := split(by, edges, shape):
                    f, most, *children = found
                    tree.splits[node] = f, most
                    tree.leaves.pop(node, None)
                    for child, (cg, ch) in zip((2 * node, 2 * node + 1), children, strict=True):
                        tree.leaves[child] = -shape.rate * cg / (ch + shape.l2 * UNIT)
                        open_.add(child)
            if not open_:
                break
        trees.append(tree)
    return Model(shares_of(counts), tuple(trees))


def score(model: Model, url: Column, host: Column, path: Column) -> Column:
    """The probability that a url is one to block."""
    return _chance(model, features(url, host, path, model.shares))


def _chance(model: Model, values: Sequence[Column]) -> Column:
    margin = F.lit(0.0)
    for t in model.trees:
        margin = margin + expression(t, values)
    return 1 / (1 + F.exp(-margin))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, per_label: int = 20_000, shape: Shape = Shape(), least: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row of `pages` (page_id, url); `score` is null where a rule decides."""
    found = fitting(F.col("__host"), F.col("__path"), rules)
    rows = _named(pages.select("page_id", "url")).withColumn("__rule", found)
    labelled = rows.where("__rule is not null").select("url", (F.col("__rule.verdict") == "block").cast("int").alias("label"))
    model = fitted(labelled, per_label, shape)
    if model is None:
        block = labelled.agg(F.max("label")).first()[0] == 1
        guess = F.lit(float(block))
    else:
        # the features once, as columns: a tree names them at each of its splits
        values = features(F.col("url"), F.col("__host"), F.col("__path"), model.shares)
        names = [f"__f{i}" for i in range(len(values))]
        row = F.struct(*[v.alias(n) for v, n in zip(values, names, strict=True)])
        rows = rows.withColumn("__f", F.explode(F.array(F.when(F.col("__rule").isNull(), row))))
        guess = _chance(model, [F.col("__f")[n] for n in names])
    rows = rows.withColumn("score", F.when(F.col("__rule").isNull(), guess))
    verdict = F.coalesce(F.col("__rule.verdict"), F.when(F.col("score") > least, "block").otherwise("allow"))
    return rows.select("page_id", F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule.rule").alias("rule"), verdict.alias("verdict"), "score")


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))
