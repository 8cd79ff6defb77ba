"""URL filter: domain rules, and for URLs that no rule decides gradient-boosted trees on lexical features.

Everything is DataFrame operations. The trees are grown on labelled URLs by histograms: features are cut into few
bins, and each level of a tree costs one aggregation of gradients by node, feature and bin, whose result has a fixed
size. Suffix statistics are joined; the finished trees are compiled into one column.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgloom.llm.common import kept, scratch, smallest, stored

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["url_length", "host_length", "path_length", "host_labels", "path_depth", "digit_ratio", "mark_ratio", "entropy", "parameters", "has_fragment", "suffix_rate", "domain_rate"]
MOST_RULES = 1000


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with all its subdomains, where the path starts so."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path after the first ``://``; both empty for null or without it."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UP, _LOW)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null. Rules are compiled, ``MOST_RULES`` at most."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules can be compiled into a column")
    text = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def _entropy(s: Column) -> Column:
    n = F.greatest(F.length(s), F.lit(1)).cast("double")
    share = lambda c: (F.length(s) - F.length(F.replace(s, c))) / n
    return F.aggregate(F.array_distinct(F.split(s, "")), F.lit(0.0), lambda acc, c: acc - F.when((c == "") | (share(c) <= 0), 0.0).otherwise(share(c) * F.log2(share(c))))


def suffixes(host: Column) -> tuple[Column, Column]:
    """The last label of a host, and its last two."""
    return F.substring_index(host, ".", -1), F.substring_index(host, ".", -2)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """All features but the suffix statistics."""
    u = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(u), F.lit(1)).cast("double")
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    return {
        "url_length": F.length(u), "host_length": F.length(host), "path_length": F.length(path),
        "host_labels": F.size(F.split(host, r"\.")), "path_depth": F.length(path) - F.length(F.replace(path, F.lit("/"))),
        "digit_ratio": (n - F.length(F.translate(u, "0123456789", ""))) / n, "mark_ratio": (n - F.length(F.translate(u, "-_%=&~+!@;,", ""))) / n,
        "entropy": _entropy(u), "parameters": F.when(query == "", 0).otherwise(1 + F.length(query) - F.length(F.replace(query, F.lit("&")))),
        "has_fragment": (F.instr(u, "#") > 0).cast("int"),
    }


def _number(x: float) -> Column:
    return F.lit(float(x))


def _array(values: list) -> Column:
    """A constant array; constants of one kind give one compiled plan, whatever their values."""
    return F.array(*[F.lit(x) for x in values])


def _bin(value: Column, cuts: list[float]) -> Column:
    """How many cuts are below a value."""
    return F.size(F.filter(_array(cuts), lambda c: c < value))


#: Folds of the sample whose suffix statistics are made without each other's labels.
FOLDS = 5


@dataclass
class Tree:
    """A tree of nodes numbered from 1, the children of i being 2i (at most the cut) and 2i + 1."""

    splits: dict[int, tuple[int, int]] = field(default_factory=dict)
    leaves: dict[int, float] = field(default_factory=dict)


@dataclass
class UrlModel:
    """Boosted trees over the bins of features, which ``cuts`` part; suffix statistics are tables of ``key, rate``, of
    no more rows than the sample had."""

    prior: float
    bias: float
    rates: dict[str, DataFrame] = field(default_factory=dict)
    cuts: dict[str, list[float]] = field(default_factory=dict)
    trees: list[Tree] = field(default_factory=list)

    def with_features(self, rows: DataFrame) -> DataFrame:
        """Rows of ``url, host, path`` with the columns ``FEATURES``; suffixes that the sample lacks get its share."""
        rows = rows.withColumns({k: c.cast("double") for k, c in lexical(F.col("url"), F.col("host"), F.col("path")).items()})
        for name, key in zip(("suffix_rate", "domain_rate"), suffixes(F.col("host")), strict=True):
            if name in self.rates:
                rows = rows.withColumn("key", key).join(F.broadcast(self.rates[name].withColumnRenamed("rate", name)), "key", "left").drop("key")
                rows = rows.withColumn(name, F.coalesce(name, _number(self.prior)))
            else:
                rows = rows.withColumn(name, _number(self.prior))
        return rows

    def margin(self) -> Column:
        """The log odds of "block" as a column over the features."""
        return sum((self._value(t, 1) for t in self.trees), _number(self.bias))

    def _value(self, tree: Tree, node: int) -> Column:
        if node not in tree.splits:
            return _number(tree.leaves.get(node, 0.0))
        f, k = tree.splits[node]
        return F.when(F.col(FEATURES[f]) <= _number(self.cuts[FEATURES[f]][k]), self._value(tree, 2 * node)).otherwise(self._value(tree, 2 * node + 1))


def fit(labelled: DataFrame, key_col: str, max_rows: int = 20_000, trees: int = 8, depth: int = 3, bins: int = 16, rate: float = 0.5) -> UrlModel:
    """Fit on ``url, host, path, block (0 or 1)`` of at most ``max_rows`` rows, those whose hash of key and URL is
    smallest.

    Suffix statistics hold the smoothed share of blocked rows of every suffix of that sample; others get the sample's
    share. While trees grow, a row has the statistics of the other ``FOLDS`` - 1 folds, so that no tree sees a row's own
    label, nor that of a row with it in a fold, among its features. With no rows, or of one class only, there are no trees. Rows keep their margin in a stored table, and each
    level of a tree is one aggregation.
    """
    rows = labelled.select("url", "host", "path", F.col("block").cast("double").alias("block"), F.xxhash64(F.col(key_col).cast("string"), "url").alias("h"))
    rows = stored(smallest(rows, "h", max_rows), "url-sample")
    n, blocked = rows.agg(F.count(F.lit(1)), F.sum("block")).first()
    share = (blocked or 0.0) / n if n else 0.5
    model = UrlModel(share, math.log((share + 1e-3) / (1 - share + 1e-3)))
    if not n or share in (0.0, 1.0):
        return model
    data = model.with_features(rows.withColumn("fold", F.pmod("h", F.lit(FOLDS))))
    for name, key in zip(("suffix_rate", "domain_rate"), suffixes(F.col("host")), strict=True):
        smoothed = lambda blocked, n: (blocked + 8 * share) / (n + 8)
        folds = stored(data.groupBy(key.alias("key"), "fold").agg(F.sum("block").alias("own_sum"), F.count(F.lit(1)).alias("own_n")), f"folds-{name}")
        whole = folds.groupBy("key").agg(F.sum("own_sum").alias("sum"), F.sum("own_n").alias("n"))
        model.rates[name] = kept(whole.select("key", smoothed(F.col("sum"), F.col("n")).alias("rate")), name)
        others = folds.join(whole, "key").select("key", "fold", smoothed(F.col("sum") - F.col("own_sum"), F.col("n") - F.col("own_n")).alias(name))
        data = data.drop(name).withColumn("key", key).join(F.broadcast(others), ["key", "fold"]).drop("key")  # no more rows than the sample
    data = stored(data.select("block", *FEATURES), "url-features")
    quantiles = data.agg(*[F.percentile_approx(f, [i / bins for i in range(1, bins)], 10_000).alias(f) for f in FEATURES]).first()
    model.cuts = {f: sorted(set(quantiles[f])) for f in FEATURES}
    places = [_bin(F.col(f), model.cuts[f]) for f in FEATURES]
    data = data.select("block", _number(model.bias).alias("margin"), F.array(*places).alias("bins"))
    for _ in range(trees):
        data = stored(data, "url-margins")
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("margin")))
        grown, tree = data.select("block", "margin", "bins", (F.col("block") - p).alias("g"), (p * (1 - p)).alias("w"), F.lit(1).alias("node")), Tree()
        for level in range(depth):
            first, splits = 1 << level, {}
            for node, sums in _histogram(grown).items():
                if node >= first and (best := _best(sums, model.cuts)):
                    splits[node], sides = best
                    for side, (g, w) in enumerate(sides):
                        tree.leaves[2 * node + side] = rate * g / (w + 1.0)
            if not splits:
                break
            tree.splits |= splits
            of = [splits.get(i, (-1, 0)) for i in range(1, 2 * first)]
            f, cut = (F.element_at(_array([x[k] for x in of]), F.least("node", F.lit(2 * first - 1))) for k in (0, 1))
            below = 2 * F.col("node") + (F.element_at("bins", F.greatest(f, F.lit(0)) + 1) > cut).cast("int")
            grown = grown.withColumn("node", F.when((F.col("node") >= first) & (f >= 0), below).otherwise(F.col("node")))
        values = _array([float(tree.leaves.get(i, 0.0)) for i in range(1, 2 << depth)])
        data = grown.select("block", (F.col("margin") + F.element_at(values, F.col("node"))).alias("margin"), "bins")
        model.trees.append(tree)
    return model


def _histogram(grown: DataFrame) -> dict[int, dict[int, dict[int, tuple[float, float]]]]:
    """Sums of gradient and weight by node, feature and bin."""
    got = grown.select("node", "g", "w", F.posexplode("bins").alias("f", "b")).groupBy("node", "f", "b").agg(F.sum("g").alias("g"), F.sum("w").alias("w")).collect()
    out: dict[int, dict[int, dict[int, tuple[float, float]]]] = {}
    for r in sorted(got, key=lambda r: (r["node"], r["f"], r["b"])):
        out.setdefault(r["node"], {}).setdefault(r["f"], {})[r["b"]] = (r["g"], r["w"])
    return out


def _best(by_feature: dict[int, dict[int, tuple[float, float]]], cuts: dict[str, list[float]]) -> tuple[tuple[int, int], list[tuple[float, float]]] | None:
    """The best split of a node as feature and cut, and the sums of gradient and weight on its two sides."""
    g, w = (sum(x[i] for x in next(iter(by_feature.values())).values()) for i in (0, 1))
    best, found = 1e-6 + g * g / (w + 1.0), None
    for f, sums in by_feature.items():
        left_g = left_w = 0.0
        for k in range(len(cuts[FEATURES[f]])):
            left_g, left_w = left_g + sums.get(k, (0.0, 0.0))[0], left_w + sums.get(k, (0.0, 0.0))[1]
            if left_w > 1e-3 and w - left_w > 1e-3:
                gain = left_g**2 / (left_w + 1.0) + (g - left_g) ** 2 / (w - left_w + 1.0)
                if gain > best + 1e-9:
                    best, found = gain, ((f, k), [(left_g, left_w), (g - left_g, w - left_w)])
    return found


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5, max_rows: int = 20_000) -> DataFrame:
    """``page_id, host, path, rule, verdict, score``: the longest fitting rule's verdict, else the trees'.

    The trees learn from the URLs that rules decide. ``score`` is the trees' chance of "block"; null or broken URLs
    have empty host and path and are judged by the trees on that. Rows are never merged, whole URLs of any length are
    read, other columns are ignored, an empty table gives no rows.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = rows.withColumn("host", host).withColumn("path", path)
    text, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", text).withColumn("ruled", verdict)
    with scratch(pages.sparkSession):
        model = fit(rows.filter(F.col("ruled").isNotNull()).withColumn("block", (F.col("ruled") == "block").cast("int")), "page_id", max_rows)
    scored = model.with_features(rows).withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-model.margin())))
    learned = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", learned).alias("verdict"), "score")
