"""Quality: a sparse rule ensemble over text statistics.

Boosted trees are grown on statistics of labelled texts; every path from a root is a conjunctive rule. A logistic
regression with a lasso penalty keeps few of the rules, and the rules and weights are compiled into one Spark column.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgloom.llm.common import slices
from orgloom.llm.toxicity import sampled

STATS = ["chars", "words", "word_chars", "distinct_share", "top_share", "repeat_share", "upper_share", "digit_share", "mark_share", "bang_share", "bar_share", "line_words", "line_repeat", "short_lines", "end_share", "squeeze"]
_UPPER, _DIGIT, _BAR = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"|"
_MARK = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'-")


def statistics(text: str | None) -> list[float]:
    """The statistics named in ``STATS`` of a whole text; all 0 for null or empty text."""
    if not text:
        return [0.0] * len(STATS)
    raw = text.encode()
    words = text.split()
    n, w = len(raw), max(1, len(words))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    share = lambda chars: (n - len(raw.translate(None, chars))) / n
    return [
        float(len(text)), float(len(words)), len(text) / w, len(counts) / w, max(counts.values(), default=0) / w,
        sum(a == b for a, b in zip(words, words[1:])) / w,
        share(_UPPER), share(_DIGIT), share(_MARK), share(b"!"), share(_BAR),
        len(words) / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)), sum(len(x) < 30 for x in lines) / max(1, len(lines)),
        sum(x[-1] in ".!?" for x in words) / w,
        len(zlib.compress(raw, 1)) / n if n <= 1 << 16 else sum(len(zlib.compress(raw[i : i + 65536], 1)) for i in range(0, n, 65536)) / n,
    ]


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """``doc_id``, the ``extra`` columns, and one double column per statistic."""
    extra = extra or {}

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            last = b.num_columns - 1
            for part in slices(b, last, 8_000_000):
                stats = np.array([statistics(x) for x in part.column(last).to_pylist()]).reshape(-1, len(STATS))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *map(pa.array, stats.T)], [*part.schema.names[:-1], *STATS])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *[c.alias(k) for k, c in extra.items()], F.col(text_col).cast("string").alias("text"))
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    return rows.mapInArrow(task, kept + "".join(f", {s} double" for s in STATS))


#: A rule: for some statistics, a half-open interval (low, high].
Rule = tuple[tuple[int, float, float], ...]


@dataclass
class RuleEnsemble:
    rules: list[Rule]
    weights: list[float]
    bias: float

    def column(self) -> Column:
        """The chance of label 1 as a column over the statistics."""
        total = F.lit(float(self.bias))
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = F.lit(True)
            for s, low, high in rule:
                if low > -np.inf:
                    holds &= F.col(STATS[s]) > float(low)
                if high < np.inf:
                    holds &= F.col(STATS[s]) <= float(high)
            total += F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _matrix(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)), bool)
    for j, rule in enumerate(rules):
        for s, low, high in rule:
            out[:, j] &= (x[:, s] > low) & (x[:, s] <= high)
    return out


def _tree_rules(x: np.ndarray, cuts: list[np.ndarray], bins: np.ndarray, grad: np.ndarray, depth: int, update: np.ndarray, rate: float) -> list[Rule]:
    """The rules of one regression tree on the gradient; adds the tree's leaf values to ``update``."""
    rules: list[Rule] = []

    def grow(rows: np.ndarray, rule: dict[int, tuple[float, float]], left: int) -> None:
        g = grad[rows]
        best = (1e-9, -1, -1)
        if left and len(rows) >= 20:
            for s, cut in enumerate(cuts):
                if not len(cut):
                    continue
                total = np.cumsum(np.bincount(bins[rows, s], g, len(cut) + 1))[:-1]
                n = np.cumsum(np.bincount(bins[rows, s], minlength=len(cut) + 1))[:-1]
                ok = (n >= 5) & (len(rows) - n >= 5)
                if ok.any():
                    gain = np.where(ok, total**2 / np.maximum(n, 1) + (g.sum() - total) ** 2 / np.maximum(len(rows) - n, 1) - g.sum() ** 2 / len(rows), 0)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), s, k)
        if rule:
            rules.append(tuple((s, *rule[s]) for s in sorted(rule)))
        if best[1] < 0:
            update[rows] += rate * g.mean()
            return
        _, s, k = best
        at, (low, high) = float(cuts[s][k]), rule.get(s, (-np.inf, np.inf))
        below = bins[rows, s] <= k
        grow(rows[below], rule | {s: (low, at)}, left - 1)
        grow(rows[~below], rule | {s: (at, high)}, left - 1)

    grow(np.arange(len(x)), {}, depth)
    return rules


def _lasso(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic lasso by accelerated proximal gradient; the intercept isn't penalised."""
    n, m = a.shape
    a = a.astype(np.float32)
    v = np.ones(m, np.float32)
    for _ in range(20):  # the largest singular value sets the step
        v = a.T @ (a @ v)
        v /= max(float(np.linalg.norm(v)), 1e-12)
    lip = float(np.linalg.norm(a @ v)) ** 2 / (4 * n) + 0.25
    w, last, b, last_b = np.zeros(m), np.zeros(m), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), 0.0
    last_b = b
    for t in range(steps):
        push = t / (t + 3)
        u, ub = w + push * (w - last), b + push * (b - last_b)
        err = 1 / (1 + np.exp(-np.clip(a @ u.astype(np.float32) + ub, -30, 30))) - y
        last, last_b = w, b
        w = u - (a.T @ err.astype(np.float32)) / n / lip
        w = np.sign(w) * np.maximum(np.abs(w) - penalty / lip, 0)
        b = ub - err.mean() / lip
    return w, b


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = 12_000, trees: int = 30, depth: int = 3, penalty: float = 4e-4) -> RuleEnsemble:
    """Fit on at most ``max_rows`` labelled rows, those whose hashed id is smallest; only their statistics reach the
    driver. Rows without a label are ignored; with no rows, or one class only, there is no rule but the intercept."""
    rows = sampled(docs, labels, label_col, max_rows).withColumn("doc_id", F.lit(0))
    got = with_statistics(rows, extra={"y": F.col("y")}).toPandas().sort_values(STATS + ["y"], ignore_index=True)
    x, y = got[STATS].to_numpy(float), got["y"].to_numpy(float)
    if len(y) == 0 or y.min() == y.max():
        return RuleEnsemble([], [], 0.0 if len(y) == 0 else 20.0 * (2 * float(y[0]) - 1))
    cuts = [np.unique(np.quantile(x[:, s], np.linspace(0, 1, 33)[1:-1])) for s in range(x.shape[1])]
    bins = np.column_stack([np.searchsorted(c, x[:, s], side="left") for s, c in enumerate(cuts)])
    margin, rules = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        rules += _tree_rules(x, cuts, bins, y - p, depth, margin, 2.0)
    rules = list(dict.fromkeys(rules))
    w, b = _lasso(_matrix(rules, x), y, penalty)
    kept = np.flatnonzero(np.abs(w) > 1e-4)
    return RuleEnsemble([rules[i] for i in kept], w[kept].tolist(), b)


def score(docs: DataFrame, model: RuleEnsemble, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` and the statistics; null and empty texts are scored by statistics of 0. Null and repeated ids
    are carried as they are, other columns are ignored, an empty table gives no rows."""
    return with_statistics(docs, id_col, text_col).select("doc_id", model.column().alias("score"), *STATS)
