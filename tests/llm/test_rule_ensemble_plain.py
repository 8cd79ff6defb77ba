"""Tree growth and lasso of the rule ensemble against plain versions."""

import numpy as np
import pytest

from orgloom.llm import quality


def plain_tree(x, cuts, grad, depth, rate):
    """One regression tree on the gradient by trying every cut of every statistic; its rules, and the leaf of each row."""
    rules, update = [], np.zeros(len(x))

    def grow(rows, rule, left):
        g = [grad[i] for i in rows]
        best, found = 1e-9, None
        if left and len(rows) >= 20:
            for s, places in enumerate(cuts):
                for at in places:
                    low, high = [i for i in rows if x[i, s] <= at], [i for i in rows if x[i, s] > at]
                    if len(low) >= 5 and len(high) >= 5:
                        gain = sum(grad[i] for i in low) ** 2 / len(low) + sum(grad[i] for i in high) ** 2 / len(high) - sum(g) ** 2 / len(rows)
                        if gain > best + 1e-12:
                            best, found = gain, (s, float(at), low, high)
        if rule:
            rules.append(tuple((s, *rule[s]) for s in sorted(rule)))
        if not found:
            update[rows] = rate * sum(g) / len(rows)
            return
        s, at, low, high = found
        a, b = rule.get(s, (-np.inf, np.inf))
        grow(low, rule | {s: (a, at)}, left - 1)
        grow(high, rule | {s: (at, b)}, left - 1)

    grow(list(range(len(x))), {}, depth)
    return rules, update


@pytest.mark.parametrize("seed", range(4))
def test_trees_are_the_plain_ones(seed):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(150, 4)), 1)
    y = ((x[:, 0] > 0.3) & (x[:, 1] < 0.5) | (rng.random(150) < 0.1)).astype(float)
    cuts = [np.unique(np.quantile(x[:, s], np.linspace(0, 1, 9)[1:-1])) for s in range(4)]
    bins = np.column_stack([np.searchsorted(c, x[:, s], side="left") for s, c in enumerate(cuts)])
    margin = np.zeros(150)
    for _ in range(3):
        grad = y - 1 / (1 + np.exp(-margin))
        update = np.zeros(150)
        rules = quality._tree_rules(x, cuts, bins, grad, 3, update, 2.0)
        want_rules, want_update = plain_tree(x, cuts, grad, 3, 2.0)
        assert rules == want_rules and np.allclose(update, want_update)
        for rule, held in zip(rules, quality._matrix(rules, x).T, strict=True):
            assert [all(low < v[s] <= high for s, low, high in rule) for v in x] == held.tolist()
        margin += update


@pytest.mark.parametrize("penalty", [1e-3, 2e-2])
def test_lasso_is_the_optimum(penalty):
    """At the least of loss plus penalty the gradient is the penalty where a weight isn't 0, and no more elsewhere."""
    rng = np.random.default_rng(8)
    a = rng.random((600, 25)) < rng.random(25)
    y = (rng.random(600) < 1 / (1 + np.exp(-(2.0 * a[:, 0] - 3.0 * a[:, 1] + a[:, 2] - 0.5)))).astype(float)
    w, b = quality._lasso(a, y, penalty, steps=4000)
    err = 1 / (1 + np.exp(-(a @ w + b))) - y
    slope = a.T @ err / len(y)
    assert abs(err.mean()) < 1e-4
    for j, weight in enumerate(w):
        assert abs(slope[j] + penalty * np.sign(weight)) < 2e-4 if abs(weight) > 1e-6 else abs(slope[j]) <= penalty + 2e-4
    assert (w != 0).sum() < 25 or penalty < 1e-2
