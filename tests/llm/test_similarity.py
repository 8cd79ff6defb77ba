"""Nearest neighbours and near duplicates against brute force."""

import random

import numpy as np
import pytest

from orgloom.llm import jaccard_join, vptree
from orgloom.llm.components import components

VECTORS = "vec_id long, embedding array<float>, rank int, score double, id long"


def brute(rows, k):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in good:
        if q % 20 == 0:
            out[q] = sorted(((-float((v * w).sum()), i) for i, w in good if i != q and len(w) == len(v)))[:k]
    return out


def test_exact_factor_is_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(700, 8)) * rng.uniform(0.2, 3, size=(700, 1)))]
    same = rows[40][1]
    rows += [(i, same) for i in range(700, 760)] + [(800, None), (820, [0.0] * 8), (840, [1.0, None] + [0.0] * 6), (860, [float("nan")] * 8), (880, [float("inf")] * 8), (900, []), (None, same), (920, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, 1.0, 5) for i, v in rows], VECTORS)
    want = brute(rows, 20)
    index, shards = vptree.build_index(df, 20, shard_rows=200)
    got = {}
    for r in vptree.search(index, shards, df.filter("vec_id % 20 = 0"), 20, 1.0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert got.keys() == {q for q in want if want[q]}
    for q, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, len(found) + 1))
        assert np.allclose([s for _, _, s in found], [-s for s, _ in want[q]], atol=1e-6)
    assert [i for _, i, _ in sorted(got[40])] == [i for _, i in want[40]]  # ties go to smaller ids
    loose = vptree.search(index, shards, df.filter("vec_id % 20 = 0"), 20, 1.5).collect()
    hits = sum(r["vec_id"] in {i for _, i in want[r["query_id"]]} for r in loose)
    assert hits / sum(map(len, want.values())) >= 0.9


@pytest.mark.parametrize("shard_rows", [8192, 300])
def test_repeated_rows_and_ids(spark, shard_rows):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=4) / 50).tolist()) for i in range(1000, 1400)]
    rows += [(5, [1.0, 0.0, 0.0, 0.0])] * 25 + [(i, [1.0, 0.0, 0.0, 0.0]) for i in (6, 7, 8)]  # one row often
    rows += [(9, [0.0, 9.0 + i / 100, 0.0, 0.0]) for i in range(60)] + [(1000, [0.0, 9.5, 0.0, 0.0])] * 2  # one id with many vectors
    rows += [(0, [1.0, 0.0, 0.0, 0.0]), (20, [0.0, 1.0, 0.0, 0.0]), (40, [0.5, 0.5, 0.0, -0.0])]
    best = {}
    for q, v in rows:
        for i, w in rows:
            if q % 20 == 0 and i != q:
                s = sum(float(np.float32(a)) * float(np.float32(b)) for a, b in zip(v, w, strict=True))
                best.setdefault(q, {})[i] = max(s, best.get(q, {}).get(i, -np.inf))
    df = spark.createDataFrame([(i, v, 1, 1.0, 5) for i, v in rows], VECTORS)
    index, shards = vptree.build_index(df, 20, shard_rows=shard_rows)
    got = {}
    for r in vptree.search(index, shards, df.filter("vec_id % 20 = 0"), 20, 1.0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert got.keys() == best.keys()
    for q, found in got.items():
        want = sorted(best[q].items(), key=lambda x: (-round(x[1], 9), x[0]))[:20]
        assert [i for _, i, _ in sorted(found)] == [i for i, _ in want], q
    assert {5, 6, 7, 8} <= {i for _, i, _ in got[0]}


def test_trees_search_one_after_another():
    rng = np.random.default_rng(3)
    x, q = rng.normal(size=(900, 6)), rng.normal(size=(40, 6))
    trees = []
    for part in np.split(np.arange(900), 3):
        order, radius = np.arange(300), np.full(300, np.nan)
        y = vptree._lift(x[part])
        for at, lo, mid, hi in vptree._nodes(300)[0]:
            rest = order[lo:hi]
            d = np.linalg.norm(y[rest] - y[order[at]], axis=1)
            order[lo:hi] = rest[np.argsort(d)]
            radius[at] = np.sort(d)[mid - lo - 1]
        trees.append(vptree.Tree(x[part][order], [[int(i)] for i in part[order]], radius))
    exact, all_taken = vptree.search_trees(trees, q, np.full(40, -1), 5, 1.0)
    want = np.argsort(-(q @ x.T), axis=1)[:, :5]
    assert exact["vec_id"].to_numpy().reshape(40, 5).tolist() == want.tolist()
    assert vptree.search_trees(trees, q, np.full(40, -1), 5, 3.0)[1] < all_taken


def test_no_vectors(spark):
    df = spark.createDataFrame([(0, None, 1, 1.0, 5)], VECTORS)
    index, shards = vptree.build_index(df, 20)
    assert vptree.search(index, shards, df, 20, 1.0).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(50, 51), (52, 51), (60, 60), (70, 75), (70, 71), (70, 72), (71, 70)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {i: 0 for i in range(31)} | {50: 50, 51: 50, 52: 50} | {70: 70, 71: 70, 72: 70, 75: 70}
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def shingle_set(text):
    w = (text or "").split()
    return frozenset(" ".join(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()


def brute_links(rows, threshold=0.8):
    sets = [shingle_set(t) for _, t in rows]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-12:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    names = {}
    for i in range(len(rows)):
        if rows[i][0] is not None:
            names[find(i)] = min(rows[i][0], names.get(find(i), rows[i][0]))
    return [(rows[i][0], names.get(find(i)), links[i]) for i in range(len(rows))]


def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    base = [[word() for _ in range(rng.randint(30, 120))] for _ in range(25)]
    rows = []
    for b in base:
        for _ in range(6):
            w = list(b)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = word()
            rows.append((len(rows) + 10, " ".join(w)))
    rows += [(900, ""), (901, None), (902, "  \n"), (903, "one two"), (904, "one  two\n"), (905, "one two three"), (None, rows[0][1]), (906, rows[0][1]), (906, rows[60][1]), (907, " ".join(base[0] * 40))]
    rng.shuffle(rows)
    return rows


def near(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, b"k", 1, 2) for i, t in rows], "doc_id long, text string, key binary, size int, links int")
    return sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.near_duplicates(df, **kw).collect()), key=str)


def test_links_and_classes_are_brute_force(spark):
    rows = corpus()
    assert near(spark, rows) == sorted(brute_links(rows), key=str)


def test_chunks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CHUNK_MEMBERS", 3)
    monkeypatch.setattr(jaccard_join, "CHUNK_SHINGLES", 150)
    rows = corpus()
    assert near(spark, rows) == sorted(brute_links(rows), key=str)


def test_nothing_to_join(spark):
    assert near(spark, []) == []
    assert near(spark, [(1, None), (2, ""), (2, "a b c d e f")]) == [(1, 1, 0), (2, 2, 0), (2, 2, 0)]


def test_recall_sets_the_prefix():
    f = jaccard_join.Forest()
    assert f.shortest == 4 and 1 - (1 - 0.8**4) ** 16 >= 0.999 > 1 - (1 - 0.8**5) ** 16
