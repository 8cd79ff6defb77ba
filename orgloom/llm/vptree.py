"""Nearest neighbours by largest inner product through vantage-point trees, one per shard.

Repeated rows are merged, and rows are dealt to shards of a bounded size by a hash of id and vector. A shard's vectors
get one more component that makes all norms equal, so that the largest inner product is the least distance, and are
laid out as a balanced vantage-point tree: the tree's shape follows from the number of rows, and each inner node keeps
the median distance to its vantage point. Query rows are sent in blocks to groups of shards and stream through a
group's trees one after another; a leaf is skipped when ``factor`` times the bound that the triangle inequality gives
is beyond the query's present worst neighbour. Factor 1 is exact.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orgloom.llm.common import stored

INDEX = "dim int, shard int, pos int, ids array<long>, vector array<double>, radius double, most int"
FOUND = "query_id long, vec_id long, score double"
LEAF = 64
#: A query's own id takes one of the places that are searched for.
SPARE = 1
#: Bytes of vectors whose trees one task of the search holds.
TREE_BYTES = 64 << 20


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _nodes(n: int) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int]]]:
    """Inner nodes as (vantage, first inside, first outside, end) and leaves as (first, end) of a tree of n rows."""
    inner, leaves, todo = [], [], [(0, n)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= LEAF:
            leaves.append((lo, hi))
        else:
            mid = lo + 1 + (hi - lo) // 2
            inner.append((lo, lo + 1, mid, hi))
            todo += [(lo + 1, mid), (mid, hi)]
    return inner, leaves


def _lift(x: np.ndarray) -> np.ndarray:
    """The vectors with the component that makes all norms equal to the largest."""
    norms = np.einsum("ij,ij->i", x, x)
    return np.column_stack([x, np.sqrt(np.maximum(norms.max() - norms, 0))])


def build_index(vectors: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 8192) -> tuple[DataFrame, int]:
    """All usable rows as trees (``INDEX``), written to the shared folder, and the number of shards of each dimension.

    Rows that repeat id and vector count once. Equal vectors of a shard become one entry with its k + 1 smallest ids,
    which is exact for k neighbours. ``most`` is how many entries of a shard one id has at most.
    """
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("vector")).filter(usable(F.col("vector")) & F.col("id").isNotNull())
    shards = max(1, -(-rows.count() // shard_rows))
    rows = rows.withColumn("vector", F.transform("vector", lambda x: x + 0.0)).dropDuplicates(["id", "vector"])
    rows = rows.withColumn("dim", F.size("vector")).withColumn("shard", F.pmod(F.xxhash64("id", "vector"), F.lit(shards)).cast("int"))
    held = k + SPARE

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["vector"].to_numpy())
        ids = pdf["id"].to_numpy()
        sort = np.lexsort((ids, *x.T))
        x, ids = x[sort], ids[sort]
        new = np.append(True, (x[1:] != x[:-1]).any(axis=1))
        groups = [g[:held].tolist() for g in np.split(ids, np.flatnonzero(new)[1:])]
        most = int(np.unique(ids, return_counts=True)[1].max())
        x = x[new]
        y, n = _lift(x), len(x)
        order, radius = np.random.default_rng(n).permutation(n), np.full(n, np.nan)
        for at, lo, mid, hi in _nodes(n)[0]:
            rest = order[lo:hi]
            d = np.linalg.norm(y[rest] - y[order[at]], axis=1)
            near = np.argpartition(d, mid - lo - 1)
            order[lo:hi] = rest[near]
            radius[at] = d[near[mid - lo - 1]]
        head = {"dim": pdf["dim"].iloc[0], "shard": pdf["shard"].iloc[0], "pos": np.arange(n)}
        return pd.DataFrame(head | {"ids": [groups[i] for i in order], "vector": list(x[order]), "radius": radius, "most": most})

    return stored(rows.groupBy("dim", "shard").applyInPandas(build, INDEX), "vp-index"), shards


class Tree:
    """A shard's tree, ready for search."""

    def __init__(self, vectors: np.ndarray, ids: list, radius: np.ndarray, most: int = 1):
        self.x, self.ids, self.radius, self.most = vectors, ids, radius, most
        self.y = _lift(vectors)
        self.high = float(np.einsum("ij,ij->i", self.y, self.y).max())
        self.inner, self.leaves = _nodes(len(vectors))

    def _bounds(self, q: np.ndarray, square: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each query and leaf the least possible distance; the vantage points and the queries' scores with them."""
        at = np.array([v for v, *_ in self.inner], dtype=int)
        score = q @ self.x[at].T
        dist = np.sqrt(np.maximum(square[:, None] + self.high - 2 * score, 0))
        low = {0: np.zeros(len(q))}
        for j, (v, lo, mid, _) in enumerate(self.inner):
            here = low.pop(v)
            low[lo] = np.maximum(here, dist[:, j] - self.radius[v])
            low[mid] = np.maximum(here, self.radius[v] - dist[:, j])
        return np.column_stack([low[lo] for lo, _ in self.leaves]), at, score

    def search(self, q: np.ndarray, query_ids: np.ndarray, k: int, factor: float, known: np.ndarray | None = None) -> tuple[pd.DataFrame, int]:
        """Neighbours ``at, vec_id, score`` of each query in this shard, ties and the k-th included, where ``at`` is the
        query's place, and the number of scores taken.

        ``known`` has scores that k other ids of earlier shards are known to reach; what is below them may be left out.
        """
        square = np.einsum("ij,ij->i", q, q)
        low, at, score = self._bounds(q, square)
        scores = np.full((len(q), len(self.x)), -np.inf)
        scores[:, at] = score
        rank = np.argsort(np.argsort(low, axis=1, kind="stable"), axis=1, kind="stable")
        need = min((k + SPARE) * self.most, len(self.x))  # so many entries have k ids besides the query's own
        known = np.full(len(q), -np.inf) if known is None else known
        taken, kth = score.size, known
        slack = 1e-9 * np.sqrt(square * self.high)
        for first, last in ((0, 1), (1, 4), (4, 16), (16, 64), (64, len(self.x))):
            worst = np.where(np.isneginf(kth), np.inf, np.sqrt(np.maximum(square + self.high - 2 * np.where(np.isneginf(kth), 0, kth - slack), 0)))
            wanted = (rank >= first) & (rank < last) & (factor * low <= worst[:, None] + 1e-9)
            for j, (lo, hi) in enumerate(self.leaves):
                rows = np.flatnonzero(wanted[:, j])
                if len(rows):
                    scores[rows, lo:hi] = q[rows] @ self.x[lo:hi].T
                    taken += len(rows) * (hi - lo)
            kth = np.maximum(known, np.partition(scores, -need, axis=1)[:, -need])
        row, col = np.nonzero((scores >= (kth - slack)[:, None]) & ~np.isneginf(scores))
        exact = np.zeros(len(row))
        for d in range(q.shape[1]):  # one order of addition, so that equal vectors get equal scores everywhere
            exact += q[row, d] * self.x[col, d]
        times = np.array([len(x) for x in self.ids], dtype=int)[col]
        out = pd.DataFrame({"at": np.repeat(row, times), "vec_id": np.array([i for c in col for i in self.ids[c]], dtype=np.int64), "score": np.repeat(exact, times)})
        return out[query_ids[out["at"]] != out["vec_id"]], taken


def nearest(found: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best ids for each query, each with its best score, ties to the smaller id."""
    found = found.sort_values(["at", "score", "vec_id"], ascending=[True, False, True], kind="stable").drop_duplicates(["at", "vec_id"])
    return found[found.groupby("at").cumcount() < k]


def search_trees(trees: list[Tree], q: np.ndarray, ids: np.ndarray, k: int, factor: float) -> tuple[pd.DataFrame, int]:
    """The nearest of each query in all the trees, and the scores taken; later trees are pruned by what earlier had."""
    best, known, total = None, np.full(len(q), -np.inf), 0
    for tree in trees:
        found, taken = tree.search(q, ids, k, factor, known)
        best, total = nearest(found if best is None else pd.concat([best, found]), k), total + taken
        last = best.groupby("at")["score"].agg(["size", "min"])
        known[last.index] = last["min"].where(last["size"] == k, -np.inf)
    return best, total


def _tree(parts: list[pd.DataFrame]) -> list[Tree]:
    if not parts:
        return []
    own = pd.concat(parts)
    return [Tree(np.stack(own["vector"].to_numpy()), [x.tolist() for x in own["ids"]], own["radius"].to_numpy(float), int(own["most"].iloc[0]))]


def search(index: DataFrame, shards: int, queries: DataFrame, k: int, factor: float, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int = 65_536) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of each usable query row, ties to the smaller id.

    A query is never its own neighbour (nor is any row with its id); with fewer than k others all are returned; null
    ids and unusable vectors take no part; vectors meet only those of their own dimension; other columns are ignored;
    repeated rows, of queries or of the index, count once; of several vectors of one id the best counts. A query goes
    to groups of shards: as many shards as ``TREE_BYTES`` hold, fewer where that would leave cores idle.
    """
    v = F.col(vector_col).cast("array<double>")
    asked = queries.select(F.col(id_col).cast("long").alias("id"), v.alias("vector")).filter(usable(F.col("vector")) & F.col("id").isNotNull()).dropDuplicates(["id", "vector"])
    blocks = max(1, -(-asked.count() // block_rows))
    size = index.groupBy("dim", "shard").agg((F.count(F.lit(1)) * F.col("dim") * 8).alias("bytes")).agg(F.max("bytes")).first()[0] or 1
    busy = 2 * index.sparkSession.sparkContext.defaultParallelism
    groups = min(shards, max(-(-shards * size // TREE_BYTES), -(-busy // blocks)))
    group = F.pmod("shard", F.lit(groups)).cast("int")
    nothing = F.lit(None).cast("double")
    trees = index.select("dim", group.alias("group"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "shard", "pos", "ids", "vector", "radius", "most")
    sent = asked.select(
        F.size("vector").alias("dim"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"),
        F.lit(shards).alias("shard"), F.lit(0).alias("pos"), F.array("id").alias("ids"), "vector", nothing.alias("radius"), F.lit(0).alias("most"),
    )

    def task(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, trees, parts = None, [], []
        for b in batches:
            names = np.column_stack([b[c].to_numpy() for c in ("dim", "group", "block", "shard")])
            cuts = np.flatnonzero(np.append(True, (names[1:] != names[:-1]).any(axis=1))) if len(b) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(b)], strict=True):
                name, part = tuple(names[lo].tolist()), b.iloc[lo:hi]
                if key is not None and name != key:
                    trees += _tree(parts)
                    parts = []
                    if name[:3] != key[:3]:
                        trees = []
                key = name
                if name[3] < shards:
                    parts.append(part)
                    continue
                if trees:
                    q, ids = np.stack(part["vector"].to_numpy()), np.array([x[0] for x in part["ids"]])
                    for i in range(0, len(q), 256):
                        best = search_trees(trees, q[i : i + 256], ids[i : i + 256], k, factor)[0]
                        yield pd.DataFrame({"query_id": ids[i : i + 256][best["at"]], "vec_id": best["vec_id"], "score": best["score"]})

    dealt = trees.unionByName(sent).repartition(min(groups * blocks, 20_000), "dim", "group", "block").sortWithinPartitions("dim", "group", "block", "shard", "pos")
    found = dealt.mapInPandas(task, FOUND).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
