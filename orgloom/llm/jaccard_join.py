"""Near-duplicate join of documents by the Jaccard similarity of their word shingles, through a MinHash LSH forest.

1. A text's words give a class key (texts of equal words are copies of one class), distinct shingles, MinHash values,
   and for each tree of the forest the values along its trie.
2. The shortest prefix that the trees must share is where the modelled recall at the threshold reaches its target.
   Classes that share it in a tree meet, sorted as the trie is. There, members of the longest common prefixes are
   linked first by their sketches, then prefixes are shortened and what is still apart is compared.
3. Links of sketches only form candidate clusters. Inside a cluster all classes are compared exactly, every pair
   once, and counted: pairs are never rows. A class is named by what its exact links connect.

Groups too large for one task are cut into chunks, and every pair of chunks meets in a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgloom.llm.common import kept, scratch, slices, stored
from orgloom.llm.components import components

WIDTH = 5
THRESHOLD = 0.8
#: Members of a bucket, and shingles of a cluster, that one task holds from each of two chunks.
CHUNK_MEMBERS = 20_000
CHUNK_SHINGLES = 1_000_000
#: Members times shingles that one task compares, some seconds of work.
CHUNK_WORK = 1_000_000_000


@dataclass(frozen=True)
class Forest:
    """``trees`` prefix trees of ``depth`` MinHash values each."""

    trees: int = 16
    depth: int = 8
    recall: float = 0.999
    threshold: float = THRESHOLD
    #: Standard deviations that an estimate may be below the threshold.
    slack: float = 4.0

    @property
    def shortest(self) -> int:
        """The longest prefix with which a pair at the threshold is met with the target recall."""
        for d in range(self.depth, 1, -1):
            if 1 - (1 - self.threshold**d) ** self.trees >= self.recall:
                return d
        return 1

    @property
    def least_estimate(self) -> float:
        k = self.trees * self.depth
        return self.threshold - self.slack * (self.threshold * (1 - self.threshold) / k) ** 0.5


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(words: list[str], hashes: WordHashes) -> np.ndarray:
    """Distinct hashes of all runs of five words; of fewer words, the hash of them all; none of none."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - WIDTH + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(WIDTH, len(h))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return np.unique(out ^ (out >> np.uint64(32)))


def class_key(words: list[str]) -> bytes:
    return xxhash.xxh3_128_digest(" ".join(words))


def minhash(h: np.ndarray, k: int) -> np.ndarray:
    """The least of each of k multiplicative hashes."""
    rng = np.random.default_rng(20)
    a = rng.integers(1, 1 << 63, k, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(1, 1 << 63, k, dtype=np.uint64)
    out = np.full(k, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(h), 2048):
        out = np.minimum(out, (h[i : i + 2048, None] * a + b).min(axis=0))
    return out >> np.uint64(32)


def _signatures(docs: DataFrame, forest: Forest) -> DataFrame:
    types = (pa.binary(), pa.int32(), pa.binary(), pa.list_(pa.int64()))

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, short = WordHashes(), forest.shortest
        for b in batches:
            for part in slices(b, 1, 8_000_000):
                rows = []
                for known, text in zip(part.column(0).is_valid().to_pylist(), part.column(1).to_pylist(), strict=True):
                    words = text.split() if text else []
                    if not words or not known:
                        rows.append((None, 0, None, None))
                        continue
                    h = shingles(words, hashes)
                    values = minhash(h, forest.trees * forest.depth)
                    prefixes = values.reshape(forest.trees, forest.depth)[:, :short].astype("<u4")
                    buckets = [xxhash.xxh3_64_intdigest(p.tobytes(), seed=t) - (1 << 63) for t, p in enumerate(prefixes)]
                    rows.append((class_key(words), len(h), (values & np.uint64(255)).astype(np.uint8).tobytes(), buckets))
                made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *made], ["doc_id", "key", "size", "sketch", "buckets"])

    return docs.mapInArrow(task, "doc_id long, key binary, size int, sketch binary, buckets array<long>")


def _chunked(rows: DataFrame, chunks: Column, key: str) -> DataFrame:
    """Each row once for every pair of chunks that its own is in: ``lo, hi`` name the pair, ``chunk`` the row's."""
    rows = rows.withColumn("chunks", F.greatest(chunks, F.lit(1)).cast("int")).withColumn("chunk", F.pmod(F.xxhash64(key, F.lit(7)), "chunks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return rows.withColumn("lo", F.least("chunk", "other")).withColumn("hi", F.greatest("chunk", "other"))


def _runs(batches: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of each run of equal keys, from sorted batches."""
    held: list[pd.DataFrame] = []
    last = None
    for b in batches:
        if b.empty:
            continue
        cols = [b[k].to_numpy() for k in keys]
        new = np.append(True, np.any([c[1:] != c[:-1] for c in cols], axis=0))
        cuts = np.flatnonzero(new).tolist()
        for lo, hi in zip(cuts, [*cuts[1:], len(b)], strict=True):
            key = tuple(c[lo] for c in cols)
            if held and key != last:
                yield held[0] if len(held) == 1 else pd.concat(held)
                held = []
            held.append(b.iloc[lo:hi])
            last = key
    if held:
        yield held[0] if len(held) == 1 else pd.concat(held)


def link_run(sketch: np.ndarray, tail: np.ndarray, least: float) -> np.ndarray:
    """Labels of the members of a bucket, linked where their sketches agree enough.

    ``tail`` has each member's values beyond the shared prefix. Members with the longest common prefix are linked
    first; each shortening compares only what is still apart.
    """
    n = len(sketch)
    label = np.arange(n)
    need = int(np.ceil(least * sketch.shape[1] - 1e-9))
    order = np.lexsort(tail.T[::-1]) if tail.shape[1] else np.arange(n)
    for depth in range(tail.shape[1], -1, -1):
        t = tail[order][:, :depth]
        cuts = np.flatnonzero(np.append(True, (t[1:] != t[:-1]).any(axis=1))) if depth else np.array([0])
        for lo, hi in zip(cuts, [*cuts[1:], n], strict=True):
            if hi - lo > 1:
                _spread(order[lo:hi], sketch, label, need)
    return label


def _spread(group: np.ndarray, sketch: np.ndarray, label: np.ndarray, need: int) -> None:
    """Join the labels of a group's members by search from one label after another."""
    apart = group
    while len(apart) > 1:
        own = label[apart] == label[apart[0]]
        front, apart = apart[own].tolist(), apart[~own]
        name = label[front[0]]
        while front and len(apart):
            near = (sketch[apart] == sketch[front.pop()]).sum(axis=1) >= need
            if near.any():
                met = np.isin(label, np.unique(label[apart[near]]))
                moved = np.isin(label[apart], np.unique(label[apart[near]]))
                front += apart[moved].tolist()
                label[met] = name
                apart = apart[~moved]


def exact_links(sets: list[np.ndarray], left: np.ndarray | None, threshold: float) -> Iterator[tuple[int, np.ndarray]]:
    """For each member the later members at the threshold or above; every pair is met once.

    With two sides, where ``left`` marks one of them, only pairs of a left and a right member are met.
    """
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    flag = np.zeros(int(ids.max()) + 1, np.int32)
    for i in range(len(sets)) if left is None else np.flatnonzero(left):
        own = ids[starts[i] : starts[i] + sizes[i]]
        first = i + 1 if left is None else 0
        if first == len(sets):
            break
        flag[own] = 1
        shared = np.add.reduceat(flag[ids[starts[first] :]], starts[first:] - starts[first])
        flag[own] = 0
        hit = shared >= threshold * (sizes[i] + sizes[first:] - shared) - 1e-9
        if left is not None:
            hit &= ~left
        yield i, np.flatnonzero(hit) + first


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", forest: Forest | None = None) -> DataFrame:
    """One row per input row: ``doc_id, class_id, n_links, n_copies``.

    ``class_id`` is the smallest id among all documents that chains of links or copies connect. ``n_links`` counts
    the other rows, copies included, whose similarity is at the threshold or above. Words are what white space
    separates; fewer than five words count as one shingle. Null ids, and texts without words, link to nothing: the
    class is the own id, links 0, copies 1. Repeated ids are separate rows. Other columns are ignored; an empty table
    gives no rows.
    """
    with scratch(docs.sparkSession):
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        return kept(_joined(rows, forest or Forest()), "near-duplicates")


def _joined(rows: DataFrame, forest: Forest) -> DataFrame:
    signed = stored(_signatures(rows, forest), "signatures")
    classes = stored(
        signed.filter("key IS NOT NULL").groupBy("key").agg(
            F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("buckets").alias("buckets"),
        ), "classes",
    )
    clusters = stored(components(_candidates(classes, forest)), "clusters")
    checked = stored(_verified(rows, classes, clusters, forest), "verified")
    named = components(checked.filter("root IS NOT NULL").select(F.col("key").alias("a"), F.col("root").alias("b")))
    links = checked.groupBy("key").agg(F.sum("links").alias("links"))
    full = classes.select("key", "first_id", "copies").join(named.withColumnRenamed("node", "key"), "key", "left").join(links, "key", "left")
    full = stored(full.withColumn("component", F.coalesce("component", "key")), "linked")
    names = full.groupBy("component").agg(F.min("first_id").alias("class_id"))
    full = full.join(names, "component").select("key", "class_id", F.coalesce("links", F.lit(0)).alias("links"), "copies")
    out = signed.select("doc_id", "key").join(full, "key", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"), F.coalesce("copies", F.lit(1)).alias("n_copies"))


def _candidates(classes: DataFrame, forest: Forest) -> DataFrame:
    """Edges ``a, b`` that span what the sketches of bucket members connect."""
    keys = classes.select("key", F.posexplode("buckets").alias("tree", "bucket"))
    shared = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    met = stored(keys.join(shared, "bucket"), "buckets").join(classes.select("key", "sketch"), "key")
    met = _chunked(met, F.ceil(F.col("members") / CHUNK_MEMBERS), "key")
    least, depth, short = forest.least_estimate, forest.depth, forest.shortest

    def task(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = [], []
        for run in _runs(batches, ["bucket", "lo", "hi"]):
            if len(run) > 1:
                sketch = np.frombuffer(b"".join(run["sketch"]), np.uint8).reshape(len(run), -1)
                at = int(run["tree"].iloc[0]) * depth
                label, key = link_run(sketch, sketch[:, at + short : at + depth], least), run["key"].to_numpy()
                linked = np.flatnonzero(label != np.arange(len(run)))
                a += key[linked].tolist()
                b += key[label[linked]].tolist()
            if len(a) > 20_000:
                yield pd.DataFrame({"a": a, "b": b})
                a, b = [], []
        yield pd.DataFrame({"a": a, "b": b})

    dealt = met.select("bucket", "tree", "lo", "hi", "key", "sketch").repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "key")
    return dealt.mapInPandas(task, "a binary, b binary").distinct()


def _verified(rows: DataFrame, classes: DataFrame, clusters: DataFrame, forest: Forest) -> DataFrame:
    """``key, links, root``: exact links of a class, counted in rows, and a class that they connect it to."""
    known = clusters.withColumnRenamed("node", "key").join(classes.select("key", "first_id", "copies", "size"), "key")
    mass, members = F.sum("size").cast("double"), F.count(F.lit(1))
    parts = known.groupBy("component").agg(F.greatest(F.ceil(mass / CHUNK_SHINGLES), F.ceil(F.sqrt(members * mass / CHUNK_WORK))).alias("parts"))
    known = known.join(parts, "component").select("component", "key", "copies", "parts", F.col("first_id").alias("doc_id"))
    known = _chunked(known.join(rows.hint("merge"), "doc_id"), F.col("parts"), "key")
    threshold = forest.threshold

    def task(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, out = WordHashes(), []
        for run in _runs(batches, ["component", "lo", "hi"]):
            keys, copies, sets, left, seen = [], [], [], [], set()
            for key, n, text, chunk, lo in zip(run["key"], run["copies"], run["text"], run["chunk"], run["lo"], strict=True):
                words = (text or "").split()
                if key not in seen and class_key(words) == key:  # another row may have the same id
                    seen.add(key)
                    keys.append(key)
                    copies.append(n)
                    sets.append(shingles(words, hashes))
                    left.append(chunk == lo)
            if len(keys) < 2:
                continue
            weight, links, root = np.array(copies), np.zeros(len(keys), np.int64), list(range(len(keys)))

            def find(x: int, root: list[int] = root) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            one_chunk = run["lo"].iloc[0] == run["hi"].iloc[0]
            for i, hit in exact_links(sets, None if one_chunk else np.array(left), threshold):
                links[i] += weight[hit].sum()
                links[hit] += weight[i]
                for j in hit.tolist():
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
            out += [(k, int(n), keys[r] if (r := find(i)) != i else None) for i, (k, n) in enumerate(zip(keys, links, strict=True)) if n]
            if len(out) > 20_000:
                yield pd.DataFrame(out, columns=["key", "links", "root"])
                out = []
        yield pd.DataFrame(out, columns=["key", "links", "root"])

    dealt = known.select("component", "lo", "hi", "chunk", "key", "copies", "text").repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi", "key")
    return dealt.mapInPandas(task, "key binary, links long, root binary")
