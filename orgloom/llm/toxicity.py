"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A document's features count, for each n-gram of characters, the places in its distinct words that hold it (words in
lower case, marked at both ends; no n-gram crosses a word's end; n-grams are hashed to a fixed number of buckets).
Each count is scaled by the log ratio of the n-gram's smoothed document shares in toxic and clean training documents,
and a logistic regression is fitted on the scaled counts. As a score is then a sum over distinct words, the matrix of
training features is held as the product of a matrix of documents by words and one of words by n-grams, whole and
small, and a worker scores each frequent word once.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orgloom.llm.common import sliced, smallest

SIZES = (3, 4, 5)
BITS = 20
#: Words that a worker remembers the sums of; it only saves time.
CACHE_WORDS = 200_000


def _ngrams(words: list[str], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each n: the buckets of all n-grams of the words, the words' first places, and which places hold one."""
    line = "\x00" + "\x00".join(words) + "\x00" * max(SIZES)
    code = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.cumsum(lengths) - lengths
    n_at = int(lengths.sum())
    left = np.repeat(starts + lengths, lengths) - np.arange(n_at)  # characters up to the word's end mark
    for n in SIZES:
        h = np.zeros(n_at, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + code[k : k + n_at] + np.uint64(n)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        yield (h >> np.uint64(64 - bits)).astype(np.int64), starts, left >= n - 1


@dataclass
class NgramModel:
    """Weights of buckets, and the intercept."""

    weights: np.ndarray
    bias: float
    bits: int = BITS

    def word_sums(self, words: list[str]) -> np.ndarray:
        total = np.zeros(len(words))
        for buckets, starts, holds in _ngrams(words, self.bits):
            total += np.add.reduceat(np.where(holds, self.weights[buckets], 0.0), starts)
        return total


def distinct_words(text: str | None) -> set[str]:
    return set(text.lower().split()) if text else set()


def sampled(docs: DataFrame, labels: DataFrame, label_col: str, max_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``text, y`` of at most ``max_rows`` labelled documents, those whose hashed id is smallest.

    Labels are sampled first, so what is broadcast to the scan of the texts has at most ``max_rows`` rows. Of rows
    with one id the least text counts, and of an id's labels the largest.
    """
    ids = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    ids = smallest(ids.withColumn("h", F.xxhash64(F.col("id").cast("string"))), "h", max_rows).select("id", "y")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(ids), "id").groupBy("id", "y").agg(F.min("text").alias("text")).select("text", "y")


#: Words whose n-grams are gone through at a time while fitting; it only bounds memory.
PART_WORDS = 20_000


@dataclass
class Features:
    """Counts of n-grams in documents as two sparse matrices: documents by words, and words by n-grams (the n-grams of
    word i are ``gram[first[i]:first[i + 1]]``; every word has some)."""

    doc: np.ndarray
    word: np.ndarray
    docs: int
    gram: np.ndarray
    first: np.ndarray
    grams: int

    def _parts(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        words = len(self.first) - 1
        for lo in range(0, words, PART_WORDS):
            hi = min(lo + PART_WORDS, words)
            yield lo, hi, self.gram[self.first[lo] : self.first[hi]], self.first[lo : hi + 1] - self.first[lo]

    def times(self, w: np.ndarray) -> np.ndarray:
        """The sum of a document's n-grams weighted by ``w``."""
        sums = np.zeros(len(self.first) - 1)
        for lo, hi, gram, first in self._parts():
            sums[lo:hi] = np.add.reduceat(w[gram], first[:-1])
        return np.bincount(self.doc, sums[self.word], self.docs)

    def back(self, x: np.ndarray) -> np.ndarray:
        """The sum over documents, weighted by ``x``, of an n-gram's counts."""
        held, out = np.bincount(self.word, x[self.doc], len(self.first) - 1), np.zeros(self.grams)
        for lo, hi, gram, first in self._parts():
            out += np.bincount(gram, np.repeat(held[lo:hi], np.diff(first)), self.grams)
        return out

    def holders(self, y: np.ndarray) -> np.ndarray:
        """Of each class the documents that hold an n-gram at all."""
        out = np.zeros((2, self.grams))
        first = self.first.tolist()
        cuts = np.searchsorted(self.doc, np.arange(self.docs + 1))
        for d in range(self.docs):
            held = [self.gram[first[w] : first[w + 1]] for w in self.word[cuts[d] : cuts[d + 1]].tolist()]
            if held:
                out[int(y[d]), np.unique(np.concatenate(held))] += 1
        return out


def features(texts: Iterable[str | None], bits: int = BITS) -> tuple[Features, np.ndarray]:
    """All features of the texts, and the bucket of each n-gram."""
    place: dict[str, int] = {}
    doc, word = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    n = 0
    for n, text in enumerate(texts, 1):
        own = [place.setdefault(w, len(place)) for w in sorted(distinct_words(text))]
        word.append(np.array(own, np.int32))
        doc.append(np.full(len(own), n - 1, np.int32))
    words, buckets, times = list(place), [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    for at in range(0, len(words), PART_WORDS):
        part = words[at : at + PART_WORDS]
        lengths = np.fromiter(map(len, part), np.int64, len(part)) + 1
        holder = np.repeat(np.arange(len(part), dtype=np.int32), lengths)
        found = [(holder[holds], b[holds].astype(np.int32)) for b, _, holds in _ngrams(part, bits)]
        holder = np.concatenate([h for h, _ in found])
        buckets.append(np.concatenate([b for _, b in found])[np.argsort(holder, kind="stable")])
        times.append(np.bincount(holder, minlength=len(part)))
    bucket = np.concatenate(buckets)
    used = np.flatnonzero(np.bincount(bucket, minlength=1 << bits))
    number = np.zeros(1 << bits, np.int32)
    number[used] = np.arange(len(used))
    return Features(np.concatenate(doc), np.concatenate(word), n, number[bucket], np.cumsum(np.concatenate(times)), len(used)), used


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", max_rows: int = 4000, bits: int = BITS, ridge: float = 1e-3, max_bytes: int = 48_000_000) -> NgramModel:
    """Fit on at most ``max_rows`` labelled documents of each class, the ones whose hashed id is smallest.

    ``max_rows`` and ``max_bytes`` are the documented bounds of what reaches the driver of a class, each text as its
    distinct words: those texts count, by their hash, that come before so many bytes are full. Every n-gram of them is
    a feature, counted as in scoring. The intercept is corrected to the classes' shares among all
    labels. Rows without a label are ignored, null texts count as empty; with no rows of either class every score is
    that class's share.
    """
    shares = {r["y"]: r["n"] for r in labels.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(label_col).cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not shares.get(0) or not shares.get(1):
        return NgramModel(np.zeros(1 << bits, np.float32), 20.0 if shares.get(1) else -20.0, bits)

    def distinct(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"text": [" ".join(sorted(distinct_words(x))) for x in b["text"]], "y": b["y"]})

    parts = [sampled(docs, labels.filter(F.col(label_col) == y), label_col, max_rows) for y in (0, 1)]
    rows = parts[0].unionByName(parts[1]).mapInPandas(distinct, "text string, y int")
    before = Window.partitionBy("y").orderBy(F.xxhash64("text"), "text").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("full", F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0))).filter(F.col("full") < max_bytes)
    got = rows.select("text", "y").toPandas().sort_values(["y", "text"], ignore_index=True)
    y = got["y"].to_numpy(float)
    if len(got) == 0 or y.min() == y.max():
        return NgramModel(np.zeros(1 << bits, np.float32), float(np.log(shares[1] / shares[0])), bits)
    return train(got["text"], y, float(np.log(shares[1] / shares[0])), bits, ridge)


def train(texts: Iterable[str | None], y: np.ndarray, log_odds: float, bits: int = BITS, ridge: float = 1e-3) -> NgramModel:
    """The model of texts of both classes, where ``log_odds`` of label 1 hold among all labels."""
    counts, used = features(texts, bits)
    clean, toxic = counts.holders(y)
    n = len(y) - y.sum(), y.sum()
    ratio = np.log((toxic + 1) / (n[1] + 2)) - np.log((clean + 1) / (n[0] + 2))
    weights, bias = _logistic(counts, ratio, y, ridge)
    out = np.zeros(1 << bits, np.float32)
    out[used] = weights * ratio
    return NgramModel(out, float(bias + log_odds - np.log(n[1] / n[0])), bits)


def _logistic(x: Features, scale: np.ndarray, y: np.ndarray, ridge: float, rounds: int = 12, inner: int = 20) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps, each solved by conjugate gradients."""
    n = len(y)
    w = np.zeros(len(scale) + 1)  # the last is the intercept
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    keep = np.append(np.full(len(scale), ridge), 0.0)

    def rows(v: np.ndarray) -> np.ndarray:
        return x.times(scale * v[:-1]) + v[-1]

    def columns(r: np.ndarray) -> np.ndarray:
        return np.append(scale * x.back(r), r.sum()) / n

    def loss(z: np.ndarray, v: np.ndarray) -> float:
        return float((np.logaddexp(0, z) - y * z).mean() + (keep * v * v).sum() / 2)

    z = rows(w)
    start = None
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
        curve = p * (1 - p)
        rest = -columns(p - y) - keep * w
        own = np.append(scale * scale * x.back(curve), curve.sum()) / n + keep + 1e-9  # about the diagonal of the curvature
        size = rest @ (rest / own)
        start = start or size
        if size <= 1e-8 * start:
            break
        step, way, first = np.zeros_like(w), rest / own, size
        for _ in range(inner):
            moved = columns(curve * rows(way)) + keep * way
            along = size / max(way @ moved, 1e-300)
            step, rest = step + along * way, rest - along * moved
            size, old = rest @ (rest / own), size
            if size <= 1e-3 * first:
                break
            way = rest / own + size / old * way
        ahead, here, share = rows(step), loss(z, w), 1.0
        while loss(z + share * ahead, w + share * step) > here and share > 1e-3:
            share /= 2
        w, z = w + share * step, z + share * ahead
    return w[:-1], float(w[-1])


class Scorer:
    """Chances of texts, in a worker; frequent words' sums are remembered."""

    def __init__(self, model: NgramModel):
        self.model, self.known = model, {}

    def __call__(self, texts: pa.Array) -> pa.Array:
        z = []
        for part in sliced(texts):
            split = [distinct_words(x) for x in part]
            new = list({w for words in split for w in words if w not in self.known})
            for i in range(0, len(new), PART_WORDS):
                some = new[i : i + PART_WORDS]
                self.known.update(zip(some, self.model.word_sums(some).tolist(), strict=True))
            z += [math.fsum(map(self.known.__getitem__, words)) for words in split]
            if len(self.known) > CACHE_WORDS:
                self.known = {}
        return pa.array(1 / (1 + np.exp(-np.clip(np.array(z) + self.model.bias, -35, 35))), pa.float64())


def score(docs: DataFrame, model: NgramModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score``: the chance that a whole text is toxic; null and empty texts get the intercept's.

    Null and repeated ids are carried as they are, other columns are ignored, an empty table gives no rows. The model
    that is broadcast has a fixed size, whatever the data.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scorer(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), scores(b.column(1))], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(task, "doc_id long, score double")


def with_score(docs: DataFrame, model: NgramModel, text_col: str = "text") -> DataFrame:
    """The rows as they are, with a ``score`` in place of any column of that name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.drop("score")
    at, schema = rows.columns.index(text_col), T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Scorer(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, scores(b.column(at))], [*b.schema.names, "score"])

    return rows.mapInArrow(task, schema)


def word_value(model: NgramModel, word: str) -> float:
    """What one word adds to a document's log odds."""
    return float(model.word_sums([word.lower()])[0])


def held_out(key: Column, parts: int, part: int) -> Column:
    """Whether a row is kept from training: CRC-32 of the key as text, modulo ``parts``; a null key is not."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == part, F.lit(False))
