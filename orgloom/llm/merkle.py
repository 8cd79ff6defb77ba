"""Document fingerprints: a Merkle tree over leaves, paragraphs and sections.

A paragraph is a line; what follows a blank line, and a line that begins with a number sign, begins a section. A
paragraph is cut into leaves of a few words, after words that a hash of their last bytes chooses, so that a change
moves no cut but those beside it. Leaves, with the white space behind them, make up the whole text. A leaf's digest is
the 128-bit hash of its bytes, a branch's that of its children's digests. The fingerprint is the root, which only equal
texts share, and short digests of all nodes: two fingerprints are compared branch by branch, from the sections
downwards, and only branches that differ are opened.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgloom.llm.common import slices

#: A word ends its leaf with a chance of one in so many, if the word before it does not.
CUT = 4
#: Words of more bytes are cut after so many.
LONG_WORD = 24
#: Mix the last bytes of a word.
FACTORS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)
#: Bytes of texts, or one text, that a task cuts together.
SLICE_BYTES = 1_000_000
#: Hexadecimal digits of a node in the fingerprint, and bytes of a whole digest.
SHORT, WHOLE = 8, 16
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def starts_of(raw: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where leaves, paragraphs and sections begin in texts, none empty, that lie one after another from the places
    ``texts`` on."""
    first = np.zeros(len(raw), bool)
    first[texts] = True
    white, newline = _WHITE[raw], raw == 10
    begins, ending = ~white, ~white
    begins[1:] &= white[:-1] | first[1:]
    ending[:-1] &= white[1:] | first[1:]
    words, ends = np.flatnonzero(begins), np.flatnonzero(ending)
    own = texts[np.searchsorted(texts, words, side="right") - 1]  # where the word's text begins
    mixed = np.zeros(len(ends), np.uint32)
    for back, factor in enumerate(FACTORS):
        mixed ^= np.where(ends - back >= own, raw[np.maximum(ends - back, 0)], 0).astype(np.uint32) * np.uint32(factor)
    chosen = (mixed >> np.uint32(16)) % CUT == 0
    chosen[1:] &= ~chosen[:-1] | (own[1:] != own[:-1])
    line = first.copy()
    line[1:] |= newline[:-1]
    places = np.flatnonzero(begins | line)
    after = np.searchsorted(places, ends[chosen], side="right")
    leaf = line.copy()
    leaf[places[after[after < len(places)]]] = True
    for i in np.flatnonzero(ends - words >= LONG_WORD).tolist():
        leaf[words[i] + LONG_WORD : ends[i] + 1 : LONG_WORD] = True
    lines = np.flatnonzero(line)
    blank = np.add.reduceat(~white, lines, dtype=np.int64) == 0
    top = raw[lines] == ord("#")
    top[1:] |= blank[:-1]
    top &= ~blank
    return np.flatnonzero(leaf), lines, lines[top | first[lines]]


def _digests(parts: bytes, starts: list[int], level: int) -> bytes:
    """Digests of branches, each of the children from its start to the next one's."""
    return b"".join([xxhash.xxh3_128_digest(parts[WHOLE * a : WHOLE * b], seed=level) for a, b in zip(starts, starts[1:], strict=False)])


def _short(digests: bytes) -> list[str]:
    text = digests.hex()
    return [text[i : i + SHORT] for i in range(0, len(text), 2 * WHOLE)]


@dataclass
class Fingerprint:
    """The root, and the short digests of sections, paragraphs and leaves; branches know their first children."""

    root: str
    sections: list[str]
    paragraphs: list[str]
    leaves: list[str]
    first_paragraph: list[int]
    first_leaf: list[int]

    @classmethod
    def of_all(cls, texts: list[str]) -> list[Fingerprint]:
        """The fingerprints of some texts, which are cut together."""
        full = [x.encode("utf-8", "surrogatepass") for x in texts]
        data = b"".join(full)
        sizes = np.array([len(x) for x in full], np.int64)
        starts = np.cumsum(sizes) - sizes
        if not data:
            return [cls(hashlib.blake2b(b"", digest_size=WHOLE).hexdigest(), [], [], [], [], []) for _ in texts]
        cut = starts_of(np.frombuffer(data, np.uint8), starts[sizes > 0])
        places = np.append(cut[0], len(data)).tolist()
        under = [np.searchsorted(x, y).tolist() for x, y in ((cut[0], cut[1]), (cut[1], cut[2]))]
        bounds = [np.searchsorted(x, np.append(starts, len(data))).tolist() for x in cut]
        leaves = b"".join([xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(places, places[1:], strict=False)])
        paragraphs = _digests(leaves, [*under[0], len(cut[0])], 1)
        sections = _digests(paragraphs, [*under[1], len(cut[1])], 2)
        names = [_short(x) for x in (leaves, paragraphs, sections)]
        out = []
        for (la, lb), (pa_, pb), (sa, sb) in zip(*(zip(x, x[1:], strict=False) for x in bounds), strict=True):
            root = hashlib.blake2b(sections[WHOLE * sa : WHOLE * sb], digest_size=WHOLE).hexdigest()
            out.append(cls(root, names[2][sa:sb], names[1][pa_:pb], names[0][la:lb], [x - pa_ for x in under[1][sa:sb]], [x - la for x in under[0][pa_:pb]]))
        return out

    @classmethod
    def of(cls, text: str) -> Fingerprint:
        return cls.of_all([text])[0]

    @classmethod
    def parse(cls, written: str) -> Fingerprint:
        root, _, rest = written.partition(":")
        out = cls(root, [], [], [], [], [])
        for section in rest.split("/") if rest else []:
            name, _, paragraphs = section.partition("=")
            out.sections.append(name)
            out.first_paragraph.append(len(out.paragraphs))
            for p in paragraphs.split(","):
                out.paragraphs.append(p[:SHORT])
                out.first_leaf.append(len(out.leaves))
                out.leaves += [p[i : i + SHORT] for i in range(SHORT, len(p), SHORT)]
        return out

    def __str__(self) -> str:
        """``root:section=paragraph,paragraph/section=…``; a paragraph is its digest and those of its leaves."""
        at = [*self.first_leaf, len(self.leaves)]
        paragraphs = [p + "".join(self.leaves[a:b]) for p, a, b in zip(self.paragraphs, at, at[1:], strict=False)]
        tops = [*self.first_paragraph, len(paragraphs)]
        return f"{self.root}:" + "/".join(f"{s}=" + ",".join(paragraphs[a:b]) for s, a, b in zip(self.sections, tops, tops[1:], strict=False))


def _lacking(own: list[int], names: list[str], other: list[int], other_names: list[str]) -> list[int]:
    """The nodes among ``own`` whose digests the other side lacks, copies counted."""
    there = Counter([other_names[i] for i in other])
    out = []
    for i in own:
        left = there[names[i]]
        if left:
            there[names[i]] = left - 1
        else:
            out.append(i)
    return out


def _children(nodes: list[int], first: list[int], total: int) -> list[int]:
    return [j for i in nodes for j in range(first[i], first[i + 1] if i + 1 < len(first) else total)]


def differing(a: Fingerprint, b: Fingerprint) -> tuple[list[int], list[int]]:
    """The numbers of the leaves of either that the other lacks. Only branches that differ are opened: first sections,
    then their paragraphs, then their leaves, each level's matched wherever they stand."""
    if a.root == b.root:
        return [], []
    x, y = list(range(len(a.sections))), list(range(len(b.sections)))
    x, y = _lacking(x, a.sections, y, b.sections), _lacking(y, b.sections, x, a.sections)
    x, y = _children(x, a.first_paragraph, len(a.paragraphs)), _children(y, b.first_paragraph, len(b.paragraphs))
    x, y = _lacking(x, a.paragraphs, y, b.paragraphs), _lacking(y, b.paragraphs, x, a.paragraphs)
    x, y = _children(x, a.first_leaf, len(a.leaves)), _children(y, b.first_leaf, len(b.leaves))
    return _lacking(x, a.leaves, y, b.leaves), _lacking(y, b.leaves, x, a.leaves)


def likeness(a: Fingerprint, b: Fingerprint, gone: tuple[list[int], list[int]] | None = None) -> float:
    """The share of both fingerprints' leaves that lie in equal nodes: 1 if the roots are equal, else below."""
    if a.root == b.root:
        return 1.0
    both = len(a.leaves) + len(b.leaves)
    left, right = gone or differing(a, b)
    return 1.0 - max(0.5, len(left) + len(right)) / both


def located(text: str, leaves: list[int]) -> list[tuple[int, int]]:
    """The spans of a text (code points, end exclusive) that these leaves cover, adjacent ones joined. A code point
    that a leaf cuts counts to the leaf where it begins."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    at = np.append(starts_of(raw, np.zeros(1, np.int64))[0], len(raw))
    chars = np.append(0, np.cumsum((raw & 0xC0) != 0x80))[at].tolist()
    out: list[tuple[int, int]] = []
    for i in sorted(leaves):
        if out and out[-1][1] == chars[i]:
            out[-1] = (out[-1][0], chars[i + 1])
        else:
            out.append((chars[i], chars[i + 1]))
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_chars, fingerprint``. Null text counts as empty; null and repeated ids are
    carried as they are; other columns are ignored; an empty table gives no rows."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 1, SLICE_BYTES):
                texts = [x or "" for x in part.column(1).to_pylist()]
                columns = [part.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array([str(x) for x in Fingerprint.of_all(texts)], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "fingerprint"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(task, "doc_id long, n_chars long, fingerprint string")


def in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``slot, tail, doc_id, text`` in sorted partitions by ascending id: each has the rows of one range of ids and
    then, as ``tail``, the rows with the next id, so that every row finds the next in its own task.

    Ids alone are read for the ranges, whose number is that of the shuffle's partitions; texts are shuffled once. Null
    ids come last. Rows with one id stand in the order of their texts; after the last row comes the first again.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ids = rows.select("doc_id")
    cuts = ids.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 100 * parts)).first()[0] or [0]
    splits = [-float("inf"), *sorted({float(x) for x in cuts}), float("inf")]
    slots = Bucketizer(splits=splits, inputCol="at", outputCol="slot")

    def placed(df: DataFrame) -> DataFrame:
        return slots.transform(df.withColumn("at", F.col("doc_id").cast("double"))).drop("at").withColumn("slot", F.coalesce(F.col("slot"), F.lit(len(splits))).cast("int"))

    firsts = sorted(placed(ids).groupBy("slot").agg(F.min("doc_id").alias("first")).collect())  # a row per partition
    firsts = [(slot, first, firsts[i - 1][0]) for i, (slot, first) in enumerate(firsts)]
    known = spark.createDataFrame(firsts, "slot int, first long, before int")
    own = F.struct(F.col("slot"), F.lit(False).alias("tail"))
    also = F.struct(F.col("before").alias("slot"), F.lit(True).alias("tail"))
    dealt = placed(rows).join(F.broadcast(known), "slot").select("doc_id", "text", F.explode(F.when(F.col("doc_id").eqNullSafe(F.col("first")), F.array(own, also)).otherwise(F.array(own))).alias("s"))
    dealt = dealt.select("s.slot", "s.tail", "doc_id", "text").repartitionById(len(splits) + 1, F.col("slot"))
    return dealt.sortWithinPartitions("slot", "tail", F.col("doc_id").asc_nulls_last(), "text")


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, first_edit long"


def compared_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next document.

    The edited text has the last half of the code points (rounded down) replaced by the first as many, or all, of the
    next document by ascending id. Returns the columns of ``EDITED``; ``first_edit`` is where the first leaf begins
    that the edited text lacks (null if there is none). Null text counts as empty, whose fingerprint is like that of
    empty texts alone; null ids come last, rows with one id in the order of their texts; a single row is its own next
    one; other columns are ignored; an empty table gives no rows. A task holds two documents and a batch at a time.
    """
    fields = [x.split() for x in EDITED.split(", ")]

    def rows_of(pairs: list[tuple]) -> list[tuple]:
        halves = [(text, len(text) - len(text) // 2, after) for _, text, _, after, _ in pairs]
        edited = [text[:keep] + after[: len(text) - keep] for text, keep, after in halves]
        out = []
        for (doc_id, text, own, _, other), new, made in zip(pairs, edited, Fingerprint.of_all(edited), strict=True):
            gone = differing(own, made)
            first = located(text, gone[0][:1])[0][0] if gone[0] else None
            out.append((doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), str(own), str(made), likeness(own, made, gone), likeness(own, other), first))
        return out

    def written(rows: list[tuple]) -> pa.RecordBatch:
        types = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
        return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, done = None, None
        for b in batches:
            for part in slices(b, 3, SLICE_BYTES):
                columns, pairs = [c.to_pylist() for c in part.columns], []
                for slot, tail, doc_id, text, own in zip(*columns, Fingerprint.of_all(columns[3]), strict=True):
                    if tail and done == slot:  # more rows with the next id
                        continue
                    if last is not None and last[0] == slot:
                        pairs.append((*last[1:], text, own))
                    last, done = (None, slot) if tail else ((slot, doc_id, text, own), done)
                if pairs:
                    yield written(rows_of(pairs))

    return in_order(docs, id_col, text_col).mapInArrow(task, EDITED)
