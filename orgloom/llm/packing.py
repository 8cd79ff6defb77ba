"""Packing of documents' token ids into sequences of a fixed capacity.

Both packers read documents as a stream inside each task and need no shuffle. ``pack_online`` keeps a fixed number of
open bins and places a piece at once; ``pack_decreasing`` sorts a window of pieces, longest first, and finds each a
bin through a segment tree over free capacities. Documents longer than the capacity are cut losslessly: all pieces
but the first have the full capacity, the first has the rest.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgloom.llm.byte_bpe import byte_bpe
from orgloom.llm.common import slices

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
PACKED = "sequence_id long, input_ids binary, cu_seqlens array<int>, position_ids binary, doc_ids array<long>, pieces array<int>, starts array<long>"
Encode = Callable[[str], np.ndarray]


class OpenBins:
    """At most ``most`` open bins; a bitset has the bit of every free space that an open bin has.

    The fullest bin that a piece fits into takes it. If none fits, a new bin opens, and if too many are open the
    fullest closes first. A piece of the whole capacity opens and closes its own.
    """

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = self.open = self.made = 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        at = bins.pop()
        if not bins:
            self.bits ^= 1 << free
        self.open -= 1
        return at

    def place(self, length: int) -> tuple[int, int]:
        """The bin and the offset in it of a piece of this length."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            at = self._take(free)
        else:
            free, at = self.capacity, self.made
            self.made += 1
            if length < self.capacity and self.open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
        left = free - length
        if left:
            self.by_free[left].append(at)
            self.bits |= 1 << left
            self.open += 1
        return at, self.capacity - free


class FreeTree:
    """A segment tree over free capacities 0..capacity; a node has the number of bins below it."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, free: int, n: int) -> None:
        at = free + self.size
        while at:
            self.count[at] += n
            at >>= 1

    def least(self, need: int) -> int:
        """The smallest free capacity of at least ``need`` that some bin has, or -1."""
        at = need + self.size
        if self.count[at]:
            return need
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return -1


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """Bin and offset of each piece; the longest are placed first, ties in the given order."""
    tree, bins, made = FreeTree(capacity), [[] for _ in range(capacity + 1)], 0
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        free = tree.least(lengths[i])
        if free < 0:
            free, at = capacity, made
            made += 1
        else:
            at = bins[free].pop()
            tree.add(free, -1)
        out[i] = (at, capacity - free)
        bins[free - lengths[i]].append(at)
        tree.add(free - lengths[i], 1)
    return out


def cut(total: int, capacity: int) -> Iterator[tuple[int, int]]:
    """Start and length of the pieces of a document of so many ids."""
    at = 0
    to = total - (-(-total // capacity) - 1) * capacity
    while at < total:
        yield at, to - at
        at, to = to, to + capacity


def _task_base() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId() << 40


def token_source(json_path: str, ranks_path: str | None, end_id: int) -> Callable[[str], np.ndarray]:
    """A function, made in each worker, from a text to its ids with the end id."""

    def encode(text: str) -> np.ndarray:
        return np.append(byte_bpe(json_path, ranks_path).encode(text), np.uint32(end_id)).astype("<u4")

    return encode


def pack_online(docs: DataFrame, encode: Encode, capacity: int = 1024, open_bins: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece, placed by bounded-space best fit.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: offsets in a sequence are gapless from
    0. Null text counts as empty; a text that gives no ids gives no piece; null and repeated ids are carried as they
    are; other columns are ignored; an empty table gives no rows.
    """

    fields = [x.split() for x in PIECES.split(", ")]

    def written(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, pa.int32() if t == "int" else pa.int64()) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)]
        return pa.RecordBatch.from_arrays(columns, [n for n, _ in fields])

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base, rows = OpenBins(capacity, open_bins), _task_base(), []
        for b in batches:
            for part in slices(b, 1, 8_000_000):
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = encode(text or "")
                    for k, (start, length) in enumerate(cut(len(ids), capacity)):
                        at, offset = bins.place(length)
                        rows.append((doc_id, k, start, length, zlib.crc32(ids[start : start + length].tobytes()), base + at, offset))
                    if len(rows) >= 20_000:
                        yield written(rows)
                        rows = []
        if rows:
            yield written(rows)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(task, PIECES)


def _lists(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), values)


def _matrix(x: np.ndarray) -> pa.Array:
    """The rows of a matrix, each as its bytes."""
    starts = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x[:1].nbytes)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, starts.buffers()[1], pa.py_buffer(x)])


def position_type(capacity: int) -> str:
    """Positions take 16 bits where that is enough, else 32."""
    return "<u2" if capacity <= 1 << 16 else "<u4"


def packed_rows(window: list[tuple], capacity: int, pad_id: int, base: int, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """The sequences of a window of ``(doc_id, piece, start, ids)``, packed by best fit decreasing."""
    length = np.array([len(x[3]) for x in window], np.int64)
    at, offset = np.array(best_fit_decreasing(length.tolist(), capacity), np.int64).reshape(-1, 2).T
    order = np.lexsort((offset, at))
    at, offset, length = at[order], offset[order], length[order]
    places = np.arange(capacity, dtype=position_type(capacity))
    bins = int(at[-1]) + 1 if len(at) else 0
    cuts = np.searchsorted(at, np.append(np.arange(0, bins, rows), bins))
    for first, (lo, hi) in zip(range(0, bins, rows), zip(cuts, cuts[1:])):
        n = min(rows, bins - first)
        ids, position = np.full((n, capacity), pad_id, "<u4"), np.zeros((n, capacity), places.dtype)
        row, seg = at[lo:hi] - first, [window[i] for i in order[lo:hi].tolist()]
        for r, a, m, x in zip(row.tolist(), offset[lo:hi].tolist(), length[lo:hi].tolist(), seg, strict=True):
            ids[r, a : a + m] = x[3]
            position[r, a : a + m] = places[:m]
        count = np.bincount(row, minlength=n)
        ends = np.zeros(hi - lo + n, np.int32)
        ends[np.arange(hi - lo) + row + 1] = offset[lo:hi] + length[lo:hi]
        yield pa.RecordBatch.from_arrays([
            pa.array(base + first + np.arange(n)), _matrix(ids), _lists(pa.array(ends), count + 1), _matrix(position),
            _lists(pa.array([x[0] for x in seg], pa.int64()), count), _lists(pa.array([x[1] for x in seg], pa.int32()), count), _lists(pa.array([x[2] for x in seg], pa.int64()), count),
        ], [x.split()[0] for x in PACKED.split(", ")])


def pack_decreasing(docs: DataFrame, encode: Encode, capacity: int = 1024, pad_id: int = 0, window_tokens: int = 8_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per sequence, packed by best fit decreasing in windows of about ``window_tokens`` ids a task.

    Returns ``sequence_id, input_ids`` (a matrix row of ``capacity`` little-endian unsigned 32-bit ids, padded),
    ``cu_seqlens`` (0, then the end of each segment), ``position_ids`` (a matrix row of ``position_type``, which
    restarts at 0 in each segment and is 0 in the padding), and for each segment ``doc_ids, pieces, starts``. Every id
    of every document is in just one sequence. The rules for odd rows are those of ``pack_online``.
    """

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window, tokens, base = [], 0, _task_base()
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = encode(text or "")
                window += [(doc_id, k, start, ids[start : start + length]) for k, (start, length) in enumerate(cut(len(ids), capacity))]
                tokens += len(ids)
                if tokens >= window_tokens:
                    for out in packed_rows(window, capacity, pad_id, base):
                        base += out.num_rows
                        yield out
                    window, tokens = [], 0
        yield from packed_rows(window, capacity, pad_id, base)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(task, PACKED)


def pieces_of(sequences: DataFrame) -> DataFrame:
    """The segments of packed sequences as rows like those of ``pack_online``."""
    seg = sequences.select("sequence_id", "input_ids", "cu_seqlens", F.posexplode(F.arrays_zip("doc_ids", "pieces", "starts")).alias("k", "s"))
    offset = F.get("cu_seqlens", F.col("k"))
    length = F.get("cu_seqlens", F.col("k") + 1) - offset
    return seg.select(
        F.col("s.doc_ids").alias("doc_id"), F.col("s.pieces").alias("piece"), F.col("s.starts").alias("start"), length.cast("long").alias("length"),
        F.crc32(F.substring("input_ids", offset * 4 + 1, length * 4)).alias("ids_crc32"), "sequence_id", offset.cast("long").alias("offset"),
    )


def write_packed(sequences: DataFrame, path: str) -> None:
    """Write packed sequences as Parquet."""
    sequences.write.mode("overwrite").parquet(path)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``write_packed`` wrote."""
    return spark.read.schema(PACKED).parquet(path)
