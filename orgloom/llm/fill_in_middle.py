"""Fill-in-the-middle documents, cut at unit boundaries through succinct rank and select.

A unit is a line with its newline, or what follows the last newline. All texts of a batch lie one after another in one
buffer of bytes; a packed bit vector marks each unit's last byte, another each character's first. A directory of
popcounts per block answers ``rank`` (units before a byte) and ``select`` (the byte of a unit) without a list of units:
a text's popcount is its number of units, two selects give its byte cuts, and ranks of characters give the lengths of
the parts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgloom.llm.common import slices

# The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_MARKS = [x.encode() for x in (PREFIX, SUFFIX, MIDDLE)]
#: Bytes of packed bits that one entry of the directory counts.
BLOCK = 64


class BitVector:
    """Packed bits with the number of ones before each block."""

    def __init__(self, flags: np.ndarray):
        self.size = len(flags)
        self.packed = np.packbits(flags, bitorder="little")
        ones = np.bitwise_count(np.pad(self.packed, (0, -len(self.packed) % BLOCK))).reshape(-1, BLOCK)
        self.before = np.append(0, np.cumsum(ones.sum(axis=1, dtype=np.int64)))

    @property
    def ones(self) -> int:
        return int(self.before[-1])

    def _block(self, b: int) -> np.ndarray:
        """The ones in each byte of a block, from its first byte to and with each."""
        return np.cumsum(np.bitwise_count(self.packed[b * BLOCK : (b + 1) * BLOCK]), dtype=np.int64)

    def rank(self, at: int) -> int:
        """Ones among the first ``at`` bits."""
        b, byte = at // (8 * BLOCK), at // 8
        n = int(self.before[b]) + int(np.bitwise_count(self.packed[b * BLOCK : byte]).sum(dtype=np.int64))
        return n + (int(self.packed[byte]) & ((1 << at % 8) - 1)).bit_count() if at % 8 else n

    def select(self, k: int) -> int:
        """The place of the one number ``k``, counted from 1."""
        b = int(np.searchsorted(self.before, k)) - 1
        left, upto = k - int(self.before[b]), self._block(b)
        byte = int(np.searchsorted(upto, left))
        left -= int(upto[byte - 1]) if byte else 0
        bits = int(self.packed[b * BLOCK + byte])
        for _ in range(left - 1):
            bits &= bits - 1
        return 8 * (b * BLOCK + byte) + (bits & -bits).bit_length() - 1


def unit_ends(raw: np.ndarray, offsets: np.ndarray) -> BitVector:
    """The last byte of every unit of texts that lie between successive offsets."""
    flags = raw == 10
    flags[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = True
    return BitVector(flags)


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of strings, nulls as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def transformed(texts: pa.Array, draws: list[np.ndarray], fim_percent: int, spm_percent: int) -> list[pa.Array]:
    """``n, form, prefix_chars, middle_chars, output`` of texts, given four draws for each."""
    raw, offsets = _buffers(texts)
    ends, chars = unit_ends(raw, offsets), BitVector((raw & 0xC0) != 0x80)
    data = raw.tobytes()
    out: list[list] = [[], [], [], [], []]
    for lo, hi, h1, h2, h3, h4 in zip(offsets[:-1].tolist(), offsets[1:].tolist(), *(d.tolist() for d in draws), strict=True):
        first = ends.rank(lo)
        n = ends.rank(hi) - first
        text = data[lo:hi]
        if not n or h3 % 100 >= fim_percent or any(m in text for m in _MARKS):
            row = (n, "plain", None, None, text)
        else:
            a, b = (ends.select(first + k) + 1 if k else lo for k in sorted((h1 % (n + 1), h2 % (n + 1))))
            prefix, middle, suffix = data[lo:a], data[a:b], data[b:hi]
            p, s, m = _MARKS
            at = chars.rank(a)
            spm = h4 % 100 < spm_percent
            row = (n, "spm" if spm else "psm", at - chars.rank(lo), chars.rank(b) - at, b"".join([s, suffix, p, prefix, m, middle] if spm else [p, prefix, s, suffix, m, middle]))
        for column, value in zip(out, row, strict=True):
            column.append(value)
    types = (pa.int64(), pa.string(), pa.int64(), pa.int64())
    return [*(pa.array(c, t) for c, t in zip(out, types)), pa.array(out[4], pa.binary()).cast(pa.string())]


def draws(id_col: str, seed: int) -> list[Column]:
    """Four numbers of a row: the first groups of eight hexadecimal digits of the hash of seed and id (null: none)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, fim_percent: int = 100, spm_percent: int = 50, slice_bytes: int = 8_000_000) -> DataFrame:
    """One row per document: ``doc_id, n, form, prefix_chars, middle_chars, output``.

    A document's hash of ``seed`` and id draws two cuts between its n units, whether it is transformed at all
    (``fim_percent``), and whether the suffix comes first (``spm``, ``spm_percent``) or the prefix (``psm``). Empty and
    null texts, and those that hold a mark, stay ``plain``: the text itself, the lengths null. Rows with a null id draw
    by the seed alone; null and repeated ids are carried as they are; other columns are ignored; an empty table gives
    no rows. Whole texts of any length are cut; a task holds ``slice_bytes`` of a batch, or one text, at a time.
    """

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 1, slice_bytes):
                made = transformed(part.column(1), [part.column(i).to_numpy(zero_copy_only=False) for i in range(2, 6)], fim_percent, spm_percent)
                yield pa.RecordBatch.from_arrays([part.column(0), *made], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *draws(id_col, seed))
    return rows.mapInArrow(task, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The exact text of an output. No mark lies inside the parts or across their ends, as texts with marks stay plain
    and no mark has an end that is also its beginning."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm = F.concat(F.get(part, F.lit(1)), F.get(part, F.lit(3)), F.get(part, F.lit(2)))
    spm = F.concat(F.get(part, F.lit(2)), F.get(part, F.lit(3)), F.get(part, F.lit(1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
