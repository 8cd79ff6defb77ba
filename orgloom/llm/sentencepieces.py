"""SentencePiece encoding that keeps offsets, and decoding.

A text is normalised through the model's compiled character map: at each place the longest prefix that the map's
double-array trie knows is replaced, and for every byte of the normalised text the source byte is recorded. The
pieces that the model then finds are projected through that record to byte spans of the original text.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgloom.llm.common import slices

MARK = "▁".encode()
ENCODED = "doc_id long, ids array<int>, begins array<int>, ends array<int>, decoded string"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, span_bytes long"


class CharsMap:
    """The compiled character map: a double-array trie over UTF-8 prefixes, and the strings that replace them."""

    def __init__(self, blob: bytes):
        self.units: list[int] = []
        self.strings = b""
        if blob:
            n = int.from_bytes(blob[:4], "little")
            self.units = np.frombuffer(blob[4 : 4 + n], "<u4").tolist()
            self.strings = blob[4 + n :]

    def longest(self, raw: bytes, at: int) -> tuple[int, int]:
        """Length of the longest known prefix of ``raw[at:]`` and its string's place; (0, 0) if there is none."""
        units, best, place = self.units, 0, 0
        node = self._offset(units[0])
        for i in range(at, len(raw)):
            node ^= raw[i]
            unit = units[node] if node < len(units) else 0
            if unit & 0x800000FF != raw[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                best, place = i + 1 - at, units[node] & 0x7FFFFFFF
        return best, place

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 0x200) >> 6)

    def apply(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The mapped bytes, and for each the source byte its replaced prefix began at."""
        if not self.units:
            return np.frombuffer(raw, np.uint8), np.arange(len(raw), dtype=np.int32)
        out, source, at = bytearray(), [], 0
        while at < len(raw):
            n, place = self.longest(raw, at)
            if n:
                new = self.strings[place : self.strings.index(b"\0", place)]
            else:
                n = 1 + (raw[at] >= 0xC0) + (raw[at] >= 0xE0) + (raw[at] >= 0xF0)
                new = raw[at : at + n]
            out += new
            source += [at] * len(new)
            at += n
        return np.frombuffer(bytes(out), np.uint8), np.array(source, dtype=np.int32)


@dataclass
class Encoding:
    ids: list[int]
    begins: np.ndarray
    ends: np.ndarray


class OffsetEncoder:
    """Ids as the library gives them (an end id, no begin id, no sampling), with byte spans of the original text."""

    def __init__(self, model_path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(self.model.serialized_model_proto())
        self.spec = proto.normalizer_spec
        self.map = CharsMap(self.spec.precompiled_charsmap)
        # kinds of pieces: 2 unknown, 3 control, 6 a byte
        self.width = np.array([0 if p.type == 3 else 1 if p.type == 6 else len(p.piece.encode()) for p in proto.pieces], np.int32)
        self.unknown = self.model.unk_id()
        self.decimal = [str(i) for i in range(len(proto.pieces))]

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and the source byte of each, then the source's length."""
        raw = text.encode()
        chars, source = self.map.apply(raw)
        space = chars == 32
        if self.spec.remove_extra_whitespaces:
            keep = ~space | (np.append(False, ~space[:-1]) if len(space) else space)
            while len(keep) and keep.any() and space[last := int(np.flatnonzero(keep)[-1])]:
                keep[last] = False
            chars, source, space = chars[keep], source[keep], space[keep]
        mark = MARK if self.spec.escape_whitespaces else b" "
        times = np.where(space, len(mark), 1)
        out, source = np.repeat(chars, times), np.repeat(source, times)
        starts = np.cumsum(times) - times
        for k, byte in enumerate(mark):
            out[starts[space] + k] = byte
        if self.spec.add_dummy_prefix and len(chars):
            out, source = np.append(np.frombuffer(mark, np.uint8), out), np.append(np.zeros(len(mark), np.int32), source)
        return out.tobytes(), np.append(source, np.int32(len(raw)))

    def encode(self, text: str) -> Encoding:
        ids = self.model.encode(text, add_bos=False, add_eos=True)
        normal, source = self.normalise(text)
        at = np.asarray(ids, np.int64)
        width = self.width[at]
        if (at == self.unknown).any():
            pieces = self.model.encode(text, out_type=str, add_bos=False, add_eos=True)
            width = np.where(at == self.unknown, [len(p.encode()) for p in pieces], width)
        to = np.cumsum(width)
        if to[-1] != len(normal):
            raise ValueError("the pieces do not cover the normalised text")
        return Encoding(ids, source[to - width], source[to])

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


@functools.lru_cache(maxsize=2)
def offset_encoder(model_path: str) -> OffsetEncoder:
    """The worker's one encoder of this model."""
    return OffsetEncoder(model_path)


#: Bytes of texts whose pieces a task holds at a time.
SLICE_BYTES = 2_000_000
_TYPES = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}


def _run(docs: DataFrame, model_path: str, id_col: str, text_col: str, schema: str, row) -> DataFrame:
    fields = [x.split() for x in schema.split(", ")]

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = offset_encoder(model_path)
        for b in batches:
            for part in slices(b, 1, SLICE_BYTES):
                made = zip(*[row(encoder, text or "") for text in part.column(1).to_pylist()], strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, _TYPES[t]) for c, (_, t) in zip(made, fields[1:], strict=True))], [n for n, _ in fields])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(task, schema)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, ids, begins, ends, decoded``.

    Spans are bytes of the original text, end exclusive; a piece made of what normalisation adds, and the end id,
    have empty spans. Null text counts as empty (only the end id); null and repeated ids are carried as they are;
    other columns are ignored; an empty table gives no rows.
    """

    def row(encoder: OffsetEncoder, text: str) -> tuple:
        e = encoder.encode(text)
        return e.ids, e.begins, e.ends, encoder.decode(e.ids)

    return _run(docs, model_path, id_col, text_col, ENCODED, row)


def encode_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The digests of what ``encode`` gives, made in the same task so that no id leaves it:
    ``doc_id, n_tokens, ids_sha256, decoded_sha256, span_bytes`` (bytes of the text that the spans cover)."""

    def row(encoder: OffsetEncoder, text: str) -> tuple:
        e = encoder.encode(text)
        joined = " ".join(map(encoder.decimal.__getitem__, e.ids))
        return len(e.ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(encoder.decode(e.ids).encode()).hexdigest(), int((e.ends - e.begins).sum())

    return _run(docs, model_path, id_col, text_col, DIGESTS, row)
