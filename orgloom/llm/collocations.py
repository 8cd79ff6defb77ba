"""Collocations: frequent phrases found through vertical positional inverted lists.

Texts of a language are cut into blocks, and in a block every word has the list of the positions where it stands; ends
of pieces and documents leave a gap. Lists are rows of a table. The length of a phrase's lists over all blocks is its
exact frequency. For each length of phrases the lists of frequent words, as every word of a frequent phrase is, are
brought together by block and merge-joined with the lists of what stands at the next positions. Only the lengths of the
joined lists leave a task, at most a row an occurrence: how many phrases pass the least frequency grows faster than the
text, so their own lists are neither kept nor joined with frequencies. Frequencies of words are joined to lists by
shuffles, so no vocabulary is held in one place, and a word that is everywhere has one row a block only.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orgloom.llm.common import outside, scratch, slices, stored

#: Words of a language's block, and of all blocks that a task has open.
BLOCK_WORDS, OPEN_WORDS = 2_000_000, 4_000_000
#: Bytes of texts that a task splits at a time.
SLICE_BYTES = 4_000_000
# What ends a piece, and what lies between words.
_TOKEN = re.compile("[^ \t.,;:!?\x0a-\x0d]+|[.,;:!?\x0a-\x0d]+")
_ENDS = frozenset(".,;:!?\x0a\x0b\x0c\x0d")
_LOWER = {c: c + 32 for c in range(65, 91)}
UNKNOWN = "und"


class Vocabulary(dict):
    """Numbers of words in the order they come; what ends a piece is -1."""

    def __init__(self) -> None:
        super().__init__()
        self.words: list[str] = []

    def __missing__(self, word: str) -> int:
        if word[0] in _ENDS:
            value = -1
        else:
            value = len(self.words)
            self.words.append(word)
        self[word] = value
        return value


class OpenBlock:
    """Words of one language as numbers, -1 between pieces and documents."""

    def __init__(self) -> None:
        self.vocabulary, self.parts, self.size = Vocabulary(), [], 0

    def add(self, text: str) -> None:
        numbers = [self.vocabulary[w] for w in _TOKEN.findall(text.translate(_LOWER) if not text.isascii() else text.lower())]
        if numbers:
            self.parts.append(np.array([*numbers, -1], np.int32))
            self.size += len(numbers) + 1

    def lists(self) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The words, the length of each one's list, and the lists one after another."""
        row = np.concatenate([np.zeros(0, np.int32), *self.parts])
        at = np.flatnonzero(row >= 0).astype(np.int32)
        word = row[at]
        return self.vocabulary.words, np.bincount(word, minlength=len(self.vocabulary.words)), at[np.argsort(word, kind="stable")]


def packed(lengths: np.ndarray, positions: np.ndarray) -> pa.Array:
    """Lists of ascending positions as bytes: the first, then steps, each in as many groups of seven bits as it needs,
    the lowest first; all groups of a number but the last have the eighth bit set."""
    steps = positions.astype(np.int64)
    steps[1:] -= positions[:-1]
    starts = (np.cumsum(lengths) - lengths)[lengths > 0]
    steps[starts] = positions[starts]
    width = 1 + sum((steps >= 1 << 7 * k).astype(np.int64) for k in range(1, 5))
    ends = np.append(0, np.cumsum(width))
    data = np.zeros(ends[-1], np.uint8)
    for k in range(5):
        some = np.flatnonzero(width > k)
        data[ends[some] + k] = (steps[some] >> 7 * k & 127) | np.where(width[some] > k + 1, 128, 0)
    offsets = ends[np.append(0, np.cumsum(lengths))].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def unpacked(lists: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and positions of such lists."""
    data = np.frombuffer(b"".join(lists), np.uint8)
    last = np.flatnonzero(data < 128)
    first = np.append(0, last[:-1] + 1)
    steps = np.zeros(len(last), np.int64)
    for k in range(5):
        some = np.flatnonzero(last - first >= k)
        steps[some] |= (data[first[some] + k].astype(np.int64) & 127) << 7 * k
    lengths = np.diff(np.searchsorted(last, np.cumsum([0, *map(len, lists)])))
    total = np.cumsum(steps)
    starts = np.cumsum(lengths) - lengths
    return lengths, total - np.repeat(total[starts] - steps[starts], lengths)


def _block_base() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId() << 32


def postings(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """``lang, word, block, n, positions``: a row for each word of a block, with the length of its list."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[str, OpenBlock] = {}
        block, total = _block_base(), 0

        def closed(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal block, total
            ended = blocks.pop(lang)
            total -= ended.size
            words, lengths, positions = ended.lists()
            for lo in range(0, len(words), 100_000):
                hi = min(len(words), lo + 100_000)
                first, last = lengths[:lo].sum(), lengths[:hi].sum()
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * (hi - lo), pa.string()), pa.array(words[lo:hi], pa.string()), pa.array(np.full(hi - lo, block)), pa.array(lengths[lo:hi]), packed(lengths[lo:hi], positions[first:last]),
                ], ["lang", "word", "block", "n", "positions"])
            block += 1

        for b in batches:
            for part in slices(b, 1, SLICE_BYTES):
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    if text:
                        open_ = blocks.setdefault(lang, OpenBlock())
                        before = open_.size
                        open_.add(text)
                        total += open_.size - before
                        if open_.size >= BLOCK_WORDS:
                            yield from closed(lang)
                        while total >= OPEN_WORDS:
                            yield from closed(max(blocks, key=lambda k: blocks[k].size))
        for lang in list(blocks):
            yield from closed(lang)

    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)), F.col(text_col).cast("string"))
    return rows.mapInArrow(task, "lang string, word string, block long, n long, positions binary")


def _columns(words: int) -> list[str]:
    return [f"w{k}" for k in range(1, words + 1)]


def _runs(ids: np.ndarray, lists: list[bytes], words: int) -> pa.RecordBatch:
    """Merge-joins all lists of a block: what stands at a position with what stands at the next ones."""
    lengths, positions = unpacked(lists)
    there = np.full(int(positions.max()) + words, -1, np.int64)
    there[positions] = np.repeat(np.arange(len(ids)), lengths)
    at = np.flatnonzero(np.logical_and.reduce([there[k : len(there) - words + 1 + k] >= 0 for k in range(words)]))
    run = there[at]
    for k in range(1, words):
        _, first, run, n = np.unique(run * len(ids) + there[at + k], return_index=True, return_inverse=True, return_counts=True)
    return pa.RecordBatch.from_arrays([*(pa.array(ids[there[at[first] + k]]) for k in range(words)), pa.array(n)], [*_columns(words), "n"])


def runs(lists: DataFrame, words: int) -> DataFrame:
    """For each phrase of a block its words, ``w1, w2, ...``, and the length of its list, ``n``; ``lists`` has ``block, id,
    positions`` of frequent words. Its rows are at most the positions, whatever the phrases' frequencies."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, held = None, [], []
        for b in batches:
            blocks = b.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if held and blocks[lo] != block:
                    yield _runs(np.concatenate(ids), held, words)
                    ids, held = [], []
                block = int(blocks[lo])
                ids.append(b.column(1).slice(lo, hi - lo).to_numpy())
                held += b.column(2).slice(lo, hi - lo).to_pylist()
        if held:
            yield _runs(np.concatenate(ids), held, words)

    dealt = lists.select("block", "id", "positions").repartition("block").sortWithinPartitions("block")
    return dealt.mapInArrow(task, "".join(f"{c} long, " for c in _columns(words)) + "n long")


@dataclass
class Mined:
    """Scored phrases, ``lang, phrase, words, a, l, r, score, covered``, and ``lang, n``, the words of each language."""

    phrases: DataFrame
    totals: DataFrame


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), in whole numbers of up to 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)"), wide(left) * wide(right))


def mine(docs: DataFrame, longest: int = 3, least: int = 10, cover_percent: int = 50, text_col: str = "text", lang_col: str = "lang") -> Mined:
    """Phrases of 2 to ``longest`` words that occur ``least`` times or more in their language.

    ``a`` is the number of occurrences, overlapping ones included; of the cuts of a phrase in two, with ``l`` and ``r``
    occurrences of the parts, the one with the lowest score counts, then the earliest. ``covered`` is whether a longer
    phrase around it, within ``longest``, has ``cover_percent`` of its occurrences or more. Null languages are ``und``,
    null and empty texts have no words; repeated rows count each; other columns are ignored; an empty table gives none.
    """
    spark = docs.sparkSession
    with scratch(spark):
        every = stored(postings(docs, text_col, lang_col), "postings")
        with outside():
            counts = stored(every.groupBy("lang", "word").agg(F.sum("n").alias("f")), "word-counts")
            none = F.array().cast("array<long>")
            known = counts.filter(F.col("f") >= least).select(F.monotonically_increasing_id().alias("id"), "lang", F.col("word").alias("phrase"), "f", none.alias("heads"), none.alias("tails"))
            known = stored(known.withColumn("w1", F.col("id")), "phrases-1")
            lists = stored(every.join(known.select("id", "lang", F.col("phrase").alias("word")), ["lang", "word"]).select("block", "id", "positions"), "lists-1")
    levels: list[DataFrame] = []
    for words in range(2, longest + 1):
        all_words = _columns(words)
        often = runs(lists, words).groupBy(*all_words).agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
        often = stored(often.select(F.monotonically_increasing_id().alias("id"), *all_words, "f"), f"frequent-{words}")
        left, right = (
            known.select(*[F.col(f"w{k}").alias(f"w{k + shift}") for k in range(1, words)], *[F.col(c).alias(f"{side}_{c}") for c in ("id", "lang", "phrase", "f", "heads", "tails")])
            for shift, side in enumerate(("prefix", "suffix"))
        )
        known = often.join(left, all_words[:-1]).join(right, all_words[1:]).select(
            "id", *all_words, F.col("prefix_id").alias("prefix"), F.col("suffix_id").alias("suffix"), F.col("prefix_lang").alias("lang"),
            F.concat("prefix_phrase", F.lit(" "), F.substring_index("suffix_phrase", " ", -1)).alias("phrase"), "f",
            F.concat("prefix_heads", F.array("prefix_f")).alias("heads"), F.concat(F.array("suffix_f"), "suffix_tails").alias("tails"),
        )
        known = stored(known, f"phrases-{words}")
        levels.append(known)
    scored = []
    for words, level in enumerate(levels, 2):
        cut = F.array_min(F.transform("heads", lambda h, i: F.struct(_score(F.col("f"), h, F.get("tails", i)).alias("score"), i.alias("k"), h.alias("l"), F.get("tails", i).alias("r"))))
        covered = F.lit(False)
        if words < longest:
            most = levels[words - 1].select(F.explode(F.array("prefix", "suffix")).alias("id"), F.col("f").alias("longer")).groupBy("id").agg(F.max("longer").alias("most"))
            level = level.join(most, "id", "left")
            covered = F.coalesce(100 * F.col("most") >= cover_percent * F.col("f"), F.lit(False))
        level = level.withColumn("cut", cut)
        scored.append(level.select("lang", "phrase", F.lit(words).alias("words"), F.col("f").alias("a"), "cut.l", "cut.r", "cut.score", covered.alias("covered")))
    phrases = scored[0]
    for other in scored[1:]:
        phrases = phrases.unionByName(other)
    return Mined(phrases, counts.groupBy("lang").agg(F.sum("f").alias("n")))


def best(mined: Mined, most: int = 2000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's first ``most`` phrases that none covers, by score,
    then ``a``, both descending, then the phrase. Every task keeps as many a language before they are shuffled."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = mined.phrases.filter(~F.col("covered")).withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= most)
    return ranked.join(mined.totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
