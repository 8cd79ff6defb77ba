"""Which terms of a vocabulary stand in a text, found in one pass however many terms there are."""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of terms that one automaton has, some hundred bytes each in a worker.
MOST_CHARS = 2_000_000


class Automaton:
    """Nodes are prefixes of terms: ``goto`` leads on by a character, ``fail`` to the longest end of the prefix that is
    a prefix too, ``ends`` to the nearest prefix by ``fail`` that is a term, and ``term`` names it."""

    def __init__(self, terms: Iterable[str]):
        self.goto: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        for term in terms:
            node = 0
            for c in term:
                if c not in self.goto[node]:
                    self.goto[node][c] = len(self.goto)
                    self.goto.append({})
                    self.term.append(None)
                node = self.goto[node][c]
            if term:
                self.term[node] = term
        self.fail, self.ends = [0] * len(self.goto), [0] * len(self.goto)
        todo = deque(self.goto[0].values())
        while todo:
            node = todo.popleft()
            for c, child in self.goto[node].items():
                todo.append(child)
                back = self.fail[node]
                while back and c not in self.goto[back]:
                    back = self.fail[back]
                self.fail[child] = self.goto[back].get(c, 0)
            back = self.fail[node]
            self.ends[node] = back if self.term[back] is not None else self.ends[back]

    def count(self, text: str) -> Counter[str]:
        """How often each term stands in a text, overlapping ones included."""
        goto, fail, ends, term = self.goto, self.fail, self.ends, self.term
        node, out = 0, Counter()
        for c in text:
            while node and c not in goto[node]:
                node = fail[node]
            node = goto[node].get(c, 0)
            at = node if term[node] is not None else ends[node]
            while at:
                out[term[at]] += 1
                at = ends[at]
        return out


def term_hits(texts: DataFrame, vocabulary: DataFrame, id_col: str, text_col: str, term_col: str = "term", most_chars: int = MOST_CHARS) -> DataFrame:
    """``id_col, term, hits`` for the terms of a table that stand in each text, as they are written.

    A vocabulary is broadcast as an automaton of at most some ``most_chars`` characters; a larger one is dealt by hash
    into several, each of which takes a pass over the texts. Null and empty terms stand nowhere, repeated terms count
    once, null texts have none.
    """
    spark = texts.sparkSession
    terms = vocabulary.select(F.col(term_col).alias("term")).filter("term <> ''").distinct()
    total = terms.agg(F.sum(F.length("term"))).first()[0] or 0
    parts = max(1, -(-int(total * 1.2) // most_chars)) if total > most_chars else 1
    kind = texts.schema[id_col].dataType.simpleString()

    def hits(part: int) -> DataFrame:
        own = [r[0] for r in terms.filter(F.pmod(F.xxhash64("term"), F.lit(parts)) == part).collect()]
        shared = spark.sparkContext.broadcast(own)

        def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = Automaton(shared.value)
            for b in batches:
                rows, found, n = [], [], []
                for i, text in enumerate(b.column(1).to_pylist()):
                    for term, times in automaton.count(text or "").items():
                        rows.append(i)
                        found.append(term)
                        n.append(times)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.string()), pa.array(n, pa.int64())], [id_col, "term", "hits"])

        return texts.select(id_col, text_col).mapInArrow(task, f"{id_col} {kind}, term string, hits long")

    out = hits(0)
    for part in range(1, parts):
        out = out.unionByName(hits(part))
    return out
