"""Phrases against counting every run of words, with and without blocks that end early, and odd rows."""

import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from orgloom.llm import collocations
from orgloom.llm.collocations import best, mine


def plain(rows, longest=3, least=10, most=2000):
    f = Counter()
    for lang, text in rows:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^ \t]+", piece)
            for m in range(1, longest + 1):
                f.update(("und" if lang is None else lang, tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    total = Counter()
    for (lang, w), n in f.items():
        total[lang] += n if len(w) == 1 else 0
    found = {k: n for k, n in f.items() if len(k[1]) > 1 and n >= least}
    out = {}
    for (lang, w), a in found.items():
        inside = lambda q: any(q[i : i + len(w)] == w for i in range(len(q) - len(w) + 1))  # noqa: B023, E731
        if any(ql == lang and len(q) > len(w) and 100 * n >= 50 * a and inside(q) for (ql, q), n in found.items()):
            continue
        cuts = [(int(Fraction(1_000_000 * a * a, f[lang, w[:k]] * f[lang, w[k:]])), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted(
        (lang, rank, p.decode(), -a, left, right, total[lang], -score) for lang, all_ in out.items() for rank, (score, a, p, left, right) in enumerate(sorted(all_)[:most], 1)
    )


def sample(seed, n=400):
    rng = random.Random(seed)
    words = ["the", "The", "of", "a", "ünder", "\xa0odd\xa0", "zeta", "x", "É", "ab"]
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\r\n", "\x0b", "! ?"]) for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice(["en", "en", "en", None, "de", ""]), text))
    return rows + [("en", None), (None, ""), ("fr", "..."), ("rare", "only once here"), ("en", "a " * 5000), ("en", "w" * 100_000), ("de", "same words here again. " * 30)]


@pytest.mark.parametrize("small", [False, True])
def test_like_counting(spark, monkeypatch, small):
    if small:  # blocks end early
        monkeypatch.setattr(collocations, "BLOCK_WORDS", 200)
        monkeypatch.setattr(collocations, "OPEN_WORDS", 300)
        monkeypatch.setattr(collocations, "SLICE_BYTES", 500)
    rows = sample(1 + small)
    docs = spark.createDataFrame([(i % 5, lang, text, "w", 3, 1) for i, (lang, text) in enumerate(rows)], "doc_id int, lang string, text string, word string, block int, id int").repartition(3)
    for longest, least, most in ((3, 10, 2000), (2, 3, 7), (4, 25, 50)):
        got = best(mine(docs, longest, least), most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
        assert sorted(map(tuple, got)) == plain(rows, longest, least, most)


def test_only_words_have_rows_per_block(spark, monkeypatch):
    """Frequent phrases in many blocks: what is kept of phrases is one row each, not one for every block."""
    monkeypatch.setattr(collocations, "BLOCK_WORDS", 40)
    rows, stored = {}, collocations.stored

    def counted(df, name):
        out = stored(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(collocations, "stored", counted)
    docs = spark.createDataFrame([("en", "one two three four. " * 10)] * 30, "lang string, text string").repartition(2)
    got = best(mine(docs)).select("phrase", "a").collect()
    assert sorted(map(tuple, got)) == [("one two three", 300), ("two three four", 300)]
    assert rows["lists-1"] > 20 * 4
    assert {n: k for n, k in rows.items() if n not in ("postings", "lists-1")} == {"word-counts": 4, "phrases-1": 4, "frequent-2": 3, "phrases-2": 3, "frequent-3": 2, "phrases-3": 2}


def test_empty(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert best(mine(docs)).collect() == []
    docs = spark.createDataFrame([(None, None), ("en", "")], "lang string, text string")
    assert best(mine(docs)).collect() == []


def test_scores_beyond_64_bits(spark):
    row = spark.sql("SELECT 3000000000L AS a, 4000000000L AS l, 5000000001L AS r")
    score = row.select(collocations._score(row.a, row.l, row.r)).first()[0]
    assert score == 1_000_000 * 3_000_000_000**2 // (4_000_000_000 * 5_000_000_001)


def test_lists_are_packed_without_loss():
    rng = random.Random(3)
    for size in (1, 5, 400):
        lists = [sorted(rng.sample(range(rng.choice([10, 200, 20_000, 3_000_000, 2**31 - 1])), rng.randint(1, 9))) for _ in range(size)]
        lengths, positions = collocations.unpacked(collocations.packed(np.array([len(x) for x in lists]), np.array(sum(lists, []))).to_pylist())
        assert lengths.tolist() == [len(x) for x in lists] and positions.tolist() == sum(lists, [])
