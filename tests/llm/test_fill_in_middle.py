"""Fill-in-the-middle documents against plain Python, and rank and select against loops."""

import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orgloom.llm.fill_in_middle import BitVector, fill_in_middle, restored

TEXTS = ["", None, "one line", "a\nb\n", "\n", "\n\n\n", "a\r\nb", "ä\nöü\n\U0001f600 x\nß", "has <P> in it\nb", "<S>", "x<M", "<\n<\nP>\n", "end <\nM>", "long\n" * 40_000 + "last", "no newline " * 30_000]


def plain(doc_id, text, fim, spm):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_like_plain_python_and_restored(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 3)] + [(None, "a\nb\nc"), (2**53 + 1, "a\nb"), (2**53 + 1, "a\nb"), (-5, "x\ny")]
    docs = spark.createDataFrame([(t, "n", i, 1) for i, t in rows], "text string, form string, doc_id long, h1 int").repartition(3)
    for fim, spm in ((100, 50), (60, 20), (0, 50)):
        made = fill_in_middle(docs, fim_percent=fim, spm_percent=spm, slice_bytes=1000)
        got = made.select("*", restored(F.col("output"), F.col("form")).alias("back")).collect()
        assert sorted((tuple(r)[:6] for r in got), key=str) == sorted((plain(i, t, fim, spm) for i, t in rows), key=str)
        assert sorted(r["back"] for r in got) == sorted(t or "" for _, t in rows)
    assert fill_in_middle(docs.limit(0)).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.booleans(), max_size=3000))
def test_rank_and_select(flags):
    bits = BitVector(np.array(flags, bool))
    ones = [i for i, f in enumerate(flags) if f]
    assert bits.ones == len(ones)
    assert [bits.select(k + 1) for k in range(len(ones))] == ones
    for at in {0, len(flags), len(flags) // 2, len(flags) // 3}:
        assert bits.rank(at) == sum(flags[:at])


def test_rank_at_the_ends_of_blocks():
    for n in (511, 512, 513, 1024, 4096):
        bits = BitVector(np.ones(n, bool))
        assert bits.rank(n) == n and bits.select(n) == n - 1 and bits.select(1) == 0
