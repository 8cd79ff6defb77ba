"""Merge keys and vocabularies in linear time, catalogues merged without a window over a key's rows."""

import random
import time
import unicodedata

from pyspark.sql import functions as F

from orgloom.functions import rules, text
from orgloom.operators.resolve import merge_catalogue


def test_catalogue_is_one_aggregation(spark):
    rnd = random.Random(3)
    rows = [(f"k{rnd.randrange(40)}", rnd.randrange(3), i, rnd.choice(["", "s", "t"]), rnd.choice(["", None, "u", "v"]), [rnd.choice(["Regional registry", "target list"])]) for i in range(160)]
    merged = merge_catalogue(spark.createDataFrame(rows, "key string, src int, pos int, sector string, type string, sources array<string>"), "key", ["src", "pos"], ["sector", "type"])
    assert "Window" not in merged._jdf.queryExecution().executedPlan().toString()
    for got in merged.collect():
        own = sorted((r for r in rows if r[0] == got["key"]), key=lambda r: r[1:3])
        want = [next((r[c] for r in own if r[c]), own[0][c]) for c in (3, 4)]
        for r in own[1:]:
            if r[5] == ["Regional registry"] and r[3]:
                want = [r[3], r[4] or want[1]]
        assert [got["sector"], got["type"]] == want


def test_ascii_forms(spark):
    chars = [(c, f"a{chr(c)}b") for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    got = spark.createDataFrame(chars, "c int, s string").select("c", text.to_ascii(F.col("s"))).collect()
    assert [c for c, s in got if s != "a" + unicodedata.normalize("NFKD", chr(c)).encode("ascii", "ignore").decode() + "b"] == []


def test_merge_keys_of_open_parentheses(spark):
    df = spark.createDataFrame([("The (a) b" + "(" * 300_000,), ("x (" + " " * 300_000 + "é",), ("(a(b)c)",)], "s string")
    start = time.perf_counter()
    assert [r[0] for r in df.select(text.merge_key(F.col("s"))).collect()] == ["b", "xe", "c"]
    assert time.perf_counter() - start < 15


def test_terms_of(spark):
    df = spark.createDataFrame([("abcd",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(rules.terms_of(F.col("s"), ("bc", "zz", "abc"))).collect()] == [["bc", "abc"], [], []]
