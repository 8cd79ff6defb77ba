"""Both duplicate stages on repeated and null ids: rows are decided one by one."""

import random

import corpus_pipeline

WORDS = random.Random(3).choices([f"w{i}" for i in range(5000)], k=400)
LONG, NEAR, UNIQUE = " ".join(WORDS[:200]), " ".join([*WORDS[:199], "other"]), " ".join(WORDS[200:])


def run(spark, stage, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return sorted(((r["doc_id"], r["text"]) for r in stage(spark, docs, "").collect()), key=str)


def test_exact_copies(spark):
    rows = [(3, "a b"), (7, "a b"), (7, "own"), (8, "twice"), (8, "twice"), (None, "null"), (None, "null"), (None, "a b")]
    want = [(3, "a b"), (7, "own"), (8, "twice"), (None, "null")]
    assert run(spark, corpus_pipeline.drop_copies, rows) == sorted(want, key=str)


def test_near_copies(spark):
    rows = [(7, NEAR), (3, LONG), (7, UNIQUE), (None, NEAR)]
    assert run(spark, corpus_pipeline.drop_near_copies, rows) == sorted([(3, LONG), (7, UNIQUE)], key=str)
