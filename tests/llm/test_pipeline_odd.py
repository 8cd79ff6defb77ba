"""Every stage of the pipeline on odd rows: null and repeated ids, null, empty and very long texts, ties, wholly equal
rows, columns that clash with names used inside, and empty tables; against plain Python."""

import random
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest

from orgloom.llm import pii, toxicity
from orgloom.llm.byte_bpe import ByteBpe

WORDS = random.Random(4).choices([f"w{i}" for i in range(9000)], k=70_000)
LONG = " ".join(WORDS)
ROWS = [
    (1, "a text of seven words in all"), (1, "a text of seven words in all"), (1, "another text with that id"), (None, "no id at all"), (None, "no id at all"),
    (2, None), (3, ""), (4, None), (5, " \n"), (6, LONG), (7, LONG + " end"), (8, "mail a.b@c.de or +1 (434) 555-2368 now"), (9, "mail a.b@c.de or +1 (434) 555-2368 now"), (10, "1" * 200_000),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, row_key long, key string, class_id long, h long, y int, digest string, chunk int, row int"


def docs(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, "en" if k % 2 else None, "s", None, 0.5, 1, "k", 1, 1, 1, "d", 1, 1) for k, (i, t) in enumerate(rows)], COLUMNS)


def texts(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def kept(rows, key, order=lambda r: (r[0] is None, r[0] or 0)):
    best = {}
    for r in rows:
        best[key(r)] = min(best.get(key(r), r), r, key=order)
    return sorted(best.values(), key=str)


def test_toxic_rows_go(spark, sf_dir):
    out = corpus_pipeline.drop_toxic(spark, docs(spark), sf_dir)
    model = toxicity.fit(docs(spark), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    z = lambda t: model.bias + (model.word_sums(sorted(w)).sum() if (w := toxicity.distinct_words(t)) else 0)
    assert out.columns == corpus_pipeline.COLUMNS
    assert texts(out) == sorted((r for r in ROWS if 1 / (1 + np.exp(-z(r[1]))) < corpus_pipeline.TOXIC), key=str)


def test_exact_copies_go(spark):
    out = corpus_pipeline.drop_copies(spark, docs(spark), "")
    squeezed = lambda r: "".join((r[1] or "").split())
    got = texts(out)
    assert out.columns == corpus_pipeline.COLUMNS
    assert got == kept(ROWS, squeezed, lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))


def test_near_copies_go(spark):
    out = corpus_pipeline.drop_near_copies(spark, docs(spark), "")
    worded = lambda r: "LONG" if r[1] and r[1].startswith(LONG) else " ".join(r[1].split()) if r[1] and r[1].split() else f"own {r[0]}"
    assert out.columns == corpus_pipeline.COLUMNS and texts(out) == kept(ROWS, worded)


def test_personal_data_is_masked(spark):
    out = corpus_pipeline.mask_personal_data(spark, docs(spark), "")
    got = out.collect()
    assert out.columns == corpus_pipeline.COLUMNS and len(got) == len(ROWS)
    base = lambda t: None if t is None else pii.masked(t, pii.base_spans(t))
    assert texts(out) == sorted(((i, base(t)) for i, t in ROWS), key=str)  # nothing here for the field to add
    assert all(r["n_chars"] == len(r["text"] or "") for r in got)


def test_every_id_is_packed(spark):
    got = corpus_pipeline.pack(spark, docs(spark), "").collect()
    bpe = ByteBpe(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [(i, np.append(bpe.encode(t or ""), 2).astype("<u4")) for i, t in ROWS]
    want = []
    for i, x in ids:
        first = (len(x) - 1) % 1024 + 1
        cuts = [0, *range(first, len(x) + 1, 1024)]
        want += [(i, k, a, b - a, zlib.crc32(x[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got), key=str) == sorted(want, key=str)
    seats = {}
    for r in got:
        seats.setdefault(r["sequence_id"], []).append((r["offset"], r["offset"] + r["length"]))
    for s in seats.values():
        s.sort()
        assert s[0][0] == 0 and s[-1][1] <= 1024 and all(a[1] == b[0] for a, b in zip(s, s[1:]))


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_empty_tables(spark, sf_dir, stage):
    assert stage(spark, docs(spark).limit(0), sf_dir).count() == 0


def test_run_leaves_its_result_only(spark, sf_dir):
    from pathlib import Path

    from orgloom.llm.common import shared_dir

    base = Path(shared_dir(spark, "x")).parent
    before = set(base.iterdir()) if base.exists() else set()
    out = corpus_pipeline.run(spark, sf_dir)
    (left,) = set(base.iterdir()) - before
    assert left.name.startswith("stage-packing") and out.count() > 0
