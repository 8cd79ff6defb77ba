"""Exact deduplication and both packers, against brute force and round trips."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from orgloom.llm.byte_bpe import ByteBpe
from orgloom.llm.exact_dedup import DigestIndex
from orgloom.llm.packing import FreeTree, OpenBins, best_fit_decreasing, cut, pack_decreasing, pack_online, pieces_of, token_source, write_packed

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, digest string, keep_id int, n string"
ROWS = [
    (1, "a b", "x", 1, None), (2, "ab", None, None, None), (3, "a\tb\x0b", "x", 1, "n"), (4, None, "x", 1, "n"), (5, " \n", "x", 1, "n"), (6, "", "x", 1, "n"),
    (7, "solo", "x", 1, "n"), (8, "word " * 3000, "x", 1, "n"), (9, "a b", "x", 1, "n"), (9, "a b", "x", 1, "n"), (None, "nul", "x", 1, "n"),
]


def ids_of(text):
    return ByteBpe(JSON).encode(text or "").tolist() + [2]


def test_exact_dedup_matches_brute_force(spark):
    index = DigestIndex.temporary(spark)
    got = index.ingest(spark.createDataFrame(ROWS, DOCS)).collect()
    norm = lambda t: "".join(c for c in (t or "") if c not in " \t\n\x0b\x0c\r")
    groups = {}
    for r in ROWS:
        groups.setdefault(norm(r[1]), []).append((-len(r[1] or ""), r[0] is None, r[0] or 0, r[0]))
    assert len(got) == len(ROWS)
    for g in got:
        members = next(m for t, m in groups.items() if hashlib.sha256(t.encode()).hexdigest() == g["text_sha256"])
        assert g["keep_id"] == min(members)[3] and g["group_size"] == len(members)
    assert sorted((g["doc_id"] for g in got if g["kept"]), key=str) == [3, 5, 7, 8, None]
    again = index.ingest(spark.createDataFrame([(50, "s o l o", None, None, None), (51, "new", None, None, None)], DOCS)).collect()
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in again} == {(50, 7, False), (51, 51, True)}
    assert index.rows().count() == len(groups) + 1


def test_one_row_of_repeated_ids_stays(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "a\tb"), (2, "ab"), (3, "own"), (None, "nul"), (None, "nul")]
    got = DigestIndex.temporary(spark).ingest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] for r in got if r["kept"]), key=str) == [1, 3, None]
    assert sorted(r["group_size"] for r in got) == [1, 2, 2, 4, 4, 4, 4]


def test_a_batch_again_changes_nothing(spark):
    index, docs = DigestIndex.temporary(spark), spark.createDataFrame(ROWS, DOCS)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assigned = index._assigned
    index._assigned = lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):  # appended, but not read back
        index.ingest(docs, batch="one")
    index._assigned = assigned
    held = rows(index.rows())
    again = rows(index.ingest(docs, batch="one"))
    assert rows(index.rows()) == held and again == rows(DigestIndex.temporary(spark).ingest(docs))
    assert not any(r["kept"] for r in index.ingest(docs, batch="two").collect())


def test_exact_dedup_of_nothing(spark):
    assert DigestIndex.temporary(spark).ingest(spark.createDataFrame([], DOCS)).count() == 0


def test_hot_text_is_whole(spark):
    df = spark.range(9000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('t', id) END AS text")
    got = DigestIndex.temporary(spark).ingest(df)
    assert got.count() == 9000 and got.filter("kept").count() == 6001 and got.filter("keep_id = 0").count() == 3000


def test_fast_ids_are_the_defining_ids():
    fast, full = ByteBpe(JSON, RANKS), ByteBpe(JSON)
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "B", "é", "1", "²", "'s", "-", "<|endoftext|>", "<|", "日", "🙂", " ", "\x1c", "\x85", "́", "ß"]
    for _ in range(1500):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert fast.encode(text).tolist() == full.encode(text).tolist(), text


def test_pieces_cover_documents():
    for total in (1, 7, 1023, 1024, 1025, 5000):
        pieces = list(cut(total, 1024))
        assert [p[1] for p in pieces[1:]] == [1024] * (len(pieces) - 1) and sum(p[1] for p in pieces) == total
        assert [p[0] for p in pieces] == np.cumsum([0, *(p[1] for p in pieces)])[:-1].tolist()
    assert list(cut(0, 1024)) == []


@pytest.mark.parametrize("most", [1, 4, 64])
def test_open_bins_against_plain_search(most):
    rng, bins, made = random.Random(most), OpenBins(64, most), 0
    for _ in range(2000):
        n, before = rng.randint(1, 64), sorted(f for f, b in enumerate(bins.by_free) for _ in b)
        at, offset = bins.place(n)
        free = min((f for f in before if f >= n), default=64)
        if free == 64 and 64 not in before:
            assert at == made
            made += 1
            if n < 64 and len(before) >= most:
                before.pop(0)  # the fullest closes
        else:
            before.remove(free)
        assert offset == 64 - free and sorted(before + [free - n] * (free > n)) == sorted(f for f, b in enumerate(bins.by_free) for _ in b)
        assert bins.open <= most and bins.bits == sum(1 << f for f, b in enumerate(bins.by_free) if b)


def test_segment_tree_finds_least():
    rng, tree, held = random.Random(3), FreeTree(100), []
    for _ in range(1500):
        if held and rng.random() < 0.4:
            tree.add(held.pop(rng.randrange(len(held))), -1)
        else:
            held.append(rng.randint(0, 100))
            tree.add(held[-1], 1)
        need = rng.randint(0, 100)
        assert tree.least(need) == min((f for f in held if f >= need), default=-1)


def test_decreasing_fits():
    rng = random.Random(4)
    lengths = [rng.randint(1, 100) for _ in range(500)]
    used = {}
    for n, (at, offset) in zip(lengths, best_fit_decreasing(lengths, 100), strict=True):
        used.setdefault(at, []).append((offset, n))
    for segs in used.values():
        at = 0
        for offset, n in sorted(segs):
            assert offset == at
            at += n
        assert at <= 100
    assert len(used) <= 1.3 * sum(lengths) / 100


@pytest.mark.parametrize("kind", ["online", "decreasing"])
def test_packed_pieces_hold_every_id(spark, kind):
    docs, encode = spark.createDataFrame(ROWS, DOCS), token_source(JSON, RANKS, 2)
    got = (pack_online(docs, encode, open_bins=2) if kind == "online" else pieces_of(pack_decreasing(docs, encode))).collect()
    want = sorted((r[0] or -1, k, s, n, zlib.crc32(np.array(ids_of(r[1]), "<u4")[s : s + n].tobytes())) for r in ROWS for k, (s, n) in enumerate(cut(len(ids_of(r[1])), 1024)))
    assert sorted((r["doc_id"] or -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for segs in seqs.values():
        at = 0
        for offset, n in sorted(segs):
            assert offset == at
            at += n
        assert at <= 1024


def test_written_matrix_round_trips(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, DOCS).filter("doc_id < 9")
    write_packed(pack_decreasing(docs, token_source(JSON, RANKS, 2), pad_id=50256), str(tmp_path / "m"))
    found = {}
    for r in spark.read.parquet(str(tmp_path / "m")).collect():
        ids = np.frombuffer(r["input_ids"], "<u4")
        assert len(ids) == 1024 and (ids[r["cu_seqlens"][-1] :] == 50256).all()
        assert np.frombuffer(r["position_ids"], "<u2").tolist() == [i for a, b in zip(r["cu_seqlens"], r["cu_seqlens"][1:]) for i in range(b - a)] + [0] * (1024 - r["cu_seqlens"][-1])
        for d, p, a, b in zip(r["doc_ids"], r["pieces"], r["cu_seqlens"], r["cu_seqlens"][1:]):
            found[d, p] = ids[a:b].tolist()
    for r in ROWS[:8]:
        assert sum((found[r[0], k] for k in range(99) if (r[0], k) in found), []) == ids_of(r[1])


def test_packing_nothing(spark):
    empty, encode = spark.createDataFrame([], DOCS), token_source(JSON, RANKS, 2)
    assert pack_online(empty, encode).count() == 0 and pack_decreasing(empty, encode).count() == 0
