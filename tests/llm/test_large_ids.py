"""Ids beyond 2^53 beside null ids in one batch, through every operator; and operators in threads of one session."""

import time
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from orgloom.llm import collocations, fill_in_middle, jaccard_join, merkle, packing, pii, quality, queries, sentencepieces, toxicity, url_filter, vptree
from orgloom.llm.exact_dedup import DigestIndex

BIG = 2**53
IDS = [BIG + 1, BIG + 3, None, BIG + 5, BIG + 7, 4]
COPY = "seven words of this text are repeated here for certain and some more of them follow"
TEXTS = [COPY, COPY, COPY, "mail a.b@c.de now", "call +49 30 1234567 or so", None]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in zip(IDS, TEXTS, strict=True)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)


def ids(df, name="doc_id"):
    return Counter(r[0] for r in df.select(name).collect())


def test_ids_stay(spark, docs, sf_dir):
    labels = spark.createDataFrame([(BIG + 1, 1, 0), (BIG + 5, 0, 1), (4, 1, 0), (BIG + 7, 0, 0)], "doc_id long, quality int, toxic int")
    want = Counter(IDS)
    source = packing.token_source(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), 2)
    model = public_tokenizers.path("piece_bpe_32k.model")
    found = {
        "op2": packing.pieces_of(packing.pack_decreasing(docs, source)), "op3": pii.find(docs, pii.fit(docs)), "op4": sentencepieces.encode_digests(docs, model), "op4 spans": sentencepieces.encode(docs, model),
        "op5": toxicity.score(docs, toxicity.fit(docs, labels)), "op6": quality.score(docs, quality.fit(docs, labels)), "op7": jaccard_join.near_duplicates(docs), "op8": packing.pack_online(docs, source),
        "op11": merkle.compared_with_next(docs), "op11 alone": merkle.fingerprints(docs), "op12": fill_in_middle.fill_in_middle(docs), "pack": corpus_pipeline.pack(spark, docs, sf_dir),
    }
    assert {k: ids(v) for k, v in found.items()} == dict.fromkeys(found, want)
    near = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in found["op7"].collect()}
    assert near == {BIG + 1: (BIG + 1, 1), BIG + 3: (BIG + 1, 1), None: (None, 0), BIG + 5: (BIG + 5, 0), BIG + 7: (BIG + 7, 0), 4: (4, 0)}
    index = DigestIndex.temporary(spark)
    try:
        exact = index.ingest(docs)
        assert ids(exact) == want and {r["keep_id"] for r in exact.filter("group_size = 3").collect()} == {BIG + 1}
    finally:
        index.drop()
    pages = docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("https://a.example.net/en/"), F.coalesce("text", F.lit(""))).alias("url"))
    assert ids(url_filter.judge(pages, queries.URL_RULES), "page_id") == want
    vectors = spark.createDataFrame([(i, [float(k), 1.0, 2.0]) for k, i in enumerate(IDS[:2] + IDS[3:])], "vec_id long, embedding array<float>").coalesce(1)
    name = spark.read.parquet(f"{sf_dir}/embeddings.parquet").columns[1]
    tree, shards = vptree.build_index(vectors.withColumnRenamed("embedding", name), 20)
    near = vptree.search(tree, shards, vectors.withColumnRenamed("embedding", name), 20, 1.0)
    assert ids(near, "query_id") == ids(near, "vec_id") == Counter({i: 4 for i in IDS if i is not None})
    assert sum(r["n"] for r in collocations.mine(docs).totals.collect()) > 40


def test_operators_in_threads(spark, docs, sf_dir):
    def near(seed):
        texts = [(i, f"{COPY} {seed} {i // 2} {'x y z ' * (i // 2 % 3)}") for i in range(200)]
        return sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard_join.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect())

    alone = [near(i) for i in range(3)]
    with ThreadPoolExecutor(4) as pool:
        runs = [pool.submit(corpus_pipeline.run, spark, sf_dir) for _ in range(2)]
        assert list(pool.map(near, range(3))) == alone
        counts = [r.result().count() for r in runs]
    assert counts[0] == counts[1] > 0


def test_long_runs_of_numbers_take_linear_time():
    text = " ".join(["12", "345"] * 50_000) + " and " + " ".join(["12", "345"] * 50_000)
    started = time.perf_counter()
    n = pii.nodes_of([text], [pii.base_spans(text)])
    assert time.perf_counter() - started < 15 and len(n.skip) >= 100_000


def test_toxicity_is_fitted_within_bytes(spark):
    rows = [(i, f"text of words number{i} " * 3, i % 2) for i in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    whole, few, one = (toxicity.fit(docs, labels, bits=14, max_bytes=n) for n in (10**9, 300, 1))
    used = [int((m.weights != 0).sum()) for m in (whole, few, one)]
    assert used[0] > used[1] > used[2]
    assert toxicity.score(docs, few).count() == len(rows)
