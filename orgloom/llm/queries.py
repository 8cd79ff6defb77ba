"""The registered queries of this package, each with production parameters over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orgloom.llm import collocations, fill_in_middle, jaccard_join, merkle, pii, quality, sentencepieces, toxicity, url_filter, vptree
from orgloom.llm.common import kept, scratch, shared_dir, table
from orgloom.llm.exact_dedup import DigestIndex
from orgloom.llm.packing import pack_decreasing, pack_online, pieces_of, read_packed, token_source, write_packed

END_ID = 2
PAD_ID = 0
CAPACITY = 1024
#: How far the trees' pruning goes beyond exact search.
VP_FACTOR = 1.25


def _gpt_ids():
    return token_source(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), END_ID)


def op1_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20, among all."""
    vectors = table(spark, sf_dir, "embeddings")
    with scratch(spark):
        index, shards = vptree.build_index(vectors, 20)
        return kept(vptree.search(index, shards, vectors.filter(F.col("vec_id") % 20 == 0), 20, VP_FACTOR), "neighbours")


def op2_packed_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed by best fit decreasing and written as a padded matrix with restarting positions; a row per
    piece, its checksum taken from the matrix read back."""
    path = shared_dir(spark, "packed")  # the operator's output, so it stays
    write_packed(pack_decreasing(table(spark, sf_dir, "documents"), _gpt_ids(), CAPACITY, PAD_ID), path)
    return pieces_of(read_packed(spark, path))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: the patterns' spans, and those that the field adds."""
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's pieces, and of what they decode to."""
    return sentencepieces.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def _labels(spark: SparkSession, sf_dir: str, parts: int, part: int) -> DataFrame:
    """The labels outside the held-out part."""
    return table(spark, sf_dir, "labels").filter(~toxicity.held_out(F.col("doc_id"), parts, part))


def _judged(scores: DataFrame, parts: int, part: int) -> DataFrame:
    return scores.select("doc_id", toxicity.held_out(F.col("doc_id"), parts, part).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents")
    return _judged(toxicity.score(docs, toxicity.fit(docs, _labels(spark, sf_dir, 4, 2))), 4, 2)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labels outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    return _judged(quality.score(docs, quality.fit(docs, _labels(spark, sf_dir, 5, 0))), 5, 0)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near duplicates and its number of links."""
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op8_online_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed by bounded-space best fit; a row per piece."""
    return pack_online(table(spark, sf_dir, "documents"), _gpt_ids())


#: Fixed rules of the URL query.
URL_RULES = [url_filter.Rule("net/", "block"), url_filter.Rule("example.net/en/", "allow"), url_filter.Rule("example.com/de/", "block"), url_filter.Rule("org/fr/", "allow")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the rules, else by boosted trees learned from the URLs that rules decide."""
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents ingested into a new digest index, which goes afterwards."""
    index = DigestIndex.temporary(spark)
    try:
        return index.ingest(table(spark, sf_dir, "documents"))
    finally:
        index.drop()


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's Merkle fingerprint, compared with that of its edited text and of the next document."""
    return merkle.compared_with_next(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a fill-in-the-middle example: digests of the output, and of the text restored from it."""
    made = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    restored = fill_in_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of two or three words of every language."""
    with scratch(spark):
        return kept(collocations.best(collocations.mine(table(spark, sf_dir, "documents"))), "collocations")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_vptree, op2_packed_token_ids, op3_pii, op4_sentencepiece, op5_toxicity, op6_quality, op7_jaccard_join, op8_online_packing, op9_url_filter, op10_exact_dedup, op11_fingerprints, op12_fill_in_middle, op13_collocations)}

ORACLES: dict[str, str] = {
    "op7_jaccard_join": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS words FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle
            FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)
        ), n AS (
            SELECT doc_id, count(*) AS size FROM s GROUP BY 1
        ), p AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
        ), e AS (
            SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE shared >= 0.8 * (a.size + b.size - shared) - 1e-9
        ), r AS (
            SELECT doc_id AS node, doc_id AS met FROM documents UNION SELECT node, y FROM r JOIN e ON met = x
        ), c AS (
            SELECT node, min(met) AS class_id FROM r GROUP BY 1
        ), l AS (
            SELECT x, count(*) AS n FROM e GROUP BY 1
        )
        SELECT w.doc_id, class_id, coalesce(n, 0) AS n_links,
               CASE WHEN len(words) = 0 THEN 1 ELSE count(*) OVER (PARTITION BY words) END AS n_copies
        FROM w JOIN c ON node = w.doc_id LEFT JOIN l ON x = w.doc_id
    """,
    "op10_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS chars,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents
        ), w AS (
            SELECT doc_id, text_sha256,
                   first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY text_sha256) AS group_size
            FROM d
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
    """,
    "op12_fill_in_middle": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
        ), r AS (
            SELECT *, len(units) AS n, ('0x' || h[1:8])::BIGINT % (len(units) + 1) AS r1, ('0x' || h[9:16])::BIGINT % (len(units) + 1) AS r2,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 100 THEN 'plain'
                        WHEN ('0x' || h[25:32])::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
            FROM d
        ), p AS (
            SELECT *, array_to_string(units[1:least(r1, r2)], '') AS p, array_to_string(units[least(r1, r2) + 1:greatest(r1, r2)], '') AS m, array_to_string(units[greatest(r1, r2) + 1:], '') AS s FROM r
        )
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
        FROM p
    """,
    "op13_collocations": r"""
        WITH docs AS (
            SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
        ), pieces AS (
            SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS words
            FROM (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs)
        ), grams AS (
            SELECT lang, m, array_to_string(words[i:i + m - 1], ' ') AS phrase FROM (
                SELECT lang, words, m, unnest(range(1, len(words) - m + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3]) AS m) WHERE len(words) >= m
            )
        ), f AS (
            SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL
        ), total AS (
            SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY 1
        ), c AS (
            SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 10
        ), cuts AS (
            SELECT *, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, m)) AS k FROM c)
        ), scored AS (
            SELECT c.lang, c.m, c.phrase, c.a, x.f AS l, y.f AS r, k, ((1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
            FROM cuts c JOIN f x ON x.lang = c.lang AND x.m = k AND x.phrase = first JOIN f y ON y.lang = c.lang AND y.m = c.m - k AND y.phrase = rest
        ), lowest AS (
            SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        ), longer AS (
            SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM c WHERE m = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM c WHERE m = 3
        ), covered AS (
            SELECT lang, phrase, max(a) AS most FROM longer GROUP BY ALL
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM lowest LEFT JOIN covered USING (lang, phrase) JOIN total USING (lang)
        WHERE most IS NULL OR 100 * most < 50 * a
        QUALIFY rank <= 2000
    """,
}
