"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again for the next.

Toxic documents go; of equal texts one stays; of each class of near duplicates one stays; personal data is masked;
what is left is packed into sequences. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orgloom.llm import jaccard_join, pii, toxicity
from orgloom.llm.common import outside, removed, scratch, shared_dir, stored, table
from orgloom.llm.exact_dedup import DigestIndex
from orgloom.llm.packing import pack_online, token_source

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document with this chance of being toxic, or more, is rejected.
TOXIC = 0.3
END_ID = 2


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't find toxic. Every row is judged by its whole text, those with null or
    repeated ids like others, null text as empty; an empty table gives no rows, other columns than ``COLUMNS`` go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.with_score(docs, model).filter(F.col("score") < TOXIC).select(COLUMNS)


def _keyed(docs: DataFrame, name: str) -> DataFrame:
    """The rows with a ``row_key`` of their own, stored so that it stays the same."""
    return stored(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row_key")), name)


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows but those with the keys in ``gone``. These are stored, so that Spark knows their size: it broadcasts
    them below its threshold and otherwise merges."""
    return rows.join(stored(gone, "rows-gone"), "row_key", "left_anti").select(COLUMNS)


def _order() -> Column:
    """Rows by id, null ids last, then by key."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("row_key").alias("row_key"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row that the digest index keeps: the longest, then the smallest id. One of wholly equal rows
    stays; ids may repeat or be null; null text counts as empty; an empty table gives no rows."""
    rows, index = _keyed(docs, "rows-exact"), DigestIndex.temporary(spark)
    try:
        found = index.ingest(rows.select(_order().alias("row"), "text"), "row")
    finally:
        index.drop()
    return _without(rows, found.filter("NOT kept").select(F.col("doc_id.row_key").alias("row_key")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the row with the smallest id. Rows are told apart by a key; ids may repeat or
    be null; texts without words are near to nothing and stay; an empty table gives no rows."""
    rows = _keyed(docs, "rows-near")
    near = jaccard_join.near_duplicates(rows.select("row_key", "text"), "row_key").filter("n_links > 0").select(F.col("doc_id").alias("row_key"), "class_id")
    near = stored(near.join(rows.select("row_key", "doc_id"), "row_key").select("class_id", "row_key", _order().alias("row")), "near-classes")
    best = near.groupBy("class_id").agg(F.min("row").alias("best")).select(F.col("best.row_key").alias("row_key"))
    return _without(rows, near.select("row_key").join(best, "row_key", "left_anti"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, the personal data of their whole texts masked, with the new number of characters; null text stays
    null and has 0. Ids may repeat or be null; an empty table gives no rows."""
    return pii.mask(docs, pii.fit(docs)).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a packed sequence. Null text counts as empty and gives its end id; null and repeated ids are
    carried as they are; an empty table gives no rows."""
    return pack_online(docs, token_source(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), END_ID))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("pii", mask_personal_data),
    ("packing", pack),
]
#: No SQL can express the trained stages; tests hold what each stage keeps, masks and packs against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table ``documents`` to packed pieces."""
    docs, old = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            with outside():
                path = shared_dir(spark, f"stage-{name}")
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if old:
            removed(spark, old)
        old = path
    return docs
