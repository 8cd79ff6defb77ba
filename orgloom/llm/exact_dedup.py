"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest. A batch is digested once, grouped with map-side
combination (so a text that a third of all rows share costs one row per task), and only digests that a sort-merge
anti-join does not find in the index are appended; the index may be empty. Rows get their group back by a sort-merge
join; digests with at least a thousandth of all rows, of which there are a thousand at most, are joined by broadcast
instead, so no task gets all rows of a hot text. Everything is DataFrame operations.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orgloom.llm.common import kept, scratch, stored

WHITE = " \t\n\x0b\x0c\r"
#: Digests with at least 1/HOT_SHARE of the rows count as hot; there are at most HOT_SHARE of them.
HOT_SHARE = 1000


def digest(text: Column) -> Column:
    """SHA-256 of the text without white space, as 32 bytes; null counts as empty."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), WHITE, ""), 256))


class DigestIndex:
    """A digest table ``(digest, keep_id, keep_chars, group_size, batch)``, bucketed and sorted by digest."""

    def __init__(self, spark: SparkSession, name: str, buckets: int = 0):
        self.spark, self.name = spark, name
        self.buckets = buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))

    @classmethod
    def temporary(cls, spark: SparkSession) -> DigestIndex:
        return cls(spark, f"digest_index_{uuid.uuid4().hex[:12]}")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, groups: DataFrame) -> None:
        (
            groups.repartition(self.buckets, "digest")
            .write.mode("append").format("parquet")
            .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)
        )

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def ingest(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
        """Deduplicate a batch and append its new digests.

        Returns one row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``. Of equal texts the one
        with the most code points stays, then the smallest id (null ids last); of rows that agree in both just one
        stays. A digest that another batch brought keeps that batch's row: none of the new rows is kept and keep_id
        names the old one; group_size counts the batch that brought the digest. ``batch`` names the batch: ingested
        again after a failure, under the same name, it adds nothing twice and gives the result of the first time.
        Null text counts as empty, other columns are ignored, an empty batch gives an empty result.
        """
        batch = batch or uuid.uuid4().hex
        with scratch(self.spark):
            text = F.coalesce(F.col(text_col), F.lit(""))
            keyed = docs.select(F.col(id_col).alias("doc_id"), digest(F.col(text_col)).alias("digest"), F.length(text).alias("chars"), F.monotonically_increasing_id().alias("row"))
            rows = stored(keyed, "digests")
            best = F.struct((-F.col("chars")).alias("n"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("row").alias("row"))
            groups = rows.groupBy("digest").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("group_size"))
            groups = stored(groups.select("digest", F.col("best.id").alias("keep_id"), (-F.col("best.n")).alias("keep_chars"), F.col("best.row").alias("keep_row"), "group_size"), "digest-groups")
            entries = groups.select("digest", "keep_id", "keep_chars", "group_size", F.lit(batch).alias("batch"))
            if not self.spark.catalog.tableExists(self.name):
                self.append(entries.limit(0))
            self.append(stored(entries.join(self.rows().select("digest").hint("merge"), "digest", "left_anti"), "digests-new"))
            return kept(self._assigned(rows, groups, batch), "digests-assigned")

    def _assigned(self, rows: DataFrame, groups: DataFrame, batch: str) -> DataFrame:
        """The rows with what the index says of their digests."""
        index = self.rows().select("digest", "keep_id", F.col("group_size").alias("size"), (F.col("batch") == batch).alias("own"))
        known = stored(groups.select("digest", "keep_row", "group_size").join(index.hint("merge"), "digest"), "digests-known")
        total = rows.count()
        hot = known.filter(F.col("group_size") >= max(1000, -(-total // HOT_SHARE)))
        warm = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(known.hint("merge"), "digest")
        out = warm.unionByName(rows.join(F.broadcast(hot), "digest"))
        return out.select("doc_id", "keep_id", F.col("size").alias("group_size"), (F.col("own") & (F.col("row") == F.col("keep_row"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
