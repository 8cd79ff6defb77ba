"""Connected components over tables, for groups that no task should hold whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgloom.sources.folders import work_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of the shared folder: its lineage ends here, and a lost executor costs no more than a read."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of all nodes of edges ``a, b`` (long): the smallest node that edges lead to.

    Every node keeps a parent, at first its smallest neighbour. Each round lets parents take the smallest parent met
    over an edge from any of their children, then halves the way to the top, until nothing moves.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "component-edges")
    up = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("p")).select("node", F.least("node", "p").alias("parent")), "parents")
    while True:
        across = both.join(up.select(F.col("node").alias("b"), F.col("parent").alias("other")), "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        hooked = up.join(across, "node").groupBy(F.col("parent").alias("node")).agg(F.min("other").alias("offer"))
        lifted = up.join(across, "node").join(hooked, "node", "left").select("node", F.least("parent", "other", "offer").alias("step"), "parent")
        top = up.select(F.col("node").alias("step"), F.col("parent").alias("above"))
        new = written(lifted.join(top, "step").select("node", F.least("step", "above").alias("next"), "parent"), "parents")
        up = new.select("node", F.col("next").alias("parent"))
        if new.filter("next <> parent").isEmpty():
            return up.withColumnRenamed("parent", "component")


def joined_by_words(rows: DataFrame, key: str, group: str, words: str, salts: int = 32) -> DataFrame:
    """``node, component`` of the rows of a group that share words, over any number of rows between. Rows meet at the
    first row of their word, by way of the first of each of some shares of the word's rows, so that no word's rows are
    in one place."""
    named = rows.select(F.col(key).alias("a"), group, F.explode(words).alias("word")).withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(salts)))
    firsts = named.groupBy(group, "word", "salt").agg(F.min("a").alias("b"))
    tops = firsts.groupBy(group, "word").agg(F.min("b").alias("top"))
    near = named.join(firsts, [group, "word", "salt"]).select("a", "b")
    far = firsts.join(tops, [group, "word"]).select(F.col("b").alias("a"), F.col("top").alias("b"))
    return components(near.union(far))
