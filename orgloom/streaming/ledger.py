"""Long runs over a stream of work that may stop anywhere and go on from where they were."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Work = Callable[[DataFrame], DataFrame]
#: Called after each step of a batch, with the step's name and the batch's number; for tests and progress reports.
Watch = Callable[[str, int], None]


def _folder(path: str, kind: str, batch: int) -> str:
    return f"{path}/{kind}/batch={batch}"


def _exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)


def entered(spark: SparkSession, path: str) -> DataFrame:
    """The ledger: ``batch, rows`` of the finished batches."""
    schema = "rows long, batch int"
    folder = f"{path}/ledger"
    return spark.read.schema(schema).option("basePath", folder).parquet(folder) if _exists(spark, folder) else spark.createDataFrame([], schema)


def run(stream: DataFrame, work: Work, path: str, watch: Watch = lambda step, batch: None) -> None:
    """Do ``work`` on all that is available, batch by batch, and put the results below ``path``.

    The stream's checkpoint gives a batch the same rows and the same number if it comes again. Its results replace what
    an earlier try left under that number, then an entry in the ledger makes them count, so that every row is worked on
    and counted once wherever a run was stopped. A batch that has its entry is passed over.
    """
    spark = stream.sparkSession

    def batch_done(rows: DataFrame, batch: int) -> None:
        if _exists(spark, _folder(path, "ledger", batch) + "/_SUCCESS"):
            return
        watch("begun", batch)
        work(rows).write.mode("overwrite").parquet(_folder(path, "data", batch))
        watch("written", batch)
        done = spark.read.parquet(_folder(path, "data", batch)).agg(F.count(F.lit(1)).alias("rows"))
        done.write.mode("overwrite").parquet(_folder(path, "ledger", batch))
        watch("entered", batch)

    stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(batch_done).start().awaitTermination()


def results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The results of finished batches, with their ``batch``."""
    data = f"{path}/data"
    if not _exists(spark, data):
        return spark.createDataFrame([], f"{schema}, batch int")
    rows = spark.read.schema(f"{schema}, batch int").option("basePath", data).parquet(data)
    return rows.join(entered(spark, path).select("batch"), "batch", "left_semi")
