"""How queries are registered: a name, a plan over the tables of a folder, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """The tables of a folder as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def spread(self, name: str, key: str) -> DataFrame:
        """A table of short rows, dealt by a key over the cluster before much work is done on each: a row group is read
        by one task, and a million short rows may be one. The number is given, so that few bytes aren't put together."""
        most = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.spark.sparkContext.defaultParallelism)
        return getattr(self, name).repartition(most, key)


Plan = Callable[[Tables], DataFrame]


@dataclass
class Queries:
    plans: dict[str, Plan] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, plan: Plan, sql: str | None = None) -> None:
        if name in self.plans:
            raise ValueError(f"{name} is registered twice")
        self.plans[name] = plan
        if sql is not None:
            self.sql[name] = sql
