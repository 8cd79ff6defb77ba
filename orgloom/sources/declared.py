"""Catalogue tables that are declared: columns, caps on texts, required columns and unique keys."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Declared:
    """A table as it should be. ``caps`` are the most characters of texts; ``unique`` are keys of one or more columns."""

    name: str
    columns: Mapping[str, str]
    caps: Mapping[str, int] = field(default_factory=dict)
    required: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    partition_by: tuple[str, ...] = ()

    @property
    def ddl(self) -> str:
        return ", ".join(f"{c} {t}" for c, t in self.columns.items())

    def heal(self, spark: SparkSession, location: str | None = None) -> list[str]:
        """Make the table if it isn't there, else add the columns that it lacks; gives these. A column of another type
        than declared raises, as its values would be lost."""
        if not spark.catalog.tableExists(self.name):
            by = f" PARTITIONED BY ({', '.join(self.partition_by)})" if self.partition_by else ""
            at = f" LOCATION '{location}'" if location else ""
            spark.sql(f"CREATE TABLE {self.name} ({self.ddl}) USING parquet{by}{at}")
            return []
        held = {f.name: f.dataType for f in spark.table(self.name).schema.fields}
        wanted = {f.name: f.dataType for f in T.StructType.fromDDL(self.ddl).fields}
        wrong = [c for c, t in wanted.items() if c in held and held[c] != t]
        if wrong:
            raise ValueError(f"{self.name}: columns of another type: {', '.join(wrong)}")
        added = [c for c in wanted if c not in held]
        if added:
            spark.sql(f"ALTER TABLE {self.name} ADD COLUMNS ({', '.join(f'{c} {self.columns[c]}' for c in added)})")
        return added

    def broken(self) -> Column:
        """The rules that a row breaks by itself, as an array: ``cap:column``, ``required:column``."""
        rules = [F.when(F.length(c) > most, f"cap:{c}") for c, most in self.caps.items()]
        rules += [F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), f"required:{c}") for c in self.required]
        return F.array_compact(F.array(*rules)) if rules else F.array().cast("array<string>")

    def violations(self, rows: DataFrame) -> DataFrame:
        """``rule, rows``: how many rows break each rule; of a unique key those beyond the first of each value. Rows
        whose key has a null are unlike all others. Counts are combined before they are shuffled."""
        own = rows.select(F.explode(self.broken()).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("rows"))
        for key in self.unique:
            known = rows.dropna(subset=list(key)).groupBy(*key).agg((F.count(F.lit(1)) - 1).alias("more")).filter("more > 0")
            own = own.unionByName(known.agg(F.sum("more").alias("rows")).filter("rows > 0").select(F.lit(f"unique:{','.join(key)}").alias("rule"), "rows"))
        return own

    def shaped(self, rows: DataFrame) -> DataFrame:
        """Rows with the declared columns in order, those that they lack as null, texts cut to their caps."""
        have = set(rows.columns)
        value = lambda c: (F.substring(c, 1, self.caps[c]) if c in self.caps else F.col(c)) if c in have else F.lit(None)
        ordered = [c for c in self.columns if c not in self.partition_by] + list(self.partition_by)
        return rows.select(*[value(c).cast(self.columns[c]).alias(c) for c in ordered])

    def overwrite_touched(self, rows: DataFrame) -> None:
        """Write rows over the partitions that they are in; all other partitions keep their files."""
        spark, key = rows.sparkSession, "spark.sql.sources.partitionOverwriteMode"
        before = spark.conf.get(key)
        spark.conf.set(key, "dynamic")  # the writer's own option does not reach a table of the catalogue
        try:
            self.shaped(rows).select(*spark.table(self.name).columns).write.mode("overwrite").insertInto(self.name)
        finally:
            spark.conf.set(key, before)


def sync_touched(table: Declared, spark: SparkSession, synced: DataFrame, action: str = "action") -> bool:
    """Write what a sync gives, ``action`` saying of each row what became of it. Only current rows are rewritten where
    none was superseded, and nothing where none changed; the history is written when rows join it. The result is stored
    by the caller before, as the table is read and written at once otherwise. Gives whether anything was written."""
    done = synced.agg(F.count_if(F.col(action) == "supersede"), F.count_if(F.col(action).isin("patch", "insert", "supersede"))).first()
    if not done[1]:
        return False
    rows = synced.drop(action)
    table.overwrite_touched(rows if done[0] else rows.filter(~F.col("superseded")))
    return True
