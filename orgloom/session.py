"""One place that builds the Spark session: UTC, adaptive execution, Arrow."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "orgloom", cores: int | None = None, partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; on a cluster the submitter's settings win."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("ORGLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
