"""What a log of search attempts leads to: retries, waits, cool-downs and the fallback to another engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Attempts of a query at an engine, and seconds to wait: after the nth refusal, after the nth empty answer, and where
#: so many empty answers came in a row that the engine must be blocking.
TRIES = 4
REFUSED_WAIT, EMPTY_WAIT, COOL_DOWN, EMPTY_ROW = 2, 12, 300, 3


def decided(log: DataFrame, primary: str, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Each attempt ``run, query, engine, seq, status, found`` with its number ``attempt`` (from 0), the ``decision``
    (done, retry, fallback, gave_up) and the seconds to ``wait`` after it.

    The primary engine answers with a status: 429 is tried again and leads to the fallback after ``TRIES``; any other
    than 200 leads there at once. The other engine only shows that it refuses by empty answers. These are counted over
    all queries of a run, in order, until one brings results; each third in a row asks for a long pause.
    """
    own = Window.partitionBy("run", "query", "engine").orderBy(*order)
    lane = Window.partitionBy("run", "engine").orderBy(*order)
    first = F.col("engine") == primary
    hit = F.coalesce(F.col("found") > 0, F.lit(False))
    rows = log.withColumn("attempt", F.row_number().over(own) - 1).withColumn("good_so_far", F.count_if(hit).over(lane))
    since = Window.partitionBy("run", "engine", "good_so_far").orderBy(*order)
    rows = rows.withColumn("empties", F.count_if(~hit).over(since))  # the good one that begins the stretch isn't counted
    last = F.col("attempt") >= TRIES - 1
    status = F.coalesce(F.col("status"), F.lit(0))
    decision = F.when(first, F.when(status == 200, "done").when((status == 429) & ~last, "retry").otherwise("fallback")).otherwise(F.when(hit, "done").when(last, "gave_up").otherwise("retry"))
    refused = F.when(status == 429, REFUSED_WAIT * (F.col("attempt") + 1)).otherwise(0)
    empty = F.when(hit, 0).when(F.col("empties") % EMPTY_ROW == 0, COOL_DOWN).otherwise(EMPTY_WAIT * (F.col("attempt") + 2))
    return rows.withColumn("decision", decision).withColumn("wait", F.when(first, refused).otherwise(empty).cast("int")).drop("good_so_far", "empties")


def outcomes(attempts: DataFrame, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """What became of each query: the last ``decision``, its ``engine``, results ``found``, all ``attempts`` and all
    seconds ``waited``."""
    at = F.struct(*order)
    last = F.max_by(F.struct("engine", "decision", F.when(F.col("decision") == "done", F.coalesce("found", F.lit(0))).otherwise(0).alias("found")), at)
    done = attempts.groupBy("run", "query").agg(last.alias("last"), F.count(F.lit(1)).alias("attempts"), F.sum("wait").alias("waited"))
    return done.select("run", "query", "last.engine", "last.decision", "last.found", "attempts", "waited")
