"""Queries of tables that are declared, of runs that go on, of vocabularies, and of what is observed on the way."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from orgloom.functions import links, terms
from orgloom.operators import attempts, versions
from orgloom.plans.queries_store import SCANS_SQL, STORE_SQL, event_stream, half_time, store
from orgloom.plans.queries_text import IN_PAGE
from orgloom.plans.registry import Queries, Tables
from orgloom.sources import workbook
from orgloom.sources.declared import Declared, sync_touched
from orgloom.sources.folders import work_dir
from orgloom.streaming import flags, ledger, state

Q = Queries()


# Links as a table function.
def links_table(t: Tables) -> DataFrame:
    links.register(t.spark)
    t.pages.createOrReplaceTempView("pages_with_links")
    return t.spark.sql("SELECT page_id, l.pos, l.href FROM pages_with_links, LATERAL extract_links(html) l")


Q.add(
    "x3_links_table", links_table,
    f"""WITH s AS (SELECT page_id, regexp_replace({IN_PAGE}, '(?s)<!--.*?-->', ' ', 'g') AS h FROM pages), a AS (SELECT page_id, regexp_extract_all(h, '(?i)<a\\s[^>]*href="([^"]*)"', 1) AS found FROM s)
        SELECT page_id, CAST(pos AS INT) AS pos, replace(found[pos + 1], '&amp;', '&') AS href FROM (SELECT page_id, found, unnest(range(len(found))) AS pos FROM a)""",
)

# A vocabulary as a table: every word of five letters or more of the benchmark.
TERMS = lambda t: t.benchmark.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0))).alias("term")).distinct()
Q.add(
    "j8_terms_in_texts", lambda t: terms.term_hits(t.documents.select("doc_id", F.lower("text").alias("low")), TERMS(t), "doc_id", "low").groupBy("term").agg(F.count(F.lit(1)).alias("docs")),
    "SELECT term, count(*) AS docs FROM documents, (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS term FROM benchmark) WHERE contains(lower(documents.text), term) GROUP BY 1",
)


# Running metrics: counted while rows pass on their way to the table.
def observed(t: Tables) -> DataFrame:
    seen = Observation("checks")
    rows = t.events.select("user_id", "event_type", "value").observe(
        seen, F.count(F.lit(1)).alias("checked"), F.count_if(F.col("event_type") == "error").alias("failed"), F.count_if(F.col("value") > 50).alias("high"), F.max("value").alias("best"),
    )
    rows.write.parquet(work_dir(t.spark, "observed"))
    return t.spark.createDataFrame([tuple(seen.get[k] for k in ("checked", "failed", "high", "best"))], "checked long, failed long, high long, best double")


Q.add("a14_observed", observed, "SELECT count(*) AS checked, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (value > 50) AS high, max(value) AS best FROM events")


# A run that is stopped in its first batch, after the results were written and before they counted, and then goes on.
class Stopped(Exception):
    pass


def resumed(t: Tables) -> DataFrame:
    path, stream = work_dir(t.spark, "ledger"), event_stream(t)
    work = lambda rows: rows.select("event_id", "user_id", F.upper("event_type").alias("verdict"))

    def stop(step: str, batch: int) -> None:
        if step == "written":
            raise Stopped

    try:
        ledger.run(stream, work, path, stop)
    except Exception:  # noqa: BLE001 the query's own, which the stream wraps
        pass
    ledger.run(stream, work, path)
    return ledger.results(t.spark, path, "event_id long, user_id long, verdict string").select("event_id", "user_id", "verdict", (F.col("batch") > 0).alias("later"))


Q.add("t5_ledger", resumed, "SELECT event_id, user_id, upper(event_type) AS verdict, ts >= TIMESTAMP '2024-01-15' AS later FROM events")

# The flag of change, which ends by a timer.
FLAG_DAYS = 2


def flagged(t: Tables) -> DataFrame:
    out, saved = work_dir(t.spark, "flags"), work_dir(t.spark, "checkpoint")
    scans = event_stream(t).select(F.col("user_id").cast("string").alias("url"), F.col("ts").alias("scanned_at"), F.col("event_id").alias("nth"), F.col("event_type").alias("hash"))
    with flags.rocks_state(t.spark):
        state.run_available(flags.change_flags(scans, FLAG_DAYS), out, saved)
    return t.spark.read.schema(flags.EVENTS).parquet(out)


Q.add(
    "t4_change_flags", flagged,
    f"""WITH s AS ({SCANS_SQL}), c AS (SELECT url, date_trunc('millisecond', scanned_at) AS m FROM s WHERE changed), g AS (SELECT url, m, coalesce(m - lag(m) OVER w > INTERVAL {FLAG_DAYS} DAY, true) AS begins FROM c WINDOW w AS (PARTITION BY url ORDER BY m)),
        i AS (SELECT url, m, begins, count(*) FILTER (begins) OVER (PARTITION BY url ORDER BY m) AS island FROM g), e AS (SELECT url, max(m) + INTERVAL {FLAG_DAYS} DAY AS m FROM i GROUP BY url, island)
        SELECT url, m AS happened_at, 'begun' AS event FROM i WHERE begins UNION ALL SELECT url, m, 'ended' FROM e WHERE m <= (SELECT date_trunc('millisecond', max(ts)) FROM events)""",
)


def listed_titles(t: Tables) -> DataFrame:
    """Every event lists its type and a word of its value's; what the user's event before didn't list is new."""
    out, saved = work_dir(t.spark, "titles"), work_dir(t.spark, "checkpoint")
    titles = F.when(F.col("event_id") % 6 != 0, F.array(F.upper("event_type"), F.concat(F.lit("v"), (F.floor("value") % 3).cast("string"))))
    scans = event_stream(t).select(F.col("user_id").cast("string").alias("version"), F.col("ts").alias("scanned_at"), F.col("event_id").alias("nth"), titles.alias("titles"))
    with flags.rocks_state(t.spark):
        state.run_available(flags.new_titles(scans), out, saved)
    return t.spark.read.schema(flags.NEW_TITLES).parquet(out)


Q.add(
    "t2_listed_titles", listed_titles,
    """WITH s AS (SELECT user_id, ts, event_id, CASE WHEN event_id % 6 <> 0 THEN [upper(event_type), 'v' || CAST(floor(value) AS BIGINT) % 3] ELSE [] END AS titles FROM events),
        p AS (SELECT *, lag(titles) OVER (PARTITION BY user_id ORDER BY date_trunc('millisecond', ts), event_id) AS before FROM s), u AS (SELECT user_id, ts, before, unnest(titles) AS title FROM p WHERE before IS NOT NULL)
        SELECT CAST(user_id AS VARCHAR) AS version, date_trunc('millisecond', ts) AS happened_at, title FROM u WHERE NOT list_contains(before, title)""",
)

# Declared tables.
ORDERS = Declared(
    "orders", {"o_orderkey": "long", "o_custkey": "long", "o_orderstatus": "string", "o_orderpriority": "string", "note": "string"}, {"o_orderpriority": 8, "o_orderstatus": 1}, ("o_orderstatus", "note"), (("o_orderkey",), ("o_custkey", "o_orderpriority")),
)
Q.add(
    "s22_violations", lambda t: ORDERS.violations(t.orders.withColumn("note", F.when(F.col("o_orderkey") % 3 != 0, F.when(F.col("o_orderkey") % 5 != 0, "n").otherwise("")))),
    """SELECT 'cap:o_orderpriority' AS rule, count(*) AS rows FROM orders WHERE length(o_orderpriority) > 8 HAVING count(*) > 0
        UNION ALL SELECT 'required:note', count(*) FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 HAVING count(*) > 0
        UNION ALL SELECT 'unique:o_custkey,o_orderpriority', count(*) - count(DISTINCT (o_custkey, o_orderpriority)) FROM orders HAVING count(*) > count(DISTINCT (o_custkey, o_orderpriority))""",
)
VERSIONS = {"org": "long", "url": "string", "run_id": "string", "discovered_at": "timestamp", "version_id": "string", **dict.fromkeys(versions.KEPT_FIELDS, "string"), "superseded": "boolean"}


def healed(t: Tables) -> DataFrame:
    """A table of versions as an older release made it, healed, filled, and synced in the partitions that are touched."""
    name, path = f"versions_{uuid.uuid4().hex[:12]}", work_dir(t.spark, "declared")
    old = Declared(name, {c: k for c, k in VERSIONS.items() if c not in ("page_text", "version_id")}, partition_by=("superseded",))
    new = Declared(name, VERSIONS, {"url": 400, "page_text": 20_000}, ("org", "url"), (("org", "url", "run_id"),), ("superseded",))
    history, catalogue = store(t)
    columns = list(VERSIONS)
    try:
        old.heal(t.spark, path)
        new.heal(t.spark)
        new.overwrite_touched(history.select(columns))
        synced = work_dir(t.spark, "synced")
        versions.sync_versions(t.spark.table(name).select(columns), catalogue.select("org", "url", *versions.KEPT_FIELDS), "r1", half_time()).write.parquet(synced)
        sync_touched(new, t.spark, t.spark.read.parquet(synced))
    finally:
        t.spark.sql(f"DROP TABLE IF EXISTS {name}")  # its files stay, as they have a place of their own
    return t.spark.read.schema(", ".join(f"{c} {k}" for c, k in VERSIONS.items())).parquet(path).select("org", "url", "superseded", "run_id", "content_hash", "page_text")


Q.add(
    "s22_declared_sync", healed,
    f"""WITH {STORE_SQL} SELECT org, url, superseded OR action = 'supersede' AS superseded, CASE WHEN action = 'insert' THEN 'r1' ELSE 'r0' END AS run_id,
        CASE WHEN action IN ('patch', 'insert') AND org % 5 <> 0 THEN 'h' ELSE '' END AS content_hash, CASE WHEN action IN ('supersede', 'insert') THEN '' ELSE 'old' END AS page_text FROM a""",
)


# A log of search attempts. Every user's events are a run; queries take turns of five attempts, the first ones at the
# primary engine.
def attempts_log(t: Tables) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rows = t.events.select(F.col("user_id").alias("run"), "event_type", "value", nth.alias("seq"))
    first = F.col("seq") % 5 < F.floor(F.col("seq") / 5) % 5
    bad = F.col("event_type").isin("error", "click")
    return rows.select(
        "run", F.floor(F.col("seq") / 5).alias("query"), F.when(first, "main").otherwise("other").alias("engine"), "seq",
        F.when(~bad, 200).when(F.col("event_type") == "error", 403).otherwise(429).alias("status"), F.when(bad, 0).otherwise(F.floor(F.col("value")).cast("int") % 7).alias("found"),
    )


LOG_SQL = """n AS (SELECT user_id AS run, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq FROM events),
    l AS (SELECT run, seq // 5 AS query, CASE WHEN seq % 5 < seq // 5 % 5 THEN 'main' ELSE 'other' END AS engine, seq, CASE event_type WHEN 'error' THEN 403 WHEN 'click' THEN 429 ELSE 200 END AS status,
        CASE WHEN event_type IN ('error', 'click') THEN 0 ELSE CAST(floor(value) AS INT) % 7 END AS found FROM n),
    r AS (SELECT run, seq, query, engine, status, found, 0 AS attempt, CASE WHEN engine = 'other' AND found <= 0 THEN 1 ELSE 0 END AS empties FROM l WHERE seq = 0
        UNION ALL SELECT l.run, l.seq, l.query, l.engine, l.status, l.found, CASE WHEN l.query = r.query AND l.engine = r.engine THEN r.attempt + 1 ELSE 0 END,
            CASE WHEN l.engine = 'main' THEN CASE WHEN r.empties >= 3 THEN 0 ELSE r.empties END WHEN l.found > 0 THEN 0 WHEN r.empties >= 3 THEN 1 ELSE r.empties + 1 END FROM r JOIN l ON l.run = r.run AND l.seq = r.seq + 1),
    d AS (SELECT *, CASE WHEN engine = 'main' THEN CASE WHEN status = 200 THEN 'done' WHEN status = 429 AND attempt < 3 THEN 'retry' ELSE 'fallback' END WHEN found > 0 THEN 'done' WHEN attempt >= 3 THEN 'gave_up' ELSE 'retry' END AS decision,
        CASE WHEN engine = 'main' THEN CASE WHEN status = 429 THEN 2 * (attempt + 1) ELSE 0 END WHEN found > 0 THEN 0 WHEN empties = 3 THEN 300 ELSE 12 * (attempt + 2) END AS wait FROM r)"""
Q.add("s9_attempts", lambda t: attempts.decided(attempts_log(t), "main").select("run", "query", "engine", "seq", "attempt", "decision", "wait"), f"WITH RECURSIVE {LOG_SQL} SELECT run, query, engine, seq, CAST(attempt AS INT) AS attempt, decision, wait FROM d")
Q.add(
    "s9_outcomes", lambda t: attempts.outcomes(attempts.decided(attempts_log(t), "main")),
    f"""WITH RECURSIVE {LOG_SQL} SELECT run, query, arg_max(engine, seq) AS engine, arg_max(decision, seq) AS decision, arg_max(CASE WHEN decision = 'done' THEN found ELSE 0 END, seq) AS found, count(*) AS attempts, sum(wait) AS waited FROM d GROUP BY 1, 2""",
)


# A workbook, written by the source and read again by ranges of rows.
def workbook_round(t: Tables) -> DataFrame:
    workbook.register(t.spark)
    path = work_dir(t.spark, "workbook")
    rows = t.part.select("p_partkey", F.concat("p_name", F.lit(" <&> \"é\"")).alias("p_name"), F.when(F.col("p_size") % 3 != 0, F.col("p_size")).alias("p_size"), "p_retailprice", (F.col("p_size") > 25).alias("large"))
    rows.repartition(3).write.format("workbook").mode("append").save(path)
    return t.spark.read.format("workbook").schema("large boolean, p_name string, p_partkey long, p_retailprice double, p_size int, absent string").load(path)


Q.add("s21_workbook", workbook_round, "SELECT p_partkey, p_name || ' <&> \"é\"' AS p_name, CASE WHEN p_size % 3 <> 0 THEN p_size END AS p_size, p_retailprice, p_size > 25 AS large, CAST(NULL AS VARCHAR) AS absent FROM part")
