"""Queries of joins, merging, the versioned store, sources, pages and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orgloom.functions import urls
from orgloom.functions.text import merge_key, name_tokens
from orgloom.operators import discover, freshness, openings, resolve, versions
from orgloom.plans.registry import Queries, Tables
from orgloom.sources import readers
from orgloom.sources.folders import work_dir
from orgloom.streaming import state

Q = Queries()
AS_OF = "2001-01-01"


def day() -> Column:
    return F.lit(AS_OF).cast("date")


def half_time() -> Column:
    return F.to_timestamp(F.lit("2024-01-15 00:00:00"))


# Joins.
Q.add("j1_current_version", lambda t: versions.with_current(t.customer, t.orders.withColumn("superseded", F.col("o_orderstatus") != "P"), "c_custkey", "o_custkey").select("c_custkey", "o_orderkey"), "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON c_custkey = o_custkey")
Q.add(
    "j2_latest_check", lambda t: t.customer.join(versions.latest_per_key(t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus"), "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")]), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("o_orderstatus", F.lit("")).alias("verdict")),
    "SELECT c_custkey, coalesce(o_orderstatus, '') AS verdict FROM customer LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1) ON c_custkey = o_custkey",
)
Q.add(
    "j3_split_by_key", lambda t: (lambda known, new: known.select("c_custkey", F.lit("update").alias("op")).unionByName(new.select("c_custkey", F.lit("create").alias("op"))))(*versions.split_by_key(t.customer, t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")),
    "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'update' ELSE 'create' END AS op FROM customer",
)
HALVES = lambda t: (t.events.filter(F.col("ts") < half_time()), t.events.filter(F.col("ts") >= half_time()))
LAST = lambda e: versions.latest_per_key(e.select("user_id", "event_type", "ts", "event_id"), "user_id", [F.col("ts"), F.col("event_id")])
LAST_SQL = "SELECT user_id, event_type FROM events WHERE ts {op} TIMESTAMP '2024-01-15' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"
BOTH_SQL = f"(SELECT coalesce(a.user_id, b.user_id) AS user_id, a.event_type AS old, b.event_type AS new FROM ({LAST_SQL.format(op='<')}) a FULL JOIN ({LAST_SQL.format(op='>=')}) b ON a.user_id = b.user_id)"
Q.add(
    "j4_classify", lambda t: (lambda a, b: LAST(a).select("user_id", F.col("event_type").alias("old")).join(LAST(b).select("user_id", F.col("event_type").alias("new")), "user_id", "full_outer").select("user_id", F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "kept").when(F.col("old") == F.col("new"), "unchanged").otherwise("moved").alias("action")))(*HALVES(t)),
    f"SELECT user_id, CASE WHEN old IS NULL THEN 'new' WHEN new IS NULL THEN 'kept' WHEN old = new THEN 'unchanged' ELSE 'moved' END AS action FROM {BOTH_SQL}",
)
Q.add("j5_update_in_place", lambda t: t.documents.join(t.labels.select("doc_id", F.col("quality").alias("new")), "doc_id", "left").select("doc_id", F.coalesce("new", F.lit(-1)).alias("quality")), "SELECT doc_id, coalesce(quality, -1) AS quality FROM documents LEFT JOIN labels USING (doc_id)")
Q.add("j6_resume", lambda t: discover.todo(t.documents.select("doc_id"), t.labels.select("doc_id", F.when(F.col("quality") == 1, "high").otherwise("none").alias("confidence")), "doc_id"), "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
Q.add(
    "j7_edits", lambda t: t.orders.select("o_orderkey", "o_orderstatus").join(t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 9 == 0, "F").otherwise(F.col("o_orderstatus")).alias("edited")), "o_orderkey").filter("edited <> o_orderstatus").select("o_orderkey", "edited"),
    "SELECT o_orderkey, 'F' AS edited FROM orders WHERE o_orderkey % 9 = 0 AND o_orderstatus <> 'F'",
)
Q.add(
    "j9_sitemap",
    lambda t: freshness.sitemap_dates(t.pages.select("page_id", "url"), t.pages.filter("page_id % 3 = 0").select(F.concat(F.lit(" "), F.rtrim("url", F.lit("/")), F.lit("/")).alias("loc"), F.format_string("2024-03-%02dT00:00", (F.col("page_id") % 28 + 1).cast("int")).alias("lastmod"), F.lit(0).alias("map_order"), F.col("page_id").alias("pos")), "url").select("page_id", "sitemap_date"),
    "WITH e AS (SELECT rtrim(url, '/') AS k, arg_min(format('2024-03-{:02d}', page_id % 28 + 1), page_id) AS d FROM pages WHERE page_id % 3 = 0 GROUP BY 1) SELECT page_id, coalesce(d, '') AS sitemap_date FROM pages LEFT JOIN e ON rtrim(url, '/') = k",
)
Q.add(
    "j10_shared_words", lambda t: (lambda x: x.join(x.groupBy("domain", "token").agg(F.count_distinct("s_suppkey").alias("n")).filter("n > 1"), ["domain", "token"], "left_semi").select("s_suppkey").distinct())(t.supplier.select("s_suppkey", F.col("s_nationkey").alias("domain"), F.explode(name_tokens(F.concat(F.substring("s_name", -2, 2), F.lit("x supplier "), (F.col("s_suppkey") % 3).cast("string"), F.lit("kind")))).alias("token"))),
    "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT s_nationkey FROM supplier GROUP BY 1 HAVING count(*) > 1)",
)

# Merging. Suppliers, then customers, then nations as sources of one catalogue.
SOURCES = lambda t: (
    t.spread("supplier", "s_suppkey").select(F.concat(F.lit("Body "), F.col("s_nationkey").cast("string"), F.lit(" (S)")).alias("organisation"), F.lit(0).alias("src"), F.col("s_suppkey").alias("pos"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise("").alias("description"), F.lit("sheet").alias("sector"), F.lit("").alias("type"), F.array(F.lit("target list")).alias("sources"))
    .unionByName(t.spread("customer", "c_custkey").select(F.concat(F.lit("the body-"), F.col("c_nationkey").cast("string")).alias("organisation"), F.lit(1).alias("src"), F.col("c_custkey").alias("pos"), F.col("c_name").alias("description"), F.col("c_mktsegment").alias("sector"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("").alias("type"), F.array(F.lit("Regional registry")).alias("sources")))
    .withColumn("key", merge_key(F.col("organisation")))
)
UNION_SQL = """u AS (SELECT 'body' || s_nationkey AS key, 0 AS src, s_suppkey AS pos, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE '' END AS description, 'sheet' AS sector, '' AS type FROM supplier
    UNION ALL SELECT 'body' || c_nationkey, 1, c_custkey, c_name, c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END FROM customer)"""
Q.add(
    "m2_first_filled", lambda t: resolve.merge_first_filled(SOURCES(t), "key", ["src", "pos"], ["description", "sector", "type"], ("sources",)).withColumn("sources", F.array_join("sources", ",")),
    f"WITH {UNION_SQL} SELECT key, coalesce(arg_min(description, (src, pos)) FILTER (description <> ''), '') AS description, arg_min(sector, (src, pos)) AS sector, coalesce(arg_min(type, (src, pos)) FILTER (type <> ''), '') AS type, CASE WHEN max(src) = 0 THEN 'target list' WHEN min(src) = 1 THEN 'Regional registry' ELSE 'Regional registry,target list' END AS sources FROM u GROUP BY 1",
)
Q.add(
    "m3_registry_override", lambda t: resolve.merge_catalogue(SOURCES(t), "key", ["src", "pos"], ["description", "sector", "type"]).select("key", "sector", "type"),
    f"WITH {UNION_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY src, pos) AS rn FROM u) SELECT key, coalesce(arg_max(sector, (src, pos)) FILTER (rn > 1 AND src = 1), arg_min(sector, (src, pos))) AS sector, coalesce(arg_max(type, (src, pos)) FILTER (rn > 1 AND src = 1 AND type <> ''), arg_min(type, (src, pos)) FILTER (type <> ''), '') AS type FROM o GROUP BY 1",
)
Q.add("m4_cluster_by_domain", lambda t: resolve.cluster_by_domain(t.pages.select(F.col("page_id").alias("pos"), F.concat(F.regexp_extract("url", "/([a-z]{2})/", 1), F.lit("page "), (F.col("page_id") % 5).cast("string"), F.lit("kind")).alias("organisation"), F.col("url").alias("homepage"), F.lit("").alias("careers_url"), F.when(F.col("page_id") % 4 == 0, F.array(F.lit("target list"))).otherwise(F.array(F.lit("harvest"))).alias("sources"))).withColumn("sources", F.array_join("sources", ",")))
Q.add("m6_longest_name", lambda t: resolve.longest_name(t.pages.select(urls.domain(F.col("url")).alias("host"), F.col("url").alias("name"), F.col("page_id").alias("pos")), "host", "name", "pos"), f"SELECT host, name, pos FROM (SELECT regexp_replace(regexp_extract(lower(url), '^https?://([^/]+)', 1), '^www\\.', '') AS host, url AS name, page_id AS pos FROM pages) QUALIFY row_number() OVER (PARTITION BY host ORDER BY length(name) DESC, pos) = 1")
Q.add("m7_first_per_host", lambda t: t.pages.groupBy(urls.domain(F.col("url")).alias("host")).agg(F.min_by("url", "page_id").alias("url")), "SELECT regexp_replace(regexp_extract(lower(url), '^https?://([^/]+)', 1), '^www\\.', '') AS host, arg_min(url, page_id) AS url FROM pages GROUP BY 1")
Q.add("m8_dedupe_jobs", lambda t: resolve.first_per_key(t.part.select("p_partkey", F.coalesce(F.nullif(F.when(F.col("p_size") > 40, F.col("p_name")), F.lit("")), F.concat_ws("|", "p_type", "p_brand")).alias("key")), ["key"], [F.asc("p_partkey")]), "SELECT min(p_partkey) AS p_partkey, key FROM (SELECT p_partkey, CASE WHEN p_size > 40 THEN p_name ELSE p_type || '|' || p_brand END AS key FROM part) GROUP BY key")
Q.add("m10_seen_in_page", lambda t: resolve.first_per_key(t.lineitem, ["l_orderkey", "l_suppkey"], [F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("l_extendedprice")]).select("l_orderkey", "l_suppkey", "l_linenumber"), "SELECT l_orderkey, l_suppkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY 1, 2")
POOL = lambda t: t.lineitem.select("l_orderkey", F.col("l_linenumber").alias("query_pos"), F.when(F.col("l_linenumber") == 1, "site:x").otherwise("plain").alias("query"), (F.col("l_partkey") % 5).cast("int").alias("rank"), F.col("l_suppkey").cast("string").alias("url"))
Q.add(
    "m11_pool", lambda t: resolve.pool_candidates(POOL(t), "l_orderkey", "query", "rank", "url"),
    """WITH f AS (SELECT l_orderkey, l_linenumber AS qp, CAST(l_partkey % 5 AS INT) AS rank, CAST(l_suppkey AS VARCHAR) AS url FROM lineitem WHERE l_partkey % 5 < 3), m AS (SELECT l_orderkey, url, min(qp) AS met FROM f GROUP BY 1, 2),
        n AS (SELECT l_orderkey, qp, count(m.url) AS new FROM (SELECT DISTINCT l_orderkey, qp FROM f) LEFT JOIN m USING (l_orderkey) WHERE m.met = qp OR m.met IS NULL GROUP BY 1, 2),
        a AS (SELECT d.l_orderkey, d.qp, sum(coalesce(n.new, 0)) OVER (PARTITION BY d.l_orderkey ORDER BY d.qp) AS so_far FROM (SELECT DISTINCT l_orderkey, qp FROM f) d LEFT JOIN n ON n.l_orderkey = d.l_orderkey AND n.qp = d.qp),
        s AS (SELECT l_orderkey, min(qp) FILTER (so_far >= 4 AND qp <> 1) AS stop FROM a GROUP BY 1)
        SELECT l_orderkey, url, min(rank) AS rank FROM f JOIN s USING (l_orderkey) WHERE stop IS NULL OR qp <= stop GROUP BY 1, 2""",
)
Q.add("m12_ttl_lookup", lambda t: resolve.newest_within(t.events.select("user_id", "ts", "event_id"), "user_id", "ts", F.to_timestamp(F.lit("2024-01-20 00:00:00")), 86400 * 7, ["event_id"]).select("user_id", "event_id"), "SELECT user_id, event_id FROM events WHERE ts > TIMESTAMP '2024-01-20' - INTERVAL 7 DAY QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
Q.add(
    "m13_upsert", lambda t: (lambda a, b: versions.upsert(LAST(a).select("user_id", "event_type"), LAST(b).select("user_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("event_type")), "user_id", ["event_type"]))(*HALVES(t)),
    f"SELECT user_id, coalesce(CASE WHEN new <> 'error' THEN new END, old) AS event_type, CASE WHEN old IS NULL THEN 'insert' WHEN new IS NOT NULL AND new <> 'error' AND new <> old THEN 'update' ELSE 'keep' END AS action FROM {BOTH_SQL}",
)


def store(t: Tables) -> tuple[DataFrame, DataFrame]:
    """A history of addresses from the first half of the events, and a catalogue from the second. Catalogue rows of
    every fourth organisation were scanned without openings, of every fifth not scanned at all."""
    a, b = HALVES(t)
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kept = {f: F.lit("old" if f == "page_text" else "").alias(f) for f in versions.KEPT_FIELDS}
    first = a.withColumn("before", F.lag("event_type").over(w)).filter("before IS NULL OR before <> event_type").withColumn("after", F.lead("ts").over(w))
    org, empty = F.col("user_id"), F.array().cast("array<string>")
    history = first.select(
        org.alias("org"), F.col("event_type").alias("url"), F.col("after").isNotNull().alias("superseded"), F.lit("r0").alias("run_id"), F.col("ts").alias("discovered_at"), *kept.values(),
        F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("version_id"), F.lit("low").alias("confidence"), F.lit(1).alias("score"), empty.alias("reasons"), F.lit("old").alias("method"),
        F.lit("has_openings").alias("openings_state"), F.lit(9).alias("openings_count"), F.array(F.lit("old")).alias("openings_titles"), F.lit("1999-01-01").alias("openings_deadline"),
        F.lit("t0").alias("openings_checked_at"), F.lit(99).alias("last_updated_age_days"),
    )
    scanned, some = org % 5 != 0, org % 4 != 0
    new = LAST(b).select(
        org.alias("org"), F.when(F.col("event_type") != "error", F.col("event_type")).otherwise("").alias("url"), *[F.when(scanned, "h" if f == "content_hash" else "").otherwise("").alias(f) for f in versions.KEPT_FIELDS],
        F.when(some, "high").alias("confidence"), F.when(some, org.cast("int")).alias("score"), F.when(some, F.array(F.lit("why"))).alias("reasons"), F.when(some, "probe").otherwise("").alias("method"),
        F.when(scanned & some, "has_openings").alias("openings_state"), F.when(scanned & some, 2).alias("openings_count"), F.when(scanned & some, F.array(F.lit("a"), F.lit("b"))).alias("openings_titles"),
        F.when(scanned & some, "2001-01-01").alias("openings_deadline"), F.when(scanned, "t1").alias("openings_checked_at"), F.when(scanned & some, 3).alias("last_updated_age_days"),
    )
    return history, new


STORE_SQL = f"""h AS (SELECT user_id AS org, event_type AS url, event_id, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NOT NULL AS superseded FROM
    (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events WHERE ts < TIMESTAMP '2024-01-15') WHERE before IS NULL OR before <> event_type),
    n AS (SELECT user_id AS org, event_type AS new_url FROM ({LAST_SQL.format(op='>=')}) WHERE event_type <> 'error'), c AS (SELECT org, url FROM h WHERE NOT superseded),
    a AS (SELECT h.org, h.url, CASE WHEN h.superseded OR new_url IS NULL THEN 'keep' WHEN new_url <> h.url THEN 'supersede' WHEN h.org % 5 <> 0 THEN 'patch' ELSE 'keep' END AS action, h.superseded, event_id FROM h LEFT JOIN n ON h.org = n.org
        UNION ALL SELECT n.org, new_url, 'insert', false, NULL FROM n LEFT JOIN c ON n.org = c.org WHERE url IS NULL OR url <> new_url),
    r AS (SELECT *, action IN ('patch', 'insert') AND org % 5 <> 0 AND org % 4 <> 0 AS whole, action IN ('patch', 'insert') AS fresh FROM a)"""
VERSION_SQL = """SELECT org, url, superseded OR action = 'supersede' AS superseded, action, CASE WHEN fresh AND org % 5 <> 0 THEN 'h' ELSE '' END AS content_hash, CASE WHEN action IN ('supersede', 'insert') THEN '' ELSE 'old' END AS page_text,
    CASE WHEN whole THEN 'has_openings' WHEN fresh THEN 'unknown' ELSE 'has_openings' END AS openings_state, CASE WHEN whole THEN 2 WHEN fresh THEN 0 ELSE 9 END AS openings_count,
    CASE WHEN whole THEN 'a|b' WHEN fresh THEN '' ELSE 'old' END AS openings_titles, CASE WHEN whole THEN '2001-01-01' WHEN fresh THEN '' ELSE '1999-01-01' END AS openings_deadline,
    CASE WHEN fresh AND org % 5 <> 0 THEN 't1' WHEN fresh THEN NULL ELSE 't0' END AS openings_checked_at, CASE WHEN whole THEN 3 WHEN fresh THEN NULL ELSE 99 END AS last_updated_age_days,
    CASE WHEN action <> 'insert' THEN 'low' WHEN org % 4 <> 0 THEN 'high' ELSE 'none' END AS confidence, CASE WHEN action <> 'insert' THEN 1 WHEN org % 4 <> 0 THEN CAST(org AS INT) ELSE 0 END AS score,
    CASE WHEN action = 'insert' AND org % 4 <> 0 THEN 'why' ELSE '' END AS reasons, CASE WHEN action <> 'insert' THEN 'old' WHEN org % 4 <> 0 THEN 'probe' ELSE 'search+verify' END AS method,
    CASE WHEN action = 'insert' THEN 'r1' ELSE 'r0' END AS run_id FROM r"""
SYNCED = lambda df: df.select("org", "url", "superseded", "action", "content_hash", "page_text", "openings_state", "openings_count", F.array_join("openings_titles", "|").alias("openings_titles"), "openings_deadline", "openings_checked_at", "last_updated_age_days", "confidence", "score", F.array_join("reasons", "|").alias("reasons"), "method", "run_id")
Q.add("m14_sync_versions", lambda t: SYNCED(versions.sync_versions(*store(t), "r1", half_time())), f"WITH {STORE_SQL} {VERSION_SQL}")


def pointed(t: Tables) -> DataFrame:
    """A whole sync: organisations created or changed, and pointed to the version that the run added."""
    history, new = store(t)
    orgs = LAST(HALVES(t)[0]).filter("user_id % 3 <> 0").select(F.col("user_id").alias("org"), F.lit("unnamed").alias("organisation"), F.lit("p").alias("sector"), F.concat(F.lit("v-"), "event_type").alias("current_url"))
    named = new.withColumns({"organisation": F.concat(F.lit("Org "), F.col("org").cast("string")), "sector": F.when(F.col("org") % 2 == 0, "s")})
    orgs, synced = versions.sync(orgs, history, named, "r1", half_time())
    added = synced.filter("action = 'insert'").select("org", F.col("version_id").alias("current_url"), F.lit(True).alias("added"))
    return orgs.join(added, ["org", "current_url"], "left").select("org", "organisation", "sector", F.coalesce("added", F.lit(False)).alias("moved"), F.when(F.col("added").isNull(), F.col("current_url")).alias("kept_version"))


Q.add(
    "m14_whole_sync", pointed,
    f"""WITH {STORE_SQL}, o AS (SELECT user_id AS org, event_type FROM ({LAST_SQL.format(op='<')}) WHERE user_id % 3 <> 0), b AS (SELECT user_id AS org FROM ({LAST_SQL.format(op='>=')})), i AS (SELECT org FROM r WHERE action = 'insert')
        SELECT coalesce(o.org, b.org) AS org, CASE WHEN b.org IS NULL THEN 'unnamed' ELSE 'Org ' || b.org END AS organisation, CASE WHEN b.org % 2 = 0 THEN 's' WHEN o.org IS NOT NULL THEN 'p' END AS sector,
               i.org IS NOT NULL AS moved, CASE WHEN i.org IS NULL AND o.org IS NOT NULL THEN 'v-' || o.event_type END AS kept_version
        FROM o FULL JOIN b ON o.org = b.org LEFT JOIN i ON i.org = coalesce(o.org, b.org)""",
)


def refreshed(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Every organisation scanned in the second half is refreshed: pages are dated for every third, fingerprinted but
    for every fifth, and read but for every fourth; all are reviewed before, at a date that every other has passed."""
    history, new = store(t)
    org = F.col("org")
    history = history.withColumns({"openings_new_titles": F.array(F.lit("older")), "openings_new_at": F.lit("t0")})
    read = org % 4 != 0
    scans = new.select(
        "org", "url", "confidence", "score", "reasons", F.when(org % 3 == 0, "2001-02-03").otherwise("").alias("date"), F.lit("meta").alias("source"), F.lit("high").alias("trust"), F.lit(7).alias("age_days"),
        F.when(org % 5 != 0, "h").otherwise("").alias("hash"), F.when(read, "has_openings").otherwise("unknown").alias("state"), F.when(read, 2).otherwise(0).alias("count"),
        F.when(read & (org % 7 != 0), F.array(F.lit(" OLD"), F.lit("b"))).when(read, F.array(F.lit("Old"))).otherwise(F.array().cast("array<string>")).alias("titles"),
    )
    orgs = history.select("org").distinct().select("org", F.lit("p").alias("current_url"), (org % 11 != 0).alias("reviewed"), F.lit("u").alias("reviewed_url"), F.when(org % 2 == 0, "2001-01-01").otherwise("2002-01-01").alias("reviewed_page_date"))
    return versions.refresh(orgs, history, scans, "r1", F.lit("now"))


REFRESH_SQL = f"""{STORE_SQL.rsplit("a AS (", 1)[0]}
    a AS (SELECT h.org, h.url, CASE WHEN h.superseded OR new_url IS NULL THEN 'keep' WHEN new_url <> h.url THEN 'supersede' ELSE 'patch' END AS action, h.superseded FROM h LEFT JOIN n ON h.org = n.org
        UNION ALL SELECT n.org, new_url, 'insert', false FROM n LEFT JOIN c ON n.org = c.org WHERE url IS NULL OR url <> new_url),
    r AS (SELECT *, action IN ('patch', 'insert') AS fresh, org % 4 <> 0 AS readable, CASE WHEN org % 4 = 0 THEN '' WHEN org % 7 <> 0 THEN ' OLD|b' ELSE 'Old' END AS titles FROM a)"""
Q.add(
    "m15_refresh_versions", lambda t: refreshed(t)[1].select("org", "url", "superseded", "action", "last_updated", "last_updated_age_days", "content_hash", "openings_state", "openings_count", F.array_join("openings_titles", "|").alias("titles"), F.array_join("openings_new_titles", "|").alias("new_titles"), "openings_new_at", "method"),
    f"""WITH {REFRESH_SQL} SELECT org, url, superseded OR action = 'supersede' AS superseded, action, CASE WHEN fresh AND org % 3 = 0 THEN '2001-02-03' ELSE '' END AS last_updated,
        CASE WHEN action = 'insert' OR (action = 'patch' AND org % 3 = 0) THEN 7 ELSE 99 END AS last_updated_age_days, CASE WHEN fresh AND org % 5 <> 0 THEN 'h' ELSE '' END AS content_hash,
        CASE WHEN fresh AND NOT readable THEN 'unknown' ELSE 'has_openings' END AS openings_state, CASE WHEN NOT fresh THEN 9 WHEN readable THEN 2 ELSE 0 END AS openings_count, CASE WHEN fresh THEN titles ELSE 'old' END AS titles,
        CASE WHEN action = 'insert' AND readable THEN titles WHEN action = 'insert' THEN NULL WHEN action = 'patch' AND readable AND org % 7 <> 0 THEN 'b' ELSE 'older' END AS new_titles,
        CASE WHEN action = 'insert' AND NOT readable THEN NULL WHEN (action = 'insert' OR org % 7 <> 0) AND fresh AND readable THEN 'now' ELSE 't0' END AS openings_new_at, CASE WHEN action = 'insert' THEN 'refresh' ELSE 'old' END AS method FROM r""",
)
Q.add(
    "m15_refresh_reviews", lambda t: (lambda orgs, after: orgs.join(after.filter("action = 'insert'").select("org", F.col("version_id").alias("made")), "org", "left").select("org", "reviewed", "reviewed_url", "reviewed_page_date", (F.col("current_url") == F.col("made")).alias("moved")))(*refreshed(t)),
    f"""WITH {REFRESH_SQL}, o AS (SELECT DISTINCT org FROM h), m AS (SELECT org FROM r WHERE action = 'insert'),
        e AS (SELECT o.org, m.org IS NOT NULL AS moved, o.org % 11 <> 0 AS was, m.org IS NOT NULL OR (o.org IN (SELECT org FROM n) AND o.org % 3 = 0 AND o.org % 2 = 0) AS ends FROM o LEFT JOIN m ON o.org = m.org)
        SELECT org, was AND NOT ends AS reviewed, CASE WHEN was AND ends THEN '' ELSE 'u' END AS reviewed_url, CASE WHEN was AND ends THEN '' WHEN org % 2 = 0 THEN '2001-01-01' ELSE '2002-01-01' END AS reviewed_page_date, CASE WHEN moved THEN true END AS moved FROM e""",
)
Q.add("m15_one_organisation", lambda t: (lambda h, n: SYNCED(versions.sync_versions(h.filter("org = 7"), n.filter("org = 7"), "r1", half_time())))(*store(t)), f"WITH {STORE_SQL} {VERSION_SQL} WHERE org = 7")
Q.add("m16_settings", lambda t: versions.upsert(t.nation.select("n_nationkey", "n_name"), t.region.select(F.col("r_regionkey").alias("n_nationkey"), F.col("r_name").alias("n_name")), "n_nationkey", ["n_name"]), "SELECT n_nationkey, coalesce(r_name, n_name) AS n_name, CASE WHEN r_name IS NOT NULL AND r_name <> n_name THEN 'update' ELSE 'keep' END AS action FROM nation LEFT JOIN region ON n_nationkey = r_regionkey")
Q.add(
    "m17_set_reviewed",
    lambda t: versions.set_reviewed(t.customer.select("c_custkey", F.lit(True).alias("reviewed"), F.lit("u").alias("reviewed_url"), F.lit("d").alias("reviewed_page_date"), half_time().alias("reviewed_at")), "c_custkey", t.customer.filter("c_custkey % 3 = 0").select("c_custkey", (F.col("c_custkey") % 2 == 0).alias("flag"), F.col("c_name").alias("url"), F.lit(None).cast("string").alias("page_date")), half_time()).drop("reviewed_at"),
    "SELECT c_custkey, c_custkey % 3 <> 0 OR c_custkey % 2 = 0 AS reviewed, CASE WHEN c_custkey % 3 <> 0 THEN 'u' WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END AS reviewed_url, CASE WHEN c_custkey % 3 <> 0 THEN 'd' ELSE '' END AS reviewed_page_date FROM customer",
)
Q.add(
    "m18_mark_seen", lambda t: versions.clear_new(t.part.select("p_partkey", F.array("p_name").alias("openings_new_titles"), half_time().alias("openings_new_at")), t.part.filter("p_size > 25"), "p_partkey").select("p_partkey", F.array_join("openings_new_titles", ",").alias("titles"), F.col("openings_new_at").isNull().alias("seen")),
    "SELECT p_partkey, CASE WHEN p_size > 25 THEN '' ELSE p_name END AS titles, p_size > 25 AS seen FROM part",
)


def log_and_read(t: Tables) -> DataFrame:
    """Two batches appended to a check log, and read again."""
    path = work_dir(t.spark, "checks")
    for part in range(2):
        batch = t.events.filter(F.col("event_id") % 2 == part).select("event_id", "user_id", F.when(F.col("event_type") == "error", "dead").otherwise(F.col("event_type")).alias("verdict"))
        readers.append_events(versions.check_events(batch, half_time()), path)
    return t.spark.read.parquet(path).groupBy("user_id", "verdict").agg(F.count(F.lit(1)).alias("n"))


Q.add("m19_check_log", log_and_read, "SELECT user_id, CASE WHEN event_type = 'error' THEN 'dead' ELSE 'unsure' END AS verdict, count(*) AS n FROM events GROUP BY 1, 2")
Q.add("w9_history", lambda t: versions.history(store(t)[0], F.lit(7)).select("org", "url", "superseded"), f"WITH {STORE_SQL} SELECT org, url, superseded FROM h WHERE org = 7")
Q.add("v7_version_history", lambda t: store(t)[0].groupBy("org").agg(F.count(F.lit(1)).alias("versions"), F.count_if(~F.col("superseded")).alias("current")), f"WITH {STORE_SQL} SELECT org, count(*) AS versions, count(*) FILTER (NOT superseded) AS current FROM h GROUP BY 1")
Q.add(
    "c17_recheck",
    lambda t: freshness.recheck(
        t.orders.select("o_orderkey", F.lit("1999-01-01").alias("last_updated"), F.lit("meta").alias("last_updated_source"), F.lit("high").alias("last_updated_trust"), F.lit(5).alias("last_updated_age_days"), F.lit("c0").alias("changed_at"), F.lit("h0").alias("content_hash"), F.lit("t0").alias("page_text")), "o_orderkey",
        t.orders.filter("o_orderkey % 2 = 0").select("o_orderkey", F.lit("2000-01-01").alias("date"), F.lit("hash").alias("source"), F.lit("high").alias("trust"), F.lit(0).alias("age_days"), F.when(F.col("o_orderkey") % 3 == 0, "c1").otherwise("").alias("changed_at"), F.when(F.col("o_orderkey") % 5 == 0, "h1").otherwise("").alias("hash"), F.lit("").alias("page_text")),
    ),
    """SELECT o_orderkey, CASE WHEN e THEN '2000-01-01' ELSE '1999-01-01' END AS last_updated, CASE WHEN e THEN 'hash' ELSE 'meta' END AS last_updated_source, 'high' AS last_updated_trust, CASE WHEN e THEN 0 ELSE 5 END AS last_updated_age_days,
        CASE WHEN e AND o_orderkey % 3 = 0 THEN 'c1' ELSE 'c0' END AS changed_at, CASE WHEN e AND o_orderkey % 5 = 0 THEN 'h1' ELSE 'h0' END AS content_hash, 't0' AS page_text FROM (SELECT o_orderkey, o_orderkey % 2 = 0 AS e FROM orders)""",
)

# Pages. Careers pages written around the parts, as fetched and listed pages would be.


def careers_page() -> Column:
    return F.concat(
        F.lit("<html><head><title>Careers</title></head><body><nav><a href='/x'>officer in nav</a></nav><ul><li><a href='/jobs/a-1/'>"), "p_name", F.lit(" officer</a> Posted 3 July 2000. Deadline 4 August 2000."),
        F.when(F.col("p_partkey") % 4 == 1, "<p>Closes <time datetime='2000-06-30'>at noon</time></p>").when(F.col("p_partkey") % 4 == 2, "<p><time datetime='2000-05-05'>in May</time></p>").otherwise(""), F.lit("</li>"),
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('<script type="application/ld+json">{"@type":"JobPosting","title":"'), "p_brand", F.lit(' lead","validThrough":"2000-08-09"}</script>'))).otherwise(""),
        F.lit("<li><a href='/about'>About us</a></li></ul></body></html>"),
    )


EMPTY_PAGE = "<html><body><p>There are no current vacancies.</p></body></html>"
FETCHED = lambda t: t.spread("part", "p_partkey").select(F.concat(F.lit("https://p.example/"), F.col("p_partkey").cast("string")).alias("url"), F.when(F.col("p_partkey") % 5 == 0, EMPTY_PAGE).otherwise(careers_page()).alias("text"), (F.col("p_partkey") % 7 != 0).alias("ok"), F.when(F.col("p_partkey") % 7 != 0, 200).otherwise(403).alias("status"))
Q.add(
    "c12_openings", lambda t: openings.detect(FETCHED(t)).select("url", "state", "count", F.array_join("titles", "|").alias("titles"), "deadline", "note"),
    """SELECT 'https://p.example/' || p_partkey AS url, CASE WHEN k % 7 = 0 THEN 'unknown' WHEN k % 5 = 0 THEN 'no_openings' ELSE 'has_openings' END AS state, CASE WHEN k % 7 = 0 OR k % 5 = 0 THEN 0 ELSE 1 END AS count,
        CASE WHEN k % 7 = 0 OR k % 5 = 0 THEN '' WHEN k % 3 = 0 THEN p_brand || ' lead' ELSE p_name || ' officer' END AS titles, CASE WHEN k % 7 = 0 OR k % 5 = 0 THEN '' WHEN k % 3 = 0 THEN '2000-08-09' ELSE '2000-08-04' END AS deadline,
        CASE WHEN k % 7 = 0 THEN 'couldn''t read page (HTTP 403)' WHEN k % 5 = 0 THEN 'page says no openings right now' ELSE '' END AS note FROM (SELECT *, p_partkey AS k FROM part)""",
)
LISTED = lambda t: openings.listings(FETCHED(t).select("url", F.col("text").alias("html")), day())
Q.add(
    "c15_listings", LISTED,
    """SELECT 'https://p.example/' || p_partkey AS url, CASE WHEN p_partkey % 3 = 0 THEN p_brand || ' lead' ELSE p_name || ' officer' END AS title, CASE WHEN p_partkey % 3 = 0 THEN 'https://p.example/' || p_partkey ELSE 'https://p.example/jobs/a-1/' END AS job_url, '' AS location,
        CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 4 = 2 THEN '2000-05-05' ELSE '2000-07-03' END AS posted, CASE WHEN p_partkey % 3 = 0 THEN '2000-08-09' WHEN p_partkey % 4 = 1 THEN '2000-06-30' ELSE '2000-08-04' END AS deadline, CASE WHEN p_partkey % 3 = 0 THEN 'jsonld' ELSE 'generic' END AS method FROM part WHERE p_partkey % 5 <> 0""",
)
ATS = lambda t: t.part.filter("p_partkey % 4 = 0").select(F.concat(F.lit("https://p.example/"), F.col("p_partkey").cast("string")).alias("source_url"), F.concat(F.lit('{"jobs":[{"title":" '), "p_name", F.lit('  x","absolute_url":"https://a.example/1","location":{"name":"Gent"},"updated_at":"2000-05-06T01:02"}]}')).alias("body"))
Q.add(
    "c14_layers", lambda t: openings.layered([readers.platform_jobs(ATS(t), "greenhouse").select(F.col("source_url").alias("url"), "title", "method"), LISTED(t).select("url", "title", "method")]),
    "SELECT 'https://p.example/' || p_partkey AS url, CASE WHEN p_partkey % 4 = 0 THEN p_name || ' x' WHEN p_partkey % 3 = 0 THEN p_brand || ' lead' ELSE p_name || ' officer' END AS title, CASE WHEN p_partkey % 4 = 0 THEN 'ats:greenhouse' WHEN p_partkey % 3 = 0 THEN 'jsonld' ELSE 'generic' END AS method FROM part WHERE p_partkey % 4 = 0 OR p_partkey % 5 <> 0",
)
ORGS = lambda t: t.supplier.select(F.col("s_suppkey").alias("id"), F.concat(F.lit("Acme"), F.col("s_suppkey").cast("string")).alias("organisation"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("https://www.acme"), F.col("s_suppkey").cast("string"), F.lit(".example.org/"))).otherwise("").alias("homepage"), F.lit(None).cast("string").alias("existing_url"), F.lit("Brussels").alias("base"), F.lit("").alias("languages"))
HIRING = "<title>Jobs at us</title><p>Apply now. Deadline soon. Full-time.</p>"
PROBED = lambda t: t.supplier.filter("s_suppkey % 2 = 0").select("s_suppkey", F.explode(F.array(F.lit("/jobs"), F.lit("/werk"))).alias("path")).select(F.concat(F.lit("https://acme"), F.col("s_suppkey").cast("string"), F.lit(".example.org"), "path").alias("url"), F.lit(True).alias("ok"), F.lit(200).alias("status"), F.lit("").alias("final_url"), F.lit(HIRING).alias("text"))
Q.add("c6_probe", lambda t: discover.probe(ORGS(t), PROBED(t)).select("id", "careers_url", "confidence", "score", "method"), "SELECT s_suppkey AS id, 'https://acme' || s_suppkey || '.example.org/jobs' AS careers_url, 'high' AS confidence, 22 AS score, 'homepage-probe' AS method FROM supplier WHERE s_suppkey % 2 = 0")
FOUND = lambda t: ORGS(t).filter("id % 2 = 1").select(F.explode(discover.queries_for(F.col("organisation"), F.col("base"), F.col("languages"), F.col("existing_url"))).alias("query"), "id").select("query", F.explode(F.array(F.lit(0), F.lit(1))).alias("rank"), "id").select("query", "rank", F.when(F.col("rank") == 0, F.lit("https://www.linkedin.com/acme/jobs")).otherwise(F.concat(F.lit("https://acme"), F.col("id").cast("string"), F.lit(".org/careers"))).alias("url"), F.lit("Careers").alias("title"), F.lit("").alias("snippet"), F.lit("e").alias("engine"))
Q.add(
    "c5_discover", lambda t: discover.discover(ORGS(t), FOUND(t), PROBED(t)).select("id", "careers_url", "confidence", "score", "method"),
    "SELECT s_suppkey AS id, 'https://acme' || s_suppkey || CASE WHEN s_suppkey % 2 = 0 THEN '.example.org/jobs' ELSE '.org/careers' END AS careers_url, CASE WHEN s_suppkey % 2 = 0 THEN 'high' ELSE 'medium' END AS confidence, CASE WHEN s_suppkey % 2 = 0 THEN 22 ELSE 13 END AS score, CASE WHEN s_suppkey % 2 = 0 THEN 'homepage-probe' ELSE 'search+verify' END AS method FROM supplier",
)

# Sources and sinks, each written and read again.


def sheet(t: Tables) -> DataFrame:
    path = work_dir(t.spark, "sheet")
    out = t.part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 == 0, " ").otherwise(F.concat(F.lit("  "), "p_name")).alias("organisation"), *[F.lit("x").alias(c) for c in ("category", "type", "base", "target_roles", "why_fits", "language_edge", "eu_nationality")], F.col("p_size").alias("priority"), F.lit("u").alias("existing_url"), F.lit("high").alias("existing_confidence"))
    readers.write_csv(out, path)
    return readers.read_sheet(t.spark, path).select("id", "organisation", "priority")


Q.add("s1_sheet", sheet, "SELECT p_partkey AS id, p_name AS organisation, p_size AS priority FROM part WHERE p_partkey % 3 <> 0")


def register(t: Tables) -> DataFrame:
    path = work_dir(t.spark, "register")
    start = F.element_at(F.array(*[F.lit(x) for x in ("<a:interestRepresentative>", '<ns.b:interestRepresentative xmlns:ns.b="urn:x" id="1">', "<interestRepresentative>", "<interestRepresentative xmlns='urn:y'\n>")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    prefix = F.element_at(F.array(*[F.lit(x) for x in ("a:", "ns.b:", "", "")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    body = F.concat(F.lit("<~a><~city> </~city></~a><~registrationCategory>Non-governmental organisations</~registrationCategory><~b><~country>"), F.when(F.col("p_partkey") % 3 == 0, "FRANCE").otherwise("BELGIUM"), F.lit("</~country><~city>GENT</~city></~b><~originalName>"), "p_name", F.lit("</~originalName><~membersFTE>"), (F.col("p_size") / 20).cast("string"), F.lit("</~membersFTE></~interestRepresentative>"))
    t.part.select(F.concat(start, F.replace(body, F.lit("~"), prefix)).alias("value")).write.text(path)
    return readers.filter_register(readers.read_register(t.spark, path), "BELGIUM").select("originalName", "city", "membersFTE")


Q.add("s4_register", register, "SELECT p_name AS \"originalName\", 'GENT' AS city, CAST(p_size / 20 AS VARCHAR) AS \"membersFTE\" FROM part WHERE p_partkey % 3 <> 0 AND p_size / 20 >= 1")


def xml_text() -> Column:
    return F.concat(F.lit('<r xmlns:n="urn:x"><a><n:t> </n:t></a><b><c><n:t> '), "p_name", F.lit(" </n:t></c></b><n:t>later</n:t></r>"))


Q.add("s5_any_depth", lambda t: t.part.select("p_partkey", readers.first_element(xml_text(), "t").alias("v"), readers.first_element(xml_text(), "zz").alias("none")), "SELECT p_partkey, p_name AS v, '' AS none FROM part")
FETCH_LOG = lambda t: t.events.select(F.col("user_id").cast("string").alias("url"), F.col("ts").alias("fetched_at"), (F.col("event_type") != "error").alias("ok"), F.when(F.col("event_type") != "error", 200).alias("status"), F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("text"), F.when(F.col("event_id") % 2 == 0, "text/html").otherwise("image/png").alias("content_type"))
Q.add(
    "s6_latest_fetch", lambda t: readers.latest_fetch(FETCH_LOG(t), F.to_timestamp(F.lit("2024-01-20 00:00:00")), 24 * 7).select("url", "ok", "status", "text"),
    "SELECT CAST(user_id AS VARCHAR) AS url, event_type <> 'error' AS ok, CASE WHEN event_type <> 'error' THEN 200 ELSE 0 END AS status, CASE WHEN event_id % 2 = 0 THEN 'v' || event_id ELSE '' END AS text FROM events WHERE ts > TIMESTAMP '2024-01-20' - INTERVAL 7 DAY QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1",
)
Q.add("s7_rendered", lambda t: readers.rendered_or_fetched(t.part.select(F.col("p_partkey").alias("url"), F.when(F.col("p_size") > 25, F.col("p_name")).otherwise("").alias("text")), t.part.filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("url"), F.col("p_brand").alias("text"))), "SELECT p_partkey AS url, CASE WHEN p_size > 25 THEN p_name WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS text FROM part")
Q.add("s8_search_fallback", lambda t: readers.search_results(t.events.select(F.col("user_id").alias("query"), F.when(F.col("event_type") == "signup", "main").otherwise("other").alias("engine"), "event_id"), "main", "other").select("query", "engine", "event_id"), "SELECT user_id AS query, CASE WHEN event_type = 'signup' THEN 'main' ELSE 'other' END AS engine, event_id FROM events WHERE event_type = 'signup' OR user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup')")
BOARD = lambda t: t.lineitem.select("l_orderkey", F.ceil(F.col("l_linenumber") / 2).cast("int").alias("page"), (F.col("l_suppkey") % 4).alias("url"), "l_linenumber")
Q.add(
    "s10_paged_boards", lambda t: resolve.until_repeated(BOARD(t), "l_orderkey", "page", "url"),
    """WITH i AS (SELECT l_orderkey, CAST(ceil(l_linenumber / 2) AS INT) AS page, l_suppkey % 4 AS url, l_linenumber FROM lineitem), n AS (SELECT *, min(page) OVER (PARTITION BY l_orderkey, url) AS met FROM i),
        p AS (SELECT l_orderkey, page, bool_and(met < page) AS repeated, row_number() OVER (PARTITION BY l_orderkey ORDER BY page) AS nth FROM n GROUP BY 1, 2),
        s AS (SELECT l_orderkey, min(page) FILTER (repeated OR nth <> page) AS stop FROM p GROUP BY 1)
        SELECT i.* FROM i JOIN s USING (l_orderkey) WHERE stop IS NULL OR page < stop""",
)
Q.add("s10_board_listing", lambda t: resolve.first_per_key(LISTED(t), ["job_url"], [F.asc("url")]).groupBy("method").agg(F.count(F.lit(1)).alias("n")), "SELECT method, count(*) AS n FROM (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN 'jsonld' ELSE 'generic' END AS method, CASE WHEN p_partkey % 3 = 0 THEN p_partkey ELSE -1 END FROM part WHERE p_partkey % 5 <> 0) GROUP BY 1")


def lever() -> Column:
    return F.concat(F.lit('[{"text":"'), "p_name", F.lit('","hostedUrl":"https://l.example/1","categories":{"location":"Brugge"}}]'))


def recruitee() -> Column:
    return F.concat(F.lit('{"offers":[{"title":"'), "p_brand", F.lit('","url":"https://r.example/1","location":"Mons","published_at":"2001-02-03 04:05"}]}'))


Q.add(
    "s11_platforms", lambda t: readers.platform_jobs(ATS(t), "greenhouse").unionByName(readers.platform_jobs(t.part.select(F.col("p_partkey").cast("string").alias("source_url"), lever().alias("body")), "lever")).unionByName(readers.platform_jobs(t.part.select(F.col("p_partkey").cast("string").alias("source_url"), recruitee().alias("body")), "recruitee")),
    """SELECT 'https://p.example/' || p_partkey AS source_url, p_name || ' x' AS title, 'https://a.example/1' AS url, 'Gent' AS location, '2000-05-06' AS posted, 'ats:greenhouse' AS method FROM part WHERE p_partkey % 4 = 0
        UNION ALL SELECT CAST(p_partkey AS VARCHAR), p_name, 'https://l.example/1', 'Brugge', '', 'ats:lever' FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), p_brand, 'https://r.example/1', 'Mons', '2001-02-03', 'ats:recruitee' FROM part""",
)
Q.add("s12_anchored_jobs", lambda t: readers.anchored_jobs(FETCHED(t).select("url", F.col("text").alias("html"))), "SELECT 'https://p.example/' || p_partkey AS source_url, p_name || ' officer' AS title, 'https://p.example/jobs/a-1/' AS url, 'ats:teamtailor' AS method FROM part WHERE p_partkey % 5 <> 0")


def members() -> Column:
    return F.concat(F.lit("<body><a href='https://www."), F.lower("p_type"), F.lit(".org/a'>"), "p_name", F.lit("</a><a href='https://"), F.lower("p_type"), F.lit(".org/b'>"), "p_name", F.lit(" union</a><a href='https://facebook.com/x'>f</a><a href='/onze-leden/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("/'></a></body>"))


DIRECTORY_PAGES = lambda t: t.spread("part", "p_partkey").select(F.concat(F.lit("https://d.example/"), F.col("p_partkey").cast("string")).alias("url"), members().alias("html"))
Q.add("s13_harvest", lambda t: readers.harvest(DIRECTORY_PAGES(t)), "SELECT 'https://d.example/' || p_partkey AS page, lower(p_type) || '.org' AS host, p_name || ' union' AS organisation, 'https://' || lower(p_type) || '.org' AS homepage FROM part")
TITLED = " || ' ' || ".join(f"upper(substring(split_part(p_name, ' ', {i}), 1, 1)) || substring(split_part(p_name, ' ', {i}), 2)" for i in (1, 2))
Q.add("s14_member_pages", lambda t: readers.member_pages(DIRECTORY_PAGES(t), "/onze-leden/"), f"SELECT 'https://d.example/' || p_partkey AS page, replace(p_name, ' ', '-') AS slug, {TITLED} AS organisation, 'https://d.example/onze-leden/' || replace(p_name, ' ', '-') || '/' AS homepage FROM part")
Q.add("s15_filtered_scan", lambda t: t.orders.filter("o_orderstatus = 'P'").select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
WRITES = lambda t: versions.batch_write(
    t.customer.select("c_custkey", "c_name", "c_mktsegment"),
    t.orders.select(F.col("o_orderkey").alias("op_no"), F.lit("update").alias("kind"), (F.col("o_custkey") * F.when(F.col("o_totalprice") > 300_000, -1).otherwise(1)).alias("c_custkey"), F.col("o_orderpriority").alias("c_name"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("c_mktsegment")),
    "c_custkey", ["c_name", "c_mktsegment"],
)
WRITES_SQL = """o AS (SELECT o_orderkey AS op_no, o_custkey, o_totalprice > 300000 OR o_custkey NOT IN (SELECT c_custkey FROM customer) AS failed, o_orderpriority AS name, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS segment, o_orderkey // 100 AS chunk FROM orders),
    b AS (SELECT coalesce(min(chunk) FILTER (failed), 1 << 60) AS bad FROM o)"""
Q.add(
    "s17_batch_table", lambda t: WRITES(t)[0],
    f"""WITH {WRITES_SQL}, a AS (SELECT o_custkey, arg_max(name, op_no) AS name, arg_max(segment, op_no) FILTER (segment IS NOT NULL) AS segment FROM o, b WHERE chunk < bad GROUP BY 1)
        SELECT c_custkey, coalesce(name, c_name) AS c_name, coalesce(segment, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN a ON c_custkey = o_custkey""",
)
Q.add("s17_batch_status", lambda t: WRITES(t)[1].select("op_no", "chunk", "status"), f"WITH {WRITES_SQL} SELECT op_no, chunk, CASE WHEN chunk < bad THEN 'applied' WHEN chunk = bad AND failed THEN 'failed' ELSE 'skipped' END AS status FROM o, b")
Q.add("s16_find_one", lambda t: t.orders.filter("o_orderkey = 42").limit(1).select("o_orderkey", "o_custkey"), "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 42")


def json_round(t: Tables) -> DataFrame:
    path = work_dir(t.spark, "json")
    readers.write_json(t.part.select("p_partkey", "p_name", F.split("p_name", " ").alias("words")), path)
    return t.spark.read.schema("p_partkey long, p_name string, words array<string>").json(path).select("p_partkey", "p_name", F.size("words").alias("n"))


Q.add("s18_json_sink", json_round, "SELECT p_partkey, p_name, 2 AS n FROM part")


def csv_round(t: Tables) -> DataFrame:
    path = work_dir(t.spark, "csv")
    readers.write_csv(t.part.select("p_partkey", "p_name", "p_retailprice"), path)
    return t.spark.read.schema("p_partkey long, p_name string, p_retailprice double").option("header", True).csv(path)


Q.add("s19_csv_export", csv_round, "SELECT p_partkey, p_name, p_retailprice FROM part")


def envelopes(t: Tables) -> DataFrame:
    path = work_dir(t.spark, "jobs")
    readers.write_json(readers.envelopes(t.part.select("p_brand", F.struct(F.col("p_name").alias("title"), F.col("p_brand").alias("employer")).alias("job")), "p_brand", "job", F.lit("2000-01-01")), path)
    return readers.unwrap_jobs(t.spark.read.schema(f"generated_at string, count int, jobs array<struct<{readers.JOB.replace(' string', ':string').replace(' int', ':int')}>>").json(path)).groupBy("employer").agg(F.count(F.lit(1)).alias("n"))


Q.add("s20_envelope", envelopes, "SELECT p_brand AS employer, count(*) AS n FROM part GROUP BY 1")


def evolved(t: Tables) -> DataFrame:
    from orgloom.operators.records import RECORD

    path = work_dir(t.spark, "records")
    t.part.select(F.col("p_name").alias("organisation"), "p_partkey").write.parquet(path)
    t.part.select(F.col("p_brand").alias("organisation"), "p_partkey", F.col("p_type").alias("sector")).write.mode("append").parquet(path)
    return readers.read_records(t.spark, path, RECORD).select("organisation", "p_partkey", F.coalesce("sector", F.lit("")).alias("sector"), "careers_score", F.size("sources").alias("n"))


Q.add("s22_schema_evolution", evolved, "SELECT p_name AS organisation, p_partkey, '' AS sector, 0 AS careers_score, 0 AS n FROM part UNION ALL SELECT p_brand, p_partkey, p_type, 0, 0 FROM part")
REGISTRY = [("EUROPE", "Gent", 10, True), ("ASIA", "Mons", 20, False), ("ATLANTIS", "Sea", 0, True)]
Q.add(
    "s2_registry", lambda t: t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).join(F.broadcast(readers.registry(t.spark, REGISTRY, "listed string, base string, size int, flag boolean")), F.col("r_name") == F.col("listed"), "left").select("n_name", F.col("listed").isNotNull().alias("known"), F.coalesce("base", F.lit("")).alias("base"), "size", "flag"),
    "SELECT n_name, listed IS NOT NULL AS known, coalesce(base, '') AS base, size, flag FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN (VALUES ('EUROPE', 'Gent', 10, true), ('ASIA', 'Mons', 20, false), ('ATLANTIS', 'Sea', 0, true)) v(listed, base, size, flag) ON listed = r_name",
)

# Streams, and the batch plans that they equal.
SCANS_SQL = """SELECT CAST(user_id AS VARCHAR) AS url, ts AS scanned_at, event_type AS hash, coalesce(lag(event_type) OVER w <> event_type, false) AS changed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""
Q.add(
    "t1_changes_batch", lambda t: freshness.change_log(t.events.select(F.col("user_id").cast("string").alias("url"), F.col("ts").alias("scanned_at"), F.col("event_type").alias("hash"), "event_id"), "url", ["scanned_at", "event_id"], "hash").drop("event_id"),
    f"SELECT *, max(CASE WHEN changed THEN scanned_at END) OVER (PARTITION BY url ORDER BY scanned_at) AS changed_at FROM ({SCANS_SQL})",
)


#: Files that the writer makes of each half of the events, and that a batch of the stream takes.
STREAM_FILES = 4


def event_stream(t: Tables) -> DataFrame:
    """The events as a stream of two batches, the earlier half first, each of several files."""
    path = work_dir(t.spark, "stream-in")
    for half in (F.col("ts") < half_time(), F.col("ts") >= half_time()):
        t.events.filter(half).repartition(STREAM_FILES).write.mode("append").parquet(path)
    return t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", STREAM_FILES).parquet(path)


def changes(t: Tables) -> DataFrame:
    out, saved = work_dir(t.spark, "changes"), work_dir(t.spark, "checkpoint")
    scans = event_stream(t).select(F.col("user_id").cast("string").alias("url"), F.col("ts").alias("scanned_at"), F.col("event_id").alias("nth"), F.col("event_type").alias("hash"))
    state.run_available(state.detect_changes(scans), out, saved)
    return t.spark.read.schema(state.CHANGES).parquet(out)


Q.add("t1_changes_stream", changes, f"SELECT *, max(CASE WHEN changed THEN scanned_at END) OVER (PARTITION BY url ORDER BY scanned_at) AS changed_at FROM ({SCANS_SQL})")


def titles(t: Tables) -> DataFrame:
    out, saved = work_dir(t.spark, "titles"), work_dir(t.spark, "checkpoint")
    scans = event_stream(t).select(F.col("user_id").cast("string").alias("version"), F.col("ts").alias("scanned_at"), F.col("event_id").alias("nth"), F.array("event_type").alias("titles"))
    state.run_available(state.detect_new_titles(scans), out, saved)
    return t.spark.read.schema(state.NEW_TITLES).parquet(out).select("version", "scanned_at", F.array_join("new_titles", ",").alias("new"))


Q.add("t2_new_titles_stream", titles, f"SELECT url AS version, scanned_at, CASE WHEN changed THEN hash ELSE '' END AS new FROM ({SCANS_SQL})")


def latest(t: Tables) -> DataFrame:
    out, saved = work_dir(t.spark, "latest"), work_dir(t.spark, "checkpoint")
    state.run_available(state.latest_checks(event_stream(t).select("user_id", "event_id", "event_type", "ts"), "user_id", "ts", ["event_id"]), out, saved, "complete")
    epochs = t.spark.read.option("basePath", out).parquet(f"{out}/epoch=*")
    return epochs.join(epochs.agg(F.max("epoch").alias("epoch")), "epoch").select("user_id", "event_id", "event_type")


Q.add("t3_latest_checks_stream", latest, "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
TTL_DAYS = 3


def forgotten(t: Tables) -> DataFrame:
    out, saved = work_dir(t.spark, "changes"), work_dir(t.spark, "checkpoint")
    scans = event_stream(t).select(F.col("user_id").cast("string").alias("url"), F.col("ts").alias("scanned_at"), F.col("event_id").alias("nth"), F.col("event_type").alias("hash"))
    state.run_available(state.detect_changes(scans, TTL_DAYS * 86_400_000), out, saved)
    return t.spark.read.schema(state.CHANGES).parquet(out)


Q.add(
    "t4_forgotten_stream", forgotten,
    f"""WITH g AS (SELECT CAST(user_id AS VARCHAR) AS url, ts AS scanned_at, event_type AS hash, event_id, lag(event_type) OVER w AS before, coalesce(ts - lag(ts) OVER w > INTERVAL {TTL_DAYS} DAY, true) AS anew FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        e AS (SELECT *, NOT anew AND before <> hash AS changed, sum(CASE WHEN anew THEN 1 ELSE 0 END) OVER (PARTITION BY url ORDER BY scanned_at, event_id) AS memory FROM g)
        SELECT url, scanned_at, hash, changed, max(CASE WHEN changed THEN scanned_at END) OVER (PARTITION BY url, memory ORDER BY scanned_at) AS changed_at FROM e""",
)
Q.add("t4_expired", lambda t: t.events.groupBy("user_id").agg(F.max("ts").alias("last")).select("user_id", (F.col("last") < F.to_timestamp(F.lit("2024-01-30 00:00:00"))).alias("expired")), "SELECT user_id, max(ts) < TIMESTAMP '2024-01-30' AS expired FROM events GROUP BY 1")
Q.add("t5_resumable", lambda t: discover.todo(t.events.select("event_id"), t.events.filter(F.col("ts") < half_time()).select("event_id", F.when(F.col("event_type") == "error", "none").otherwise("high").alias("confidence")), "event_id"), "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15' OR event_type = 'error'")


def refreshed_twice(t: Tables) -> DataFrame:
    """A sync that runs again from its own result changes nothing."""
    history, new = store(t)
    once = versions.sync_versions(history, new, "r1", half_time()).drop("action")
    return versions.sync_versions(once, new, "r2", half_time()).groupBy("action", "superseded").agg(F.count(F.lit(1)).alias("n")).filter("action IN ('insert', 'supersede')")


Q.add("t6_idempotent_refresh", lambda t: refreshed_twice(t).agg(F.count(F.lit(1)).alias("changes")), "SELECT CAST(0 AS BIGINT) AS changes")
