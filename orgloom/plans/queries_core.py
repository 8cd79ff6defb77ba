"""Projection, predicates, aggregation, ranking and set queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orgloom.functions import rules, text
from orgloom.operators.fit import Profile, rollup_openings, score_title
from orgloom.operators.records import as_int, conform, ensure_columns
from orgloom.operators.resolve import first_per_key
from orgloom.operators.versions import differs, latest_per_key, new_titles
from orgloom.plans import views
from orgloom.plans.registry import Queries

Q = Queries()
AS_OF = "2001-01-01"


def day() -> Column:
    return F.lit(AS_OF).cast("date")


#: A profile over part names, standing in for titles.
PARTS = Profile(
    topics=(("policy", ("widget", "gear"), 28, "policy role"), ("region", ("red", "blue"), 25, "region named"), ("research", ("ring",), 22, "research track"), ("adjacent", ("bolt", "plate"), 12, "adjacent area")),
    senior=(("large",), -30, "too senior"), mid=(("hot", "old"), 12, "right level"), junior=(("small",), -6, "entry level"), languages=(("gizmo",), 6, "language named"),
)
SCORE_SQL = """greatest(0, least(100, 30
    + CASE WHEN regexp_matches(lower({t}), 'widget|gear') THEN 28 ELSE 0 END + CASE WHEN regexp_matches(lower({t}), 'red|blue') THEN 25 ELSE 0 END
    + CASE WHEN regexp_matches(lower({t}), 'ring') THEN 22 ELSE 0 END + CASE WHEN regexp_matches(lower({t}), 'bolt|plate') THEN 12 ELSE 0 END
    + CASE WHEN regexp_matches(lower({t}), 'large') THEN -30 WHEN regexp_matches(lower({t}), 'hot|old') THEN 12 WHEN regexp_matches(lower({t}), 'small') THEN -6 ELSE 0 END
    + CASE WHEN regexp_matches(lower({t}), 'gizmo') THEN 6 ELSE 0 END))"""
SCORED = f"SELECT *, {SCORE_SQL.format(t='p_name')} AS score FROM part"
BAND_SQL = "CASE WHEN score >= 65 THEN 'strong' WHEN score >= 45 THEN 'possible' ELSE 'weak' END"

# Aggregations.
Q.add("a1_value_counts", lambda t: views.counts(t.orders, "o_orderpriority"), "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
Q.add(
    "a2_coverage", lambda t: views.coverage_by(t.orders, "o_orderpriority", F.col("o_orderstatus") == "F"),
    "SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS found, round_even(count(*) FILTER (o_orderstatus = 'F') / count(*) * 100, 0) AS pct FROM orders GROUP BY 1",
)
Q.add(
    "a3_top_bases", lambda t: views.counts(t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).filter("n_name <> ''"), "n_name").limit(12),
    "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name <> '' GROUP BY 1 ORDER BY n DESC, n_name LIMIT 12",
)
Q.add(
    "a4_explode_counts", lambda t: views.counts(t.part.select(F.explode(F.split("p_name", " ")).alias("word")), "word"),
    "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY 1",
)
Q.add(
    "a5_kpis",
    lambda t: t.orders.agg(F.count(F.lit(1)).alias("shown"), F.count_if(F.col("o_orderstatus") == "O").alias("hiring"), F.count_if((F.col("o_orderstatus") == "O") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("hiring_fit"), F.count_if(F.col("o_orderdate").cast("date") >= F.date_sub(day(), 7)).alias("this_week")),
    f"SELECT count(*) AS shown, count(*) FILTER (o_orderstatus = 'O') AS hiring, count(*) FILTER (o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH')) AS hiring_fit, count(*) FILTER (CAST(o_orderdate AS DATE) >= DATE '{AS_OF}' - 7) AS this_week FROM orders",
)
Q.add(
    "a6_tallies", lambda t: t.part.groupBy(F.substring_index("p_brand", "#", 1).alias("root"), "p_type").agg(F.count(F.lit(1)).alias("n")),
    "SELECT split_part(p_brand, '#', 1) AS root, p_type, count(*) AS n FROM part GROUP BY 1, 2",
)
Q.add(
    "a7_latest_check", lambda t: latest_per_key(t.events.select("user_id", "event_type", "value", "event_id", "ts"), "user_id", [F.col("ts"), F.col("event_id")]).drop("ts"),
    "SELECT user_id, event_type, value, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
)
Q.add(
    "a9_fit_rollup",
    lambda t: rollup_openings(t.part, "p_brand", "p_name", "p_partkey", PARTS),
    f"""WITH s AS ({SCORED}), b AS (SELECT *, {BAND_SQL} AS band FROM s)
        SELECT p_brand, max(score) AS best_score, arg_max(band, (score, -p_partkey)) AS best_band, arg_max(p_name, (score, -p_partkey)) AS best_title,
               CAST(count(*) FILTER (band = 'strong') AS INT) AS strong, CAST(count(*) FILTER (band = 'possible') AS INT) AS possible FROM b GROUP BY 1""",
)
Q.add(
    "a11_facets", lambda t: t.part.agg(F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("types"), F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("brands")),
    "SELECT string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS brands FROM part",
)
Q.add(
    "a12_predicate_counts", lambda t: t.documents.agg(F.count_if(F.expr("lang = 'en'")).alias("english"), F.count_if(F.expr("n_chars > 1000")).alias("long"), F.count_if(F.expr("lang <> 'en' AND n_chars > 1000")).alias("long_other")),
    "SELECT count(*) FILTER (lang = 'en') AS english, count(*) FILTER (n_chars > 1000) AS long, count(*) FILTER (lang <> 'en' AND n_chars > 1000) AS long_other FROM documents",
)
HINTS = ("tion", "ered", "the ", "and the", "license", "mail", "queest")
Q.add(
    "a13_capped_hits", lambda t: t.documents.select("doc_id", F.least(F.lit(6), 2 * rules.hit_count(F.lower("text"), HINTS)).alias("points")),
    "SELECT doc_id, least(6, 2 * (" + " + ".join(f"CAST(contains(lower(text), '{h}') AS INT)" for h in HINTS) + ")) AS points FROM documents",
)
Q.add(
    "a14_progress", lambda t: t.events.groupBy(F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("done"), F.count_if(F.expr("event_type = 'error'")).alias("failed")),
    "SELECT CAST(ts AS DATE) AS d, count(*) AS done, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1",
)

# Ranking and limits.
ORDER_VIEW = lambda t: t.orders.withColumn("hiring", F.col("o_orderstatus") == "O").withColumn("fit_here", F.col("hiring") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
Q.add(
    "w1_five_keys",
    lambda t: ORDER_VIEW(t).orderBy(F.desc("fit_here"), F.desc("hiring"), F.desc("o_totalprice"), F.asc("o_orderpriority"), F.asc("o_orderkey")).select("o_orderkey", "fit_here", "o_totalprice"),
    "SELECT o_orderkey, o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AS fit_here, o_totalprice FROM orders ORDER BY fit_here DESC, o_orderstatus = 'O' DESC, o_totalprice DESC, o_orderpriority, o_orderkey",
)
Q.add(
    "w2_nulls_last",
    lambda t: t.orders.withColumn("d", F.when(F.col("o_orderkey") % 3 != 0, F.to_date("o_orderdate"))).orderBy(F.col("d").desc_nulls_last(), "o_orderkey").select("o_orderkey", "d"),
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_orderdate AS DATE) END AS d FROM orders ORDER BY d DESC NULLS LAST, o_orderkey",
)
Q.add(
    "w3_two_keys", lambda t: ORDER_VIEW(t).orderBy(F.desc("hiring"), F.desc("o_orderdate"), "o_orderkey").select("o_orderkey", "hiring"),
    "SELECT o_orderkey, o_orderstatus = 'O' AS hiring FROM orders ORDER BY hiring DESC, o_orderdate DESC, o_orderkey",
)
Q.add(
    "w4_rank_by_titles", lambda t: t.part.groupBy("p_brand").agg(F.max(score_title(F.col("p_name"), PARTS)["score"]).alias("new_fit")).orderBy(F.desc("new_fit"), "p_brand"),
    f"WITH s AS ({SCORED}) SELECT p_brand, max(score) AS new_fit FROM s GROUP BY 1 ORDER BY new_fit DESC, p_brand",
)
Q.add(
    "w5_first_best", lambda t: t.part.withColumn("score", score_title(F.col("p_name"), PARTS)["score"]).groupBy("p_type").agg(F.max_by(F.struct("p_partkey", "score"), F.struct("score", -F.col("p_partkey"))).alias("b")).select("p_type", "b.*"),
    f"WITH s AS ({SCORED}) SELECT p_type, p_partkey, score FROM s QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY score DESC, p_partkey) = 1",
)
Q.add(
    "w6_top_in_group", lambda t: views.top_titles(t.part.withColumn("score", score_title(F.col("p_name"), PARTS)["score"]), "p_brand", [F.desc("score"), F.asc("p_partkey")], 4, 25).select("p_brand", "p_partkey", "score", "nth"),
    f"WITH s AS ({SCORED}), g AS (SELECT DISTINCT p_brand FROM part ORDER BY 1 LIMIT 25) SELECT p_brand, p_partkey, score, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) AS INT) AS nth FROM s WHERE p_brand IN (SELECT p_brand FROM g) QUALIFY nth <= 4",
)
Q.add("w7_head", lambda t: t.customer.orderBy(F.desc("c_acctbal"), "c_custkey").limit(40).select("c_custkey", "c_acctbal"), "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 40")
Q.add("w8_code_point_order", lambda t: t.customer.orderBy("c_mktsegment", "c_name").select("c_mktsegment", "c_name"), "SELECT c_mktsegment, c_name FROM customer ORDER BY 1, 2")
Q.add("w10_rank_semantics", lambda t: first_per_key(t.lineitem, ["l_orderkey"], [F.desc("l_extendedprice"), F.asc("l_linenumber"), F.asc("l_partkey")]).select("l_orderkey", "l_extendedprice"), "SELECT l_orderkey, max(l_extendedprice) AS l_extendedprice FROM lineitem GROUP BY 1")

# Sets.
Q.add(
    "u1_union_precedence",
    lambda t: t.customer.select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("name"), F.lit(0).alias("rank")).unionByName(t.supplier.select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("name"), F.lit(1).alias("rank"), F.lit("s").alias("kind")), allowMissingColumns=True).groupBy("k").agg(F.min_by("name", F.struct("rank", "name")).alias("name"), F.count("kind").alias("suppliers")),
    "WITH u AS (SELECT c_nationkey AS k, c_name AS name, 0 AS rank, NULL AS kind FROM customer UNION ALL SELECT s_nationkey, s_name, 1, 's' FROM supplier) SELECT k, arg_min(name, (rank, name)) AS name, count(kind) AS suppliers FROM u GROUP BY 1",
)
TWO_SETS = lambda t: t.part.select("p_partkey", F.split("p_name", " ").alias("a"), F.array(F.lower("p_type"), F.substring_index("p_name", " ", 1)).alias("b"))
Q.add(
    "u2_set_functions", lambda t: TWO_SETS(t).select("p_partkey", F.array_join(F.array_sort(F.array_union("a", "b")), ",").alias("u"), F.arrays_overlap("a", "b").alias("o")),
    "WITH x AS (SELECT p_partkey, string_split(p_name, ' ') AS a, [lower(p_type), split_part(p_name, ' ', 1)] AS b FROM part) SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS u, list_has_any(a, b) AS o FROM x",
)
Q.add(
    "u3_new_titles",
    lambda t: t.events.groupBy("user_id").agg(F.array_sort(F.collect_set(F.when(F.dayofmonth("ts") <= 15, F.concat(F.lit(" "), F.upper("event_type"))))).alias("old"), F.array_sort(F.collect_set(F.when(F.dayofmonth("ts") > 15, F.col("event_type")))).alias("now")).select("user_id", F.array_join(new_titles(F.col("now"), F.col("old")), ",").alias("new")),
    "WITH x AS (SELECT user_id, event_type, bool_or(day(ts) <= 15) AS was, bool_or(day(ts) > 15) AS is_now FROM events GROUP BY 1, 2) SELECT user_id, coalesce(string_agg(event_type, ',' ORDER BY event_type) FILTER (is_now AND NOT was), '') AS new FROM x GROUP BY 1",
)
Q.add("u4_subset", lambda t: TWO_SETS(t).select("p_partkey", (F.size(F.array_except("b", "a")) == 0).alias("sub")), "SELECT p_partkey, list_has_all(string_split(p_name, ' '), [lower(p_type), split_part(p_name, ' ', 1)]) AS sub FROM part")
Q.add(
    "u5_disjoint_views",
    lambda t: (lambda o: o.filter("urgent").select("o_orderkey", F.lit("new").alias("tab")).unionByName(o.filter("changed AND NOT urgent").select("o_orderkey", F.lit("changed").alias("tab"))))(t.orders.withColumn("urgent", F.col("o_orderpriority") == "1-URGENT").withColumn("changed", F.col("o_orderstatus") == "P")),
    "SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'new' ELSE 'changed' END AS tab FROM orders WHERE o_orderpriority = '1-URGENT' OR o_orderstatus = 'P'",
)

# Projection and predicates.
SHAPE = T.StructType([T.StructField(n, t) for n, t in (("name", T.StringType()), ("size", T.IntegerType()), ("note", T.StringType()), ("flag", T.BooleanType()), ("tags", T.ArrayType(T.StringType())))])
Q.add(
    "p1_conform", lambda t: conform(t.part.withColumn("name", F.col("p_name")), SHAPE, size=F.when(F.col("p_partkey") % 2 == 0, F.col("p_size"))).select("name", "note", "flag", F.size("tags").alias("n_tags"), "size"),
    "SELECT p_name AS name, '' AS note, false AS flag, 0 AS n_tags, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS size FROM part",
)
Q.add(
    "p2_source_mapping",
    lambda t: t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("organisation"), F.when(F.col("c_mktsegment") == "MACHINERY", "industry").otherwise("other").alias("sector"), F.concat(F.lit("Registered in "), "n_name").alias("description"), F.lit("registry").alias("source")),
    "SELECT c_name AS organisation, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'industry' ELSE 'other' END AS sector, 'Registered in ' || n_name AS description, 'registry' AS source FROM customer JOIN nation ON c_nationkey = n_nationkey",
)
Q.add(
    "p3_flatten", lambda t: t.customer.join(t.orders.filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("o_orderkey", F.lit(-1)).alias("version"), F.coalesce("o_orderpriority", F.lit("")).alias("priority")),
    "SELECT c_custkey, coalesce(o_orderkey, -1) AS version, coalesce(o_orderpriority, '') AS priority FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON c_custkey = o_custkey",
)
Q.add(
    "p4_null_skipping", lambda t: t.part.select("p_partkey", F.coalesce(F.when(F.col("p_size") > 25, F.col("p_name")), F.col("p_brand")).alias("merged")),
    "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_name ELSE p_brand END AS merged FROM part",
)
Q.add(
    "p5_coercion", lambda t: ensure_columns(t.part.select("p_partkey", as_int(F.substring_index("p_brand", "#", -1)).alias("n"), as_int(F.col("p_name")).alias("bad")), SHAPE).select("p_partkey", "n", "bad", "note", "flag"),
    "SELECT p_partkey, coalesce(TRY_CAST(split_part(p_brand, '#', 2) AS INT), 0) AS n, 0 AS bad, '' AS note, false AS flag FROM part",
)
Q.add(
    "p6_derived_flags", lambda t: t.orders.select("o_orderkey", (F.size(F.filter(F.array("o_orderstatus"), lambda x: x == "O")) > 0).alias("has_new"), (F.col("o_orderpriority") != "").alias("has_careers"), views.within(F.to_date("o_orderdate"), day(), 14).alias("page_changed")),
    f"SELECT o_orderkey, o_orderstatus = 'O' AS has_new, o_orderpriority <> '' AS has_careers, CAST(o_orderdate AS DATE) >= DATE '{AS_OF}' - 14 AS page_changed FROM orders",
)
Q.add("p7_keyword", lambda t: t.part.filter(views.keyword(["p_name", "p_brand", "p_type"], "BOLT brand#1")).select("p_partkey", "p_name"), "SELECT p_partkey, p_name FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'bolt brand#1')")
Q.add("p8_pattern", lambda t: t.part.filter(views.pattern(["p_name", "p_type"], "^red|eco.*y$")).select("p_partkey"), "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '(?i)^red|eco.*y$') OR regexp_matches(p_type, '(?i)^red|eco.*y$')")
Q.add("p9_membership", lambda t: t.documents.filter(F.col("lang").isin("en", "fr") & ~F.col("source").isin("src0", "src1")).select("doc_id"), "SELECT doc_id FROM documents WHERE lang IN ('en', 'fr') AND source NOT IN ('src0', 'src1')")
Q.add("p10_tri_state", lambda t: t.documents.join(t.labels, "doc_id", "left").filter(F.coalesce("quality", F.lit(-1)) != 0).select("doc_id", "quality"), "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(quality, -1) <> 0")


def recent() -> Column:
    return F.when(F.col("o_orderkey") % 5 != 0, F.to_date("o_orderdate"))


Q.add("p11_recency", lambda t: t.orders.filter(views.within(recent(), day(), 90, undated=True)).select("o_orderkey"), f"SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0 OR CAST(o_orderdate AS DATE) >= DATE '{AS_OF}' - 90")
Q.add(
    "p12_null_range", lambda t: t.orders.withColumn("age", F.datediff(day(), recent())).filter("age <= 365 OR age IS NULL").select("o_orderkey", "age"),
    f"SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 5 <> 0 THEN date_diff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF}') END AS INT) AS age FROM orders WHERE o_orderkey % 5 = 0 OR date_diff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF}') <= 365",
)
Q.add(
    "p17_changed", lambda t: t.part.select("p_partkey", differs([(F.col("p_name"), F.concat(F.col("p_name"), F.when(F.col("p_size") > 40, F.lit("!")).otherwise(""))), (F.nullif("p_type", F.lit("SMALL")), F.nullif("p_type", F.lit("SMALL")))]).alias("changed")),
    "SELECT p_partkey, p_size > 40 AS changed FROM part",
)
Q.add(
    "p19_labels",
    lambda t: t.orders.select("o_orderkey", views.openings_label(F.when(F.col("o_orderstatus") == "O", "has_openings").when(F.col("o_orderstatus") == "F", "no_openings").otherwise("unknown"), (F.col("o_orderkey") % 3).cast("int")).alias("openings"), views.deadline_label(F.to_date("o_orderdate"), day()).alias("deadline")),
    f"""SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 3) || ' open' ELSE 'hiring' END WHEN 'F' THEN 'none now' ELSE '?' END AS openings,
        CASE WHEN l < 0 THEN 'closed' WHEN l = 0 THEN 'today' WHEN l <= 7 THEN l || 'd left' ELSE strftime(d, '%d %b') END AS deadline
        FROM (SELECT *, CAST(o_orderdate AS DATE) AS d, date_diff('day', DATE '{AS_OF}', CAST(o_orderdate AS DATE)) AS l FROM orders)""",
)

# Scores.
Q.add(
    "c1_score_title", lambda t: t.part.withColumn("f", score_title(F.col("p_name"), PARTS)).select("p_partkey", "f.score", "f.band", F.array_join("f.reasons", "; ").alias("reasons")),
    f"""WITH s AS ({SCORED}) SELECT p_partkey, score, {BAND_SQL} AS band, array_to_string(list_filter([
        CASE WHEN regexp_matches(p_name, 'widget|gear') THEN 'policy role' END, CASE WHEN regexp_matches(p_name, 'red|blue') THEN 'region named' END,
        CASE WHEN contains(p_name, 'ring') THEN 'research track' END, CASE WHEN regexp_matches(p_name, 'bolt|plate') THEN 'adjacent area' END,
        CASE WHEN contains(p_name, 'large') THEN 'too senior' WHEN regexp_matches(p_name, 'hot|old') THEN 'right level' WHEN contains(p_name, 'small') THEN 'entry level' END,
        CASE WHEN contains(p_name, 'gizmo') THEN 'language named' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM s""",
)
Q.add(
    "c2_apply_fit", lambda t: rollup_openings(t.part, "p_type", "p_name", "p_partkey", PARTS).select("p_type", "best_score", "best_band", "strong"),
    f"WITH s AS ({SCORED}) SELECT p_type, max(score) AS best_score, CASE WHEN max(score) >= 65 THEN 'strong' WHEN max(score) >= 45 THEN 'possible' ELSE 'weak' END AS best_band, CAST(count(*) FILTER (score >= 65) AS INT) AS strong FROM s GROUP BY 1",
)
Q.add("n1_clamp", lambda t: t.part.select("p_partkey", rules.clamp(F.col("p_size") * 3 - 20, 0, 100).alias("c"), F.greatest(F.lit(0), 3 - F.col("p_size")).alias("bonus")), "SELECT p_partkey, least(greatest(p_size * 3 - 20, 0), 100) AS c, greatest(0, 3 - p_size) AS bonus FROM part")
Q.add("n2_half_even", lambda t: t.part.select("p_partkey", F.bround(F.col("p_size") / 2).cast("int").alias("r")), "SELECT p_partkey, CAST(round_even(p_size / 2, 0) AS INT) AS r FROM part")
Q.add(
    "r1_reasons", lambda t: t.customer.select("c_custkey", F.array_join(rules.reasons([rules.Term(F.col("c_acctbal") > 5000, 1, "rich"), rules.Term(F.col("c_mktsegment") == "BUILDING", 1, "builds"), rules.Term(F.col("c_nationkey") < 5, 1, "near")]), ",").alias("why")),
    "SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_acctbal > 5000 THEN 'rich' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'builds' END, CASE WHEN c_nationkey < 5 THEN 'near' END], lambda x: x IS NOT NULL), ',') AS why FROM customer",
)
Q.add(
    "r2_arrays", lambda t: t.part.select("p_partkey", F.array_join(F.slice(F.array_sort(F.array_distinct(F.concat(F.split("p_name", " "), F.array(F.lower("p_type"), F.lower("p_type"))))), 1, 2), ",").alias("two"), F.exists(F.split("p_name", " "), lambda x: x == "red").alias("any_red")),
    "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(string_split(p_name, ' '), [lower(p_type)])))[1:2], ',') AS two, list_contains(string_split(p_name, ' '), 'red') AS any_red FROM part",
)
Q.add("r3_flatten", lambda t: t.part.groupBy("p_brand").agg(F.size(F.array_distinct(F.flatten(F.collect_set(F.split("p_name", " "))))).alias("words")), "SELECT p_brand, CAST(count(DISTINCT word) AS INT) AS words FROM (SELECT p_brand, unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY 1")
Q.add("f15_truncate", lambda t: t.documents.select("doc_id", F.substring("text", 1, 400).alias("head"), F.length(F.substring("text", 1, text.PAGE_TEXT_CHARS)).alias("kept")), "SELECT doc_id, substring(text, 1, 400) AS head, CAST(length(substring(text, 1, 20000)) AS INT) AS kept FROM documents")

# Views.
V1_SQL = f"""FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""


def v1_ranked_orders(t):
    """The flagship: orders with customer and nation, filtered, scored, labelled and ranked."""
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    terms = [rules.Term(F.col("o_orderpriority") == "1-URGENT", 28, "urgent"), rules.Term(F.col("o_totalprice") > 300000, 25, "large"), rules.Term(F.col("c_mktsegment") == "MACHINERY", 22, "machinery"), rules.Term(F.col("c_acctbal") < 0, -30, "in debt")]
    score = rules.clamp(rules.total(terms, 30), 0, 100)
    out = joined.filter(views.keyword(["c_name", "n_name", "c_mktsegment"], "nation_1") & F.col("c_mktsegment").isin("MACHINERY", "BUILDING", "FURNITURE") & views.within(F.to_date("o_orderdate"), day(), 1000))
    out = out.select("o_orderkey", "c_name", "n_name", score.alias("fit_score"), rules.band(score, ((65, "strong"), (45, "possible")), "weak").alias("fit_band"), F.array_join(rules.reasons(terms), "; ").alias("reasons"), (F.col("o_orderstatus") == "O").alias("hiring"))
    return out.orderBy((F.col("hiring") & views.fits(F.col("fit_band"))).desc(), F.desc("hiring"), F.desc("fit_score"), "c_name", "o_orderkey")


Q.add(
    "v1_ranked_orders", v1_ranked_orders,
    f"""WITH s AS (SELECT *, greatest(0, least(100, 30 + CASE WHEN o_orderpriority = '1-URGENT' THEN 28 ELSE 0 END + CASE WHEN o_totalprice > 300000 THEN 25 ELSE 0 END
            + CASE WHEN c_mktsegment = 'MACHINERY' THEN 22 ELSE 0 END + CASE WHEN c_acctbal < 0 THEN -30 ELSE 0 END)) AS score {V1_SQL}
            WHERE contains(lower(concat_ws(' ', c_name, n_name, c_mktsegment)), 'nation_1') AND c_mktsegment IN ('MACHINERY', 'BUILDING', 'FURNITURE') AND CAST(o_orderdate AS DATE) >= DATE '{AS_OF}' - 1000)
        SELECT o_orderkey, c_name, n_name, score AS fit_score, {BAND_SQL} AS fit_band, array_to_string(list_filter([CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' END,
            CASE WHEN o_totalprice > 300000 THEN 'large' END, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'machinery' END, CASE WHEN c_acctbal < 0 THEN 'in debt' END], lambda x: x IS NOT NULL), '; ') AS reasons,
            o_orderstatus = 'O' AS hiring FROM s""",
)
CATALOGUE = lambda t: t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
    F.concat_ws(" ", "c_name", "o_orderkey").alias("organisation"), F.col("c_mktsegment").alias("sector"), F.col("o_orderpriority").alias("description"), F.lit("").alias("target_roles"), F.lit("").alias("type"), F.lit("").alias("page_text"),
    (F.col("o_orderkey") % 7 == 0).alias("reviewed"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("last_updated"), F.when(F.col("o_orderstatus") == "O", "has_openings").when(F.col("o_orderstatus") == "F", "no_openings").otherwise("unknown").alias("openings_state"),
    (F.col("o_orderkey") % 3).cast("int").alias("openings_count"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("openings_deadline"), F.when(F.col("o_orderkey") % 4 == 0, F.array("o_orderpriority")).otherwise(F.array().cast("array<string>")).alias("openings_new_titles"),
    F.date_format("o_orderdate", "yyyy-MM-dd").alias("changed_at"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("https://x.example")).otherwise("").alias("careers_url"), F.when(F.col("o_orderkey") % 2 == 0, "high").otherwise("none").alias("careers_confidence"),
    F.when(F.col("o_totalprice") > 300000, "strong").otherwise("weak").alias("fit_band"), F.col("o_totalprice").alias("fit_score"), F.col("o_orderpriority").alias("fit_best_title"),
)
Q.add(
    "v1_organisations", lambda t: views.organisations(CATALOGUE(t), views.Filters(query="customer#0000", sectors=("MACHINERY",), reviewed=False, updated_within=400, openings="hide none", links="found"), day()).drop("last_updated"),
    f"""SELECT c_name || ' ' || o_orderkey AS organisation, c_mktsegment AS sector, false AS reviewed, CASE o_orderstatus WHEN 'O' THEN CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 3) || ' open' ELSE 'hiring' END ELSE '?' END AS openings,
        CASE WHEN o_totalprice > 300000 THEN '★ ' ELSE '' END || o_orderpriority AS best_opening, CASE WHEN l < 0 THEN 'closed' WHEN l = 0 THEN 'today' WHEN l <= 7 THEN l || 'd left' ELSE strftime(d, '%d %b') END AS deadline, 'https://x.example' AS careers_url
        FROM (SELECT *, CAST(o_orderdate AS DATE) AS d, date_diff('day', DATE '{AS_OF}', CAST(o_orderdate AS DATE)) AS l FROM orders JOIN customer ON o_custkey = c_custkey)
        WHERE c_mktsegment = 'MACHINERY' AND o_orderkey % 7 <> 0 AND d >= DATE '{AS_OF}' - 400 AND o_orderstatus <> 'F' AND o_orderkey % 2 = 0 AND contains(lower(c_name), 'customer#0000')""",
)
Q.add(
    "v1_kpis", lambda t: views.kpis(CATALOGUE(t)),
    "SELECT count(*) AS shown, count(*) FILTER (o_orderstatus = 'O') AS hiring, count(*) FILTER (o_orderstatus = 'O' AND o_totalprice > 300000) AS hiring_fit, count(*) FILTER (o_orderkey % 7 = 0) AS reviewed FROM orders JOIN customer ON o_custkey = c_custkey",
)
Q.add(
    "v2_why_these", lambda t: views.top_titles(t.part.withColumn("f", score_title(F.col("p_name"), PARTS)).filter(F.col("f.band").isin("strong", "possible")).select("p_type", "p_partkey", "p_name", "f.score"), "p_type", [F.desc("score"), F.asc("p_partkey")], 4, 25),
    f"WITH s AS ({SCORED}) SELECT p_type, p_partkey, p_name, score, CAST(row_number() OVER (PARTITION BY p_type ORDER BY score DESC, p_partkey) AS INT) AS nth FROM s WHERE score >= 45 QUALIFY nth <= 4",
)
Q.add(
    "v3_sectors", lambda t: views.coverage_by(CATALOGUE(t), "sector", F.col("careers_url") != ""),
    "SELECT c_mktsegment AS sector, count(*) AS total, count(*) FILTER (o_orderkey % 2 = 0) AS found, round_even(count(*) FILTER (o_orderkey % 2 = 0) / count(*) * 100, 0) AS pct FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
)
JOBS = lambda t: t.orders.select(
    "o_orderkey", F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("employer"), F.when(F.col("o_orderkey") % 5 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("").alias("posted"),
    F.when(F.col("o_orderkey") % 2 == 0, F.date_format(F.date_add("o_orderdate", 30), "yyyy-MM-dd")).otherwise("").alias("deadline"), F.when(F.col("o_orderkey") % 3 == 0, "high").otherwise("low").alias("confidence"),
)
Q.add(
    "v4_jobs", lambda t: views.jobs(JOBS(t).withColumn("posted", F.nullif("posted", F.lit(""))).withColumn("deadline", F.nullif("deadline", F.lit(""))), day(), search="urgent|high", confidence=("high",), newest_days=400).select("o_orderkey", "age", "days_left"),
    f"""SELECT o_orderkey, age, days_left FROM (SELECT o_orderkey, o_orderpriority, CAST(CASE WHEN o_orderkey % 5 <> 0 THEN date_diff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF}') END AS INT) AS age,
        CAST(CASE WHEN o_orderkey % 2 = 0 THEN date_diff('day', DATE '{AS_OF}', CAST(o_orderdate AS DATE) + 30) END AS INT) AS days_left FROM orders)
        WHERE regexp_matches(o_orderpriority, '(?i)urgent|high') AND o_orderkey % 3 = 0 AND (age <= 400 OR age IS NULL) AND (days_left >= 0 OR days_left IS NULL)""",
)
Q.add(
    "v5_coverage", lambda t: CATALOGUE(t).agg(F.count(F.lit(1)).alias("organisations"), F.count_if(F.expr("careers_url <> ''")).alias("found"), F.count_if(F.expr("careers_confidence = 'high'")).alias("high"), F.count_if(F.expr("last_updated <> ''")).alias("dated")),
    "SELECT count(*) AS organisations, count(*) FILTER (o_orderkey % 2 = 0) AS found, count(*) FILTER (o_orderkey % 2 = 0) AS high, count(*) AS dated FROM orders JOIN customer ON o_custkey = c_custkey",
)
Q.add(
    "v5_stale", lambda t: views.stale(CATALOGUE(t).withColumn("last_updated_trust", F.when(F.col("reviewed"), "low").otherwise("high")).withColumn("last_updated_age_days", F.datediff(day(), F.col("last_updated").cast("date")))).select("organisation", "last_updated_age_days"),
    f"SELECT c_name || ' ' || o_orderkey AS organisation, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '{AS_OF}') AS INT) AS last_updated_age_days FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 7 <> 0 ORDER BY 2 DESC, 1 LIMIT 40",
)
Q.add("v5_missing", lambda t: views.missing(CATALOGUE(t)).select("organisation", "sector"), "SELECT c_name || ' ' || o_orderkey AS organisation, c_mktsegment AS sector FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 2 <> 0")
Q.add(
    "v6_whats_new",
    lambda t: (lambda n, c: n.select("organisation", F.lit("new").alias("tab")).unionByName(c.select("organisation", F.lit("changed").alias("tab"))))(*views.whats_new(views.derive(CATALOGUE(t), day()).withColumn("domain", F.lower("sector")).withColumn("openings_new_at", F.col("changed_at")), day(), hidden=("building",), days=200)),
    f"""SELECT c_name || ' ' || o_orderkey AS organisation, CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE 'changed' END AS tab FROM orders JOIN customer ON o_custkey = c_custkey
        WHERE c_mktsegment <> 'BUILDING' AND ((o_orderkey % 4 = 0 AND CAST(o_orderdate AS DATE) >= DATE '{AS_OF}' - 200) OR (o_orderkey % 4 <> 0 AND CAST(o_orderdate AS DATE) >= DATE '{AS_OF}' - 14))""",
)
Q.add(
    "v8_toggles", lambda t: t.part.select("p_partkey", score_title(F.col("p_name"), Profile(topics=PARTS.topics, senior=PARTS.senior, mid=PARTS.mid, junior=PARTS.junior, languages=PARTS.languages, toggles={"seniority": False, "region": False}))["score"].alias("score")),
    "SELECT p_partkey, least(100, greatest(0, 30 + CASE WHEN regexp_matches(p_name, 'widget|gear') THEN 28 ELSE 0 END + CASE WHEN contains(p_name, 'ring') THEN 22 ELSE 0 END + CASE WHEN regexp_matches(p_name, 'bolt|plate') THEN 12 ELSE 0 END + CASE WHEN regexp_matches(p_name, 'hot|old') THEN 12 WHEN contains(p_name, 'small') THEN -6 ELSE 0 END + CASE WHEN contains(p_name, 'gizmo') THEN 6 ELSE 0 END)) AS score FROM part",
)
