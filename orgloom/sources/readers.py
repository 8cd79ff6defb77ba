"""Readers and writers: every source has an explicit schema, every sink is a plain Spark writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orgloom.functions.text import clean
from orgloom.functions.urls import is_member_link, join_url
from orgloom.functions.html import parse_page
from orgloom.functions.text import tidy_name, title_case
from orgloom.operators.records import ensure_columns
from orgloom.operators.resolve import longest_name

SHEET = "id long, organisation string, category string, type string, base string, target_roles string, why_fits string, language_edge string, eu_nationality string, priority int, existing_url string, existing_confidence string"
DIRECTORY = "organisation string, homepage string, category string, type string, base string, source_directory string"
FETCHES = "url string, fetched_at timestamp, ok boolean, status int, final_url string, text string, content_type string, headers map<string,string>, error string"
RESULTS = "query string, rank int, url string, title string, snippet string, engine string"
JOB = "title string, employer string, location string, url string, posted string, deadline string, category string, priority int, org_id string, source string, source_url string, method string, confidence string"
#: A prefix of XML names, if there is one.
_PREFIX = r"(?:[A-Za-z_][\w.-]*:)?"
#: Fields of a register entry, found at any depth.
REGISTER_FIELDS = ("registrationCategory", "country", "originalName", "acronym", "webSiteURL", "city", "membersFTE", "EPAccreditedNumber", "goals", "identificationCode")


def read_sheet(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """The sheet of targets from CSV: rows without a name are dropped, names trimmed."""
    rows = spark.read.schema(SHEET).option("header", header).option("enforceSchema", True).csv(path)
    return rows.filter(F.trim("organisation") != "").withColumn("organisation", F.trim("organisation"))


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """Directory members from a JSON array."""
    return spark.read.schema(DIRECTORY).option("multiLine", True).json(path)


def read_register(spark: SparkSession, path: str, entry: str = "interestRepresentative") -> DataFrame:
    """Register entries from XML, whatever prefix their names have; each field is the first filled element of its name
    at any depth and in any namespace. Files of any size stream: lines end at the entry's name before ``>``, so a part
    is an entry where it ends in an end tag without its name, ``</`` or ``</prefix:``. It begins after its start tag,
    if that has attributes, or else is the whole part, as the start tag has ended the part before."""
    raw = spark.read.option("lineSep", f"{entry}>").text(path)
    ended = raw.filter(F.col("value").rlike(rf"</{_PREFIX}$")).select(F.regexp_replace("value", rf"</{_PREFIX}$", "").alias("value"))
    body = F.element_at(F.split("value", rf"<{_PREFIX}{entry}\s[^>]*>"), -1)
    rows = ended.select(F.concat(F.lit("<entry>"), body, F.lit("</entry>")).alias("xml"))
    return rows.select(*[first_element(F.col("xml"), f).alias(f) for f in REGISTER_FIELDS])


def first_element(xml: Column, name: str) -> Column:
    """The trimmed text of the first element of a name that has text; empty if none has."""
    text = F.regexp_replace(xml, r"(</?)[A-Za-z_][\w.-]*:", "$1")
    text = F.regexp_replace(text, r"""\s(?:[A-Za-z_][\w.-]*:[\w.-]+|xmlns)\s*=\s*(?:"[^"]*"|'[^']*')""", "")
    return F.coalesce(F.trim(F.xpath_string(text, F.lit(f"(//{name}[normalize-space()])[1]"))), F.lit(""))


def filter_register(rows: DataFrame, country: str, larger_only: bool = True) -> DataFrame:
    """Entries of a country in the kept categories, by default only larger bodies."""
    from orgloom.functions import vocab
    from orgloom.functions.rules import has_any
    from orgloom.operators.classify import is_larger

    kept = rows.filter((F.col("country") == country) & has_any(F.lower("registrationCategory"), vocab.KEEP_CATEGORIES))
    return kept.filter(is_larger(F.col("membersFTE"), F.col("EPAccreditedNumber"))) if larger_only else kept


def registry(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small list given as rows."""
    return spark.createDataFrame(rows, schema)


def latest_fetch(fetches: DataFrame, as_of: Column, ttl_hours: int = 24) -> DataFrame:
    """The newest fetch of each address within its time to live; bodies that aren't text are empty, failures are 0."""
    from orgloom.operators.resolve import newest_within

    young = newest_within(fetches, "url", "fetched_at", as_of, ttl_hours * 3600)
    texty = F.coalesce("content_type", F.lit("")).rlike("(?i)text|html|xml|json") | (F.coalesce("content_type", F.lit("")) == "")
    return young.withColumn("text", F.when(texty, F.coalesce("text", F.lit(""))).otherwise("")).withColumn("status", F.coalesce("status", F.lit(0))).withColumn("ok", F.coalesce("ok", F.lit(False)))


def rendered_or_fetched(fetches: DataFrame, rendered: DataFrame) -> DataFrame:
    """Fetches whose empty text is filled from the rendered snapshot."""
    other = rendered.filter(F.coalesce("text", F.lit("")) != "").select("url", F.col("text").alias("rendered_text"))
    return fetches.join(other, "url", "left").withColumn("text", F.coalesce(F.nullif("text", F.lit("")), "rendered_text", F.lit(""))).drop("rendered_text")


def search_results(results: DataFrame, primary: str, fallback: str) -> DataFrame:
    """Results of the primary engine; of the other where the primary has none for a query."""
    has = results.filter(F.col("engine") == primary).select("query").distinct()
    rest = results.filter(F.col("engine") == fallback).join(has, "query", "left_anti")
    return results.filter(F.col("engine") == primary).unionByName(rest)


_GREENHOUSE = "struct<jobs:array<struct<title:string,absolute_url:string,location:struct<name:string>,updated_at:string>>>"
_LEVER = "array<struct<text:string,hostedUrl:string,categories:struct<location:string>>>"
_RECRUITEE = "struct<offers:array<struct<title:string,careers_url:string,url:string,location:string,published_at:string>>>"


def board_of(url: Column) -> tuple[Column, Column]:
    """The recruitment platform of an address, and the board's name there."""
    patterns = {"greenhouse": r"(?i)greenhouse\.io/(?:embed/job_board\?for=)?([a-z0-9_-]+)", "lever": r"(?i)lever\.co/([a-z0-9_-]+)", "recruitee": r"(?i)([a-z0-9_-]+)\.recruitee\.com"}
    kind, board = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, p in patterns.items():
        hit = F.regexp_extract(url, p, 1)
        kind, board = F.when(hit != "", name).otherwise(kind), F.when(hit != "", hit).otherwise(board)
    return kind, board


def platform_jobs(bodies: DataFrame, kind: str) -> DataFrame:
    """Jobs of a platform's JSON answers ``source_url, body``: four fields each, broken answers give none."""
    if kind == "greenhouse":
        jobs = bodies.select("source_url", F.explode(F.from_json("body", _GREENHOUSE)["jobs"]).alias("j"))
        cols = [clean(F.col("j.title")), F.col("j.absolute_url"), clean(F.col("j.location.name")), F.substring("j.updated_at", 1, 10)]
    elif kind == "lever":
        jobs = bodies.select("source_url", F.explode(F.from_json("body", _LEVER)).alias("j"))
        cols = [clean(F.col("j.text")), F.col("j.hostedUrl"), clean(F.col("j.categories.location")), F.lit("")]
    elif kind == "recruitee":
        jobs = bodies.select("source_url", F.explode(F.from_json("body", _RECRUITEE)["offers"]).alias("j"))
        cols = [clean(F.col("j.title")), F.coalesce("j.careers_url", "j.url"), clean(F.col("j.location")), F.substring("j.published_at", 1, 10)]
    else:
        raise ValueError(f"unknown platform {kind}")
    names = ("title", "url", "location", "posted")
    out = jobs.select("source_url", *[F.coalesce(c, F.lit("")).alias(n) for c, n in zip(cols, names, strict=True)], F.lit(f"ats:{kind}").alias("method"))
    return out.filter("title <> ''")


def anchored_jobs(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Links to single jobs below ``/jobs/`` with some text."""
    links = pages.withColumn("p", parse_page(F.col(html))).select(F.col(url).alias("source_url"), F.explode("p.links").alias("x"))
    return links.filter(F.col("x.href").contains("/jobs/") & (F.length(clean(F.col("x.text"))) > 5)).select("source_url", clean(F.col("x.text")).alias("title"), join_url(F.col("source_url"), F.col("x.href")).alias("url"), F.lit("ats:teamtailor").alias("method"))


def harvest(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Members that directory pages link to: one row per page and host, with the longest readable name."""
    links = pages.withColumn("p", parse_page(F.col(html))).select(F.col(url).alias("page"), F.explode("p.links").alias("x"))
    own = F.regexp_replace(F.lower(F.regexp_extract("page", "^https?://([^/?#]*)", 1)), r"www\.", "")
    links = links.filter(is_member_link(F.trim("x.href"), own)).withColumn("host", F.regexp_replace(F.lower(F.regexp_extract(F.trim("x.href"), "^https?://([^/?#]*)", 1)), r"www\.", ""))
    label = F.when(F.length(clean(F.col("x.text"))) < 3, clean(F.col("x.alt"))).otherwise(clean(F.col("x.text")))
    name = tidy_name(label, F.col("host"))
    name = F.when(F.length(name) < 3, title_case(F.replace(F.substring_index("host", ".", 1), F.lit("-"), F.lit(" ")))).otherwise(name)
    rows = links.select(F.concat_ws(" ", "page", "host").alias("at"), "page", "host", name.alias("organisation"), F.col("x.pos").alias("pos"))
    return longest_name(rows, "at", "organisation", "pos").select("page", "host", "organisation", F.concat(F.lit("https://"), "host").alias("homepage"))


def member_pages(pages: DataFrame, prefix: str, url: str = "url", html: str = "html") -> DataFrame:
    """Members that have a page of their own below a path: the last link to each counts."""
    links = pages.withColumn("p", parse_page(F.col(html))).select(F.col(url).alias("page"), F.explode("p.links").alias("x"))
    links = links.withColumn("href", join_url(F.col("page"), F.col("x.href")))
    slug = F.regexp_extract("href", rf"^[a-z]+://[^/]+{prefix}([^/?#]+)/?(?:[?#].*)?$", 1)
    links = links.withColumn("slug", slug).filter("slug <> ''")
    name = F.coalesce(F.nullif(clean(F.col("x.text")), F.lit("")), title_case(F.replace(F.col("slug"), F.lit("-"), F.lit(" "))))
    return links.groupBy("page", "slug").agg(F.max_by(F.struct(name.alias("organisation"), F.col("href").alias("homepage")), F.col("x.pos")).alias("m")).select("page", "slug", "m.*")


def envelopes(rows: DataFrame, by: str, job: str, at: Column, most: int = 10_000) -> DataFrame:
    """Jobs of each ``by`` as ``generated_at, count, jobs[]``, in envelopes of some ``most`` jobs at the most: rows are
    dealt into as many by their hash, so that no envelope, nor the task that makes it, holds all of a large one."""
    sizes = rows.groupBy(by).agg(F.ceil(F.count(F.lit(1)) * 1.5 / most).alias("parts"))
    dealt = rows.join(sizes, by).withColumn("part", F.pmod(F.xxhash64(job), F.col("parts")))
    return dealt.groupBy(by, "part").agg(at.alias("generated_at"), F.count(F.lit(1)).cast("int").alias("count"), F.collect_list(job).alias("jobs")).drop(by, "part")


def unwrap_jobs(envelope: DataFrame) -> DataFrame:
    """The jobs of ``generated_at, jobs[]`` envelopes."""
    return envelope.selectExpr("generated_at", "inline(jobs)")


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([T.StructField("generated_at", T.StringType()), T.StructField("count", T.IntegerType()), T.StructField("jobs", T.ArrayType(T.StructType.fromDDL(JOB)))])
    return unwrap_jobs(spark.read.schema(schema).option("multiLine", True).json(path))


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table with the columns of a schema, older files included: what they lack holds defaults."""
    return ensure_columns(spark.read.option("mergeSchema", True).parquet(path), schema)


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """A whole table, overwritten."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """The export of a view: a header, no index."""
    df.write.mode("overwrite").option("header", True).csv(path)


def append_events(df: DataFrame, path: str) -> None:
    """Rows added to an append-only log."""
    df.write.mode("append").parquet(path)
