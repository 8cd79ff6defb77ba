"""Openings on pages: titles and deadlines, empty states, listings by layers of decreasing trust."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orgloom.functions import vocab
from orgloom.functions.dates import deadline_near_cue, listing_dates, structured_deadline
from orgloom.functions.html import parse_page
from orgloom.functions.rules import has_any
from orgloom.functions.text import BODY_CHROME, clean, is_opening_title, looks_like_listing, looks_like_opening, visible_text
from orgloom.functions.urls import join_url
from orgloom.operators.resolve import distinct_titles

HAS, NONE, UNKNOWN = "has_openings", "no_openings", "unknown"
MOST_TITLES = 25
#: Fixed pattern: pages that say that nothing is open.
EMPTY_STATE = (
    r"(?iu)no (current |open )?(vacanc|job|position|opening)\w*|no vacancies (at this time|currently|right now|available)"
    r"|there are (currently )?no (open|current)?\s?(vacanc|position|job|opening)|not? (open )?(positions?|vacanc\w*) (available|at the moment|currently)"
    r"|pas d[’']offre|aucune offre|aucun poste|pas de poste (vacant|à pourvoir)|aucune (offre|vacance)|pas de recrutement"
    r"|geen (vacature|openstaande)|momenteel geen vacature|er zijn (momenteel |op dit moment )?geen vacature"
    r"|keine (offene[n]? )?(stelle|stellenangebote|vakanz)|derzeit keine|zurzeit keine|aktuell keine (stelle|offene)"
    r"|no hay (vacantes|ofertas|puestos)|sin (vacantes|ofertas)|no existen (vacantes|ofertas)"
    r"|nessuna posizione|non ci sono posizioni|nessuna offerta|check back (later|soon|regularly)|please check back"
)
#: Fixed pattern: the same for listings.
LISTING_EMPTY = (
    r"(?iu)(no (current |open )?(vacanc|job|position|opening)\w*|no vacancies at this time|there are currently no"
    r"|pas d'offre|aucune offre|geen vacature|check back (later|soon)|at the moment)"
)
#: Fixed patterns and words: paths of jobs and listings, and titles that need none.
_JOB_PATH = (
    r"(?iu)/(job|jobs|vacanc|vacature|career|carriere|offre|emploi|stelle|stellenangebot|position|opening|opportunit|stage|praktik|empleo|oferta"
    r"|lavora|posizione|traineeship|internship|recruit)[a-z-]*/"
)
_LISTING_PATH = r"(?i)/(job|jobs|vacanc|vacature|career|offre|emploi|position|opening|opportunit|stage|internship|recruit)[a-z-]*/[^/]{4,}"
_STRONG_OPENING = ("officer", "adviser", "manager", "coordinator", "director", "referent", "chargé", "responsable", "intern")
_STRONG_LISTING = ("officer", "adviser", "advisor", "manager", "coordinator", "director", "intern", "analyst", "assistant", "head of")


def detect(pages: DataFrame, key: str = "url", html: str = "text", ok: str = "ok", status: str = "status") -> DataFrame:
    """``state, count, titles, deadline, note`` of fetched pages.

    Titles come from postings in scripts, else from links that read like titles. Without titles, a page that says so
    has no openings, and another is unknown, as is one that can't be read.
    """
    page = F.col(html)
    read = pages.withColumn("parsed", parse_page(F.when(F.col(ok), page)))
    link = F.filter("parsed.links", lambda x: looks_like_opening(x["text"]) & (x["href"].rlike(_JOB_PATH) | has_any(F.lower(x["text"]), _STRONG_OPENING)))
    body = visible_text(page, BODY_CHROME)
    full = read.withColumns({"body": body, "linked": F.transform(link, lambda x: clean(x["text"])), "scripted": F.transform("parsed.postings", lambda p: p["title"])})
    given = distinct_titles(F.filter(F.transform("scripted", clean), is_opening_title))
    full = full.withColumn("given", given).withColumn("titles", F.when(F.size("given") > 0, F.col("given")).otherwise(distinct_titles(F.col("linked"))))
    readable, some = F.coalesce(F.col(ok), F.lit(False)), F.size("titles") > 0
    structured = structured_deadline(page)
    deadline = F.when(structured != "", structured).otherwise(deadline_near_cue(F.col("body")))
    return full.select(
        key,
        F.when(~readable, UNKNOWN).when(some, HAS).when(F.col("body").rlike(EMPTY_STATE), NONE).otherwise(UNKNOWN).alias("state"),
        F.when(readable, F.size("titles")).otherwise(0).alias("count"),
        F.when(readable, F.slice("titles", 1, MOST_TITLES)).otherwise(F.array().cast("array<string>")).alias("titles"),
        F.when(readable & some, deadline).otherwise("").alias("deadline"),
        F.when(~readable, F.concat(F.lit("couldn't read page (HTTP "), F.coalesce(F.col(status), F.lit(0)).cast("string"), F.lit(")"))).when(some, "").when(F.col("body").rlike(EMPTY_STATE), "page says no openings right now").otherwise("couldn't tell from the page").alias("note"),
    )


def _row_dates(row: Column, as_of: Column) -> Column:
    """``posted, deadline`` of a row: its times first, then its text. A time with a deadline's cue is the deadline,
    if no other time stands before it."""
    good = F.filter(row["times"], lambda t: t["datetime"].rlike(r"^\d{4}-\d{2}-\d{2}"))
    plain = F.filter(good, lambda t: ~t["deadline"])
    ahead = F.filter(good, lambda t, i: t["deadline"] & (F.size(F.filter(F.slice(good, 1, i + 1), lambda o: ~o["deadline"])) == 0))
    first = lambda found: F.substring(F.get(found, F.lit(0))["datetime"], 1, 10)
    posted, deadline = listing_dates(row["text"], as_of)
    return F.struct(F.coalesce(first(plain), posted).alias("posted"), F.coalesce(first(ahead), deadline).alias("deadline"))


def listings(pages: DataFrame, as_of: Column, url: str = "url", html: str = "html") -> DataFrame:
    """Jobs of pages, a row each with its ``method``: postings in scripts, else links that read like listings.

    A page is parsed once; only jobs and likely links leave it, each with the dates of its row."""
    read = pages.select(url, parse_page(F.col(html)).alias("parsed")).select(url, "parsed.listed", "parsed.links", F.transform("parsed.rows", lambda r: _row_dates(r, as_of)).alias("dates"))
    exact = F.transform("listed", lambda p: F.struct(p["title"].alias("text"), p["url"].alias("href"), p["location"].alias("location"), p["posted"].alias("posted"), p["deadline"].alias("deadline"), F.lit("jsonld").alias("method")))
    likely = F.filter("links", lambda x: ~x["href"].rlike("^(#|mailto:|tel:|javascript:)") & looks_like_listing(clean(x["text"])))
    dated = lambda x, name: F.get("dates", x["row"])[name].alias(name)
    linked = F.transform(likely, lambda x: F.struct(clean(x["text"]).alias("text"), x["href"].alias("href"), F.lit("").alias("location"), dated(x, "posted"), dated(x, "deadline"), F.lit("generic").alias("method")))
    jobs = read.select(url, F.posexplode(F.when(F.size("listed") > 0, exact).otherwise(linked)).alias("pos", "job")).select(url, "pos", "job.*")
    jobs = jobs.withColumn("job_url", F.when((F.col("method") == "jsonld") & (F.col("href") == ""), F.col(url)).otherwise(join_url(F.col(url), F.col("href"))))
    path = F.regexp_extract("job_url", "^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    jobs = jobs.filter((F.col("method") == "jsonld") | path.rlike(_LISTING_PATH) | has_any(F.lower("text"), _STRONG_LISTING))
    same = F.when(F.col("method") == "generic", F.col("job_url")).otherwise(F.col("pos").cast("string"))  # links to one job are one job
    first = jobs.groupBy(url, "method", same.alias("same")).agg(F.min_by(F.struct(F.col("text").alias("title"), "job_url", "location", "posted", "deadline"), "pos").alias("j"))
    return first.select(url, "j.*", "method")


def layered(layers: list[DataFrame], url: str = "url") -> DataFrame:
    """Of several layers of jobs, those of the first layer that has any for the page."""
    ranked = [df.withColumn("layer", F.lit(i)) for i, df in enumerate(layers)]
    out = ranked[0]
    for df in ranked[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    best = F.min("layer").over(Window.partitionBy(url))  # of one page's jobs; a join would make every layer twice
    return out.filter(F.col(url).isNotNull()).withColumn("best", best).filter("layer = best").drop("layer", "best")


def empty_method(found: Column, body: Column, ok: Column, status: Column) -> Column:
    """The method of a page: that of its jobs, else why there are none."""
    return F.coalesce(found, F.when(~ok, F.concat(F.lit("fetch-failed:"), status.cast("string"))).when(body.rlike(LISTING_EMPTY), "empty-page").otherwise("no-jobs-found"))


def method_confidence(method: Column) -> Column:
    """Trust in a method by its root."""
    out, root = F.lit("low"), F.substring_index(method, ":", 1)
    for name, trust in vocab.METHOD_TRUST:
        out = F.when(root == name, trust).otherwise(out)
    return out
