"""When a page last changed: by its fingerprint, by dates it gives, by what was known before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgloom.functions.dates import age_days, header_date
from orgloom.functions.rules import is_filled
from orgloom.functions.text import cut_spans, let, without_element

#: Metas that hold a date of change, in order.
META_KEYS = ("article:modified_time", "og:updated_time", "last-modified", "dateModified")
TRUST = (("meta", "high"), ("jsonld", "high"), ("sitemap", "medium"), ("hash", "medium"), ("http", "low"))


def meta_date(html: Column) -> Column:
    """The first date among a page's metas, by the order of keys; empty if none has one. Values stand in quotes of
    either kind or in none; metas in comments, scripts and styles don't count."""
    page = cut_spans(without_element(without_element(F.coalesce(html, F.lit("")), "script"), "style"), "<!--", "-->")
    tags = F.regexp_extract_all(page, F.lit(r"""(?i)<meta\b(?:[^<>"']|"[^"]*"|'[^']*')*+>"""), F.lit(0))

    def first(tags: Column) -> Column:
        out = []
        for key in META_KEYS:
            named = rf"""(?i)[\s"'](?:property|name|itemprop)\s*=\s*(?:"{key}"|'{key}'|{key}(?=[\s/>]))"""
            given = F.transform(F.filter(tags, lambda x: x.rlike(named)), lambda x: F.regexp_extract(x, r"""(?i)[\s"']content\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1))  # noqa: B023
            days = F.filter(F.transform(given, lambda x: F.regexp_extract(x, r"\d{4}-\d{2}-\d{2}", 0)), lambda x: x != "")
            out.append(F.get(days, F.lit(0)))
        return F.coalesce(*out, F.lit(""))

    return let(tags, first)


def jsonld_date(html: Column) -> Column:
    return F.coalesce(F.regexp_extract(html, r'(?i)"dateModified"\s*:\s*"(\d{4}-\d{2}-\d{2})', 1), F.lit(""))


def last_modified(headers: Column) -> Column:
    """The day in the headers, whatever the case of their names."""
    return header_date(F.try_element_at(F.transform_keys(headers, lambda k, _: F.lower(k)), F.lit("last-modified")))


def sitemap_dates(pages: DataFrame, sitemaps: DataFrame, url: str) -> DataFrame:
    """Pages with ``sitemap_date``: of entries ``loc, lastmod, map_order, pos`` for the same address, a final slash
    aside, the first that has a date."""
    entries = sitemaps.withColumn("day", F.regexp_extract("lastmod", r"\d{4}-\d{2}-\d{2}", 0)).filter("day <> ''")
    first = entries.groupBy(F.rtrim(F.trim("loc"), F.lit("/")).alias("loc_key")).agg(F.min_by("day", F.struct("map_order", "pos")).alias("sitemap_date"))
    return pages.withColumn("loc_key", F.rtrim(F.col(url), F.lit("/"))).join(first, "loc_key", "left").drop("loc_key").withColumn("sitemap_date", F.coalesce("sitemap_date", F.lit("")))


def ladder(cur_hash: Column, prev_hash: Column, prev_date: Column, meta: Column, jsonld: Column, sitemap: Column, header: Column, as_of: Column) -> dict[str, Column]:
    """``date, source, trust, age_days, changed_at, hash`` of a page.

    A changed fingerprint says today, and only that sets ``changed_at``. Else the page's own dates count, best source
    first; else an unchanged fingerprint carries the date known before, and a fingerprint without one is a seed. If the
    date that counts doesn't exist in the calendar, there is no date, source or trust.
    """
    has, had = is_filled(cur_hash, "string"), is_filled(prev_hash, "string")
    moved = has & had & (cur_hash != prev_hash)
    carried = has & had & is_filled(prev_date, "string")
    given = [(meta, "meta"), (jsonld, "jsonld"), (sitemap, "sitemap"), (header, "http")]
    own = F.coalesce(*[F.nullif(d, F.lit("")) for d, _ in given])
    source = F.lit("")
    source = F.when(has, "hash-seeded").otherwise(source)
    source = F.when(carried, "hash").otherwise(source)
    for d, name in reversed(given):
        source = F.when(is_filled(d, "string"), name).otherwise(source)
    source = F.when(moved, "hash").otherwise(source)
    date = F.when(moved, F.date_format(as_of, "yyyy-MM-dd")).otherwise(F.coalesce(own, F.when(carried, prev_date), F.lit("")))
    wrong = (date != "") & F.try_to_timestamp(date, F.lit("yyyy-MM-dd")).isNull()
    date, source = F.when(wrong, "").otherwise(date), F.when(wrong, "").otherwise(source)
    trust = F.lit("none")
    for name, level in TRUST:
        trust = F.when(source == name, level).otherwise(trust)
    trust = F.when(moved, "high").when(date == "", "none").otherwise(trust)
    return {
        "date": date, "source": source, "trust": trust,
        "age_days": F.when(moved, F.lit(0)).otherwise(F.when(date != "", age_days(date, as_of))),
        "changed_at": F.when(moved, F.date_format(as_of, "yyyy-MM-dd")).otherwise(""),
        "hash": F.coalesce(cur_hash, F.lit("")),
    }


def recheck(old: DataFrame, key: str, scan: DataFrame) -> DataFrame:
    """Stored freshness with a scan over it: dates as scanned, ``changed_at`` kept unless new, a hash never blanked."""
    new = scan.select(key, *[F.col(c).alias(f"scan_{c}") for c in ("date", "source", "trust", "age_days", "changed_at", "hash", "page_text")])
    both = old.join(new, key, "left")
    seen = F.col("scan_date").isNotNull()

    def filled(new_name: str, old_name: str) -> Column:
        return F.when(is_filled(F.col(new_name), "string"), F.col(new_name)).otherwise(F.col(old_name))

    out = {"last_updated": "date", "last_updated_source": "source", "last_updated_trust": "trust", "last_updated_age_days": "age_days"}
    cols = {k: F.when(seen, F.col(f"scan_{v}")).otherwise(F.col(k)) for k, v in out.items()}
    cols |= {"changed_at": filled("scan_changed_at", "changed_at"), "content_hash": filled("scan_hash", "content_hash"), "page_text": filled("scan_page_text", "page_text")}
    return both.withColumns(cols).select(*old.columns)


def change_log(scans: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Every scan with whether its value differs from the one before of the same key, and the last change so far."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(*order)
    before = F.lag(value).over(w)
    changed = before.isNotNull() & (before != F.col(value))
    seen = scans.withColumn("changed", changed)
    return seen.withColumn("changed_at", F.last(F.when(F.col("changed"), F.col(order[0])), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
