"""End-user views: one lazy plan each, built from a filter description."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orgloom.functions.rules import is_filled

PAGE_CHANGED_DAYS = 14


@dataclass(frozen=True)
class Filters:
    """What a user picked; what is left at its default doesn't filter."""

    query: str = ""
    sectors: tuple[str, ...] = ()
    reviewed: bool | None = None
    updated_within: int | None = None
    include_undated: bool = False
    openings: str = "any"
    good_fit_only: bool = False
    links: str = "any"


def keyword(columns: list[str], query: str) -> Column:
    """Whether the joined columns hold a text, whatever its case; the text is taken literally."""
    return F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(query.lower()))


def pattern(columns: list[str], regex: str) -> Column:
    """Whether any column matches a pattern, whatever its case; a pattern that can't be read raises ``ValueError`` here,
    not in a task."""
    try:
        SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(f"(?iu){regex}")
    except PySparkException as bad:
        raise ValueError(f"not a pattern: {regex}") from bad
    out = F.lit(False)
    for c in columns:
        out |= F.coalesce(F.col(c).rlike(f"(?iu){regex}"), F.lit(False))
    return out


def within(day: Column, as_of: Column, days: int, undated: bool = False) -> Column:
    """Whether a day is no older; days that can't be known count if ``undated``."""
    return F.coalesce(day >= F.date_sub(as_of, days), F.lit(undated))


def derive(catalogue: DataFrame, as_of: Column) -> DataFrame:
    """Records with the flags that views use."""
    changed = F.try_to_timestamp("changed_at").cast("date")
    return catalogue.withColumns({
        "has_new": F.coalesce(F.size("openings_new_titles"), F.lit(0)) > 0,
        "has_careers": F.coalesce(F.col("careers_url") != "", F.lit(False)),
        "page_changed": F.coalesce(changed >= F.date_sub(as_of, PAGE_CHANGED_DAYS), F.lit(False)),
    })


def apply(df: DataFrame, f: Filters, as_of: Column) -> DataFrame:
    """The filters of the organisations view."""
    if f.query:
        df = df.filter(keyword(["organisation", "description", "target_roles", "type", "page_text"], f.query))
    if f.sectors:
        df = df.filter(F.col("sector").isin(*f.sectors))
    if f.reviewed is not None:
        df = df.filter(F.col("reviewed") == f.reviewed)
    if f.updated_within is not None:
        df = df.filter(within(F.try_to_timestamp("last_updated").cast("date"), as_of, f.updated_within, f.include_undated))
    if f.openings == "has":
        df = df.filter("openings_state = 'has_openings'")
    elif f.openings == "hide none":
        df = df.filter("openings_state <> 'no_openings'")
    if f.good_fit_only:
        df = df.filter(F.col("fit_band").isin("strong", "possible"))
    if f.links == "high":
        df = df.filter("careers_confidence = 'high'")
    elif f.links == "found":
        df = df.filter(F.col("careers_confidence").isin("high", "medium"))
    return df


def fits(band: Column) -> Column:
    return band.isin("strong", "possible")


def kpis(df: DataFrame) -> DataFrame:
    """Shown, hiring, hiring and fitting, reviewed: one pass."""
    hiring = F.col("openings_state") == "has_openings"
    return df.agg(F.count(F.lit(1)).alias("shown"), F.count_if(hiring).alias("hiring"), F.count_if(hiring & fits(F.col("fit_band"))).alias("hiring_fit"), F.count_if("reviewed").alias("reviewed"))


def ranked(df: DataFrame) -> DataFrame:
    """Best next actions first."""
    hiring = F.col("openings_state") == "has_openings"
    return df.orderBy((hiring & fits(F.col("fit_band"))).desc(), hiring.desc(), F.col("fit_score").desc(), F.col("reviewed").asc(), F.col("organisation").asc())


def openings_label(state: Column, count: Column) -> Column:
    return F.when(state == "has_openings", F.when(count > 0, F.concat(count.cast("string"), F.lit(" open"))).otherwise("hiring")).when(state == "no_openings", "none now").otherwise("?")


def deadline_label(day: Column, as_of: Column) -> Column:
    """closed, today, days left within a week, else day and month; empty if there is none."""
    left = F.datediff(day, as_of)
    return F.when(day.isNull(), "").when(left < 0, "closed").when(left == 0, "today").when(left <= 7, F.concat(left.cast("string"), F.lit("d left"))).otherwise(F.date_format(day, "dd MMM"))


def fit_label(band: Column, title: Column) -> Column:
    mark = F.when(band == "strong", "★ ").when(band == "possible", "· ").otherwise("")
    return F.when(F.coalesce(title, F.lit("")) == "", "").otherwise(F.concat(mark, title))


def organisations(catalogue: DataFrame, f: Filters, as_of: Column) -> DataFrame:
    """The ranked, labelled table of organisations."""
    return ranked(apply(derive(catalogue, as_of), f, as_of)).select(
        "organisation", "sector", "reviewed", openings_label(F.col("openings_state"), F.col("openings_count")).alias("openings"),
        fit_label(F.col("fit_band"), F.col("fit_best_title")).alias("best_opening"),
        deadline_label(F.try_to_timestamp("openings_deadline").cast("date"), as_of).alias("deadline"), "careers_url", "last_updated",
    )


def top_titles(scored: DataFrame, group: str, order: list[Column], per_group: int, groups: int) -> DataFrame:
    """The best rows of each of the first groups."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    first = scored.select(group).distinct().orderBy(group).limit(groups)
    return scored.join(first, group, "left_semi").withColumn("nth", n).filter(F.col("nth") <= per_group)


def counts(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    """Values by frequency, ties by value."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), column)


def coverage_by(df: DataFrame, column: str, flag: Column) -> DataFrame:
    """Totals, flagged rows and their share in percent, rounded half-even."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("total"), F.count_if(flag).alias("found")).withColumn("pct", F.bround(F.col("found") / F.col("total") * 100, 0)).orderBy(F.desc("total"), column)


def jobs(df: DataFrame, as_of: Column, search: str = "", confidence: tuple[str, ...] = (), newest_days: int | None = None, hide_closed: bool = True) -> DataFrame:
    """Jobs by pattern, trust, age and deadline; unknown ages and deadlines stay; newest first, undated last."""
    df = df.withColumn("age", F.datediff(as_of, F.try_to_timestamp("posted").cast("date"))).withColumn("days_left", F.datediff(F.try_to_timestamp("deadline").cast("date"), as_of))
    if search:
        df = df.filter(pattern(["title", "employer"], search))
    if confidence:
        df = df.filter(F.col("confidence").isin(*confidence))
    if newest_days is not None:
        df = df.filter((F.col("age") <= newest_days) | F.col("age").isNull())
    if hide_closed:
        df = df.filter((F.col("days_left") >= 0) | F.col("days_left").isNull())
    return df.orderBy(F.col("posted").desc_nulls_last(), "title")


def stale(df: DataFrame, most: int = 40) -> DataFrame:
    """The pages with the oldest dates that can be trusted."""
    known = df.filter(F.col("last_updated_trust").isin("high", "medium") & F.col("last_updated_age_days").isNotNull())
    return known.orderBy(F.desc("last_updated_age_days"), "organisation").limit(most)


def missing(df: DataFrame) -> DataFrame:
    return df.filter(~is_filled(F.col("careers_url"), "string"))


def whats_new(df: DataFrame, as_of: Column, hidden: tuple[str, ...] = (), days: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with new titles, and rows that only changed; hidden domains and older rows go."""
    df = df.filter(~F.col("domain").isin(*hidden)) if hidden else df
    new, changed = df.filter("has_new"), df.filter("page_changed AND NOT has_new")
    if days is not None:
        new = new.filter(within(F.try_to_timestamp("openings_new_at").cast("date"), as_of, days))
        changed = changed.filter(within(F.try_to_timestamp("changed_at").cast("date"), as_of, days))
    return new, changed.orderBy((F.col("openings_state") == "has_openings").desc(), F.col("changed_at").desc(), "organisation")
