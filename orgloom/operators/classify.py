"""Sectors, themes and the shape of source rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgloom.functions import vocab
from orgloom.functions.rules import first_match, has_any
from orgloom.functions.text import display_name
from orgloom.operators.records import conform

def blob(*parts: Column) -> Column:
    """Texts joined by blanks in lower case; nulls are empty."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts]))


def sector(organisation: Column, kind: Column, category: Column, rules=vocab.SECTOR_RULES, categories=vocab.CATEGORY_SECTORS) -> Column:
    """The first sector whose words the row holds, else its category's, else "Other"."""
    whole = F.lit("Other")
    for name, value in reversed(categories):
        whole = F.when(category == name, value).otherwise(whole)
    return first_match(blob(organisation, kind, category), rules, whole)


def register_sector(category: Column) -> Column:
    return first_match(F.lower(category), [(s, (k,)) for k, s in vocab.REGISTER_SECTORS], F.lit("NGO & civil society"))


def themes(rec: DataFrame, hints=vocab.REGION_HINTS, research=("anthropolog", "phd", "doctoral", "research"), research_sector: str = "University & research") -> DataFrame:
    """Records with the region flag, and the research flag of one sector only."""
    text = blob(*[F.col(c) for c in ("organisation", "category", "type", "description", "why_fits", "languages", "base")])
    return rec.withColumns({
        "latam_relevant": F.col("latam_relevant") | has_any(text, hints),
        "phd_relevant": F.col("phd_relevant") | ((F.col("sector") == research_sector) & has_any(text, research)),
    })


def from_sheet(sheet: DataFrame) -> DataFrame:
    """Hand-picked targets as records."""
    return conform(
        sheet, sector=sector(F.col("organisation"), F.col("type"), F.col("category")), languages=F.col("language_edge"),
        careers_url=F.col("existing_url"), careers_confidence=F.col("existing_confidence"), sources=F.array(F.lit("target list")),
    )


def from_registry(rows: DataFrame, name: str, sector_name: str, kind: str, template: str) -> DataFrame:
    """A registry list ``name, base, languages, size, note, flag`` as records; ``template`` describes a row's note."""
    note = F.col("note")
    return conform(
        rows, organisation=F.col("name"), sector=F.lit(sector_name), category=F.lit(name), type=F.lit(kind),
        description=F.when(F.coalesce(note, F.lit("")) != "", F.format_string(template, note)).otherwise(""), remote_friendly=F.col("flag"), sources=F.array(F.lit(f"registry: {name}")),
    )


def from_directory(rows: DataFrame) -> DataFrame:
    """Harvested members as records."""
    return conform(rows, sector=sector(F.col("organisation"), F.col("type"), F.col("category")), sources=F.array("source_directory"))


def from_register(rows: DataFrame, source: str = "public register") -> DataFrame:
    """Register rows as records: display name, sector by category, a short description, the size rounded half-even."""
    size = F.bround(F.col("membersFTE").try_cast("double")).try_cast("int")
    return conform(
        rows, organisation=display_name(F.col("originalName"), F.col("acronym")), sector=register_sector(F.col("registrationCategory")), category=F.col("registrationCategory"),
        type=F.col("registrationCategory"), base=F.coalesce(F.nullif(F.initcap(F.lower("city")), F.lit("")), F.lit("Belgium")), homepage=F.col("webSiteURL"),
        size=F.nullif(size, F.lit(0)), description=F.substring("goals", 1, 400), sources=F.array(F.lit(source)),
    )


def is_larger(fte: Column, badges: Column) -> Column:
    """At least one full-time member, or a badge; what can't be read is neither."""
    return F.coalesce(fte.try_cast("double") >= 1, F.lit(False)) | F.coalesce(badges.try_cast("int") > 0, F.lit(False))


def union_body(name: Column) -> dict[str, Column]:
    """Whether an institution is a body of the union, and the literals that depend on it."""
    body = has_any(F.lower(name), vocab.UNION_BODIES)
    pick = lambda a, b: F.when(body, a).otherwise(b)
    return {"is_body": body, "sector": pick("EU institution", "European & intl institution"), "category": pick("EU institutions", "International org"), "type": pick("EU body / agency", "Intergovernmental organisation")}
