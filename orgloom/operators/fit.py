"""How well titles fit a profile: topics, level and languages as points with reasons."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgloom.functions import vocab
from orgloom.functions.rules import Term, band, clamp, has_any, reasons, total

DIMENSIONS = ("policy", "region", "research", "adjacent", "seniority")


@dataclass(frozen=True)
class Profile:
    """Vocabularies and points; any of them can be replaced."""

    base: int = 30
    topics: tuple[tuple[str, tuple[str, ...], int, str], ...] = (
        ("policy", vocab.TOPIC_POLICY, 28, "policy role"),
        ("region", vocab.TOPIC_REGION, 25, "region named"),
        ("research", vocab.TOPIC_RESEARCH, 22, "research track"),
        ("adjacent", vocab.TOPIC_ADJACENT, 12, "adjacent area"),
    )
    senior: tuple[tuple[str, ...], int, str] = (vocab.LEVEL_SENIOR, -30, "too senior")
    mid: tuple[tuple[str, ...], int, str] = (vocab.LEVEL_MID, 12, "right level")
    junior: tuple[tuple[str, ...], int, str] = (vocab.LEVEL_JUNIOR, -6, "entry level")
    languages: tuple[tuple[str, ...], int, str] = (vocab.NAMED_LANGUAGES, 6, "language named")
    bands: tuple[tuple[int, str], ...] = ((65, "strong"), (45, "possible"))
    toggles: Mapping[str, bool] = field(default_factory=dict)

    def on(self, dimension: str) -> bool:
        return self.toggles.get(dimension, True)


def _terms(t: Column, p: Profile) -> list[Term]:
    out = [Term(has_any(t, words), points, why) for name, words, points, why in p.topics if p.on(name)]
    free = F.lit(True)  # no level found so far
    for words, points, why in ([p.senior] if p.on("seniority") else []) + [p.mid, p.junior]:
        out.append(Term(free & has_any(t, words), points, why))
        free &= ~has_any(t, words)
    out.append(Term(has_any(t, p.languages[0]), *p.languages[1:]))
    return out


def score_title(title: Column, profile: Profile | None = None) -> Column:
    """``score, reasons, band`` of a title; under three characters the band is unknown."""
    p = profile or Profile()
    t = F.lower(F.coalesce(title, F.lit("")))
    short = F.length(t) < 3
    terms = _terms(t, p)
    score = F.when(short, 0).otherwise(clamp(total(terms, p.base), 0, 100))
    why = F.when(short, F.array().cast("array<string>")).otherwise(reasons(terms))
    return F.struct(score.alias("score"), why.alias("reasons"), F.when(short, "unknown").otherwise(band(score, p.bands, "weak")).alias("band"))


def score_openings(titles: Column, profile: Profile | None = None) -> Column:
    """The rollup of several titles: the best, first of equals, and how many are strong or possible."""
    scored = F.transform(titles, lambda t: F.struct(t.alias("title"), score_title(t, profile).alias("fit")))
    best = F.aggregate(scored, F.lit(None).cast("struct<title:string,fit:struct<score:int,reasons:array<string>,band:string>>"), lambda a, x: F.when(a.isNull() | (x["fit"]["score"] > a["fit"]["score"]), x).otherwise(a))
    none = F.coalesce(F.size(titles), F.lit(0)) == 0
    count = lambda name: F.when(none, 0).otherwise(F.size(F.filter(scored, lambda x: x["fit"]["band"] == name)))
    return F.struct(
        F.when(none, 0).otherwise(best["fit"]["score"]).alias("best_score"), F.when(none, "none").otherwise(best["fit"]["band"]).alias("best_band"),
        F.when(none, "").otherwise(best["title"]).alias("best_title"), count("strong").alias("strong"), count("possible").alias("possible"),
    )


def rollup_openings(rows: DataFrame, key: str, title: str, order: str, profile: Profile | None = None) -> DataFrame:
    """``score_openings`` for titles that are rows: one row a key with the best title, first of equals by ``order``, and
    how many are strong or possible. Titles are scored where they are and combined before the shuffle, so a key may
    have any number of them."""
    fit = rows.select(key, order, F.col(title).alias("title"), score_title(F.col(title), profile).alias("fit"))
    best = F.max_by(F.struct("fit.score", "fit.band", "title"), F.struct("fit.score", -F.col(order)))
    count = lambda name: F.count_if(F.col("fit.band") == name).cast("int").alias(name)
    found = fit.groupBy(key).agg(best.alias("best"), count("strong"), count("possible"))
    return found.select(key, F.col("best.score").alias("best_score"), F.col("best.band").alias("best_band"), F.col("best.title").alias("best_title"), "strong", "possible")
