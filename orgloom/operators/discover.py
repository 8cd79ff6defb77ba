"""Finding an organisation's careers page: scores of candidates and pages that explain themselves, and the choice.

Where live fetching and searching would stand, snapshot tables stand: ``fetches`` by address and ``results`` by query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orgloom.functions import vocab
from orgloom.functions.rules import Term, has_any, hit_count, reasons, total
from orgloom.functions.text import VERIFY_CHROME, clean_name, initials, name_variants, tokens, visible_text
from orgloom.functions.urls import domain, is_document, label_stem, path_after, search_link

THRESHOLD, HIGH = 10, 18
REJECTED = -100
# Hosts, paths and words that tell careers pages from others.
_CAREERS_HOST = "^(careers?|jobs?|vacan|emploi|recruit|werken)"
_OFFICIAL = r"(^|\.)(europa\.eu|coe\.int|un\.org|nato\.int|oecd\.org|who\.int)$|\.int$"
_MEMBER_PATH = (
    r"(?iu)member(ship)?s?\b|become[-_]?a?[-_]?member|join[-_]?(as|us[-_]as)|devenir[-_]?membre|adhesion|adh[eé]rer|lidmaatschap|lid[-_]?worden"
    r"|mitglied|mitgliedschaft|beitritt|hazte[-_]?socio|membres[ií]a|our[-_]?members|nos[-_]?membres|onze[-_]?leden"
)
_TITLE_WORDS = ("job", "vacanc", "career", "carrière", "emploi", "work with us", "vacature", "empleo", "recruit", "karriere", "stellen")
_EMPTY = ("no current vacanc", "no open position", "no vacancies at this time", "pas d'offre")
_LOCAL_BASES = ("brussels", "bruxelles", "brussel", "belgium", "belgique", "belgië", "leuven", "antwerp", "ghent", "liège", "liege", "namur", "mons", "bruges")


def _path_points(path: Column) -> Column:
    """Points of the first path pattern that fits; 0 if none does."""
    points = F.lit(0)
    for pattern, n in reversed(vocab.PATH_POINTS):
        points = F.when(path.rlike(pattern), n).otherwise(points)
    return points


def _owned(df: DataFrame) -> DataFrame:
    """``c_named``: whether a name's token is in the host's stem, or an acronym of the name is the stem or a label."""
    stem, host = F.col("c_stem"), F.col("c_host")
    df = df.withColumns({
        "c_own": F.exists(tokens(F.col("c_org")), lambda t: stem.contains(t)),
        "c_labels": F.transform(F.split(host, r"\."), lambda p: F.regexp_replace(p, "[^a-z0-9]", "")),
        "c_variants": name_variants(F.col("c_org")), "c_official": host.rlike(_OFFICIAL),
    })
    alone = F.transform(F.filter("c_variants", lambda v: F.lower(v).rlike("^[a-z0-9]+$")), F.lower)
    df = df.withColumn("c_acronyms", F.array_union(F.transform("c_variants", initials), alone))
    least = F.when(F.col("c_official"), 2).otherwise(3)
    acronym = F.exists("c_acronyms", lambda a: (F.length(a) >= least) & ((a == stem) | F.array_contains("c_labels", a)))
    return df.withColumn("c_named", F.col("c_own") | acronym)


def score_candidates(df: DataFrame, url: Column, title: Column, snippet: Column, rank: Column, organisation: Column, existing_url: Column, base: Column) -> DataFrame:
    """The rows with ``cand_score, cand_reasons`` of a search result as an organisation's careers page.

    Documents and portals get ``REJECTED``. Steps are columns of their own, so that each is computed once.
    """
    keep = df.columns
    df = df.withColumns({"c_low": F.lower(url), "c_org": organisation, "c_old": domain(existing_url), "c_base": F.lower(F.coalesce(base, F.lit(""))), "c_rank": F.coalesce(rank, F.lit(0)), "c_words": F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(snippet, F.lit(""))))})
    df = df.withColumn("c_host", domain(F.col("c_low")))
    df = df.withColumns({"c_stem": label_stem(F.col("c_host")), "c_path": path_after(F.col("c_low"), F.col("c_host")), "c_parts": F.split("c_host", r"\.")})
    df = _owned(df)
    low, host, path, old, parts = (F.col(f"c_{x}") for x in ("low", "host", "path", "old", "parts"))
    sub = F.when(F.size(parts) > 2, F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 2, F.lit(0))), ".")).otherwise("")
    last_two = lambda h: F.substring_index(h, ".", -2)
    df = df.withColumns({
        "c_sub": sub.rlike(_CAREERS_HOST), "c_points": _path_points(path), "c_ats": has_any(low, vocab.ATS_HOSTS),
        "c_same": (old != "") & (old == host), "c_related": (old != "") & (old != host) & (last_two(old) == last_two(host)),
        "c_abroad": (has_any(host, vocab.FOREIGN_HINTS) | has_any(F.substring(path, 1, 40), vocab.FOREIGN_HINTS)) & ~has_any(F.col("c_base"), vocab.FOREIGN_HINTS),
        "c_portal": ~F.col("c_own") & has_any(low, vocab.AGGREGATORS), "c_document": is_document(low),
    })
    careers_sub, points, on_ats, official, named = (F.col(f"c_{x}") for x in ("sub", "points", "ats", "official", "named"))
    same, related = F.col("c_same"), F.col("c_related")
    terms = [Term(careers_sub, 5, "careers-shaped subdomain (+5)")]
    terms += [Term(points == n, n, f"careers-shaped path (+{n})") for n in sorted({n for _, n in vocab.PATH_POINTS}, reverse=True)]
    terms += [
        Term((F.trim(path, F.lit("/")) == "") & ~careers_sub, -8, "bare homepage, no careers path (-8)"),
        Term(path.rlike(r"/(closed|expired|archive[sd]?|past|previous)\b"), -6, "archive of closed vacancies (-6)"),
        Term(on_ats, 6, "hosted on a known platform (+6)"),
        Term(named, 4, "domain matches the name (+4)"),
        Term(~named & official, 3, "official domain (+3)"),
        Term(same, 5, "matches the known domain (+5)"),
        Term(related, 3, "matches the known domain (+3)"),
        Term(~(named | same | related | on_ats | official), -10, "unrelated domain (-10)"),
        Term(F.col("c_abroad"), -8, "looks like an office abroad (-8)"),
        Term((named | same | related) & has_any(low, vocab.HOME_HINTS), 2, "local domain signal (+2)"),
        Term(has_any(F.col("c_words"), ("job", "vacanc", "career", "emploi", "recruit")), 2, "search snippet mentions jobs (+2)"),
        *[Term(F.col("c_rank") == r, 3 - r, f"search rank #{r + 1} (+{3 - r})") for r in range(3)],
    ]
    shaped = careers_sub | (points > 0) | on_ats
    df = df.withColumns({"c_free": total(terms), "c_why": reasons(terms), "c_shaped": shaped})
    free, document, portal = F.col("c_free"), F.col("c_document"), F.col("c_portal")
    why = F.array_compact(F.concat("c_why", F.array(F.when(~F.col("c_shaped"), F.lit("no careers path or platform: capped below the threshold")))))
    return df.select(
        *keep,
        F.when(document | portal, REJECTED).when(F.col("c_shaped"), free).otherwise(F.least(free, F.lit(THRESHOLD - 1))).alias("cand_score"),
        F.when(document, F.array(F.lit("a document, not a careers page"))).when(portal, F.array(F.lit("job portal, not the own page"))).otherwise(why).alias("cand_reasons"),
    )


def verify_pages(df: DataFrame, ok: Column, status: Column, url: Column, html: Column) -> DataFrame:
    """The rows with ``page_score, page_reasons`` of the evidence on a fetched page; blocked pages count nothing,
    missing ones -50."""
    keep = df.columns
    df = df.withColumns({
        "v_ok": F.coalesce(ok, F.lit(False)), "v_status": status, "v_text": F.lower(visible_text(html, VERIFY_CHROME)), "v_title": F.lower(F.trim(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1))),
        "v_host": F.regexp_extract(url, "^[a-zA-Z]+://([^/?#]*)", 1), "v_path": F.regexp_extract(url, "^[a-zA-Z]+://[^/?#]*([^?#]*)", 1),
    })
    text, title, path = F.col("v_text"), F.col("v_title"), F.col("v_path")
    df = df.withColumns({
        "v_hits": hit_count(text, vocab.BODY_HINTS), "v_titled": has_any(title, _TITLE_WORDS), "v_members": hit_count(text, vocab.MEMBER_HINTS), "v_member_path": path.rlike(_MEMBER_PATH),
        "v_shaped": F.col("v_host").rlike(_CAREERS_HOST) | (_path_points(F.lower(path)) > 0), "v_empty": has_any(text, _EMPTY),
    })
    hits, members, member_path = F.col("v_hits"), F.col("v_members"), F.col("v_member_path")
    open_to = (hits == 0) & ~F.col("v_titled") & ~F.col("v_shaped")
    strong = open_to & (members > 0) & (member_path | (members >= 3))
    terms = [
        *[Term(hits == n if n < 3 else hits >= 3, 2 * n, f"job signals in the text (+{2 * n})") for n in (1, 2, 3)],
        Term(F.col("v_titled"), 4, "page title says careers (+4)"),
        Term(F.col("v_empty"), 2, "lists no openings, still the right page (+2)"),
        Term(strong, -6, "membership page, no job signal (-6)"),
        Term(open_to & (members > 0) & ~strong, -4, "membership page, no job signal (-4)"),
        Term(open_to & (members == 0) & member_path, -4, "membership-shaped address, no job signal (-4)"),
    ]
    blocked = F.col("v_status").isin(0, 401, 403, 429) | F.col("v_status").isNull()
    return df.select(
        *keep,
        F.when(F.col("v_ok"), total(terms)).when(blocked, 0).otherwise(-50).alias("page_score"),
        F.when(F.col("v_ok"), reasons(terms)).when(blocked, F.array(F.lit("page blocks readers, not verified"))).otherwise(F.array(F.lit("fetch failed"))).alias("page_reasons"),
    )


def queries_for(organisation: Column, base: Column, languages: Column, existing_url: Column, variants: Column | None = None) -> Column:
    """The search queries of an organisation, in order; ``variants`` may give its name's variants as a column."""
    variants, short = name_variants(organisation) if variants is None else variants, clean_name(organisation)
    longest = F.aggregate(variants, F.lit(""), lambda a, v: F.when(F.length(v) > F.length(a), v).otherwise(a))
    at, lang = F.lower(F.coalesce(base, F.lit(""))), F.upper(F.coalesce(languages, F.lit("")))
    local = (at == "") | has_any(at, _LOCAL_BASES)
    plus = lambda c, s: F.concat(c, F.lit(s))
    old = domain(existing_url)
    first = F.when(old != "", F.concat(F.lit("site:"), old, F.lit(" jobs OR vacancies OR careers")))
    here = F.array(F.when(local, plus(short, " Brussels jobs vacancies careers")), F.when(local, plus(short, " careers page Brussels Belgium")))
    there = F.array(F.when(~local | at.contains("/"), plus(longest, " careers vacancies official site")), F.when(~local, plus(longest, " jobs vacancies employment")))
    more = F.transform(F.slice(variants, 2, 10), lambda v: plus(v, " Brussels jobs vacancies careers"))
    own = F.array(*[F.when(lang.contains(k), plus(longest, s)) for k, s in (("DE", " Stellenangebote Karriere"), ("ES", " empleo vacantes trabaja con nosotros"), ("IT", " lavora con noi posizioni aperte"))])
    return F.array_compact(F.concat(F.array(first), here, there, more, own))


def confidence(score: Column) -> Column:
    return F.when(score >= HIGH, "high").when(score >= THRESHOLD, "medium").otherwise("none")


def choose(scored: DataFrame, key: str) -> DataFrame:
    """The best candidate of each organisation by ``score``, the earliest by ``pos`` of equals, with its confidence;
    below the threshold there is no address."""
    best = scored.filter(F.col("score") > REJECTED).groupBy(key).agg(F.max_by(F.struct("url", "score", "reasons"), F.struct("score", -F.col("pos"))).alias("best"))
    conf = confidence(F.col("best.score"))
    return best.select(key, F.when(conf != "none", F.col("best.url")).alias("careers_url"), conf.alias("confidence"), F.col("best.score").alias("score"), F.col("best.reasons").alias("reasons"))


def probe(orgs: DataFrame, fetches: DataFrame, key: str = "id") -> DataFrame:
    """The best of the fixed paths on each organisation's own domain, up to the first that is surely right."""
    paths = F.posexplode(F.array(*[F.lit(p) for p in vocab.PROBE_PATHS])).alias("pos", "path")
    home = F.coalesce(F.nullif("homepage", F.lit("")), "existing_url")
    tried = orgs.withColumn("own_host", domain(home)).filter("own_host <> ''").select("*", paths)
    tried = tried.withColumn("probe_url", F.concat(F.lit("https://"), "own_host", "path"))
    got = tried.join(fetches.filter("ok").withColumnRenamed("url", "probe_url"), "probe_url")
    got = got.withColumn("url", F.coalesce(F.nullif("final_url", F.lit("")), "probe_url"))
    got = score_candidates(got, F.col("url"), F.lit(""), F.lit(""), F.lit(0), F.col("organisation"), F.col("existing_url"), F.col("base"))
    got = verify_pages(got, F.col("ok"), F.col("status"), F.col("url"), F.col("text"))
    scored = got.select(key, "pos", "url", (F.col("cand_score") + F.col("page_score")).alias("score"), F.concat("cand_reasons", "page_reasons").alias("reasons"))
    stop = F.min(F.when(F.col("score") >= HIGH, F.col("pos"))).over(Window.partitionBy(key))
    return choose(scored.withColumn("stop", stop).filter("stop IS NULL OR pos <= stop"), key).filter("confidence <> 'none'").withColumn("method", F.lit("homepage-probe"))


def discover(orgs: DataFrame, results: DataFrame, fetches: DataFrame, key: str = "id") -> DataFrame:
    """Careers pages of organisations: probed, else searched and verified, with confidence, reasons and a search link.

    ``results`` has ``query, rank, url, title, snippet``; ``fetches`` has ``url, ok, status, final_url, text``.
    """
    from orgloom.operators.resolve import pool_candidates

    probed = probe(orgs, fetches, key)
    rest = orgs.join(probed.select(key), key, "left_anti")
    named = rest.withColumn("variants", name_variants(F.col("organisation")))
    asked = named.select("*", F.posexplode(queries_for(F.col("organisation"), F.col("base"), F.col("languages"), F.col("existing_url"), F.col("variants"))).alias("query_pos", "query")).drop("variants")
    found = asked.join(results, "query")
    detail = found.groupBy(key, "url").agg(F.min_by(F.struct("title", "snippet"), F.struct("query_pos", "rank")).alias("d"), F.min(F.struct("query_pos", "rank")).alias("at"))
    pool = pool_candidates(found, key, "query", "rank", "url").join(detail, [key, "url"]).join(rest, key).join(fetches.withColumnRenamed("text", "html"), "url", "left")
    pool = score_candidates(pool, F.col("url"), F.col("d.title"), F.col("d.snippet"), F.col("rank"), F.col("organisation"), F.col("existing_url"), F.col("base"))
    pool = pool.withColumn("where", F.coalesce(F.nullif("final_url", F.lit("")), "url"))
    pool = verify_pages(pool, F.col("ok"), F.col("status"), F.col("where"), F.col("html"))
    total_score = F.when(F.col("cand_score") <= REJECTED, REJECTED).otherwise(F.col("cand_score") + F.col("page_score"))
    scored = pool.select(key, (F.col("at.query_pos") * 100 + F.col("at.rank")).alias("pos"), F.col("where").alias("url"), total_score.alias("score"), F.concat("cand_reasons", "page_reasons").alias("reasons"))
    best = choose(scored, key).withColumn("method", F.lit("search+verify"))
    both = probed.unionByName(best)
    link = search_link(F.concat("organisation", F.lit(" jobs careers")))
    return orgs.select(key, "organisation", link.alias("search_url")).join(both, key, "left").withColumns({
        "confidence": F.coalesce("confidence", F.lit("none")), "score": F.coalesce("score", F.lit(0)),
        "reasons": F.coalesce("reasons", F.array(F.lit("no viable candidate"))), "method": F.coalesce("method", F.lit("search+verify")),
    })


def todo(orgs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Organisations that an earlier, interrupted run hasn't resolved; those it missed are tried again."""
    return orgs.join(done.filter("confidence <> 'none'").select(key), key, "left_anti")
