"""Dates in text, read against an explicit day ``as_of``; results are ISO strings, empty where there is none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orgloom.functions.vocab import MONTHS

_NAMES = {name: i for i, names in enumerate(MONTHS, 1) for name in names}
MONTH = "|".join(sorted(_NAMES, key=lambda x: (-len(x), x)))
_ENGLISH = {n: i for i, names in enumerate(MONTHS, 1) for n in (names[0], names[0][:3])}
#: Fixed patterns: cue words of a deadline, dates near them, and hints of what a date in a listing is.
DEADLINE_CUE = (
    r"(deadline|apply by|applications? close|closing date|last day to apply|date limite|clôture|date de clôture|postuler avant|candidature.{0,15}avant"
    r"|sluitingsdatum|uiterlijk|solliciteer voor|bewerbungsfrist|bewerbungsschluss|frist|fecha límite|plazo|hasta el|antes del|scadenza|entro il)"
)
DATE_NEAR = r"(\d{4}-\d{2}-\d{2})|(\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4})|(\d{1,2}\s+[A-Za-zÀ-ÿ]{3,12}\s+\d{4})"
POSTED_HINT = r"(?iu)(posted|published|online since|date de publication|gepubliceerd|publication date)"
DEADLINE_HINT = r"(?iu)(deadline|closing|closes|apply by|expires|date limite|uiterste|limite de candidature|until)"


def iso(year: Column, month: Column, day: Column) -> Column:
    """The date as text, null where it isn't one."""
    d = F.try_to_timestamp(F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), F.lit("yyyy-MM-dd"))
    return F.date_format(d, "yyyy-MM-dd")


def _month(name: Column, names: dict[str, int]) -> Column:
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.try_element_at(table, F.lower(name)).cast("string")


def _groups(text: Column, pattern: str, n: int) -> list[Column]:
    return [F.nullif(F.regexp_extract(text, pattern, i + 1), F.lit("")) for i in range(n)]


def _dated(text: Column, pattern: str, order: str) -> Column:
    """The date that a pattern of three groups finds, where ``order`` names them; its match is found once, and only
    that is split."""
    whole = F.regexp_extract(text, pattern, 0)

    def split(match: Column) -> Column:
        part = dict(zip(order, _groups(match, pattern, 3), strict=True))
        return iso(part["y"], _month(part["M"], _NAMES) if "M" in part else part["m"], part["d"])

    return F.get(F.transform(F.array(whole), split), F.lit(0))


def parse_date(text: Column) -> Column:
    """The first readable date: ISO, then day month year, month day year, and day/month/year; an impossible date of
    one kind leaves the next kinds to try."""
    return F.coalesce(
        _dated(text, r"\b(\d{4})-(\d{2})-(\d{2})\b", "ymd"),
        _dated(text, rf"(?iu)\b(\d{{1,2}})\s+({MONTH})\.?\s+(\d{{4}})\b", "dMy"),
        _dated(text, rf"(?iu)\b({MONTH})\.?\s+(\d{{1,2}}),?\s+(\d{{4}})\b", "Mdy"),
        _dated(text, r"\b(\d{1,2})[/.](\d{1,2})[/.](\d{4})\b", "dmy"),
        F.lit(""),
    )


def relative_date(text: Column, as_of: Column, units: tuple[str, ...] = ("day", "week", "month", "hour", "minute"), words: bool = True) -> Column:
    """"3 days ago", today and yesterday as dates; ``words`` asks that today and yesterday stand as words."""
    pattern = rf"(?i)(\d+)\s*({'|'.join(units)})s?\s+ago" if words else rf"(?i)(\d+)\s+({'|'.join(units)})s?\s+ago"
    n, unit = _groups(text, pattern, 2)
    days = F.try_element_at(F.create_map(*[F.lit(x) for kv in {"minute": 0, "hour": 0, "day": 1, "week": 7, "month": 30}.items() for x in kv]), F.lower(unit))
    now, before = (r"(?i)\b(today|just posted|new)\b", r"(?i)\byesterday\b") if words else (r"(?i)today|just posted", r"(?i)yesterday")
    day = F.when(n.isNotNull(), F.date_sub(as_of, (n.try_cast("int") * days).cast("int"))).when(text.rlike(now), as_of).when(text.rlike(before), F.date_sub(as_of, 1))
    return F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit(""))


def next_deadline(text: Column, as_of: Column) -> Column:
    """"deadline 19 August [2026]"; without a year the next one, unless under 31 days past. 29 February that would
    roll into a common year is no date."""
    day, name, given = _groups(text, r"(?i)deadline\s+(\d{1,2})\s+(\w+)\s*(\d{4})?", 3)
    month = _month(name, _ENGLISH)
    this = iso(F.coalesce(given, F.year(as_of).cast("string")), month, day)
    late = given.isNull() & (this.try_cast("date") < F.date_sub(as_of, 30))
    return F.coalesce(F.when(late, iso((F.year(as_of) + 1).cast("string"), month, day)).otherwise(this), F.lit(""))


def closing_date(text: Column) -> Column:
    """"closing date: August 15, 2026"."""
    name, day, year = _groups(text, r"(?i)closing date:?\s*(\w+)\s+(\d{1,2}),?\s*(\d{4})", 3)
    return F.coalesce(iso(year, _month(name, _ENGLISH), day), F.lit(""))


def norm_deadline(raw: Column) -> Column:
    """A matched date as ISO text; one that begins like ISO passes as it is."""
    raw = F.trim(raw)
    plain = F.nullif(F.regexp_extract(raw, r"^\d{4}-\d{2}-\d{2}", 0), F.lit(""))
    d, m, y = _groups(raw, r"^(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{2,4})", 3)
    y = F.when(F.length(y) == 2, F.concat(F.lit("20"), y)).otherwise(y)
    d2, m2, y2 = _groups(raw, r"^(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})$", 3)
    return F.coalesce(plain, F.when(d.isNotNull(), F.coalesce(iso(y, m, d), F.lit(""))), iso(y2, _month(m2, _ENGLISH), d2), F.lit(""))


def deadline_near_cue(body: Column) -> Column:
    """The date within 80 characters of the first deadline cue that has one."""
    windows = F.regexp_extract_all(body, F.lit(rf"(?iu)(?=({DEADLINE_CUE}.{{0,80}}))"), F.lit(1))
    found = F.filter(F.transform(windows, lambda w: norm_deadline(F.regexp_extract(F.substring(w, 1, 80), DATE_NEAR, 0))), lambda d: d != "")
    return F.coalesce(F.try_element_at(found, F.lit(1)), F.lit(""))


def structured_deadline(html: Column) -> Column:
    """The earliest ``validThrough`` of a page."""
    raw = F.regexp_extract_all(html, F.lit(r'"validThrough"\s*:\s*"([^"]{6,40})"'), F.lit(1))
    found = F.filter(F.transform(raw, lambda r: norm_deadline(F.substring(r, 1, 10))), lambda d: d != "")
    return F.coalesce(F.array_min(found), F.lit(""))


def listing_dates(text: Column, as_of: Column) -> tuple[Column, Column]:
    """Dates of posting and deadline in a listing's text, sentence by sentence; deadline cues come first."""
    parts = F.split(F.coalesce(text, F.lit("")), r"(?<=[.;|])\s+|\n")
    ends = F.filter(parts, lambda s: s.rlike(DEADLINE_HINT))
    starts = F.filter(parts, lambda s: ~s.rlike(DEADLINE_HINT) & s.rlike(POSTED_HINT))
    deadline = F.try_element_at(F.filter(F.transform(ends, parse_date), lambda d: d != ""), F.lit(1))

    def either(s: Column) -> Column:
        return F.coalesce(F.nullif(parse_date(s), F.lit("")), relative_date(s, as_of))

    posted = F.try_element_at(F.filter(F.transform(starts, either), lambda d: d != ""), F.lit(1))
    return F.coalesce(posted, relative_date(text, as_of)), F.coalesce(deadline, F.lit(""))


def header_date(value: Column) -> Column:
    """The day of a header's date and time, as mail and web servers write them: RFC 2822, RFC 850 with dashes and years
    of two digits (those from 69 on are of the last century), and that of C's ``asctime``; names short or whole."""
    rest = F.trim(F.regexp_replace(value, r"^\s*[A-Za-z]+(,\s*|\s+(?=\d))", ""))
    day, name, year = _groups(rest, r"^(\d{1,2})[ -]+([A-Za-z]{3,9})[ -]+(\d{4}|\d{2})\s+\d", 3)
    name2, day2, year2 = _groups(rest, r"^(?:[A-Za-z]{3,9}\s+)?([A-Za-z]{3,9})\s+(\d{1,2})\s+[\d:]+\s+(?:[A-Z]{1,5}\s+)?(\d{4})\b", 3)
    century = F.when(F.length(year) == 2, F.when(year.cast("int") > 68, "19").otherwise("20")).otherwise("")
    return F.coalesce(iso(F.concat(century, year), _month(name, _ENGLISH), day), iso(year2, _month(name2, _ENGLISH), day2), F.lit(""))


def age_days(day: Column, as_of: Column) -> Column:
    """Whole days since a day given as ISO text; null if it isn't one."""
    return F.datediff(as_of, F.try_to_timestamp(day, F.lit("yyyy-MM-dd")).cast("date"))
