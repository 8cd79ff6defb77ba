"""The versioned store as table rewrites: upserts by key, a history of addresses with one current row each, a check
log, settings. Every function takes the present tables and gives the next ones, so a job that is run again from the
same state gives the same result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgloom.functions.rules import is_filled

#: Fields of an organisation that a sync writes.
ORG_FIELDS = ("organisation", "sector", "category", "type", "base", "languages", "size", "description", "target_roles", "why_fits", "priority", "eu_nationality", "phd_relevant", "latam_relevant", "remote_friendly", "homepage", "search_url")
#: Fields of a current version that an empty value never overwrites.
KEPT_FIELDS = ("last_updated", "last_updated_source", "last_updated_trust", "content_hash", "content_hash_at", "page_text", "changed_at")
#: What every scan of a page says anew.
SNAPSHOT_FIELDS = ("openings_state", "openings_count", "openings_titles", "openings_deadline", "openings_checked_at", "last_updated_age_days")
#: What a version gets when it is made.
MADE_FIELDS = ("confidence", "score", "reasons", "method")
TEXT_DEFAULTS = {"openings_state": "unknown", "openings_deadline": "", "confidence": "none", "method": "search+verify"}
OTHER_DEFAULTS = {"openings_count": lambda: F.lit(0), "score": lambda: F.lit(0), "openings_titles": lambda: F.array().cast("array<string>"), "reasons": lambda: F.array().cast("array<string>")}
VERDICTS = ("good", "wrong", "dead", "outdated", "blocked", "unsure")


def latest_per_key(rows: DataFrame, key: str, order: Sequence[Column], name: str = "latest") -> DataFrame:
    """The last row of each key by ``order``, as one aggregation."""
    row = F.struct(*[c for c in rows.columns if c != key])
    return rows.groupBy(key).agg(F.max_by(row, F.struct(*order)).alias(name)).select(key, f"{name}.*")


def with_current(orgs: DataFrame, versions: DataFrame, org_ref: str, version_id: str) -> DataFrame:
    """Every organisation with the current version it points to, if any."""
    return orgs.join(versions.filter(~F.col("superseded")).drop("superseded"), F.col(org_ref) == F.col(version_id), "left")


def differs(pairs: Sequence[tuple[Column, Column]]) -> Column:
    """Whether any pair of values is not the same, nulls being the same as each other."""
    out = F.lit(False)
    for a, b in pairs:
        out |= ~a.eqNullSafe(b)
    return out


def upsert(existing: DataFrame, incoming: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """The next table with an ``action`` for each row: insert, update, or keep.

    Nulls of incoming rows never overwrite; rows that bring nothing new are kept as they are.
    """
    new = incoming.select(F.col(key).alias("new_key"), *[F.col(f).alias(f"new_{f}") for f in fields], F.lit(True).alias("incoming"))
    both = existing.withColumn("existing", F.lit(True)).join(new, F.col(key).eqNullSafe(F.col("new_key")), "full_outer")
    changed = differs([(F.coalesce(f"new_{f}", f), F.col(f)) for f in fields])
    action = F.when(F.col("existing").isNull(), "insert").when(F.col("incoming").isNotNull() & changed, "update").otherwise("keep")
    rest = [c for c in existing.columns if c != key and c not in fields]
    return both.select(F.coalesce(key, "new_key").alias(key), *[F.coalesce(f"new_{f}", f).alias(f) for f in fields], *rest, action.alias("action"))


def _scanned(field: str) -> Column:
    """A catalogue's value of a field as a version holds it: what is missing gets the field's default."""
    value = F.col(f"new_{field}")
    return F.coalesce(F.when(value != "", value), F.lit(TEXT_DEFAULTS[field])) if field in TEXT_DEFAULTS else F.coalesce(value, OTHER_DEFAULTS[field]()) if field in OTHER_DEFAULTS else value


def sync_versions(versions: DataFrame, catalogue: DataFrame, run_id: str, at: Column) -> DataFrame:
    """The next history of addresses, with an ``action``: keep, patch, supersede or insert.

    ``versions`` has ``org, url, superseded, run_id, discovered_at``, ``KEPT_FIELDS`` and, where it holds them,
    ``SNAPSHOT_FIELDS``, ``MADE_FIELDS`` and ``version_id``; ``catalogue`` has ``org, url`` and the same fields. The
    current row of an unchanged address that was scanned is patched: what the scan saw of openings and age is taken as
    it is, ``KEPT_FIELDS`` only where filled. A changed address supersedes the current row, whose page text is cleared,
    and adds a new current row. Rows without an address change nothing.
    """
    kinds = dict(versions.dtypes)
    seen = [f for f in SNAPSHOT_FIELDS if f in kinds]
    fields = [*KEPT_FIELDS, *seen, *[f for f in MADE_FIELDS if f in kinds]]
    new = catalogue.filter(is_filled(F.col("url"), "string")).select("org", F.col("url").alias("new_url"), *[F.col(f).alias(f"new_{f}") for f in fields])
    current = versions.join(new, "org", "left")
    live = ~F.col("superseded") & F.col("new_url").isNotNull()
    scanned = is_filled(F.col("new_content_hash"), "string")
    if "openings_checked_at" in kinds:
        scanned |= is_filled(F.col("new_openings_checked_at"), kinds["openings_checked_at"])
    elif not seen:
        scanned = F.lit(True)
    same, moved = live & (F.col("url") == F.col("new_url")) & scanned, live & (F.col("url") != F.col("new_url"))
    patched = {f: F.when(same & is_filled(F.col(f"new_{f}"), kinds[f]), F.col(f"new_{f}")).otherwise(F.col(f)) for f in KEPT_FIELDS}
    patched |= {f: F.when(same, _scanned(f)).otherwise(F.col(f)).cast(kinds[f]) for f in seen}
    patched["page_text"] = F.when(moved, F.lit("")).otherwise(patched["page_text"])
    kept = current.withColumn("action", F.when(moved, "supersede").when(same, "patch").otherwise("keep"))
    kept = kept.withColumns(patched).withColumn("superseded", F.col("superseded") | F.coalesce(moved, F.lit(False))).select(*versions.columns, "action")
    live_now = versions.filter(~F.col("superseded")).select("org", F.col("url").alias("old_url"))
    added = new.join(live_now, "org", "left").filter(~F.col("new_url").eqNullSafe(F.col("old_url")))
    made = {"org": F.col("org"), "url": F.col("new_url"), "superseded": F.lit(False), "run_id": F.lit(run_id), "discovered_at": at, "version_id": version_id(F.col("org"), F.col("new_url"), F.lit(run_id))} | {f: _scanned(f) for f in fields}
    return kept.unionByName(added.select(*[(made[c] if c in made else F.lit(None)).cast(kinds[c]).alias(c) for c in versions.columns], F.lit("insert").alias("action")))


def version_id(org: Column, url: Column, run_id: Column) -> Column:
    """The id of the version that a run adds, the same if the run is repeated."""
    return F.substring(F.sha2(F.concat_ws("\n", org.cast("string"), url, run_id), 256), 1, 15)


def sync(orgs: DataFrame, versions: DataFrame, catalogue: DataFrame, run_id: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """A whole run: the next organisations, and the next versions with their ``action``.

    Organisations of the catalogue are created or updated in those ``ORG_FIELDS`` that both tables have, and
    ``current_url`` is pointed to the version that the run added, if any.
    """
    fields = [f for f in ORG_FIELDS if f in orgs.columns and f in catalogue.columns]
    synced = sync_versions(versions, catalogue, run_id, at)
    added = synced.filter("action = 'insert'").select("org", F.col("version_id").alias("added_url"))
    rest = [c for c in orgs.columns if c != "current_url"]
    pointed = upsert(orgs, catalogue, "org", fields).join(added, "org", "left")
    return pointed.select(*rest, F.coalesce("added_url", "current_url").alias("current_url"), "action"), synced


#: What a scan says of openings.
SCAN = "org, url, confidence, score, reasons, date, source, trust, age_days, hash, state, count, titles"


def refresh(orgs: DataFrame, versions: DataFrame, scans: DataFrame, run_id: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """Scans of single organisations, the columns of ``SCAN``: the next organisations, and the next versions with their
    ``action`` (keep, patch, supersede, insert).

    A moved address supersedes the current version and adds one made by "refresh", to which ``current_url`` points; an
    unchanged one takes the page's date where that is known and another, and the fingerprint where there is one. What
    was seen of openings goes to the current version, old or new. Titles that it did not have are its new ones, from a
    page with openings; where there are none, the new titles of earlier scans stay. A review ends if the address moved
    or the page's date is later than the reviewed one. Scans without an address change nothing.
    """
    kinds = dict(versions.dtypes)
    seen = scans.filter(is_filled(F.col("url"), "string")).select("org", *[F.col(c.strip()).alias(f"scan_{c.strip()}") for c in SCAN.split(",")[1:]], F.lit(True).alias("scanned"))
    both = versions.join(seen, "org", "left")
    # made before openings_titles is replaced: inside a lambda its name would mean the new value
    both = both.withColumn("found", F.when(F.col("scan_state") == "has_openings", new_titles(F.col("scan_titles"), F.col("openings_titles"))))
    live = ~F.col("superseded") & F.coalesce(F.col("scanned"), F.lit(False))
    moved, same = live & (F.col("url") != F.col("scan_url")), live & (F.col("url") == F.col("scan_url"))
    dated = same & is_filled(F.col("scan_date"), "string") & ~F.col("scan_date").eqNullSafe(F.col("last_updated"))
    hashed = same & is_filled(F.col("scan_hash"), "string")
    brought = F.coalesce(F.size("found"), F.lit(0)) > 0
    openings = {"openings_state": F.col("scan_state"), "openings_count": F.col("scan_count"), "openings_titles": F.col("scan_titles"), "openings_checked_at": at}
    dates = {"last_updated": F.col("scan_date"), "last_updated_source": F.col("scan_source"), "last_updated_trust": F.col("scan_trust"), "last_updated_age_days": F.col("scan_age_days")}
    prints = {"content_hash": F.col("scan_hash"), "content_hash_at": at}
    fresh = {"openings_new_titles": F.col("found"), "openings_new_at": at}
    put = {k: (v, same) for k, v in openings.items()} | {k: (v, dated) for k, v in dates.items()} | {k: (v, hashed) for k, v in prints.items()} | {k: (v, same & brought) for k, v in fresh.items()}
    kept = both.withColumn("action", F.when(moved, "supersede").when(same, "patch").otherwise("keep"))
    kept = kept.withColumns({k: F.when(when, v.cast(kinds[k])).otherwise(F.col(k)) for k, (v, when) in put.items()} | {"superseded": F.col("superseded") | moved}).select(*versions.columns, "action")

    live_now = versions.filter(~F.col("superseded")).select("org", F.col("url").alias("old_url"))
    added = seen.join(live_now, "org", "left").filter(~F.col("scan_url").eqNullSafe(F.col("old_url")))
    first = F.when((F.col("scan_state") == "has_openings") & (F.size("scan_titles") > 0), F.col("scan_titles"))
    made = openings | dates | {
        "org": F.col("org"), "url": F.col("scan_url"), "superseded": F.lit(False), "run_id": F.lit(run_id), "discovered_at": at, "version_id": version_id(F.col("org"), F.col("scan_url"), F.lit(run_id)),
        "confidence": F.coalesce("scan_confidence", F.lit("none")), "score": F.coalesce("scan_score", F.lit(0)), "reasons": F.coalesce("scan_reasons", F.array().cast("array<string>")), "method": F.lit("refresh"),
        "content_hash": F.col("scan_hash"), "content_hash_at": F.when(is_filled(F.col("scan_hash"), "string"), at), "openings_new_titles": first, "openings_new_at": F.when(first.isNotNull(), at),
    }
    inserted = added.select(*[made.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in versions.columns], F.lit("insert").alias("action"))

    now = seen.join(live_now, "org", "left").select("org", ~F.col("scan_url").eqNullSafe(F.col("old_url")), F.coalesce("scan_date", F.lit("")), made["version_id"]).toDF("org", "scan_moved", "scan_date", "scan_version")
    joined = orgs.join(now, "org", "left")
    ends = should_untick(F.col("reviewed"), F.coalesce("scan_moved", F.lit(False)), F.col("scan_date"), F.col("reviewed_page_date"))
    blank = {"reviewed": F.lit(False), "reviewed_url": F.lit(""), "reviewed_page_date": F.lit(""), "reviewed_at": F.lit(None)}
    after = {k: F.when(F.coalesce(ends, F.lit(False)), v).otherwise(F.col(k)) for k, v in blank.items() if k in orgs.columns}
    after["current_url"] = F.when(F.col("scan_moved"), F.col("scan_version")).otherwise(F.col("current_url"))
    return joined.withColumns(after).select(*orgs.columns), kept.unionByName(inserted)


def batch_write(table: DataFrame, ops: DataFrame, key: str, fields: Sequence[str], chunk: int = 100) -> tuple[DataFrame, DataFrame]:
    """Ordered writes ``op_no`` (0, 1, ...), ``kind`` (create, update, delete), ``key`` and ``fields``, in chunks.

    A chunk applies as a whole or not at all, and the first that fails ends the run: creating a key that is there, or
    changing one that isn't, fails. An update leaves fields that it has null as they are. Gives the next table, and the
    operations with their ``chunk`` and ``status`` (applied, failed, or skipped in and after the failing chunk).
    """
    from pyspark.sql import Window

    earlier = Window.partitionBy(key).orderBy("op_no").rowsBetween(Window.unboundedPreceding, -1)
    there = ops.join(table.select(key, F.lit(True).alias("held")), key, "left")
    before = F.coalesce(F.last(F.when(F.col("kind") != "update", F.col("kind") == "create"), ignorenulls=True).over(earlier), F.col("held"), F.lit(False))
    tried = there.withColumn("chunk", F.floor(F.col("op_no") / chunk)).withColumn("failed", F.when(F.col("kind") == "create", before).otherwise(~before)).drop("held")
    last = tried.filter("failed").agg(F.min("chunk").alias("bad"))
    tried = tried.crossJoin(F.broadcast(last))  # one row
    done = F.col("bad").isNull() | (F.col("chunk") < F.col("bad"))
    status = tried.withColumn("status", F.when(done, "applied").when(F.col("failed") & (F.col("chunk") == F.col("bad")), "failed").otherwise("skipped"))
    applied = status.filter("status = 'applied'")
    reset = applied.groupBy(key).agg(F.max(F.when(F.col("kind") != "update", F.col("op_no"))).alias("reset"), F.max_by("kind", "op_no").alias("last_kind"))
    since = applied.join(reset, key).filter("reset IS NULL OR op_no >= reset")
    values = since.groupBy(key).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("op_no"))).alias(f"new_{f}") for f in fields])
    state = reset.join(values, key).withColumn("touched", F.lit(True))
    both = table.join(state, key, "full_outer").filter("touched IS NULL OR last_kind <> 'delete'")
    value = {f: F.when(F.col("reset").isNotNull(), F.col(f"new_{f}")).otherwise(F.coalesce(f"new_{f}", f)) for f in fields}
    rest = [c for c in table.columns if c != key and c not in fields]
    return both.select(key, *[v.alias(f) for f, v in value.items()], *rest), status.drop("bad", "failed")


def split_by_key(incoming: DataFrame, existing: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Incoming rows whose key exists, and those whose key doesn't."""
    known = existing.select(key)
    return incoming.join(known, key, "left_semi"), incoming.join(known, key, "left_anti")


def history(versions: DataFrame, org: Column) -> DataFrame:
    """An organisation's addresses, newest first."""
    return versions.filter(F.col("org") == org).orderBy(F.col("discovered_at").desc_nulls_last(), "url")


def set_reviewed(orgs: DataFrame, org_id: str, patches: DataFrame, at: Column) -> DataFrame:
    """Ticks of ``patches(org_id, flag, url, page_date)``: a tick stores what was reviewed, its removal clears it."""
    joined = orgs.join(patches.select(org_id, F.col("flag").alias("p_flag"), F.col("url").alias("p_url"), F.col("page_date").alias("p_date")), org_id, "left")
    touched, on = F.col("p_flag").isNotNull(), F.col("p_flag")
    return joined.withColumns({
        "reviewed": F.coalesce("p_flag", "reviewed"),
        "reviewed_url": F.when(touched, F.when(on, F.coalesce("p_url", F.lit(""))).otherwise("")).otherwise(F.col("reviewed_url")),
        "reviewed_page_date": F.when(touched, F.when(on, F.coalesce("p_date", F.lit(""))).otherwise("")).otherwise(F.col("reviewed_page_date")),
        "reviewed_at": F.when(touched, F.when(on, at)).otherwise(F.col("reviewed_at")),
    }).drop("p_flag", "p_url", "p_date")


def clear_new(versions: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Versions with the new titles of the seen ones cleared."""
    marked = versions.join(seen.select(key).distinct().withColumn("was_seen", F.lit(True)), key, "left")
    return marked.withColumns({
        "openings_new_titles": F.when(F.col("was_seen"), F.array().cast("array<string>")).otherwise(F.col("openings_new_titles")),
        "openings_new_at": F.when(F.col("was_seen"), F.lit(None)).otherwise(F.col("openings_new_at")),
    }).drop("was_seen")


def check_events(checks: DataFrame, at: Column) -> DataFrame:
    """Rows for the append-only check log: verdicts outside the list become "unsure", all are stamped."""
    return checks.withColumn("verdict", F.when(F.col("verdict").isin(*VERDICTS), F.col("verdict")).otherwise("unsure")).withColumn("checked_at", at)


def merged_settings(defaults: dict[str, bool], saved: Column) -> Column:
    """Default switches with the saved ones over them."""
    base = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv])
    return F.map_zip_with(base, F.coalesce(saved, F.create_map().cast("map<string,boolean>")), lambda k, a, b: F.coalesce(b, a))


def should_untick(reviewed: Column, url_changed: Column, page_date: Column, reviewed_page_date: Column) -> Column:
    """A review ends when the address moved, or the page's date is known to be later than the reviewed one."""
    newer = is_filled(page_date, "string") & is_filled(reviewed_page_date, "string") & (page_date > reviewed_page_date)
    return F.coalesce(reviewed, F.lit(False)) & (url_changed | newer)


def new_titles(now: Column, before: Column) -> Column:
    """Titles that weren't there before, whatever their case and outer blanks."""
    low = F.transform(F.coalesce(before, F.array().cast("array<string>")), lambda t: F.trim(F.lower(t)))
    return F.filter(now, lambda t: ~F.array_contains(low, F.trim(F.lower(t))))


def sticky(state: Column, found: Column, old: Column) -> Column:
    """New titles that stay until others come: only a readable page with openings can replace them."""
    return F.when((state == "has_openings") & (F.size(found) > 0), found).otherwise(old)
