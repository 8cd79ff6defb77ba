"""Merging records of one organisation: by key with precedence, by domain and shared words, and keyed deduplication."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orgloom.functions import vocab
from orgloom.functions.rules import is_filled
from orgloom.functions.text import name_tokens
from orgloom.functions.urls import dedup_domain
from orgloom.operators.components import joined_by_words, written


def merge_first_filled(rows: DataFrame, key: str, order: Sequence[str], fields: Sequence[str], union: Sequence[str] = (), also: Sequence[Column] = ()) -> DataFrame:
    """One row per key: each field's first filled value by ``order``, sorted unions of the ``union`` arrays, and what
    ``also`` aggregates.

    A field that no row fills holds the first row's value. One aggregation, combined before the shuffle.
    """
    kinds = dict(rows.dtypes)
    at = F.struct(*order)
    aggs = [F.coalesce(F.min_by(F.when(is_filled(F.col(f), kinds[f]), F.col(f)), F.when(is_filled(F.col(f), kinds[f]), at)), F.min_by(f, at)).alias(f) for f in fields]
    aggs += [F.array_sort(F.array_distinct(F.flatten(F.collect_set(u)))).alias(u) for u in union]
    return rows.filter(F.coalesce(F.col(key) != "", F.lit(False))).groupBy(key).agg(*aggs, *also)


def is_registry(sources: Column) -> Column:
    return F.exists(sources, lambda s: F.lower(s).contains("registry"))


def is_curated(sources: Column) -> Column:
    return F.exists(sources, lambda s: F.lower(s).contains("target list") | F.lower(s).contains("registry"))


def merge_catalogue(rows: DataFrame, key: str, order: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """``merge_first_filled`` where later registry rows set the sector, and the type that a row of theirs fills.

    The first row of a key doesn't override itself; of several registry rows the last one counts.
    """
    at = F.struct(*order)
    given = F.when(is_registry(F.col("sources")) & is_filled(F.col("sector"), "string"), at)
    named = F.when(is_filled(F.col("type"), "string"), given)
    # The last of them is no later row only if it is the first of all, so that no row needs to know the first.
    over = [F.min(at).alias("first_at")]
    for name, when in (("sector", given), ("type", named)):
        over += [F.max(when).alias(f"{name}_at"), F.max_by(name, when).alias(f"{name}_over")]
    merged = merge_first_filled(rows, key, order, fields, ("sources",), over)
    for name in ("sector", "type"):
        merged = merged.withColumn(name, F.coalesce(F.when(F.col(f"{name}_at") > F.col("first_at"), F.col(f"{name}_over")), name)).drop(f"{name}_at", f"{name}_over")
    return merged.drop("first_at")


def _words(name: str) -> set[str]:
    low = (name or "").lower()
    return (set(re.findall(r"[a-z0-9]{3,}", low)) | set(re.findall(r"\(([a-z0-9]{2,8})\)", low))) - set(vocab.NAME_STOP)


def _curated(sources: Iterable[str]) -> bool:
    return any("target list" in s.lower() or "registry" in s.lower() for s in sources)


def _filled(v: object) -> bool:
    if v is None or (isinstance(v, float) and v != v):
        return False
    return len(v) > 0 if hasattr(v, "__len__") else bool(v)


#: Records of a domain that one task clusters; a larger domain is cut into groups that share no word.
HOT_DOMAIN = 10_000


def _dealt(keyed: DataFrame, most: int) -> DataFrame:
    """Records with the ``piece`` of their domain: one for the whole domain, or for each component of records that
    share words, over other records or not, where the domain has more than ``most``."""
    hot = keyed.groupBy("domain_key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("domain_key")
    if hot.isEmpty():
        return keyed.withColumn("piece", F.lit(0).cast("long"))
    rows = written(keyed.withColumn("row_key", F.monotonically_increasing_id()), "records")
    large = rows.join(hot, "domain_key", "left_semi").select("row_key", "domain_key", name_tokens(F.col("organisation")).alias("words"))
    piece = joined_by_words(large, "row_key", "domain_key", "words").select(F.col("node").alias("row_key"), F.col("component").alias("piece"))
    alone = large.filter(F.size("words") == 0).select("row_key", F.col("row_key").alias("piece"))
    return rows.join(piece.union(alone.join(piece, "row_key", "left_anti")), "row_key", "left").withColumn("piece", F.coalesce("piece", F.lit(0))).drop("row_key")


def cluster_by_domain(rows: DataFrame, pos: str = "pos", most: int = HOT_DOMAIN) -> DataFrame:
    """Records of one domain whose names share a word become one, in the order of ``pos``.

    Each record meets the clusters so far, not their members, and joins the first that shares a word; two curated
    records never join. The curated record survives and fills its gaps from the other; sources are united. Records
    without a domain of their own stay. Rows stream through sorted partitions, so a task holds one domain's clusters;
    of a domain with more than ``most`` records, those of one component of records that share words, which no record of
    another component can join.
    """
    columns = rows.columns
    keyed = rows.withColumn("domain_key", dedup_domain(F.col("homepage"), F.col("careers_url")))

    def task(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        domain, clusters = None, []
        for b in batches:
            out = []
            for rec in b.to_dict("records"):
                own = rec.pop("domain_key"), rec.pop("piece")
                if own != domain:
                    out += [c for c, _ in clusters]
                    domain, clusters = own, []
                rec["sources"] = [] if rec["sources"] is None else list(rec["sources"])
                words = _words(rec["organisation"])
                hit = next((i for i, (c, w) in enumerate(clusters) if words & w and not (_curated(rec["sources"]) and _curated(c["sources"]))), None)
                if hit is None:
                    clusters.append((rec, words))
                    continue
                old = clusters[hit][0]
                win, lose = (rec, old) if _curated(rec["sources"]) and not _curated(old["sources"]) else (old, rec)
                win["sources"] = sorted({*win["sources"], *lose["sources"]})
                for f, v in lose.items():
                    if f not in ("sources", pos) and not _filled(win[f]) and _filled(v):
                        win[f] = v
                clusters[hit] = (win, _words(win["organisation"]))
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame([c for c, _ in clusters], columns=columns)

    dealt = _dealt(keyed.filter("domain_key <> ''"), most).repartition("domain_key", "piece").sortWithinPartitions("domain_key", "piece", pos)
    return dealt.mapInPandas(task, rows.schema).unionByName(keyed.filter("domain_key = ''").drop("domain_key"))


def first_per_key(rows: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("nth_of_key", n).filter("nth_of_key = 1").drop("nth_of_key")


def longest_name(rows: DataFrame, key: str, name: str, pos: str) -> DataFrame:
    """The row with the longest name of each key; the earliest of the longest."""
    row = F.struct(*[c for c in rows.columns if c != key])
    return rows.groupBy(key).agg(F.max_by(row, F.struct(F.length(name), -F.col(pos))).alias("row")).select(key, "row.*")


def distinct_titles(titles: Column) -> Column:
    """Titles with the first spelling and place of each, whatever their case."""
    low = F.transform(titles, F.lower)
    return F.filter(titles, lambda t, i: F.array_position(low, F.lower(t)) == i + 1)


def pool_candidates(found: DataFrame, group: str, query: str, rank: str, url: str, per_query: int = 3, enough: int = 4) -> DataFrame:
    """Candidates of a group's queries in their order: the best few of each, every address once with its best rank.

    Queries after those that bring ``enough`` addresses don't count; a query for one site never is the last.
    """
    top = found.filter(F.col(rank) < per_query)
    first = top.groupBy(group, url).agg(F.min("query_pos").alias("met"))
    new = first.groupBy(group, F.col("met").alias("query_pos")).agg(F.count(F.lit(1)).alias("new"))
    asked = top.groupBy(group, "query_pos").agg(F.first(query).alias("asked")).join(new, [group, "query_pos"], "left")
    so_far = F.sum(F.coalesce("new", F.lit(0))).over(Window.partitionBy(group).orderBy("query_pos"))
    stop = F.min(F.when((F.col("so_far") >= enough) & ~F.col("asked").startswith("site:"), F.col("query_pos"))).over(Window.partitionBy(group))
    kept = asked.withColumn("so_far", so_far).withColumn("stop", stop).filter(F.col("stop").isNull() | (F.col("query_pos") <= F.col("stop")))
    return top.join(kept.select(group, "query_pos"), [group, "query_pos"]).groupBy(group, url).agg(F.min(rank).alias(rank))


def newest_within(entries: DataFrame, key: str, at: str, as_of: Column, seconds: int, then: Sequence[str] = ()) -> DataFrame:
    """The newest entry of each key that is younger than so many seconds; of entries of one time the last by ``then``,
    or else by all columns, so that the same entry is found however rows are dealt."""
    rest = [c for c in entries.columns if c != key]
    young = entries.filter(F.col(at) > as_of - F.make_dt_interval(secs=F.lit(seconds)))
    return young.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(at, *(then or [F.to_json(F.struct(*rest))]))).alias("row")).select(key, "row.*")


def until_repeated(items: DataFrame, board: str, page: str, url: str) -> DataFrame:
    """The items of a board's pages 1, 2, ... up to the first page that is missing, or whose addresses were all on pages
    before: a board that ignores a page number serves an old page again. Items without an address go."""
    first = items.filter(F.col(url).isNotNull()).groupBy(board, url).agg(F.min(page).alias("first_page"))
    met = items.join(first, [board, url], "left")
    pages = met.groupBy(board, page).agg(F.count(url).alias("urls"), F.count_if(F.col("first_page") == F.col(page)).alias("fresh"))
    in_order = Window.partitionBy(board).orderBy(page)
    ends = ((F.col("urls") > 0) & (F.col("fresh") == 0)) | (F.row_number().over(in_order) != F.col(page))
    good = pages.withColumn("ends", ends).withColumn("over", F.max("ends").over(in_order)).filter(~F.col("over"))
    return items.filter(F.col(url).isNotNull()).join(good.select(board, page), [board, page], "left_semi")
