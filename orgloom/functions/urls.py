"""Scalar functions of URLs."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orgloom.functions import vocab
from orgloom.functions.rules import has_any


def domain(url: Column) -> Column:
    """The host in lower case without ``www.``; empty if there is none."""
    return F.regexp_replace(F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), "^https?://([^/]+)", 1), r"^www\.", "")


def label_stem(host: Column) -> Column:
    """Letters and digits of the second-last label, or of a host of one label."""
    parts = F.split(host, r"\.")
    return F.regexp_replace(F.coalesce(F.try_element_at(parts, F.lit(-2)), host), "[^a-z0-9]", "")


def path_after(url: Column, host: Column) -> Column:
    """What follows the host in an address."""
    return F.when(host == "", url).otherwise(F.substring(url, F.instr(url, host) + F.length(host), F.lit(100_000)))


def dedup_domain(homepage: Column, careers_url: Column) -> Column:
    """The domain that identifies an organisation; empty if it has none or shares it."""
    url = F.coalesce(F.nullif(homepage, F.lit("")), careers_url, F.lit(""))
    host = F.replace(F.lower(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit("www."), F.lit(""))
    return F.when(has_any(host, vocab.SHARED_HOSTS), "").otherwise(host)


def is_document(url: Column) -> Column:
    return F.lower(url).rlike(r"\.(pdf|docx?|xlsx?|pptx?|zip|rtf|odt)(\?|#|$)")


def is_member_link(href: Column, own_host: Column) -> Column:
    """A link to another, well-formed host that isn't plumbing."""
    host = F.lower(F.regexp_extract(href, "^https?://([^/?#]*)", 1))
    return href.startswith("http") & (host != "") & ~host.contains(own_host) & host.rlike(r"^[a-z0-9.-]+\.[a-z]{2,}$") & ~has_any(host, vocab.SKIP_HOSTS)


def redirect_target(url: Column) -> Column:
    """The address wrapped in a search engine's redirect, else the address."""
    inner = F.regexp_extract(url, "[?&]uddg=([^&#]*)", 1)
    return F.when(inner != "", F.url_decode(inner)).otherwise(url)


def search_link(query: Column) -> Column:
    return F.concat(F.lit("https://www.google.com/search?q="), F.url_encode(query))


@F.pandas_udf(T.StringType())
def join_url(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """A relative address made absolute; null where either is null or they can't be joined."""

    def one(base: str | None, href: str | None) -> str | None:
        try:
            return None if base is None or href is None else urljoin(base, href)
        except ValueError:
            return None

    for base, href in parts:
        yield pd.Series([one(b, h) for b, h in zip(base, href, strict=True)], dtype=object)


def link_verdict(status: Column, url: Column, final_url: Column, timed_out: Column) -> Column:
    """The verdict on a checked link."""
    moved = F.rtrim(F.coalesce(final_url, F.lit("")), F.lit("/")) != F.rtrim(url, F.lit("/"))
    return (
        F.when(F.coalesce(url, F.lit("")) == "", "")
        .when(F.coalesce(timed_out, F.lit(False)), "TIMEOUT")
        .when(status.isNull(), "DEAD")
        .when(status.isin(401, 403, 429) | (status >= 500), "BLOCKED")
        .when(status >= 400, "DEAD")
        .when(moved, "REDIRECTED")
        .otherwise("OK")
    )
