"""Scalar text functions as columns."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orgloom.functions import vocab
from orgloom.functions.rules import has_any

#: Tags whose content is not part of a page's text, by purpose.
CHROME = ("script", "style", "nav", "footer", "header", "noscript")
BODY_CHROME = ("script", "style", "nav", "footer", "header")
VERIFY_CHROME = ("script", "style", "nav", "footer")
PAGE_TEXT_CHARS = 20_000
#: Words that a merge key leaves out.
KEY_STOP = ("asbl", "vzw", "npo", "ngo", "the", "of", "and", "de", "het", "la", "le", "les")
#: Fixed pattern: what changes on every load of a page: keyed tokens, blobs, clock times. Applied to lower-case text.
VOLATILE = (
    r"(csrf|csrftoken|nonce|session(id)?|sid|token|auth|__viewstate|__requestverificationtoken|_token|jsessionid|phpsessid|viewstate)"
    r"\s*[=:]\s*[\"']?[\w\-./+%]+|\b[0-9a-f]{16,}\b|\b[A-Za-z0-9\-_]{24,}\b|\d{1,2}:\d{2}(:\d{2})?|\d{4}-\d{2}-\d{2}t\d{2}:\d{2}"
)
#: Java's forms of what RE2 and DuckDB mean: blanks without the vertical tab, words of ASCII, all blanks of Unicode trimmed.
_BLANK = r"[\t\n\f\r ]"
_WORD, _NO_WORD = r"[0-9A-Za-z_]", r"(?![0-9A-Za-z_])"
_VOLATILE = VOLATILE.replace(r"\b", f"(?:(?<={_WORD}){_NO_WORD}|(?<!{_WORD})(?={_WORD}))").replace(r"\s", _BLANK)
_SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def clean(c: Column) -> Column:
    """White space of any kind collapsed to single blanks, ends trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def _trimmed(c: Column) -> Column:
    return F.trim(c, F.lit(_SPACES))


@F.pandas_udf(T.StringType())
def to_ascii(texts: pd.Series) -> pd.Series:
    """Letters without their marks, compatibility forms (full width, ligatures, signs) as what they stand for; other
    characters beyond ASCII go."""
    return texts.map(lambda x: x if not isinstance(x, str) or x.isascii() else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


def merge_key(name: Column) -> Column:
    """The key under which names of one organisation meet."""
    s = F.lower(to_ascii(F.coalesce(name, F.lit(""))))
    s = F.regexp_replace(s, r"\([^)]*\)|(\([^)]*)\z", "$1 ")  # what isn't closed is taken at once
    s = F.regexp_replace(s, rf"\b({'|'.join(KEY_STOP)})\b", " ")
    return F.regexp_replace(s, "[^a-z0-9]", "")


def tokens(name: Column, stop: tuple[str, ...] = vocab.TOKEN_STOP) -> Column:
    """Distinct words of over two letters or digits that identify, in order."""
    words = F.regexp_extract_all(F.lower(name), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*stop)))


def name_tokens(name: Column, stop: tuple[str, ...] = vocab.NAME_STOP) -> Column:
    """Words of three or more, and acronyms in parentheses, that identify."""
    low = F.lower(name)
    words = F.regexp_extract_all(low, F.lit("[a-z0-9]{3,}"), F.lit(0))
    acronyms = F.regexp_extract_all(low, F.lit(r"\(([a-z0-9]{2,8})\)"), F.lit(1))
    return F.filter(F.array_union(words, acronyms), lambda w: ~w.isin(*stop))


def clean_name(name: Column) -> Column:
    """A name without parentheses."""
    return F.trim(F.regexp_replace(name, r"\s*\([^)]*\)", ""))


def name_variants(name: Column) -> Column:
    """Forms of a name worth searching for: bare, expansion, both, and the first of a bilingual pair."""
    bare = clean_name(name)
    expansion = F.trim(F.split(F.regexp_extract(name, r"\(([^)]*)\)", 1), ",")[0])
    long = F.length(expansion) > 4
    half = F.trim(F.substring_index(bare, " / ", 1))
    return F.filter(
        F.array_distinct(F.array_compact(F.array(bare, F.when(long, expansion), F.when(long, F.concat_ws(" ", bare, expansion)), F.when(bare.contains(" / "), half)))),
        lambda v: v != "",
    )


def initials(variant: Column) -> Column:
    """The first letters of a name's words."""
    letters = F.transform(F.filter(F.split(variant, r"\s+"), lambda w: w.rlike(r"^\p{L}")), lambda w: F.substring(w, 1, 1))
    return F.lower(F.array_join(letters, ""))


def display_name(name: Column, acronym: Column) -> Column:
    """A name with its acronym in parentheses, unless it holds it."""
    given = F.coalesce(acronym != "", F.lit(False)) & ~F.lower(name).contains(F.lower(acronym))
    return F.when(given, F.concat(name, F.lit(" ("), acronym, F.lit(")"))).otherwise(name)


def title_case(c: Column) -> Column:
    """Every letter after a non-letter in upper case, others in lower."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 10_000))), "")


def tidy_name(name: Column, host: Column, longest: int = 70) -> Column:
    """A readable name from link text: logo labels and chrome go, addresses and body copy fall back to the host."""
    name = clean(name)
    logo = F.regexp_extract(name, r"(?i)^(?:le\s+)?logo\s+(?:de\s+la\s+|de\s+|d['’]|of\s+|van\s+)?(.+)$", 1)
    name = F.when(logo != "", clean(logo)).otherwise(name)
    junk = r"(?i)^(en savoir plus|lire (la suite|plus)|cliquez|plus d['’]info|voir plus|read more|meer info|lees meer|learn more|click here|site web|website)"
    name = F.when(name.rlike(junk), "").otherwise(name)
    stem = F.substring_index(host, ".", 1)
    bare = (name == "") | name.rlike("^https?://") | F.ltrim(F.lower(name), F.lit("w.")).startswith(F.substring(host, 1, 8))
    head = F.split(name, r"\s+(?:is|est|was|-|–|,)\s+", 2)[0]
    short = F.when((F.length(head) > 3) & (F.length(head) <= longest), head).otherwise(title_case(stem))
    return F.when(bare, title_case(F.translate(stem, "-_", "  "))).when(F.length(name) > longest, short).otherwise(name)


def is_place(c: Column) -> Column:
    return has_any(F.lower(c), vocab.PLACES)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is named there."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def cut_spans(s: Column, opening: str, closing: str) -> Column:
    """A text with each span from the first match of ``opening`` to the next of ``closing`` replaced by a blank, what is
    not closed staying.

    Where an opening is not closed, no later one is, so that what begins there is taken at once, and any text takes
    linear time. A blank is added at the end of such a text.
    """
    return F.regexp_replace(s, f"(?s){opening}.*?{closing}|({opening_only(opening)}.*)\\z", "$1 ")


def opening_only(opening: str) -> str:
    """The part of an opening before the rest of its tag."""
    return opening.removesuffix("[^>]*>")


def without_element(html: Column, tag: str) -> Column:
    """A page without the elements of a tag that are closed."""
    return cut_spans(html, rf"(?iu:<{tag}){_NO_WORD}[^>]*>", f"(?iu:</{tag}>)")


def visible_text(html: Column, chrome: tuple[str, ...] = CHROME) -> Column:
    """A page's text by patterns: chrome, comments and tags go, common entities are read, white space collapses. Takes
    linear time, whatever is left open."""
    s = F.coalesce(html, F.lit(""))
    for tag in chrome:
        s = without_element(s, tag)
    s = cut_spans(s, "<!--", "-->")
    s = F.regexp_replace(s, r"<[^>]+>|(<[^>]+)\z", "$1 ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(entity), F.lit(char))
    return _trimmed(F.regexp_replace(s, f"{_BLANK}+", " "))


def stable_text(visible: Column) -> Column:
    """A page's text in lower case, letter by letter, without what changes on every load."""
    s = F.replace(F.replace(visible, F.lit("\u03a3"), F.lit("\u03c3")), F.lit("\u0130"), F.lit("i"))
    return _trimmed(F.regexp_replace(F.regexp_replace(F.lower(s), _VOLATILE, ""), f"{_BLANK}+", " "))


def fingerprint(visible: Column) -> Column:
    """SHA-256 of a page's text in lower case without what changes on every load; empty if nothing is left."""
    return F.replace(F.sha2(stable_text(visible), 256), F.lit(hashlib.sha256(b"").hexdigest()), F.lit(""))  # the text is made once


def facet_label(c: Column) -> Column:
    """Whether a label ends in a count, like filters do."""
    return c.rlike(r"\(\s*\d+\s*\)\s*$")


def is_opening_title(c: Column) -> Column:
    """The gate of opening titles: sensible length, no address, no encoded text, no facet, no chrome."""
    t = F.lower(clean(c))
    address = r"https?://|www\.|\.pdf($|[?#])|/wp-content/"
    return F.length(t).between(5, 140) & ~t.rlike(address) & ~t.contains("%2") & ~facet_label(t) & ~has_any(t, vocab.OPENING_NOISE)


def looks_like_opening(c: Column) -> Column:
    return is_opening_title(c) & has_any(F.lower(c), vocab.OPENING_TITLE_WORDS)


def looks_like_listing(c: Column) -> Column:
    """The gate of listed titles: noise counts only as a whole or at the start."""
    t = F.trim(F.lower(c))
    noise = F.exists(F.array(*[F.lit(n) for n in vocab.LISTING_NOISE]), lambda n: t.startswith(n))
    return F.length(t).between(6, 140) & ~noise & ~facet_label(t) & has_any(t, vocab.LISTING_TITLE_WORDS)
