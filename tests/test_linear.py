"""Texts and pages made to be slow, and values that only hard inputs show."""

import time

import pytest
from pyspark.sql import functions as F

from orgloom.functions import dates, html, text
from orgloom.operators import freshness
from orgloom.plans import views
from orgloom.sources import readers


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def timed(run, most=5.0):
    started = time.perf_counter()
    out = run()
    assert time.perf_counter() - started < most
    return out


@pytest.mark.parametrize("piece", ["<script>", "<script", "<!--", "<", "<>", "<nav><footer", "</script>", "-->", "a > b "])
def test_visible_text_is_linear(spark, piece):
    page = piece * (1_000_000 // len(piece))
    df = spark.createDataFrame([(page,)], "html string")
    df.select(text.visible_text(F.lit("<p>x"))).collect()  # compiled
    timed(lambda: df.select(F.length(text.visible_text(F.col("html")))).collect())


@pytest.mark.parametrize(
    ("page", "want"),
    [("a<script>b</script>c", "a c"), ("a<SCRIPT x='1'>b<b>c</Script>d<script>e", "a d e"), ("a<nav>b</nav>c<nav>d</nav>e", "a c e"), ("<scripts>a</scripts>b", "a b"), ("x <!-- <p> --> y <!-- z", "x y <!-- z"), ("1 < 2 <p> 3", "1 3"), ("a<>b<i>c", "a<>b c"), ("&lt;p&gt; &amp;amp;", "<p> &amp;"), (None, ""), ("", "")],
)
def test_visible_text(spark, page, want):
    df = spark.createDataFrame([(page,)], "html string")
    assert df.select(text.visible_text(F.col("html"))).first()[0] == want


def test_pages_are_read_in_linear_time():
    times = "<div>" + "<time datetime='2020-01-01'>deadline</time> some text " * 50_000 + "</div>"
    assert len(timed(lambda: html.read_page(times))["links"]) == 0
    assert timed(lambda: html.read_page("<div>" * 20_000 + "</span>" * 50_000))["text"] == ""
    links = timed(lambda: html.read_page("<b>" * 30_000 + "<a href='/x'>y</a>" * 30_000))["links"]
    assert len(links) == 30_000
    timed(lambda: html.read_page("<script type='application/ld+json'>" + "< & " * 100_000))


def test_nearest_rows_and_unmatched_ends():
    page = html.read_page("<ul><li>one <b><a href='/1'>x</a></i></b> end</li><li>two</div><a href='/2'>y</a></li></ul><a href='/3'>z</a>")
    assert [(x["href"], page["rows"][x["row"]]["text"]) for x in page["links"]] == [("/1", "one x end"), ("/2", "two y"), ("/3", "z")]


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("Tuesday, 15-Nov-94 08:12:31 GMT", "1994-11-15"), ("Tue Nov 15 08:12:31 1994", "1994-11-15"), ("15 November 1994 08:12:31 GMT", "1994-11-15"), ("Tue, 15 Nov 1994 08:12:31 GMT", "1994-11-15"),
        ("Tue, 5 Nov 24 08:12 +0100", "2024-11-05"), ("Tue Nov  5 08:12:31 2024", "2024-11-05"), ("Tue, 31 Feb 2024 08:12:31 GMT", ""), ("Tue, 15 Foo 1994 08:12:31 GMT", ""), ("15 Nov 1994", ""), ("", ""), ("soon", ""),
    ],
)
def test_header_dates(spark, value, want):
    assert one(spark, dates.header_date(F.lit(value))) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<!-- <meta name="last-modified" content="2020-01-01"> -->', ""), ("<meta property=og:updated_time content=2020-01-02>", "2020-01-02"), ("<META CONTENT='2020-01-03T1' NAME='last-modified'/>", "2020-01-03"),
        ('<meta name="last-modified" content="soon"><meta itemprop="dateModified" content="2020-01-04">', "2020-01-04"), ('<meta name="last-modified" title="a > b" content="2020-01-05">', "2020-01-05"),
        ('<script>var x = \'<meta name="last-modified" content="2020-01-06">\'</script>', ""), ('<meta data-name="x" property="og:updated_times" content="2020-01-07">', ""), ("<meta " * 100_000, ""), (None, ""),
    ],
)
def test_meta_dates(spark, page, want):
    df = spark.createDataFrame([(page,)], "html string")
    spark.createDataFrame([("<p>",)], "html string").select(freshness.meta_date(F.col("html"))).collect()  # compiled
    assert timed(lambda: df.select(freshness.meta_date(F.col("html"))).first()[0]) == want


def test_a_pattern_that_cannot_be_read_is_refused(spark):
    with pytest.raises(ValueError, match="not a pattern"):
        views.pattern(["a"], "policy (")
    assert spark.createDataFrame([("Policy Officer",)], "a string").filter(views.pattern(["a"], "policy|law")).count() == 1


def test_register_entries_of_any_prefix(spark, tmp_path):
    entry = "interestRepresentative"
    body = "<{p}originalName>{n}</{p}originalName><x:city xmlns:x='u'>Gent</x:city>"
    rows = [
        f"<a:{entry}>" + body.format(p="a:", n="one") + f"</a:{entry}>", f"<{entry} id='2'>" + body.format(p="", n="two") + f"</{entry}>", f'<b-c:{entry}\n xmlns:b-c="urn:y">' + body.format(p="b-c:", n="three") + f"</b-c:{entry}>",
        f"<{entry}>" + body.format(p="", n="four") + f"</{entry}>", f"<{entry}s>" + "<originalName>no</originalName>" + f"</{entry}s>",
    ]
    (tmp_path / "r.xml").write_text("<?xml version='1.0'?><list>" + "".join(rows) + "</list>\n")
    got = readers.read_register(spark, str(tmp_path)).select("originalName", "city").collect()
    assert sorted(map(tuple, got)) == [("four", "Gent"), ("one", "Gent"), ("three", "Gent"), ("two", "Gent")]
