"""Groups cut into components, tables that are declared, runs that are stopped, vocabularies, and links as rows."""

import datetime
import random
import re
import zipfile
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from orgloom.functions import html, links, terms
from orgloom.operators import resolve
from orgloom.operators.components import components
from orgloom.sources import workbook
from orgloom.sources.declared import Declared, sync_touched
from orgloom.sources.folders import work_dir
from orgloom.streaming import flags, ledger, state

RECORD = "pos long, organisation string, homepage string, careers_url string, sources array<string>"


def plain_clusters(rows):
    """One record after another, against the clusters of its domain so far."""
    domains = defaultdict(list)
    curated = lambda s: any("target list" in x.lower() or "registry" in x.lower() for x in s)
    for pos, name, home, _, sources in sorted(rows):
        words = resolve._words(name)
        own = domains[home]
        hit = next((c for c in own if words & resolve._words(c["name"]) and not (curated(sources) and curated(c["sources"]))), None)
        if hit is None:
            own.append({"name": name, "pos": pos, "sources": sorted(sources)})
            continue
        if curated(sources) and not curated(hit["sources"]):
            hit["name"], hit["pos"] = name, pos
        hit["sources"] = sorted({*hit["sources"], *sources})
    return sorted((c["pos"], c["name"], tuple(c["sources"])) for own in domains.values() for c in own)


@pytest.mark.parametrize("seed", range(2))
def test_a_large_domain_is_cut_without_a_change(spark, seed):
    rng = random.Random(seed)
    names = lambda: " ".join(rng.choice(["Radio", "Works", "House", "Union", "Port", "ab", f"N{rng.randrange(60)}xx", f"M{rng.randrange(60)}yy"]) for _ in range(rng.randint(0, 3)))
    rows = [(i, names(), f"https://d{rng.choice([0, 0, 0, 1, 2])}.example.org", "", rng.choice([["target list"], ["register"], ["x", "y"], ["Regional registry"]])) for i in range(300)]
    df = spark.createDataFrame(rows, RECORD).repartition(3)
    for most in (10_000, 0, 50):
        got = sorted((r["pos"], r["organisation"], tuple(sorted(r["sources"]))) for r in resolve.cluster_by_domain(df, most=most).collect())
        assert got == plain_clusters(rows)


def test_a_large_domain_is_spread(spark):
    rows = [(i, f"Word{i // 3} Name", "https://big.example.org", "", ["x"]) for i in range(600)]
    keyed = spark.createDataFrame([(p, n.replace(" Name", ""), "big.example.org") for p, n, *_ in rows], "pos long, organisation string, domain_key string")
    sizes = [r["count"] for r in resolve._dealt(keyed, 100).groupBy("piece").count().collect()]
    assert len(sizes) == 200 and max(sizes) == 3


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}

    def top(x):
        return x if parent[x] == x else top(parent[x])

    for a, b in edges:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for e in edges for x in e if e[0] != e[1]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_terms_overlap_and_nest(spark):
    rng = random.Random(1)
    words = sorted({"".join(rng.choices("abé", k=rng.randint(1, 5))) for _ in range(80)})
    texts = ["".join(rng.choices("abé ", k=rng.randint(0, 60))) for _ in range(60)] + [None, "", "a" * 5000]
    want = Counter()
    for i, text in enumerate(texts):
        for w in words:
            if n := len(re.findall(f"(?={w})", text or "")):
                want[i, w] = n
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    vocabulary = spark.createDataFrame([(w,) for w in [*words, "", None, words[0]]], "term string")
    for most in (1_000_000, 60):
        got = terms.term_hits(df, vocabulary, "id", "text", most_chars=most)
        assert {(r["id"], r["term"]): r["hits"] for r in got.collect()} == want
    assert terms.term_hits(df, vocabulary.limit(0), "id", "text").count() == 0


def test_links_as_rows(spark):
    pages = ["<nav><a href=/n>n</a></nav><a href='/1'>one <b>two</b></a> <a href='/2'>open <div><a name=x>no</a><a href='/3'><img alt=z>", None, "", "<p>none", "<a href='/k'>" + "long " * 40_000 + "</a>" + "<a href='/x'>y</a>" * 3000]
    links.register(spark)
    spark.createDataFrame(list(enumerate(pages)), "id int, html string").createOrReplaceTempView("some_pages")
    got = spark.sql("SELECT id, l.* FROM some_pages, LATERAL extract_links(html) l").collect()
    want = [(i, x["pos"], x["href"], x["text"]) for i, p in enumerate(pages) for x in html.read_page(p)["links"]]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 3000


@pytest.mark.parametrize("step", ["begun", "written", "entered"])
def test_a_stopped_run_goes_on(spark, step):
    source, path = work_dir(spark, "work-in"), work_dir(spark, "work-out")
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(source)
    stream = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source)
    steps, stopped = [], set()

    def watch(name, batch):
        steps.append((name, batch))
        if name == step and batch not in stopped:
            stopped.add(batch)
            raise RuntimeError("stopped here")

    for _ in range(4):
        try:
            ledger.run(stream(), lambda rows: rows.withColumn("twice", F.col("id") * 2), path, watch)
        except Exception as e:  # noqa: BLE001
            assert "stopped here" in str(e)
    got = ledger.results(spark, path, "id long, twice long").collect()
    assert sorted((r["id"], r["twice"]) for r in got) == [(i, 2 * i) for i in range(30)]
    assert stopped == {0, 1, 2} and {r["batch"]: r["rows"] for r in ledger.entered(spark, path).collect()} == {0: 10, 1: 10, 2: 10}
    assert steps.count(("written", 0)) == (1 if step != "written" else 2) and len(steps) <= 15
    before = len(steps)
    ledger.run(stream(), lambda rows: rows, path, watch)
    assert len(steps) == before  # nothing is left to do


def test_declared_tables(spark, tmp_path):
    columns = {"org": "long", "url": "string", "superseded": "boolean"}
    name, path = "declared_versions", str(tmp_path / "t")
    old = Declared(name, {k: columns[k] for k in ("org", "superseded")}, partition_by=("superseded",))
    new = Declared(name, columns, {"url": 4}, ("url",), (("org", "url"),), ("superseded",))
    try:
        assert old.heal(spark, path) == [] and new.heal(spark) == ["url"] and new.heal(spark) == []
        rows = spark.createDataFrame([(1, "long-url", True), (1, "b", False), (2, None, False), (2, "", True), (3, "b", False), (3, "b", False)], "org long, url string, superseded boolean")
        assert {r["rule"]: r["rows"] for r in new.violations(rows).collect()} == {"cap:url": 1, "required:url": 2, "unique:org,url": 1}
        assert new.violations(rows.limit(0)).count() == 0
        new.overwrite_touched(rows)
        assert sorted(map(str, (r["url"] for r in spark.table(name).collect()))) == ["", "None", "b", "b", "b", "long"]
        files = lambda: {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet") if "superseded=true" in str(p)}
        held = files()
        current = rows.filter("NOT superseded").withColumn("action", F.lit("patch")).withColumn("url", F.lit("new"))
        past = rows.filter("superseded").withColumn("action", F.lit("keep"))
        assert not sync_touched(new, spark, past) and sync_touched(new, spark, current.unionByName(past))
        assert held and files() == held  # the history's files are those that were there
        assert {r["url"] for r in spark.table(name).filter("NOT superseded").collect()} == {"new"}
        with pytest.raises(ValueError, match="org"):
            Declared(name, columns | {"org": "string"}).heal(spark)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_workbooks_of_other_writers(spark, tmp_path):
    """Shared strings in runs, cells without places, a stated dimension dealt to several tasks, columns in any order."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rows = "".join(f'<row r="{i}"><c r="A{i}"><v>{i}</v></c><c r="AB{i}" t="s"><v>{i % 2}</v></c>' + (f'<c r="C{i}" t="b"><v>1</v></c>' if i % 3 else "") + "</row>" for i in range(2, 51))
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as book:
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>even</t></si><si><r><t>o</t></r><r><t>dd</t></r></si><si><t>id</t></si><si><t>word</t></si></sst>')
        head = '<row r="1"><c r="A1" t="s"><v>2</v></c><c r="C1" t="inlineStr"><is><t>flag</t></is></c><c r="AB1" t="s"><v>3</v></c></row>'
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><dimension ref="A1:AB50"/><sheetData>{head}{rows}</sheetData></worksheet>')
    workbook.register(spark)
    df = spark.read.format("workbook").schema("word string, id int, flag boolean, other double").option("rowsPerTask", 10).load(str(tmp_path / "b.xlsx"))
    assert df.rdd.getNumPartitions() == 5
    assert sorted(map(tuple, df.collect()), key=lambda r: r[1]) == [("odd" if i % 2 else "even", i, True if i % 3 else None, None) for i in range(2, 51)]


def test_workbooks_are_written_whole(spark, tmp_path):
    workbook.register(spark)
    path = str(tmp_path / "w")
    rows = [(1, " a <b> & \n c\r", 1.5, True, None), (2**53 + 1, "", -0.0, False, "x"), (None, None, None, None, "\x01y")]
    df = spark.createDataFrame(rows, "i long, s string, d double, b boolean, t string")
    df.write.format("workbook").mode("append").save(path)
    df.limit(1).write.format("workbook").mode("append").save(path)
    read = lambda: sorted(map(tuple, spark.read.format("workbook").schema(df.schema).load(path).collect()), key=str)
    assert read() == sorted([*rows[:2], (*rows[2][:4], "y"), rows[0]], key=str)
    df.limit(1).write.format("workbook").mode("overwrite").save(path)
    assert read() == [rows[0]] and not [p for p in Path(path).iterdir() if p.name.startswith("_")]
    assert spark.read.format("workbook").schema("i string, zz long").load(path).first()["i"] == "1"
    df.limit(0).write.format("workbook").mode("overwrite").save(path)
    assert read() == []


def test_streams_go_on_after_a_restart(spark):
    """Each batch in a run of its own: what a flag and a list of titles know is in the checkpoint."""
    source, out, titles_out = work_dir(spark, "scans-in"), work_dir(spark, "flags-out"), work_dir(spark, "titles-out")
    day = lambda d, h=0: datetime.datetime(2024, 1, d, h)
    batches = [
        [("a", day(1), 1, "x"), ("b", day(1), 1, "x"), ("a", day(2), 2, "y")], [("b", day(3), 2, "")], [("c", day(5), 1, "z"), ("a", day(5), 3, "y")],  # the flag of a ends on the fourth
        [("b", day(6), 3, "w"), ("b", day(6, 1), 4, "x")], [("c", day(20), 2, "z")], [("c", day(21), 3, "q"), ("c", day(25), 4, "z")],
    ]
    schema = "url string, scanned_at timestamp, nth long, hash string"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = lambda: spark.readStream.schema(schema).parquet(source)
        with flags.rocks_state(spark):
            state.run_available(flags.change_flags(stream(), 2), out, f"{out}-saved")
            titles = stream().select(F.col("url").alias("version"), "scanned_at", "nth", F.filter(F.array("hash"), lambda h: h != "").alias("titles"))
            state.run_available(flags.new_titles(titles), titles_out, f"{titles_out}-saved")
    got = sorted((r["url"], r["happened_at"], r["event"]) for r in spark.read.schema(flags.EVENTS).parquet(out).collect())
    assert got == [
        ("a", day(2), "begun"), ("a", day(4), "ended"), ("b", day(6), "begun"), ("b", day(8, 1), "ended"), ("c", day(21), "begun"), ("c", day(23), "ended"), ("c", day(25), "begun"),
    ]
    new = sorted((r["version"], r["happened_at"], r["title"]) for r in spark.read.schema(flags.NEW_TITLES).parquet(titles_out).collect())
    assert new == [("a", day(2), "y"), ("b", day(6), "w"), ("b", day(6, 1), "x"), ("c", day(21), "q"), ("c", day(25), "z")]
