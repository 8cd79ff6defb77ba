"""Golden rows of rules, dates, pages and the store."""

import random

import pytest
from pyspark.sql import functions as F

from orgloom.functions import dates, text, urls
from orgloom.functions.html import find_postings, read_page
from orgloom.operators import discover, fit, freshness, openings, resolve, versions


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def candidate(spark, url, organisation, existing="", base="", title="", rank=9):
    df = discover.score_candidates(spark.range(1), F.lit(url), F.lit(title), F.lit(""), F.lit(rank), F.lit(organisation), F.lit(existing), F.lit(base))
    return df.select("cand_score", "cand_reasons").first()


def test_candidates(spark):
    assert candidate(spark, "https://acme.org/jobs/report.pdf", "Acme")[0] == -100
    assert candidate(spark, "https://acme.impactpool.org/jobs", "Acme")[0] == -100
    assert candidate(spark, "https://www.impactpool.org/jobs", "Impactpool")[0] > 0
    careers = candidate(spark, "https://careers.acme.example.org/", "Acme Works")
    assert "careers-shaped subdomain (+5)" in careers[1] and not any("bare homepage" in r for r in careers[1])
    assert candidate(spark, "https://other.org/jobs", "Acme Works")[0] == 5 - 10
    assert candidate(spark, "https://acme.org/news", "Acme", rank=0)[0] <= 9
    assert "domain matches the name (+4)" in candidate(spark, "https://careers.efsa.europa.eu/", "EFSA")[1]


def test_page_evidence(spark):
    def score(ok, status, html, url="https://x.example/about"):
        return discover.verify_pages(spark.range(1), F.lit(ok), F.lit(status), F.lit(url), F.lit(html)).first()["page_score"]

    assert [score(False, s, "") for s in (401, 403, 429, 0, 404, 500)] == [0, 0, 0, 0, -50, -50]
    assert score(True, 200, "<p>Become a member</p>") == -4
    assert score(True, 200, "<p>Become a member. Apply now.</p>") == 2
    assert score(True, 200, "<p>our members</p>", "https://x.example/membership") == -6
    assert score(True, 200, "<p>our members</p>", "https://x.example/jobs") == 0


def test_titles(spark):
    def fits(title, **toggles):
        r = one(spark, fit.score_title(F.lit(title), fit.Profile(toggles=toggles)))[0]
        return r["score"], r["band"]

    assert fits("Head of policy officer") == (28, "weak")
    assert fits("Head of policy officer", seniority=False) == (70, "strong")
    assert fits("International works") == (24, "weak")  # "intern" is in "international"
    assert fits("ab") == (0, "unknown")
    best = one(spark, fit.score_openings(F.array(F.lit("Works"), F.lit("Other"))))[0]
    assert (best["best_title"], best["best_score"]) == ("Works", 30)
    none = one(spark, fit.score_openings(F.array().cast("array<string>")))[0]
    assert (none["best_band"], none["strong"]) == ("none", 0)


def test_title_gates(spark):
    row = one(spark, *[text.is_opening_title(F.lit(x)) for x in ("Internship (15)", "https://x.example/a", "a%20b title", "Policy Officer", "abc")])
    assert list(row) == [False, False, False, True, False]


def test_dates(spark):
    written = ("16 July 2026", "July 16, 2026", "16/07/2026", "2026-07-16", "16 juillet 2026", "31/02/2026")
    assert list(one(spark, *[dates.parse_date(F.lit(x)) for x in written])) == ["2026-07-16"] * 5 + [""]
    near, late = (dates.next_deadline(F.lit("Deadline 19 August"), F.lit(d).cast("date")) for d in ("2026-08-01", "2026-10-01"))
    assert list(one(spark, near, late)) == ["2026-08-19", "2027-08-19"]
    assert one(spark, dates.next_deadline(F.lit("deadline 29 February"), F.lit("2024-06-01").cast("date")))[0] == ""
    assert one(spark, dates.norm_deadline(F.lit("2026-99-99")))[0] == "2026-99-99"


def test_fingerprint_ignores_noise(spark):
    a = "<p>Hello  world token=abc123 12:30</p>"
    b = "<p>Hello world token=zzz999 23:59:01</p><script>x()</script>"
    h = [text.fingerprint(text.visible_text(F.lit(x))) for x in (a, b, "<nav>x</nav>")]
    row = one(spark, *h)
    assert row[0] == row[1] != "" and row[2] == ""


def test_ladder_prefers_change_then_page(spark):
    def step(cur, prev, prev_date, meta):
        c = freshness.ladder(*[F.lit(x) for x in (cur, prev, prev_date, meta, "", "", "")], F.lit("2026-01-10").cast("date"))
        r = spark.range(1).select(*[v.alias(k) for k, v in c.items()]).first()
        return r["date"], r["source"], r["trust"], r["changed_at"]

    assert step("b", "a", "2025-01-01", "2024-01-01") == ("2026-01-10", "hash", "high", "2026-01-10")
    assert step("a", "a", "2025-01-01", "2024-01-01") == ("2024-01-01", "meta", "high", "")
    assert step("a", "a", "2025-01-01", "") == ("2025-01-01", "hash", "medium", "")
    assert step("a", "", "2025-01-01", "") == ("", "hash-seeded", "none", "")
    assert step("", "a", "2025-01-01", "") == ("", "", "none", "")


def test_links(spark):
    cols = [urls.dedup_domain(F.lit(u), F.lit("")) for u in ("https://www.Acme.org/x", "https://x.europa.eu/", "", "acme.org")]
    assert list(one(spark, *cols)) == ["acme.org", "", "", ""]
    assert one(spark, text.merge_key(F.lit("The Énergie (EN) of Gent asbl")))[0] == "energiegent"
    assert one(spark, text.title_case(F.lit("l'eau 3d a-b")))[0] == "L'Eau 3D A-B"


def test_html():
    page = read_page("<title>T</title><nav><a href=x>no</a></nav><ul><li><a href='/j'>Job <b>one</b></a> Posted 1 May 2020</li></ul><script>var a='<p>'</script>")
    assert page["title"] == "T" and [x["text"] for x in page["links"]] == ["Job one"] and "Posted 1 May 2020" in page["rows"][page["links"][0]["row"]]["text"]
    assert read_page(None)["links"] == []
    assert [p["title"] for p in find_postings('{"@graph":[{"@type":"JobPosting","name":"A"},{"@type":"JobPosting","name":"B"}]}')] == ["B", "A"]
    assert find_postings('{"title":"no posting"}') == []


def test_times_near_a_cue_are_deadlines(spark):
    pages = {
        "a": "<li><a href='/jobs/one-1/x'>Policy officer</a> <p>Deadline <time datetime=2024-06-30>then</time></p></li>",
        "b": "<li><a href='/jobs/one-1/x'>Policy officer</a> <p><time datetime=2024-05-01T10:00>here</time></p> <p>Closes <time datetime=2024-06-30>then</time></p></li>",
        "c": "<li><a href='/jobs/one-1/x'>Policy officer</a> <p>Apply by <time datetime=2024-06-30>x</time></p> <p><time datetime=2024-05-01>y</time> <time datetime=soon>z</time></p></li>",
        "d": "<li><a href='/jobs/one-1/x'>Policy officer</a></li><li><time datetime=2024-05-01>other row</time></li>",
    }
    rows = spark.createDataFrame([(f"https://{k}.example/", v) for k, v in pages.items()], "url string, html string")
    got = {r["url"][8]: (r["posted"], r["deadline"]) for r in openings.listings(rows, F.lit("2024-01-01").cast("date")).collect()}
    assert got == {"a": ("", "2024-06-30"), "b": ("2024-05-01", ""), "c": ("2024-05-01", "2024-06-30"), "d": ("", "")}


def test_a_row_of_many_links_is_held_once():
    page = read_page("<div>" + "".join(f"<a href='/jobs/{i}/'>Officer number {i}</a> " for i in range(2000)) + "<li><a href=x>in a row</a><a href=y>too</a></li></div>")
    assert len(page["links"]) == 2002 and len(page["rows"]) == 2 and sum(len(r["text"]) for r in page["rows"]) < 2 * len(page["text"])
    assert [x["row"] for x in page["links"][-2:]] == [1, 1] and page["rows"][1]["text"] == "in a row too"


def test_openings_states(spark):
    html = {"a": "<li><a href='/jobs/1/'>Policy Officer</a></li>", "b": "<p>No current vacancies.</p>", "c": "<p>Geen vacatures</p>", "d": "<p>hello</p>", "e": None}
    rows = spark.createDataFrame([(k, v, v is not None, 200 if v else 403) for k, v in html.items()], "url string, text string, ok boolean, status int")
    got = {r["url"]: r["state"] for r in openings.detect(rows).collect()}
    assert got == {"a": "has_openings", "b": "no_openings", "c": "no_openings", "d": "unknown", "e": "unknown"}


def test_clusters_follow_order(spark):
    rows = [(0, "Radio Works (RWO)", ["target list"]), (1, "RWO", ["register"]), (2, "Radio House", ["Regional registry"]), (3, "Other", ["register"])]
    df = spark.createDataFrame([(p, n, "https://rw.example.org", "", s) for p, n, s in rows], "pos int, organisation string, homepage string, careers_url string, sources array<string>")
    got = {r["organisation"]: r["sources"] for r in resolve.cluster_by_domain(df).collect()}
    assert got == {"Radio Works (RWO)": ["register", "target list"], "Radio House": ["Regional registry"], "Other": ["register"]}


@pytest.mark.parametrize("seed", range(6))
def test_batches_are_the_writes_one_by_one(spark, seed):
    rng = random.Random(seed)
    table = {k: (f"n{k}", "s") for k in range(8)}
    ops, now = [], dict(table)
    for n in range(60):
        key = rng.randrange(12)
        kind = rng.choice(["update", "delete", "update"]) if key in now else "create"
        if rng.random() < (0.04 if seed else 0):
            kind = "create" if key in now else "delete"
        new = (f"a{n}", rng.choice([None, f"b{n}"]))
        ops.append((n, kind, key, *new))
        if kind == "delete":
            now.pop(key, None)
        else:
            now[key] = new if kind == "create" else (new[0], new[1] or now[key][1])
    done, status = dict(table), {}
    for at in range(0, 60, 10):
        trial, bad = dict(done), False
        for n, kind, key, name, group in ops[at : at + 10]:
            wrong = (key in trial) == (kind == "create")
            status[n], bad = "failed" if wrong else "skipped", bad or wrong
            if kind == "delete":
                trial.pop(key, None)
            elif kind == "create" or key in trial:
                trial[key] = (name, group) if kind == "create" else (name, group or trial[key][1])
        if bad:
            break
        done = trial
        status |= {n: "applied" for n in range(at, at + 10)}
    held = spark.createDataFrame([(k, *v, 1) for k, v in table.items()], "id int, name string, kind_of string, rest int")
    out, log = versions.batch_write(held, spark.createDataFrame(ops, "op_no int, kind string, id int, name string, kind_of string"), "id", ["name", "kind_of"], 10)
    assert {r["id"]: (r["name"], r["kind_of"]) for r in out.collect()} == done
    assert {r["op_no"]: r["status"] for r in log.collect()} == {n: status.get(n, "skipped") for n in range(60)}


def test_one_current_version_each(spark):
    kept = {f: "" for f in versions.KEPT_FIELDS}
    history = spark.createDataFrame([dict(org=1, url="a", superseded=False, run_id="r", discovered_at="t", **(kept | {"page_text": "x", "content_hash": "h"}))], "org int, url string, superseded boolean, run_id string, discovered_at string, " + ", ".join(f"{f} string" for f in versions.KEPT_FIELDS))
    new = spark.createDataFrame([dict(org=1, url="b", **kept), dict(org=2, url="c", **kept), dict(org=3, url="", **kept)], "org int, url string, " + ", ".join(f"{f} string" for f in versions.KEPT_FIELDS))
    out = versions.sync_versions(history, new, "r1", F.lit("now"))
    assert sorted((r["org"], r["url"], r["superseded"], r["page_text"]) for r in out.collect()) == [(1, "a", True, ""), (1, "b", False, ""), (2, "c", False, "")]
    same = versions.sync_versions(history, new.withColumn("url", F.lit("a")).filter("org = 1"), "r1", F.lit("now")).first()
    assert (same["page_text"], same["content_hash"], same["action"]) == ("x", "h", "patch")


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "pos int, organisation string, homepage string, careers_url string, sources array<string>")
    assert resolve.cluster_by_domain(empty).count() == 0
    assert versions.upsert(empty.select("pos", "organisation"), empty.select("pos", "organisation"), "pos", ["organisation"]).count() == 0
