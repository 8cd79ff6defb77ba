"""The URL filter against SQL (host, path, rule) and against plain Python (features, training, scores)."""

import math
import re
from pathlib import Path

import duckdb
from pyspark.sql import functions as F

from orgloom.llm import queries, url_filter

RULE_SQL = r"""
    WITH p AS (
        SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
    ), h AS (
        SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
    )
    SELECT page_id, host, path, CASE
        WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND prefix(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/') THEN 'net/' END AS rule
    FROM h
"""


def test_hosts_paths_and_rules_are_the_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    want = {r[0]: r[1:] for r in con.execute(RULE_SQL).fetchall()}
    got = queries.op9_url_filter(spark, sf_dir).collect()
    assert {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in got} == want and len(got) == len(want)
    verdicts = {r.text: r.verdict for r in queries.URL_RULES}
    assert all(r["verdict"] == (verdicts[r["rule"]] if r["rule"] else "block" if r["score"] >= 0.5 else "allow") for r in got)


def plain_features(url, rates, prior):
    url = url or ""
    rest = url.partition("://")[2] if "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0].lower()
    path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    query = m[1] if (m := re.search(r"\?([^#]*)", url)) else ""
    n = max(1, len(url))
    share = [url.count(c) / n for c in sorted(set(url))]
    labels = host.split(".")
    return [
        len(url), len(host), len(path), len(labels), path.count("/"), sum(c in "0123456789" for c in url) / n, sum(c in "-_%=&~+!@;," for c in url) / n,
        -sum(s * math.log2(s) for s in share), query.count("&") + 1 if query else 0, int("#" in url),
        rates[0].get(labels[-1], prior), rates[1].get(".".join(labels[-2:]), prior),
    ]


def plain_trees(x, y, cuts, bias, trees, depth, rate):
    """Boosted trees grown by trying every cut of every feature on the rows of each node."""
    margin, grown = [bias] * len(y), []
    for _ in range(trees):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g, w = [a - b for a, b in zip(y, p)], [b * (1 - b) for b in p]
        nodes, tree = {1: list(range(len(y)))}, {}
        for _ in range(depth):
            for node, rows in [(n, r) for n, r in nodes.items() if 2 * n not in nodes and n.bit_length() == max(nodes).bit_length()]:
                score = lambda part: sum(g[i] for i in part) ** 2 / (sum(w[i] for i in part) + 1)
                best, found = 1e-6 + score(rows), None
                for f in range(len(cuts)):
                    for k, cut in enumerate(cuts[f]):
                        left = [i for i in rows if x[i][f] <= cut]
                        right = [i for i in rows if x[i][f] > cut]
                        if left and right and sum(w[i] for i in left) > 1e-3 and sum(w[i] for i in right) > 1e-3 and score(left) + score(right) > best + 1e-9:
                            best, found = score(left) + score(right), (f, k, left, right)
                if found:
                    tree[node] = found[:2]
                    nodes[2 * node], nodes[2 * node + 1] = found[2:]
        values = {n: rate * sum(g[i] for i in r) / (sum(w[i] for i in r) + 1) for n, r in nodes.items() if n > 1}
        for n, rows in nodes.items():
            if n not in tree:
                for i in rows:
                    margin[i] += values.get(n, 0.0)
        grown.append((tree, values))
    return grown


def plain_margin(x, grown, cuts, bias):
    for tree, values in grown:
        node = 1
        while node in tree:
            f, k = tree[node]
            node = 2 * node + (x[f] > cuts[f][k])
        bias += values.get(node, 0.0)
    return bias


def plain_rates(rows, share):
    """The smoothed shares of suffixes and domains among ``host, block``."""
    out = []
    for labels in (1, 2):
        by = {}
        for host, block in rows:
            by.setdefault(".".join(host.split(".")[-labels:]), []).append(block)
        out.append({k: (sum(v) + 8 * share) / (len(v) + 8) for k, v in by.items()})
    return out


def test_trees_are_the_plain_ones(spark):
    urls = [f"https://h{i % 5}.example{i % 3}.{('org', 'net', 'de')[i % 7 % 3]}/{'ab1/' * (i % 6)}p-{i}" + ("?a=1&b=%20" if i % 4 == 1 else "#x" if i % 4 == 2 else "") for i in range(160)]
    y = [float(i % 4 == 1 or i % 6 > 3) for i in range(160)]
    df = spark.createDataFrame([(i, u, v) for i, (u, v) in enumerate(zip(urls, y))], "page_id long, url string, block double")
    host, path = url_filter.host_and_path(F.col("url"))
    df = df.withColumn("host", host).withColumn("path", path)
    model = url_filter.fit(df, "page_id", trees=2, depth=2)
    rows = {r["page_id"]: (r["host"], r["block"], r["fold"]) for r in df.withColumn("fold", F.pmod(F.xxhash64(F.col("page_id").cast("string"), "url"), F.lit(url_filter.FOLDS))).collect()}
    share = sum(y) / len(y)
    rates = plain_rates([r[:2] for r in rows.values()], share)
    assert [{r["key"]: round(r["rate"], 12) for r in model.rates[k].collect()} for k in ("suffix_rate", "domain_rate")] == [{k: round(v, 12) for k, v in x.items()} for x in rates]
    apart = [plain_rates([r[:2] for r in rows.values() if r[2] != fold], share) for fold in range(url_filter.FOLDS)]
    seen = [plain_features(u, apart[rows[i][2]], share) for i, u in enumerate(urls)]  # none by labels of its own fold
    cuts = [model.cuts[f] for f in url_filter.FEATURES]
    grown = plain_trees(seen, y, cuts, model.bias, 2, 2, 0.5)
    assert [t.splits for t in model.trees] == [tree for tree, _ in grown]
    got = model.with_features(df).withColumn("margin", model.margin()).collect()
    for r in got:
        x = plain_features(urls[r["page_id"]], rates, share)
        assert all(abs(r[f] - v) < 1e-9 for f, v in zip(url_filter.FEATURES, x)), r
        assert abs(r["margin"] - plain_margin(x, grown, cuts, model.bias)) < 1e-9
    assert len(got) == 160


def test_held_out_urls(spark, sf_dir):
    """Trees that learn from four fifths of the URLs that rules decide judge the last fifth."""
    large = Path(sf_dir).parent / "sf0.1"  # the smallest table has a dozen such URLs
    pages = spark.read.parquet(f"{large if large.is_dir() else sf_dir}/pages.parquet")
    host, path = url_filter.host_and_path(F.col("url"))
    rows = pages.withColumn("host", host).withColumn("path", path)
    text, verdict = url_filter.longest_rule(F.col("host"), F.col("path"), queries.URL_RULES)
    rows = rows.withColumn("block", F.when(verdict.isNotNull(), (verdict == "block").cast("int"))).filter("block IS NOT NULL")
    out = F.pmod(F.xxhash64("page_id", F.lit(3)), F.lit(5)) == 0
    model = url_filter.fit(rows.filter(~out), "page_id")
    right, n, blocked = model.with_features(rows.filter(out)).select(((model.margin() >= 0) == (F.col("block") == 1)).cast("int").alias("right"), "block").agg(F.sum("right"), F.count(F.lit(1)), F.sum("block")).first()
    print(f"held out: {right} of {n}, {blocked} blocked")
    assert n > 10 and right >= 0.95 * max(blocked, n - blocked)  # the path's words, which rules ask for, are no features


def test_odd_urls(spark):
    urls = [None, "", "://", "http://", "http://a.net/" + "x" * 1_000_000, "HTTP://A.NET?q", "http://a.net/", "http://a.net/", "http://é.ORG/fr/ü"]
    pages = spark.createDataFrame([(i % 8 or None, u, "c", "d", 1.0, "k") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string, score double, key string")
    got = url_filter.judge(pages, queries.URL_RULES).collect()
    assert len(got) == len(urls) and sum(r["page_id"] is None for r in got) == 2
    assert sum(len(r["path"]) == 1_000_001 and r["rule"] == "net/" for r in got) == 1
    assert sorted(r["rule"] or "" for r in got) == ["", "", "", "", "", "net/", "net/", "net/", "org/fr/"]
