"""Streams over more keys than buckets, in several batches, against plain loops; the state has a row a bucket."""

import datetime
import random

from orgloom.streaming import flags, state
from orgloom.streaming.state import BUCKETS

DAY = datetime.timedelta(days=1)
START = datetime.datetime(2024, 1, 1)


def run(spark, batches, schema, found, out, tmp):
    """Each batch as a file, all in one run; the rows of ``out`` and the most rows that the state had."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp}/in")
    query = found(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp}/in")).writeStream
    query = query.option("checkpointLocation", f"{tmp}/saved").trigger(availableNow=True).format("parquet").option("path", f"{tmp}/out").start()
    query.awaitTermination()
    most = max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"])
    return sorted(map(tuple, spark.read.schema(out).parquet(f"{tmp}/out").collect()), key=repr), most


def scans(seed, keys, values):
    """Three batches of scans, ten days each, some up to two days late, some of one time."""
    rng, nth = random.Random(seed), 0
    for batch in range(3):
        rows = []
        for _ in range(2 * keys):
            nth += 1
            rows.append((str(rng.randrange(keys)), START + DAY * (10 * batch + rng.randrange(-2 if batch else 0, 10)), nth, rng.choice(values)))
        rng.shuffle(rows)
        yield rows


def test_changes_of_more_addresses_than_buckets(spark, tmp_path):
    batches = list(scans(1, 2000, ["x", "y", "z", "", None]))
    for ttl in (0, 3):
        want, memory = [], {}
        for rows in batches:
            for url, at, _, value in sorted(rows, key=lambda r: r[1:3]):
                last, changed_at, known = memory.get(url, (None, None, None))
                if ttl and known is not None and at - known > ttl * DAY:
                    last = changed_at = None
                changed = bool(value) and last is not None and value != last
                changed_at = at if changed else changed_at
                memory[url] = (value or last, changed_at, at)
                want.append((url, at, value, changed, changed_at))
        got, most = run(spark, batches, "url string, scanned_at timestamp, nth long, hash string", lambda s, ttl=ttl: state.detect_changes(s, ttl * 86_400_000), state.CHANGES, tmp_path / str(ttl))
        assert got == sorted(want, key=repr)
        assert 0 < most <= BUCKETS


def test_titles_of_more_versions_than_buckets(spark, tmp_path):
    lists = [None, [], ["x"], ["X ", "y"], ["y", "z"], ["z", "x", "y"]]
    batches = list(scans(2, 2000, lists))
    want, memory = [], {}
    for rows in batches:
        for version, at, _, titles in sorted(rows, key=lambda r: r[1:3]):
            if version in memory:
                want += [(version, at, t) for t in titles or [] if t.lower().strip() not in memory[version]]
            memory[version] = {t.lower().strip() for t in titles or []}
    with flags.rocks_state(spark):
        got, most = run(spark, batches, "version string, scanned_at timestamp, nth long, titles array<string>", flags.new_titles, flags.NEW_TITLES, tmp_path)
    assert got == sorted(want, key=repr)
    assert 0 < most <= BUCKETS
