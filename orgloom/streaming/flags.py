"""Streams with typed state and timers: a flag per page that a change raises and time lowers, and titles that are new."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from orgloom.streaming.state import BUCKETS, bucket

EVENTS = "url string, happened_at timestamp, event string"
_FOUND = "url string, ms long, event string"
NEW_TITLES = "version string, happened_at timestamp, title string"
_NEW = "version string, ms long, title string"
DAY_MS = 86_400_000


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, as typed state asks for."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class ChangeFlag(StatefulProcessor):
    """Holds a page's last fingerprint and, while its flag is up, when that ends; the end has a timer."""

    def __init__(self, lasts_ms: int):
        self.lasts = lasts_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "hash string")
        self.until = handle.getValueState("until", "at long")

    def _event(self, key: tuple, at: int, event: str) -> Row:
        return Row(url=key[0], ms=at, event=event)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        last = self.known.get()[0] if self.known.exists() else None
        up = self.until.get()[0] if self.until.exists() else None
        timer = up
        for at, _, value in sorted((r.ms, r.nth, r.hash) for r in rows if r.hash):
            if up is not None and at > up:
                yield self._event(key, up, "ended")
                up = None
            if last is not None and value != last:
                if up is None:
                    yield self._event(key, at, "begun")
                up = at + self.lasts
            last = value
        if last is not None:
            self.known.update((last,))
        if up != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if up is None:
                self.until.clear()
            else:
                self.until.update((up,))
                self.handle.registerTimer(up)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        if self.until.exists() and self.until.get()[0] == at:
            self.until.clear()
            yield self._event(key, at, "ended")

    def close(self) -> None:
        pass


def change_flags(scans: DataFrame, days: int = 14, late: str = "0 seconds") -> DataFrame:
    """Of scans ``url, scanned_at, nth, hash``, when each page's flag of change goes up and when it ends, ``days`` after
    the last change, though no scan of the page comes then. ``nth`` orders scans of one time; empty fingerprints change
    nothing; scans may be ``late``. Times are whole milliseconds. Start it inside ``rocks_state``.
    """
    at = F.col("scanned_at").cast("timestamp").alias("scanned_at")
    scans = scans.select("url", at, F.unix_millis(at).alias("ms"), F.col("nth").cast("long").alias("nth"), "hash").withWatermark("scanned_at", late)
    events = scans.groupBy("url").transformWithState(ChangeFlag(days * DAY_MS), _FOUND, "append", "eventTime")
    return events.select("url", F.timestamp_millis("ms").alias("happened_at"), "event")


class LastTitles(StatefulProcessor):
    """Holds the titles of the last scan of a bucket's versions, as a list of versions, for as long as the state lives."""

    def __init__(self, ttl_ms: int | None):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getListState("known", "version string, seen long, titles array<string>", self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs() if self.ttl else 0
        known = {version: (seen, frozenset(titles)) for version, seen, titles in self.known.get() if not self.ttl or now - seen < self.ttl}
        scans = [scan for r in rows for scan in zip(r["ms"].tolist(), r["nth"].tolist(), ([] if t is None else list(t) for t in r["titles"]), r["version"].tolist(), strict=True)]
        found: list[tuple[str, int, str]] = []
        for ms, _, titles, version in sorted(scans, key=lambda scan: scan[:3]):
            lower = [t.lower().strip() for t in titles]
            if version in known:
                before = known[version][1]
                found += [(version, ms, t) for t, low in zip(titles, lower, strict=True) if low not in before]
            known[version] = (now, frozenset(lower))
        self.known.put([(version, seen, sorted(titles)) for version, (seen, titles) in known.items()])
        yield pd.DataFrame(found, columns=["version", "ms", "title"])

    def close(self) -> None:
        pass


def new_titles(scans: DataFrame, ttl_days: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Of scans ``version, scanned_at, nth, titles`` each title that the scan before did not have, as a row; none for a
    version's first scan. A version that isn't scanned for ``ttl_days`` of the cluster's clock is forgotten; such
    a stream asks for empty batches as time goes by, so it runs until it is stopped, not for what is available now.
    Versions share the state of a bucket, which is written whole in each batch that scans any of them."""
    at = F.col("scanned_at").cast("timestamp")
    scans = scans.select(bucket("version", buckets).alias("bucket"), "version", F.unix_millis(at).alias("ms"), F.col("nth").cast("long").alias("nth"), "titles")
    processor = LastTitles(ttl_days * DAY_MS if ttl_days else None)
    found = scans.groupBy("bucket").transformWithStateInPandas(processor, _NEW, "append", "processingTime" if ttl_days else "none")
    return found.select("version", F.timestamp_millis("ms").alias("happened_at"), "title")
