"""Incremental computations as Structured Streaming, each equal to a batch plan over all rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGES = "url string, scanned_at timestamp, hash string, changed boolean, changed_at timestamp"
NEW_TITLES = "version string, scanned_at timestamp, new_titles array<string>"


#: Buckets that keys are hashed into. A call of Python and a state's row cost as much for one key as for hundreds.
BUCKETS = 1024
_NEVER = -(1 << 63)


def bucket(key: str, buckets: int = BUCKETS) -> Column:
    """A number from 0 below ``buckets`` for a key."""
    return F.pmod(F.xxhash64(key), F.lit(buckets).cast("long"))


def detect_changes(scans: DataFrame, ttl_ms: int = 0, buckets: int = BUCKETS) -> DataFrame:
    """Every scan ``url, scanned_at, nth, hash`` with whether its hash differs from the last known of its address, and when
    that last happened; ``nth`` orders scans of one time. The first scan of an address is a seed; an empty hash neither changes nor blanks anything.
    With ``ttl_ms`` a scan that comes so long after the one before is a first scan again; scans may be as late, and
    memories that nothing can need any more are dropped when their bucket is next scanned, or with the bucket's last.
    Addresses share the state of a bucket, which is written whole in each batch that scans any of them."""

    def step(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        memory = {url: known for url, *known in zip(*state.get, strict=True)} if state.exists else {}
        rows = pd.concat(list(batches)).sort_values(["scanned_at", "nth"], kind="stable")
        times = rows["scanned_at"].to_numpy().astype("datetime64[us]").astype("int64").tolist()
        found: list[tuple[bool, int]] = []
        for url, now, value in zip(rows["url"].tolist(), times, rows["hash"].tolist(), strict=True):
            last, changed_at, known_at = memory.get(url, (None, None, None))
            if ttl_ms and known_at is not None and now - known_at > 1000 * ttl_ms:
                last = changed_at = None
            changed = bool(value) and last is not None and value != last
            if changed:
                changed_at = now
            memory[url] = (value or last, changed_at, now)
            found.append((changed, _NEVER if changed_at is None else changed_at))
        if ttl_ms:
            over = state.getCurrentWatermarkMs()
            memory = {url: known for url, known in memory.items() if known[2] // 1000 + ttl_ms + 1 > over}
        if memory:
            state.update((list(memory), *map(list, zip(*memory.values(), strict=True))))
            if ttl_ms:
                state.setTimeoutTimestamp(max(known[2] for known in memory.values()) // 1000 + ttl_ms + 1)
        elif state.exists:
            state.remove()
        changed, changed_at = zip(*found, strict=True)
        at = np.array(changed_at, "int64").view("datetime64[us]").astype("datetime64[ns]")
        yield pd.DataFrame({"url": rows["url"].to_numpy(), "scanned_at": rows["scanned_at"].to_numpy(), "hash": rows["hash"].to_numpy(), "changed": changed, "changed_at": at})

    timeout = GroupStateTimeout.EventTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    scans = scans.withColumn("scanned_at", F.col("scanned_at").cast("timestamp")).withWatermark("scanned_at", f"{ttl_ms} milliseconds") if ttl_ms else scans
    known = "urls array<string>, lasts array<string>, changed_at array<long>, known_at array<long>"
    return scans.withColumn("bucket", bucket("url", buckets)).groupBy("bucket").applyInPandasWithState(step, CHANGES, known, "append", timeout)


def detect_new_titles(scans: DataFrame) -> DataFrame:
    """For each scan ``version, scanned_at, nth, titles`` the titles that the scan before didn't have; none for the first."""

    def step(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = set(state.get[0]) if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["scanned_at", "nth"], kind="stable")
        out = []
        for at, titles in zip(rows["scanned_at"], rows["titles"], strict=True):
            now = [] if titles is None else list(titles)
            out.append((key[0], at, [] if before is None else [t for t in now if t.lower().strip() not in before]))
            before = {t.lower().strip() for t in now}
        state.update((sorted(before or ()),))
        yield pd.DataFrame(out, columns=["version", "scanned_at", "new_titles"])

    return scans.groupBy("version").applyInPandasWithState(step, NEW_TITLES, "titles array<string>", "append", GroupStateTimeout.NoTimeout)


def latest_checks(checks: DataFrame, key: str = "org", at: str = "checked_at", then: Sequence[str] = ()) -> DataFrame:
    """The latest row of each key of an append-only log, of one time the last by ``then``; in update or complete mode."""
    row = F.struct(*[c for c in checks.columns if c != key])
    return checks.groupBy(key).agg(F.max_by(row, F.struct(at, *then)).alias("latest")).select(key, "latest.*")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """All that is available now, once each, resumable from the checkpoint."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query.format("parquet").option("path", path).start().awaitTermination()
    else:
        query.foreachBatch(lambda df, epoch: df.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")).start().awaitTermination()
