"""Stateful operators over streams: first sights with a time to live, and publication sequences. Keyed state has one writer."""

from __future__ import annotations

import time

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.detect import of_publication, ttl_of
from ..session import col


class _FirstSeen(StatefulProcessor):
    """The state holds the key until its time to live, counted from the first sight, has run out."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.seen = handle.getValueState("seen", "at boolean", self.ttl_ms)

    def handleInputRows(self, key, rows, timer):
        held = self.seen.exists()
        for pdf in rows:
            hit = [held or i > 0 for i in range(len(pdf))]
            if len(pdf) and not held:
                self.seen.update((True,))
                held = True
            yield pd.DataFrame({"key": [key[0]] * len(pdf), "raw": pdf["raw"], "triggered": hit})

    def close(self) -> None:
        pass


def seen_within(stream: DataFrame, key: str, raw: str, ttl_ms: int | None = None) -> DataFrame:
    """(key, raw, triggered) by processing time. Needs the RocksDB state store."""
    rows = stream.select(col(key).cast("string").alias("key"), col(raw).alias("raw"))
    return rows.where("key IS NOT NULL").groupBy("key").transformWithStateInPandas(_FirstSeen(ttl_of(ttl_ms)), "key string, raw string, triggered boolean", "Append", "ProcessingTime")


class _Publishing(StatefulProcessor):
    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.started = handle.getValueState("started", "log_file string", self.ttl_ms)

    def handleInputRows(self, key, rows, timer):
        for pdf in rows:
            out = []
            for log_file, message in zip(pdf["log_file"], pdf["message"]):
                m = (message or "").strip()
                if log_file is None:
                    out.append(False)
                elif "##[group]Run" in m and "npm publish" in m:
                    self.started.update((log_file,))
                    out.append(False)
                else:
                    mark = self.started.get() if self.started.exists() else None
                    out.append(m.startswith("+ ") and mark is not None and mark[0] == log_file)
            yield pd.DataFrame({"sha": pdf["sha"], "message": pdf["message"], "triggered": out})

    def close(self) -> None:
        pass


def publish_sequence(stream: DataFrame, ttl_ms: int = 15 * 60_000) -> DataFrame:
    """(sha, message, triggered) of a stream of (sha, log_file, message), for the same lines as the batch form.

    Lines without a commit or a log file share no state: each has a key of its own in the place of the commit's.
    """
    told = (F.coalesce("sha", F.lit("")) != "") & (F.coalesce("log_file", F.lit("")) != "")
    used = stream.where(of_publication(F.col("message"))).select(F.when(told, F.col("sha")).otherwise(F.lit(None)).alias("key"), "sha", "log_file", "message")
    alone = F.concat(F.lit("\0"), F.xxhash64("sha", "log_file", "message").cast("string"))
    keyed = used.select(F.coalesce("key", alone).alias("key"), "sha", F.when(F.col("key").isNotNull(), F.col("log_file")).alias("log_file"), "message")
    return keyed.groupBy("key").transformWithStateInPandas(_Publishing(ttl_ms), "sha string, message string, triggered boolean", "Append", "ProcessingTime")


def stop_after(query, rows: int, seconds: float = 300.0) -> None:
    """Stops a stateful query once it worked off so many rows. By processing time, batches without data go on for as long as state may expire."""
    until = time.monotonic() + seconds
    while sum(p["numInputRows"] for p in query.recentProgress) < rows and query.isActive and time.monotonic() < until:
        time.sleep(0.05)
    query.stop()
    if query.exception() is not None:
        raise query.exception()


ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
