"""Detections that remember: first sights within a time to live, and sequences of lines. Batch forms; see streaming for the others."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, broadcast_if_small, col, durable

DEFAULT_TTL_MS, MAX_TTL_MS = 10 * 60_000, 60 * 60_000


def ttl_of(ttl_ms: int | None) -> int:
    """The time to live that holds: the default if none is asked for, the largest at most."""
    return min(DEFAULT_TTL_MS if ttl_ms is None else ttl_ms, MAX_TTL_MS)


def seen_before(df: DataFrame, key: str, order: list[str], out: str = "triggered") -> DataFrame:
    """df with `out`: whether the key came before in the order given. No time to live. Null keys are false; of rows equal in key and order one is the first.

    A key's first place is found by an aggregation on the map side and joined back, so that a key with many rows is sorted nowhere; only rows in the
    first place are numbered.
    """
    at = F.struct(*(col(c) for c in order))
    first = df.where(col(key).isNotNull()).groupBy(col(key).alias("__key")).agg(F.min(at).alias("__first"))
    small = first.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = df.join(F.broadcast(first) if small else first, col(key) == F.col("__key"), "left").withColumn("__is_first", F.coalesce(at.eqNullSafe(F.col("__first")) & F.col("__key").isNotNull(), F.lit(False)))
    ones = joined.where("__is_first").withColumn(out, F.row_number().over(W.partitionBy("__key").orderBy(F.lit(0))) > 1)
    rest = joined.where("NOT __is_first").withColumn(out, col(key).isNotNull())
    return ones.unionByName(rest).drop("__key", "__first", "__is_first")


def _passage(ttl: int):
    """One row for each sorted partition of (pid, key, at): how an anchor that comes from the partition before passes through its first key.

    steps holds (upto, anchor): a row at or after the anchor plus the time to live, the first of which lies at most at `upto`, leads to `anchor` in the
    end; where there is no such row the anchor stays. fresh is the last anchor if none comes in. Of several keys in a partition the last one counts.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid, first, parts, last, anchor = None, None, [], None, 0
        for pdf in batches:
            if not len(pdf):
                continue
            keys, at = pdf["key"], pdf["at"].to_numpy(np.int64)
            if pid is None:
                pid, first = int(pdf["pid"].iloc[0]), keys.iloc[0]
            mine = (keys == first).to_numpy()
            parts.append(at[mine])
            for k, t in zip(keys[~mine], at[~mine].tolist()):
                if k != last or t >= anchor + ttl:
                    last, anchor = k, t
        if pid is None:
            return
        at = np.concatenate(parts)
        after = np.searchsorted(at, at + ttl).tolist()
        ends = at.tolist()
        for i in range(len(ends) - 1, -1, -1):
            if after[i] < len(ends):
                ends[i] = ends[after[i]]
        shift = [i for i in range(len(ends)) if i + 1 == len(ends) or ends[i] != ends[i + 1]]
        steps = [{"upto": int(at[i]), "anchor": ends[i]} for i in shift]
        alone = last is None
        yield pd.DataFrame([{"pid": pid, "first": first, "last": first if alone else last, "steps": steps, "fresh": ends[0] if alone else anchor, "alone": alone}])

    return run


def _incoming(ttl: int):
    """(pid, anchor) of the partitions whose first key goes on from the partition before; all partitions' passages come in one batch sequence, sorted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, anchor, out = None, 0, []
        for pdf in batches:
            for p in pdf.itertuples(index=False):
                goes_on = key is not None and p.first == key
                if goes_on:
                    out.append((p.pid, anchor))
                if p.alone and goes_on:
                    anchor = next((s["anchor"] for s in p.steps if s["upto"] >= anchor + ttl), anchor)
                else:
                    anchor = p.fresh
                key = p.last
        yield pd.DataFrame(out, columns=["pid", "anchor"]).astype({"pid": "int32", "anchor": "int64"})

    return run


def seen_within(df: DataFrame, key: str, at_ms: Column, tie: str, ttl_ms: int | None = None, out: str = "triggered") -> DataFrame:
    """(key, tie, at_ms, out): whether the key was first seen less than the time to live before. A sight does not renew it.

    Rows are range partitioned and sorted by key and time, so a key with many rows is spread over many partitions, and written once. Every
    partition tells how an anchor would pass through it, one task chains these, a row for each partition, and a second scan starts each partition with the
    anchor that comes in. Rows with a null key or time are left out; rows equal in all are sights one after another.
    """
    ttl = ttl_of(ttl_ms)
    rows = df.select(col(key).alias("key"), col(tie).alias("tie"), at_ms.cast("bigint").alias("at")).where(F.col("key").isNotNull() & F.col("at").isNotNull())
    types = dict(rows.dtypes)
    spread = durable(rows.repartitionByRange("key", "at", "tie").sortWithinPartitions("key", "at", "tie").withColumn("pid", F.spark_partition_id()))
    kind = types["key"]
    passages = spread.select("pid", "key", "at").mapInPandas(_passage(ttl), f"pid int, first {kind}, last {kind}, steps array<struct<upto:bigint,anchor:bigint>>, fresh bigint, alone boolean")
    starts = durable(passages.repartition(1).sortWithinPartitions("pid").mapInPandas(_incoming(ttl), "pid int, anchor bigint"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, anchor, begun = None, 0, False
        for pdf in batches:
            if len(pdf) and not begun:
                begun = True
                if pd.notna(pdf["start"].iloc[0]):
                    held, anchor = pdf["key"].iloc[0], int(pdf["start"].iloc[0])
            hit = []
            for k, at in zip(pdf["key"], pdf["at"]):
                if k != held or at >= anchor + ttl:
                    held, anchor = k, at
                    hit.append(False)
                else:
                    hit.append(True)
            yield pd.DataFrame({"key": pdf["key"], "tie": pdf["tie"], "at": pdf["at"], "hit": hit})

    begun = spread.join(F.broadcast(starts.withColumnRenamed("anchor", "start")), "pid", "left")  # one row for each partition at most
    done = begun.select("key", "tie", "at", "start").mapInPandas(scan, f"key {kind}, tie {types['tie']}, at bigint, hit boolean")
    return done.select(F.col("key").alias(key), F.col("tie").alias(tie), F.col("at").alias("at_ms"), F.col("hit").alias(out))


def of_publication(message: Column) -> Column:
    """Whether a line can matter to a publication."""
    return message.contains("npm publish") | message.startswith("npm notice name:") | message.startswith("npm notice shasum:") | message.startswith("+ ")


def publish_sequence(df: DataFrame, sha: str, log_file: str, message: str, at_ms: str, seq: str, ttl_ms: int = 15 * 60_000) -> DataFrame:
    """(sha, seq, step, triggered) of every line that can matter to a package publication, in the order of seq within a sha.

    A line that runs the publish command marks its log file for the time to live; only later lines of the marked file count. The
    line `+ name@version` then is the publication. Lines without a commit or a log file are answered too, by false. A commit with many
    lines is cut into parts of the order, and the last mark of a part is carried into those after it.
    """
    m = F.trim(col(message))
    start = m.contains("##[group]Run") & m.contains("npm publish")
    step = F.when(start, "start").when(m.startswith("npm notice name:"), "name").when(m.startswith("npm notice shasum:"), "shasum").when(m.startswith("+ "), "published")
    wanted = df.where(of_publication(col(message))).select(col(sha).alias("sha"), col(log_file).alias("f"), col(at_ms).cast("bigint").alias("at"), col(seq).alias("seq"), step.alias("step"))
    told = (F.coalesce("sha", F.lit("")) != "") & (F.coalesce("f", F.lit("")) != "")
    spread = durable(wanted.where(told).repartitionByRange("sha", "seq").withColumn("part", F.spark_partition_id()))
    begun = F.when(F.col("step") == "start", F.struct("f", "at"))
    # the last mark of each part of a commit, and of the parts before it
    parts = spread.groupBy("sha", "part").agg(F.max_by(F.struct("f", "at"), F.when(F.col("step") == "start", F.col("seq"))).alias("own"))
    earlier = F.last("own", ignorenulls=True).over(W.partitionBy("sha").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    carried = durable(parts.select("sha", "part", earlier.alias("earlier")).where("earlier IS NOT NULL"))
    within = F.last(begun, ignorenulls=True).over(W.partitionBy("sha", "part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1))
    live = spread.withColumn("mark", within).join(broadcast_if_small(carried, carried.count()), ["sha", "part"], "left").withColumn("mark", F.coalesce("mark", "earlier"))
    open_ = F.coalesce((F.col("mark.f") == F.col("f")) & (F.col("at") < F.col("mark.at") + ttl_ms), F.lit(False))
    found = live.select("sha", "seq", "step", F.coalesce((F.col("step") == "published") & open_, F.lit(False)).alias("triggered"))
    return found.unionByName(wanted.where(~told).select("sha", "seq", "step", F.lit(False).alias("triggered")))
