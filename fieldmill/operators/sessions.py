"""Sessions: runs of activity of one key, cut where a gap of inactivity is longer than a limit.

Rows are range partitioned and sorted by key, start and tie-breaker, so a key with a third of all rows is spread over many
partitions. One linear scan per partition keeps nothing but the open session and emits pieces. A session that runs across a
partition border leaves one piece on either side; pieces of a key lie more than the gap apart within a partition, so their number
is bounded by the time covered, not by the rows. A second sort and scan of the pieces by key joins them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SCHEMA = "key string, start_us bigint, end_us bigint, n bigint"
_ARROW = pa.schema([("key", pa.string()), ("start_us", pa.int64()), ("end_us", pa.int64()), ("n", pa.int64())])


def _scan(gap_us: int):
    """A scan over sorted batches of (key, start_us, end_us, n) that emits one row for each session met, holding one open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # key, start, end, n of the session still open
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).dictionary_encode()
            code = keys.indices.to_numpy(zero_copy_only=False)
            start, end, n = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (1, 2, 3))
            words = keys.dictionary
            new_key = np.empty(len(code), bool)
            new_key[0] = True
            np.not_equal(code[1:], code[:-1], out=new_key[1:])
            first = 0 if held is not None and words[code[0]].as_py() == held[0] else None
            joins = first == 0 and start[0] <= held[2] + gap_us
            # latest end so far within each key: the ranks of the ends are shifted into disjoint ranges by the key's order, then accumulated
            reach = end.copy()
            if first == 0:
                reach[0] = max(reach[0], held[2])
            values, rank = np.unique(reach, return_inverse=True)
            base = (np.cumsum(new_key) - 1) * len(values)
            latest = values[np.maximum.accumulate(rank + base) - base]
            opens = new_key.copy()
            opens[1:] |= ~new_key[1:] & (start[1:] > latest[:-1] + gap_us)
            if first == 0:
                opens[0] = not joins
            at = np.flatnonzero(opens)
            counts = np.add.reduceat(n, at) if len(at) else np.empty(0, np.int64)
            tops = np.maximum.reduceat(end, at) if len(at) else np.empty(0, np.int64)
            lead = at[0] if len(at) else len(code)
            if lead:  # rows that go on with the held session
                held = (held[0], held[1], max(held[2], int(end[:lead].max())), held[3] + int(n[:lead].sum()))
            if not len(at):
                continue
            out_key = [words[code[i]].as_py() for i in at]
            rows = list(zip(out_key, start[at].tolist(), tops.tolist(), counts.tolist()))
            done, held = ([held] if held is not None else []) + rows[:-1], rows[-1]
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*done), _ARROW)], schema=_ARROW)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(held, _ARROW)], schema=_ARROW)

    return run


def sessions(df: DataFrame, key: Column, start_us: Column, end_us: Column, gap_us: int, tie: Column | None = None) -> DataFrame:
    """(key string, start_us, end_us, n): one row per session.

    In the order of start, a row opens a new session of its key if it starts more than gap_us after the latest end so far of the
    key; exactly gap_us after is not more. Rows with a null key, start or end are left out; repeated rows count each; rows that
    end before they start keep both values. An empty table gives an empty one. `tie` only spreads rows of equal key and start.
    """
    rows = df.select(key.cast("string").alias("key"), start_us.alias("start_us"), end_us.alias("end_us"), F.lit(1).cast("bigint").alias("n"), (tie if tie is not None else F.lit(0)).alias("tie"))
    rows = rows.where(F.col("key").isNotNull() & F.col("start_us").isNotNull() & F.col("end_us").isNotNull())
    spread = rows.repartitionByRange("key", "start_us", "tie").sortWithinPartitions("key", "start_us", "tie")
    pieces = spread.drop("tie").mapInArrow(_scan(gap_us), _SCHEMA)
    return pieces.repartition("key").sortWithinPartitions("key", "start_us", "end_us").mapInArrow(_scan(gap_us), _SCHEMA)
