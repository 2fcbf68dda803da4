"""Percentiles per group of very large numeric columns by exact bisection, many midpoints at a time.

Every group and percentile has an interval of values known to hold its target rank. A pass counts the rows that fall between the
midpoints of the open intervals; the counts show the part that holds the rank, and the interval narrows to the smallest and
largest value seen in that part. An interval is resolved when both are equal, and then the result is exact.

The first pass uses midpoints common to all groups, spaced evenly in the logarithm of the value. Its counts, the state, are
therefore combinable: states of days, files or partitions are added up (`merge_states`), also over groups that are not named. A state alone
bounds each percentile to one cell, whose ends are values of the data and lie within a factor of 2**(1/CELLS) of each other (0.55 %);
further passes over the rows narrow that down to the value itself.

The rows are read twice: for the state, and to write those that lie in a cell with an open interval, a few in a hundred, equal values as one.
Further passes read only these. Counts are added up on the map side, so a group with a third of all rows costs its share of the scan
and no more than its cells in the shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, broadcast_if_small, col, durable

#: Cells of the first pass per doubling of the value.
CELLS = 128
#: Parts of an interval counted in one further pass.
PARTS = 4096
#: Cells of values that have no logarithm.
_ZERO, _TINY = -1_000_000, 2.2250738585072014e-308


def _cell(v: Column) -> Column:
    """The first-pass cell of a value; never falls as v rises. Negative values mirror the positive ones below the cell of zero."""
    up = F.floor(F.log2(F.greatest(F.abs(v), F.lit(_TINY))) * CELLS).cast("bigint") + 200_000
    return F.when(v == 0, 0).otherwise(F.when(v > 0, up).otherwise(-up))


def finite(v: Column) -> Column:
    """v as a double if it is a finite number, else null."""
    d = v.cast("double")
    return F.when((d > float("-inf")) & (d < float("inf")), d + F.lit(0.0))


def state(rows: DataFrame, groups: list[str], value: str) -> DataFrame:
    """The combinable state of rows: groups, cell, n, low, high. Null, NaN and infinite values are left out; a null group counts as a group."""
    rows = rows.select(*(col(g) for g in groups), finite(col(value)).alias("__v")).where(F.col("__v").isNotNull())
    return rows.groupBy(*(col(g) for g in groups), _cell(F.col("__v")).alias("cell")).agg(F.count("*").alias("n"), F.min("__v").alias("low"), F.max("__v").alias("high"))


def merge_states(states: DataFrame, groups: list[str]) -> DataFrame:
    """One state out of several under one another; also adds up over groups that are not named."""
    return states.groupBy(*(col(g) for g in groups), "cell").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def intervals(merged: DataFrame, groups: list[str], at: list[float]) -> DataFrame:
    """groups, q, n (rows of the group), rank, below (rows under the interval), inside (rows in it), low, high, cell.

    The rank is the smallest whole number of at least q * n, and at least 1: the percentile is the value of that rank.
    """
    keys = [col(g) for g in groups]
    ordered = W.partitionBy(*keys).orderBy("cell")
    cells = merged.select("*", F.sum("n").over(ordered).alias("__upto"), F.sum("n").over(W.partitionBy(*keys)).alias("__all"))
    wanted = cells.select("*", F.explode(F.array(*(F.lit(float(q)) for q in at))).alias("q"))
    rank = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("q") * F.col("__all")))
    wanted = wanted.withColumn("rank", rank).where((F.col("rank") <= F.col("__upto")) & (F.col("rank") > F.col("__upto") - F.col("n")))
    return wanted.select(*keys, "q", F.col("__all").alias("n"), "rank", (F.col("__upto") - F.col("n")).alias("below"), F.col("n").alias("inside"), "low", "high", "cell")


def _narrowed(rows: DataFrame, open_: DataFrame, groups: list[str], small: bool) -> DataFrame:
    """open_ with each interval narrowed by one pass over rows (groups, __v, cell)."""
    named = {g: f"__t{i}" for i, g in enumerate(groups)}
    targets = open_.select(*(col(g).alias(a) for g, a in named.items()), "q", "rank", "below", F.col("low").alias("__low"), F.col("high").alias("__high"), F.col("cell").alias("__cell"))
    if small:
        targets = F.broadcast(targets)
    match = F.col("cell") == F.col("__cell")
    for g, a in named.items():
        match &= col(g).eqNullSafe(F.col(a))
    met = rows.join(targets, match & (F.col("__v") >= F.col("__low")) & (F.col("__v") <= F.col("__high")))
    # halves keep the width finite for the widest intervals; rounding never lets a larger value fall into a lower part
    width = F.col("__high") / 2 - F.col("__low") / 2
    part = F.least(F.lit(PARTS - 1).cast("bigint"), F.floor((F.col("__v") / 2 - F.col("__low") / 2) / width * PARTS).cast("bigint"))
    keys = [F.col(a) for a in named.values()] + [F.col("q")]
    parts = met.groupBy(*keys, "rank", "below", "__cell", part.alias("__part")).agg(F.sum("__w").alias("inside"), F.min("__v").alias("low"), F.max("__v").alias("high"))
    upto = F.col("below") + F.sum("inside").over(W.partitionBy(*keys).orderBy("__part"))
    parts = parts.withColumn("__upto", upto).where((F.col("rank") <= F.col("__upto")) & (F.col("rank") > F.col("__upto") - F.col("inside")))
    return parts.select(*(F.col(a).alias(g) for g, a in named.items()), "q", "rank", (F.col("__upto") - F.col("inside")).alias("below"), "inside", "low", "high", F.col("__cell").alias("cell"))


def _inside(rows: DataFrame, open_: DataFrame, groups: list[str]) -> DataFrame:
    """The rows (groups, __v, __w, cell) that lie in a cell with an open interval, equal values of a group as one; written once for all further passes."""
    named = {g: f"__c{i}" for i, g in enumerate(groups)}
    cells = durable(open_.select(*(col(g).alias(a) for g, a in named.items()), F.col("cell").alias("__cell")).distinct())
    match = F.col("cell") == F.col("__cell")
    for g, a in named.items():
        match &= col(g).eqNullSafe(F.col(a))
    met = rows.join(broadcast_if_small(cells, cells.count()), match, "left_semi")
    return durable(met.groupBy(*(col(g) for g in groups), "cell", "__v").agg(F.sum("__w").alias("__w")))


def percentiles(rows: DataFrame, groups: list[str], value: str, at: list[float], merged: DataFrame | None = None, passes: int | None = None, tolerance: float = 0.0) -> DataFrame:
    """groups, q, n, low, high: the percentile of each group and q lies between low and high, both values of the data.

    Rows are those of `rows`; null, NaN and infinite values are left out, a null group is a group of its own, repeated rows count
    each, other columns are ignored, an empty table gives an empty one. With the defaults low = high, the exact value. Otherwise
    narrowing stops after `passes` further passes, or where high - low is at most `tolerance` of the larger size, and the interval
    is the error bound. `merged` is a state of these rows made before. Groups with no valid value give no row. The rank is
    ceil(q * n), at least 1.
    """
    keys = [col(g) for g in groups]
    base = merged if merged is not None else state(rows, groups, value)
    found = durable(intervals(base, groups, at))
    sizes = found.select(*keys, "q", "n")
    live = rows.select(*keys, finite(col(value)).alias("__v"), F.lit(1).cast("bigint").alias("__w")).where(F.col("__v").isNotNull())
    live = live.withColumn("cell", _cell(F.col("__v")))
    unresolved = (F.col("high") - F.col("low")) > tolerance * F.greatest(F.abs("high"), F.abs("low"))
    unresolved |= F.col("high") - F.col("low") == float("inf")
    done, now, turn = [], found.drop("n"), 0
    while True:
        done.append(now.where(~unresolved))
        open_ = now.where(unresolved)
        left = open_.count() if passes is None or turn < passes else 0
        if not left:
            done[-1] = now
            break
        if turn == 0:
            live = _inside(live, open_, groups)
        now = durable(_narrowed(live, open_, groups, left <= BROADCAST_ROWS))
        turn += 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    match = F.lit(True)
    right = broadcast_if_small(sizes.select(*(col(g).alias(f"__s{i}") for i, g in enumerate(groups)), F.col("q").alias("__sq"), "n"), found.count())
    for i, g in enumerate(groups):
        match &= col(g).eqNullSafe(F.col(f"__s{i}"))
    out = out.join(right, match & (F.col("q") == F.col("__sq")))
    return out.select(*keys, "q", "n", "low", "high")


def bound() -> float:
    """The relative width of a first-pass cell: the error bound of a state alone."""
    return math.pow(2, 1 / CELLS) - 1
