import math
import random

import pytest
from pyspark.sql import functions as F

from fieldmill.llm import percentiles as P


def exact(values, q):
    values = sorted(values)
    return values[max(1, math.ceil(q * len(values))) - 1]


def rows(seed=1):
    rng = random.Random(seed)
    out = []
    for _ in range(6000):
        g = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", None])
        v = rng.choice([rng.lognormvariate(0, 3), rng.random() * 1e-9, 0.0, float(rng.randrange(5)), -rng.random(), rng.random() * 1e300, None, float("nan"), float("inf"), float("-inf")])
        out.append((g, rng.choice(["d1", "d2"]), v, "x"))
    return out + [("ties", "d1", 7.0, "x")] * 500 + [("one", "d1", 3.0, "x"), ("none", "d1", None, "x")]


AT = [0.0, 0.01, 0.5, 0.95, 1.0]


def wanted(data, key):
    groups = {}
    for r in data:
        if r[2] is not None and math.isfinite(r[2]):
            groups.setdefault(key(r), []).append(r[2])
    return {(g, q): (exact(v, q), len(v)) for g, v in groups.items() for q in AT}


SCHEMA = "g string, day string, v double, n string"  # n clashes with a column of the result


def test_exact_against_brute_force(spark):
    data = rows()
    got = P.percentiles(spark.createDataFrame(data, SCHEMA), ["g"], "v", AT).collect()
    assert {(r.g, r.q): (r.low, r.n) for r in got} == wanted(data, lambda r: r[0]) and all(r.low == r.high for r in got)


def test_shuffled_targets_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(P, "BROADCAST_ROWS", 0)
    data = rows(2)
    got = P.percentiles(spark.createDataFrame(data, SCHEMA), ["g", "day"], "v", AT).collect()
    assert {((r.g, r.day), r.q): (r.low, r.n) for r in got} == wanted(data, lambda r: (r[0], r[1]))


def test_states_combine_and_bound(spark):
    data = rows(3)
    df = spark.createDataFrame(data, SCHEMA)
    days = [P.state(df.where(F.col("day") == d), ["g", "day"], "v") for d in ("d1", "d2")]
    merged = P.merge_states(days[0].unionByName(days[1]), ["g"])
    want = wanted(data, lambda r: r[0])
    for r in P.intervals(merged, ["g"], AT).collect():
        assert r.low <= want[r.g, r.q][0] <= r.high and r.n == want[r.g, r.q][1]
        if r.low > 1e-300:
            assert r.high / r.low <= 1 + P.bound() + 1e-9
    got = P.percentiles(df, ["g"], "v", AT, merged=merged).collect()
    assert {(r.g, r.q): (r.low, r.n) for r in got} == want


def test_bounded_work(spark):
    data = rows(4)
    df, want = spark.createDataFrame(data, SCHEMA), wanted(rows(4), lambda r: r[0])
    for r in P.percentiles(df, ["g"], "v", AT, passes=0).collect() + P.percentiles(df, ["g"], "v", AT, tolerance=0.01).collect():
        assert r.low <= want[r.g, r.q][0] <= r.high


def test_empty_and_long_values(spark):
    assert P.percentiles(spark.createDataFrame([], SCHEMA), ["g"], "v", AT).count() == 0
    wide = spark.createDataFrame([("a", "d", x, "x") for x in (-1.7e308, 1.7e308, 5e-324, -5e-324, 0.0)], SCHEMA)
    got = {r.q: r.low for r in P.percentiles(wide, ["g"], "v", [0.2, 0.5, 0.8, 1.0]).collect()}
    assert got == {0.2: -1.7e308, 0.5: 0.0, 0.8: 5e-324, 1.0: 1.7e308}


@pytest.mark.parametrize("a,b", [(1.0, 1.0000001), (0.0, 5e-324), (-2.0, -1.0), (-1e-308, 0.0), (3.999, 4.001)])
def test_cells_never_fall(spark, a, b):
    x, y = spark.createDataFrame([(a,), (b,)], "v double").select("v", P._cell(F.col("v")).alias("c")).orderBy("v").collect()
    assert x.c <= y.c
