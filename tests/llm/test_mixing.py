import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from fieldmill.llm import mixing as M


def slow(weights, seats, caps=None):
    caps = caps or [10**9] * len(weights)
    got = [0] * len(weights)
    for _ in range(seats):
        live = [i for i, w in enumerate(weights) if w > 0 and got[i] < caps[i]]
        if not live:
            break
        best = max(live, key=lambda i: (Fraction(weights[i]) / (2 * got[i] + 1), -i))
        got[best] += 1
    return got


def test_apportionment_against_the_plain_rule():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randrange(1, 9)
        weights = [float(rng.choice([0, 1, 1, rng.randrange(1, 60), rng.random()])) for _ in range(n)]
        caps = [rng.choice([0, 3, 40, 10**6]) for _ in range(n)] if rng.random() < 0.5 else None
        seats = rng.randrange(0, 400)
        assert M.sainte_lague(weights, seats, caps) == slow(weights, seats, caps), (weights, seats, caps)
    assert M.sainte_lague([], 5) == [] and M.sainte_lague([0.0], 5) == [0] and sum(M.sainte_lague([1.0, 2.0], 10**7)) == 10**7


TARGETS = "mix string, source string, weight double, max_repeats int"


def make(spark, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(6000):
        s = "big" if rng.random() < 0.6 else rng.choice(["mid", "mid", "small", None, "unused"]) if rng.random() < 0.9 else "tiny"
        rows.append((i, s, rng.choice([0, None, 5, 50, 300, 900]) if rng.random() < 0.3 else rng.randrange(20, 400)))
    return spark.createDataFrame(rows, "doc long, source string, n_tokens long")


def test_shares_are_met(spark):
    docs = make(spark).cache()
    targets = spark.createDataFrame([("m", "big", 2.0, 1), ("m", "mid", 1.0, 3), ("m", "small", 1.0, None), ("m", "zero", 1.0, 2), ("m", "tiny", 0.0, 9), ("n", "tiny", 1.0, 2), ("n", "big", 9.0, None), (None, "big", 1.0, 1), ("n", "big", None, 7)], TARGETS)
    chosen = M.select(docs, targets, total_tokens=300_000, shard_tokens=20_000).cache()
    rows = {(r.mix, r.source): r for r in M.shares(chosen, docs, targets, total_tokens=300_000).collect()}
    assert abs(rows["m", "big"].share - 0.5) < 0.01 and abs(rows["m", "mid"].share - 0.25) < 0.01 and abs(rows["m", "small"].share - 0.25) < 0.01
    assert rows["m", "zero"].used_tokens == 0 and rows["m", "tiny"].used_tokens == 0 and abs(rows["m", "big"].target_share - 0.4) < 1e-9
    held = {s: n for s, n in docs.where("n_tokens > 0").groupBy("source").sum("n_tokens").collect()}
    tiny = rows["n", "tiny"]
    assert tiny.used_tokens <= 2 * held["tiny"] and tiny.repeats <= 2.0
    assert chosen.where("copies > 7").count() == 0 and chosen.where("mix = 'm' and source = 'big' and copies > 1").count() == 0
    assert chosen.groupBy("mix", "doc").count().where("count > 1").count() == 0 and chosen.where("source is null or n_tokens = 0").count() == 0


def test_the_same_whatever_the_partitioning(spark):
    docs, targets = make(spark, 2), spark.createDataFrame([("m", "big", 1.0, 1), ("m", "tiny", 1.0, 4)], TARGETS)
    a, b = (sorted(map(tuple, M.select(d, targets, total_tokens=50_000, shard_tokens=9_000).collect())) for d in (docs.repartition(1), docs.repartition(7)))
    other = sorted(map(tuple, M.select(docs, targets, seed=8, total_tokens=50_000, shard_tokens=9_000).collect()))
    assert a == b and a != other


def test_empty_and_capped(spark):
    docs, targets = make(spark, 3), spark.createDataFrame([("m", "big", 1.0, 0), ("m", "tiny", float("nan"), 4)], TARGETS)
    assert M.select(docs, targets).count() == 0 and M.select(docs.limit(0), targets).count() == 0 and M.select(docs, targets.limit(0)).count() == 0
    assert {r.share for r in M.shares(M.select(docs, targets), docs, targets).collect()} == {0.0}
    all_ = M.select(docs, spark.createDataFrame([("m", "tiny", 1.0, 3)], TARGETS), total_tokens=10**9)
    tiny = docs.where("source = 'tiny' and n_tokens > 0")
    assert all_.where("copies = 3").count() == tiny.count() == all_.count()


def test_tokens_are_counted(spark):
    df = spark.createDataFrame([(1, "s", "one two three"), (2, None, None), (3, "s", "")], "doc_id long, source string, text string")
    assert {r.doc: r.n_tokens for r in M.sized(df, "doc_id", "source", "text").collect()} == {1: 3, 2: 0, 3: 0}


@pytest.mark.parametrize("total", [0, 1])
def test_tiny_totals(spark, total):
    docs, targets = make(spark, 5), spark.createDataFrame([("m", "big", 1.0, 1)], TARGETS)
    assert M.select(docs, targets, total_tokens=total).agg(F.sum("copies")).first()[0] in (None, 1)
