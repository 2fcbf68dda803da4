import random

from pyspark.sql import functions as F

from fieldmill.operators.sessions import sessions


def brute(rows, gap):
    out = []
    for key in {r[0] for r in rows}:
        if key is None:
            continue
        held = None
        for _, s, e in sorted((r for r in rows if r[0] == key and r[1] is not None and r[2] is not None), key=lambda r: r[1]):
            if held is None or s > held[2] + gap:
                if held:
                    out.append(tuple(held))
                held = [key, s, e, 1]
            else:
                held[2], held[3] = max(held[2], e), held[3] + 1
        if held:
            out.append(tuple(held))
    return sorted(out)


def run(spark, rows, gap):
    df = spark.createDataFrame(rows, "k string, s bigint, e bigint")
    return sorted(tuple(r) for r in sessions(df, F.col("k"), F.col("s"), F.col("e"), gap).collect())


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(4000):
        key = "hot" if rng.random() < 0.4 else f"h{rng.randrange(60)}"
        s = rng.randrange(0, 400_000)
        rows.append((key, s, s + (rng.randrange(0, 5000) if rng.random() < 0.1 else rng.randrange(0, 40))))
    rows += [(None, 1, 2), ("h1", None, 2), ("h1", 3, None)]
    assert run(spark, rows, 30) == brute(rows, 30)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert run(spark, rows, 30) == brute(rows, 30)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_exact_gap_long_cover_ties_and_empty(spark):
    assert run(spark, [("a", 0, 10), ("a", 40, 41), ("a", 72, 80)], 30) == [("a", 0, 41, 2), ("a", 72, 80, 1)]
    assert run(spark, [("a", 0, 1000), ("a", 5, 6), ("a", 900, 901), ("a", 1030, 1031), ("b", 1030, 1031)], 30) == [("a", 0, 1031, 4), ("b", 1030, 1031, 1)]
    assert run(spark, [("a", 5, 5)] * 50, 30) == [("a", 5, 5, 50)]
    assert run(spark, [], 30) == []


def test_a_batch_of_many_keys_over_twenty_years(spark):
    first, last = 1_262_304_000_000_000, 1_893_456_000_000_000
    df = spark.range(10_000).selectExpr("string(id) AS k", f"{first} + id * {(last - first) // 10_000} AS t")
    df = df.unionByName(df.selectExpr("k", "t + 1000 AS t")).unionByName(df.selectExpr("k", f"{last} AS t"))
    got = sessions(df.coalesce(1), F.col("k"), F.col("t"), F.col("t"), 1000).collect()
    assert len(got) == 20_000 and sorted({r.n for r in got}) == [1, 2]
