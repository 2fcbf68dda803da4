import random

import pytest
from pyspark.sql import functions as F

from fieldmill.llm import distinct as D

SCHEMA = "scope string, id string, g int, w0 string"


def data(groups, seed=1):
    rng = random.Random(seed)
    out = []
    for _ in range(5000):
        s = "hot" if rng.random() < 0.5 else rng.choice(["a", "b", None])
        out.append((s, rng.choice([None, f"i{rng.randrange(300)}"]), rng.choice([None, rng.randrange(groups), rng.randrange(3)]), "x"))
    return out + out[:50]


def brute(rows):
    want = {}
    for s, i, g, _ in rows:
        if i is not None:
            want.setdefault((s, -1), set()).add(i)
            if g is not None:
                want.setdefault((s, g), set()).add(i)
    return {k: len(v) for k, v in want.items()}


def counts(df):
    held = D.memberships(df, ["scope"], "id", F.col("g"))
    return {(r.scope, -1 if r["index"] is None else r["index"]): r.n for r in D.per_group(D.totals(held, ["scope"], "id"), ["scope"]).collect()}


def test_per_group_with_one_and_many_words(spark):
    for groups in (1, 63, 200):
        rows = [r for r in data(groups) if r[2] is None or r[2] < groups]
        assert counts(spark.createDataFrame(rows, SCHEMA)) == brute(rows), groups


def test_parts_made_apart_combine(spark):
    rows = data(100, 2)
    df = spark.createDataFrame(rows, SCHEMA)
    a, b = (D.memberships(df.where(F.coalesce(F.col("g"), F.lit(0)) % 2 == k), ["scope"], "id", F.col("g")) for k in (0, 1))
    merged = D.merge(a.unionByName(b), ["scope"], "id")
    assert {(r.scope, -1 if r["index"] is None else r["index"]): r.n for r in D.per_group(D.totals(merged, ["scope"], "id"), ["scope"]).collect()} == brute(rows)
    whole = D.totals(D.merge(merged, [], "id"), [], "id")
    assert D.combination(whole, []).first().n == len({r[1] for r in rows if r[1]})


def test_combinations(spark):
    rows = data(70, 3)
    df = spark.createDataFrame(rows, SCHEMA)
    totals = D.totals(D.memberships(df, ["scope"], "id", F.col("g")), ["scope"], "id").cache()
    held = {}
    for s, i, g, _ in rows:
        if i is not None:
            held.setdefault((s, i), set()).add(g)
    for any_of, all_of, none_of in (([1, 65], [], []), ([], [0, 1], []), ([0], [], [1, 2]), ([1, 2, 3], [64], [0])):
        want = {}
        for (s, _), gs in held.items():
            if (not any_of or gs & set(any_of)) and gs >= set(all_of) and not gs & set(none_of):
                want[s] = want.get(s, 0) + 1
        assert {r.scope: r.n for r in D.combination(totals, ["scope"], any_of, all_of, none_of).collect()} == want


def test_every_combination_of_groups(spark):
    rng = random.Random(4)
    odd = [None, "", "a", "a\x01b", "\x02n", "\x02a", "*"]
    rows = [(rng.choice(["s", None]), rng.choice([None, *(f"i{k}" for k in range(40))]), rng.choice(odd), rng.choice(odd[:4]), rng.choice([None, 3, 64, 19_000])) for _ in range(800)]
    df = spark.createDataFrame(rows, "scope string, id string, a string, b string, g int")
    held = D.memberships(df, ["scope"], "id", F.col("g"), ["a", "b"])
    got = {(r.scope, tuple(r.level), r.a, r.b, r["index"]): r.n for r in D.per_group(D.totals(held, ["scope"], "id", ["a", "b"]), ["scope"], ["a", "b"]).collect()}
    want = {}
    for s, i, a, b, g in rows:
        if i is not None:
            for level in ((), (0,), (1,), (0, 1)):
                for at in {None, g}:
                    want.setdefault((s, level, a if 0 in level else None, b if 1 in level else None, at), set()).add(i)
    assert got == {k: len(v) for k, v in want.items()}


def test_empty_far_and_long(spark):
    assert counts(spark.createDataFrame([], SCHEMA)) == {}
    assert counts(spark.createDataFrame([("s", "i", 2_932_896, "x")], SCHEMA)) == {("s", -1): 1, ("s", 2_932_896): 1}
    long = "i" * 100_000
    assert counts(spark.createDataFrame([("s", long, 1, "x"), ("s", "", 1, "x")], SCHEMA)) == {("s", -1): 2, ("s", 1): 2}


def test_taken_names_are_refused(spark):
    df = spark.createDataFrame([("s", "i", 1, "x")], "word string, id string, g int, n string")
    for scope, identifier, groups in ((["word"], "id", []), ([], "n", []), ([], "id", ["word"])):
        with pytest.raises(ValueError, match="rename"):
            D.memberships(df, scope, identifier, F.col("g"), groups)
    assert D.memberships(df, [], "id", F.col("g")).count() == 1


def test_blank_and_far_days_change_no_other_count(spark, tmp_path):
    from __spark_entry__ import queries

    schema = "`id.orig_h` string, `id.resp_h` string, community_id string, service string, _system_name string, ts string"
    rows = [(f"h{i % 3}", f"p{i}", f"c{i}", "dns", "s", f"2024-10-{20 + i % 5}T00:00:00Z") for i in range(40)]
    odd = [("h0", "q", "cq", "dns", "s", ""), ("h0", "q", "cr", "dns", "s", "9999-12-31T00:00:00Z"), ("h0", "q", "cs", "dns", "s", None), ("h0", "q", "ct", "dns", "s", "soon")]
    found = []
    for name, held in (("a", rows), ("b", rows + odd)):
        spark.createDataFrame(held, schema).write.parquet(f"{tmp_path}/{name}/conn.parquet")
        found.append({tuple(r[:4]): r[4] for r in queries()["p5_counts"](spark, f"{tmp_path}/{name}").collect()})
    a, b = found
    assert all(b[k] == n for k, n in a.items() if k[3] != "*") and {k[3] for k in b} - {k[3] for k in a} == {"9999-12-31"}
    assert b["resp_h", "*", "*", "*"] == a["resp_h", "*", "*", "*"] + 1 and b["community_id", "dns", "s", "*"] == a["community_id", "dns", "s", "*"] + 4


def test_hosts_are_counted_by_service_and_sensor(spark, tmp_path):
    rows = [("h", "p1", "c1", "dns", "s", "2024-10-20T00:00:00Z"), ("h", "p1", "c2", "dns", "t", "2024-10-21T00:00:00Z"), ("h", "p2", None, None, "s", "2024-10-21T00:00:00Z"), (None, "p1", "c1", "dns", "s", "2024-10-21T00:00:00Z")]
    spark.createDataFrame(rows, "`id.orig_h` string, `id.resp_h` string, community_id string, service string, _system_name string, ts string").write.parquet(f"{tmp_path}/conn.parquet")
    from __spark_entry__ import queries

    got = {tuple(r[:5]): r[5] for r in queries()["p5_hosts"](spark, str(tmp_path)).collect()}
    assert got["resp_h", "h", "*", "*", "*"] == 2 and got["resp_h", "h", "dns", "*", "*"] == 1 and got["resp_h", "h", "*", "s", "*"] == 2
    assert got["resp_h", "h", "*", "*", "2024-10-21"] == 2 and got["resp_h", "h", "(none)", "s", "2024-10-21"] == 1 and got["community_id", "h", "*", "*", "*"] == 2
    assert got["resp_h", "(none)", "*", "*", "*"] == 1
