import json
import random

from pyspark.sql import functions as F

from fieldmill.operators.nested import flat_tables, json_triples, pivot_table, stream_records, typed_table

LISTS = ("id.vals", "spcap.rule", "unmapped.spcap.rule", "observables")


def triples(spark, payloads, **more):
    df = spark.createDataFrame(list(enumerate(payloads)), "k int, p string")
    rows = json_triples(df, "k", "p", LISTS, ("unmapped",), **more).collect()
    return sorted((int(r.key), r.rec_pos, r.path, tuple(r.ordinals), r.value or "~") for r in rows)


def test_records_lists_and_envelopes(spark):
    got = triples(spark, ['{"a":1}', '[{"a":1},7,null,{"a":2.50}]', '{"records":[{"a":"x"}],"sent":1}', '{"data":{"items":{"a":true}}}', '{"records":null}', "[]", "3", "", None, '{"a":', '{"a":NaN}'])
    assert got == [(0, 0, "a", (), "1"), (1, 0, "a", (), "1"), (1, 3, "a", (), "2.50"), (2, 0, "a", (), "x"), (3, 0, "a", (), "true")]


def test_literal_key_wins_even_if_null(spark):
    both = '{"id.vals":null,"id":{"vals":["n"],"h":1}}'
    assert triples(spark, [both]) == [(0, 0, "id.h", (), "1"), (0, 0, "id.vals", (), "~")]
    assert triples(spark, ['{"id":{"vals":["n",null]}}']) == [(0, 0, "id.vals[]", (0,), "n"), (0, 0, "id.vals[]", (1,), "~")]
    assert triples(spark, ['{"id.vals":"lone"}']) == [(0, 0, "id.vals[]", (0,), "lone")]


def test_text_inside_text_and_keep(spark):
    doc = json.dumps({"unmapped": json.dumps({"spcap": {"rule": [4, None]}, "x": 1}), "observables": [None, {"reputation": {"score_id": "3"}}, {"reputation": None}]})
    got = triples(spark, [doc], keep=["unmapped.spcap.rule[]", "observables[].reputation.score_id"])
    assert got == [(0, 0, "observables[].reputation.score_id", (1,), "3"), (0, 0, "unmapped.spcap.rule[]", (0,), "4"), (0, 0, "unmapped.spcap.rule[]", (1,), "~")]
    assert triples(spark, ['{"unmapped":"plain"}']) == [(0, 0, "unmapped", (), "plain")]


def test_deep_arrays_link_to_their_parent(spark):
    df = spark.createDataFrame([(1, '{"a":[{"b":[{"c":1},{"c":2}]},{"b":[]},{"b":[{"c":3}],"n":"x"}]}'), (2, "[" * 5000)], "k int, p string")
    rows = json_triples(df, "k", "p")
    inner = sorted((tuple(r.ordinals), r.c) for r in pivot_table(rows, "a[].b[]", ["a[].b[].c"]).collect())
    assert inner == [((0, 0), "1"), ((0, 1), "2"), ((2, 0), "3")]
    assert [(tuple(r.ordinals), r.n) for r in pivot_table(rows, "a[]", ["a[].n"]).collect()] == [((2,), "x")]


def test_typed(spark):
    df = spark.createDataFrame([(1, [None, ("a", (5,))]), (2, []), (3, None)], "k int, a array<struct<n string, r struct<s int>>>")
    got = typed_table(df, {"k": F.col("k")}, F.col("a"), {"n": "n", "s": "r.s"}).collect()
    assert sorted(((r.k, r.pos, r.n or "~", r.s or 0) for r in got)) == [(1, 0, "~", 0), (1, 1, "a", 5)]


def test_paths_found_are_grouped_by_their_ancestor(spark):
    df = spark.createDataFrame([(1, '{"u":"x","o":[{"s":1,"t":"a"},null,{"s":2}],"v":["n"]}')], "k int, p string")
    found = flat_tables(json_triples(df, "k", "p"))
    assert set(found) == {"", "o[]", "v[]"} and found[""].first().u == "x"
    assert sorted((r.ordinals[0], r.s, r.t or "~") for r in found["o[]"].fillna("~").collect()) == [(0, "1", "a"), (1, "~", "~"), (2, "2", "~")]
    assert [(r.ordinals[0], r.value) for r in found["v[]"].collect()] == [(0, "n")]


def test_raw_names_and_rules(spark, tmp_path):
    payload = '[{"id.orig_h_name.vals":["a",null]},{"spcap.rule":7,"unmapped":{"spcap":{"rule":[8]}}}]'
    spark.createDataFrame([(5, payload)], "raw_id long, payload string").write.parquet(f"{tmp_path}/conn_raw.parquet")
    from fieldmill.queries.records import QUERIES

    names = sorted(tuple(r) for r in QUERIES["p4_raw_names"](spark, str(tmp_path)).fillna("~").collect())
    assert names == [("5", 0, 0, "a"), ("5", 0, 1, "~")]
    assert sorted(tuple(r) for r in QUERIES["p4_raw_rules"](spark, str(tmp_path)).collect()) == [("5", 1, "spcap", 0, "7"), ("5", 1, "unmapped.spcap", 0, "8")]


def plainly(text):
    """The records of a payload from a parse of all of it, or None if it is no JSON."""
    try:
        d = json.loads(text)
    except ValueError:
        return None
    if isinstance(d, dict):
        for found in ([d["records"]] if "records" in d else []), ([d["data.items"]] if "data.items" in d else [d["data"]["items"]] if isinstance(d.get("data"), dict) and "items" in d["data"] else []):
            if found:
                return found[0] if isinstance(found[0], list) else [] if found[0] is None else found
        return [d]
    return d if isinstance(d, list) else []


def test_streamed_records_are_those_of_a_whole_parse():
    pick = random.Random(5)

    def value(depth=0):
        kind = pick.randrange(9 if depth < 3 else 5)
        if kind < 5:
            return (None, True, 12, "a]b}c{\\", 'q"\\u00e9,:')[kind]
        return [value(depth + 1) for _ in range(pick.randrange(4))] if kind < 7 else {pick.choice(("a", "records", "data", "items", "data.items", "x.y")): value(depth + 1) for _ in range(pick.randrange(4))}

    for _ in range(3000):
        text = json.dumps(value(), indent=pick.choice((None, 1)), ensure_ascii=pick.random() < 0.5)
        if pick.random() < 0.3 and text:
            at = pick.randrange(len(text))
            text = text[:at] + pick.choice(("", "}", ",", '"', " x")) + text[at + pick.randrange(2) :]
        try:
            got = list(stream_records(text))
        except (ValueError, IndexError):
            got = None
        assert got == plainly(text), text
    assert list(stream_records('{"records":[1],"records":[{"a":2}]}')) == [{"a": 2}] and list(stream_records('{"r\\u0065cords":[3]}')) == [3]
