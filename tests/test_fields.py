"""Paths, scalars, predicates and selectors, against the plain Python reading of the same documents."""

import json

import pytest
from pyspark.sql import functions as F

from fieldmill.functions import scalars as S
from fieldmill.functions.logview import LogView
from fieldmill.functions.paths import access, segments
from fieldmill.operators.predicates import Eq, Gt, Has, In, Prefix, Regex, Selector, java_pattern, matches, necessary

DOCS = [
    {"a.b": 1, "a": {"b": 2}}, {"a.b": None, "a": {"b": 2}}, {"a": {"b": 2, "b.c": 3}}, {"a": [1, [2, 3], {"b": "x"}]}, {"a": "text", "": "empty"}, {"a": None}, {"a": {}}, {"a": []},
    {"a": 5}, {"a": 5.0}, {"a": 5e0}, {"a": -0.0}, {"a": 2**63 - 1}, {"a": 2**63}, {"a": 2**64 - 1}, {"a": True}, {"a": "5"}, {"a": "é\n"}, {"a": {"b": [None, {"c": 1}], "k": "v", "n": None, "l": [1]}}, {"x": 1},
    {"a": 0.1 + 0.2}, {"a": -3}, {"a": ["s", 1, 2.5, True, None, {}, []]}, {"a": {"": 1}}, {'q"q': 1}, {"a": 1e300},
]
PATHS = ["a", "a.b", "a[0]", "a[1][1]", "a[2].b", "a[9]", "a[x]", "a[-1]", "a[0]zz", "[0]", "", "a.", "a.b[1].c", "a.b.c", "x", "a.n"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, json.dumps(d, ensure_ascii=False)) for i, d in enumerate(DOCS)] + [(100, "[1,2]"), (101, '"text"'), (102, "7")]
    return spark.createDataFrame(rows, "i int, raw string").withColumn("v", F.try_parse_json("raw")).cache()


def views():
    return {i: LogView(json.dumps(d, ensure_ascii=False)) for i, d in enumerate(DOCS)} | {100: LogView("[1,2]"), 101: LogView('"text"'), 102: LogView("7")}


def test_segments():
    assert segments("a[0][1].b") == ["a", 0, 1, "b"] and segments("a[x]") is None and segments("a[0]zz") == ["a", 0] and segments("[0]") == ["", 0]


@pytest.mark.parametrize("path", PATHS)
def test_readings_agree_with_python(docs, path):
    v = F.col("v")
    x = access(v, path)
    got = {r.i: r for r in docs.select("i", S.has(v, path).alias("has"), S.string(x).alias("s"), S.bigint(x).alias("n"), S.double(x).alias("d"), S.boolean(x).alias("b"), S.length(v, path).alias("len"), S.keys(v, path).alias("keys"), S.string_list(v, path).alias("list")).collect()}
    for i, view in views().items():
        r, want = got[i], view.get(path)
        assert r.has == view.has(path), (i, path)
        assert r.s == (want if isinstance(want, str) else None)
        assert r.b == (want if isinstance(want, bool) else None)
        assert r.n == (want if isinstance(want, int) and not isinstance(want, bool) else None), (i, path, r.n)
        assert r.d == (want if isinstance(want, float) else None), (i, path, r.d)
        assert r.len == view.len(path)
        assert r["keys"] == view.keys(path)
        assert (r.list is None) == (view.get_list(path) is None) and len(r.list or []) == len(view.get_list(path) or [])


def holds(docs, predicate):
    return {r.i for r in docs.where(matches([Selector(all=(predicate,))], F.col("v"))).collect()}


def test_predicates(docs):
    at = lambda *values: {i for i, d in enumerate(DOCS) if any(d.get("a") == x and type(d.get("a")) is type(x) for x in values)}
    assert holds(docs, Eq("a", 5)) == at(5, 5.0) == holds(docs, Eq("a", 5.0))
    assert holds(docs, Eq("a", "5")) == at("5") and holds(docs, Eq("a", True)) == at(True)
    assert holds(docs, Eq("a", 0.3)) == {20} and holds(docs, Eq("a", 0)) == {11}
    assert holds(docs, In("a", ("5", 5, "text"))) == at("5", 5, 5.0, "text") and holds(docs, In("a", ())) == set()
    assert holds(docs, Prefix("a", "te")) == at("text") and holds(docs, Prefix("a", "")) == at("text", "5", "é\n")
    assert holds(docs, Gt("a", 4.5)) == {8, 9, 10, 12, 25} and holds(docs, Gt("a", -4.0)) >= {21, 11}
    assert holds(docs, Has("a")) == {i for i, d in enumerate(DOCS) if "a" in d}
    assert holds(docs, Regex("a", "x")) == at("text") and holds(docs, Regex("a", "t$")) == at("text") and holds(docs, Regex("a", "é$")) == set() and holds(docs, Regex("a", r"^\w\n$")) == at("é\n")


def test_regex_dialect():
    assert java_pattern(r"a$") == r"(?U)a\z" and java_pattern(r"[$]\$") == r"(?U)[$]\$" and java_pattern("(?P<n>a)") == "(?U)(?<n>a)"
    for bad in ("(?=a)", "(?<!a)", r"(a)\1"):
        with pytest.raises(ValueError):
            java_pattern(bad)


def test_selectors(docs):
    every = {r.i for r in docs.collect()}
    pick = lambda *s: {r.i for r in docs.where(matches(s, F.col("v"))).collect()}
    assert pick(Selector()) == every and pick() == set()
    assert pick(Selector(any=(Eq("a", 5), Eq("a", "5")))) == {8, 9, 10, 16}
    assert pick(Selector(all=(Has("a"),), none=(Gt("a", 0.0),))) == {r for r in pick(Selector(all=(Has("a"),))) if r not in pick(Selector(all=(Gt("a", 0.0),)))}
    assert pick(Selector(any=(Eq("a", 5),), all=(Has("nope"),))) == set()
    assert pick(Selector(all=(Eq("a", 5),)), Selector(all=(Eq("a", "5"),))) == {8, 9, 10, 16}


def test_condition_on_the_text_never_rules_out_a_match(docs):
    odd = [(200, '{"\\u0061": "t\\u0065xt"}'), (201, '{"a": "te\\/xt"}')]
    every = docs.select("i", "raw").unionByName(docs.sparkSession.createDataFrame(odd, "i int, raw string")).withColumn("v", F.try_parse_json("raw"))
    for p in (Has("a"), Has("a.b"), Has("a[1][1]"), Eq("a", "text"), Eq("a", 5), Eq("a", "te/xt"), Prefix("a", "te"), Gt("a", 1.0), In("a", ("text", 5)), Regex("a", "x"), Has("")):
        sel = [Selector(all=(p,))]
        assert every.where(matches(sel, F.col("v")) & ~necessary(sel, F.col("raw"))).count() == 0, p
    assert every.where(matches([Selector(all=(Eq("a", "text"),))], F.col("v"))).count() == 2
    assert docs.where(necessary([Selector(all=(Eq("a", "text"),))], F.col("raw"))).count() < docs.count() and docs.where(necessary([], F.col("raw")) & ~F.col("raw").contains("\\")).count() == 0
