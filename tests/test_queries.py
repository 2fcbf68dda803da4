import os

import pytest

from compare import DATA, check, tables
from fieldmill.queries import engine, logs, pipelines, records

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
SQL = logs.SQL | pipelines.SQL | engine.SQL | records.SQL
QUERIES = logs.QUERIES | pipelines.QUERIES | engine.QUERIES | records.QUERIES
#: Selectors share one shape; test_fields covers their meaning, so a few stand for all here.
PICKED = [n for n in SQL if n != "p2_offsets" and (not n.startswith("sel_") or n in ("sel_any_all_none", "sel_regex_end_anchor", "sel_in_numbers"))]


@pytest.fixture(scope="module")
def con():
    return tables()


@pytest.mark.parametrize("name", PICKED)
def test_query_agrees_with_sql(spark, con, name):
    check(spark, con, QUERIES[name], SQL[name])


def test_estimated_offsets_are_the_declared_ones(spark):
    """Needs readings in all hours around a change of offset, which the smallest tables lack."""
    data = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    check(spark, tables(data), QUERIES["p2_offsets"], SQL["p2_offsets"], data)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL])
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def brute_sessions(spark):
    """Sessions from the normalised instants by a plain loop."""
    held = {}
    for r in records.write_instants(spark, DATA, "uid", "id.orig_h", "duration").collect():
        if r.utc_us is not None and r["id.orig_h"] is not None:
            d = r.duration
            lasts = round(d * 1_000_000) if d is not None and 0 <= d < float("inf") else 0
            old = held.get(r.uid)
            held[r.uid] = (r["id.orig_h"], min(r.utc_us, old[1]) if old else r.utc_us, lasts)
    by_host = {}
    for host, end, lasts in held.values():
        by_host.setdefault(host, []).append((end - lasts, end))
    out = set()
    for host, spans in by_host.items():
        start = top = n = None
        for s, e in [*sorted(spans), (float("inf"), 0)]:
            if top is None or s > top + records.GAP_US:
                if n and n >= 3:
                    out.add((host, start, top))
                start, top, n = s, e, 1
            else:
                top, n = max(top, e), n + 1
    return out


def test_sessions_against_a_plain_loop(spark):
    assert {tuple(r) for r in records.p3_found(spark, DATA).collect()} == brute_sessions(spark)


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
    for n in range(2, 5):
        assert f"p{n}_found" in entry.queries()
