"""Sources that seal what they take, signed requests, services, metrics and sinks under failure; the queries of engine.py run them end to end."""

import io
import json
import logging
import os
import threading
import time
import urllib.request
import zipfile
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from compare import DATA
from fieldmill.operators.mapper import Mapper, apply, apply_raw, parsed, split_malformed
from fieldmill.operators.mappers import FlatDefaults
from fieldmill.operators.predicates import Eq, Has, Regex, Selector, matches
from fieldmill.functions import scalars as S
from fieldmill.functions.paths import Fields, access
from fieldmill.plans import graph as G
from fieldmill.sinks.writers import write
from fieldmill.sources import feeds
from fieldmill.sources.cloud import Queue, sign
from fieldmill.sources.spool import Spool
from fieldmill.streaming.metrics import Metrics
from fieldmill.streaming.services import Cache, Services, services_of


def test_spool_seals_and_survives(spark, tmp_path):
    folder = str(tmp_path / "spool")
    spool = Spool(spark, folder, max_bytes=20, max_age=0.2)
    assert spool.records(False).count() == 0
    spool.seal(['{"a":1}', '{"a":2}\n'])
    assert sorted(r.raw for r in spool.records(False).collect()) == ['{"a":1}', '{"a":2}']
    spool.put(["x" * 30])
    assert spool.records(False).count() == 3
    spool.put(["y"])
    time.sleep(0.6)
    assert spool.records(False).count() == 4
    spool.put(["z"])
    spool.close()
    assert Spool(spark, folder).records(False).count() == 5 and not [f for f in os.listdir(folder) if f.startswith(".") and not f.endswith(".crc")]


def test_signature_of_the_published_example():
    headers = {"Content-Type": "application/x-www-form-urlencoded; charset=utf-8"}
    at = datetime(2015, 8, 30, 12, 36, tzinfo=timezone.utc)
    got = sign("GET", "https://iam.amazonaws.com/?Action=ListUsers&Version=2010-05-08", headers, b"", "AKIDEXAMPLE", "wJalrXUtnFEMI/K7MDENG+bPxRfiCYEXAMPLEKEY", "us-east-1", "iam", at)
    assert got["authorization"].endswith("Signature=5d672d79c15b13162d9279b0855cfba6789a8edb4c82c400e06b5924a6f2b5d7")


def test_queue_refuses_errors():
    queue = Queue("http://q/1/x", key_id="k", secret="s", client=lambda r: {"id": 1, "status": 500, "headers": [], "body": b"", "error": None})
    with pytest.raises(OSError, match="500"):
        queue.receive()


def test_a_round_that_fails_is_tried_again(spark, tmp_path, caplog):
    turns = []

    def turn():
        turns.append(1)
        if len(turns) == 1:
            raise OSError("away")

    feed = feeds.Feed(Spool(spark, str(tmp_path / "s")), turn, 0.01).start()
    until = time.monotonic() + 10
    while len(turns) < 3 and time.monotonic() < until:
        time.sleep(0.02)
    feed.stop()
    assert len(turns) >= 3 and any("away" in r.getMessage() for r in caplog.records)


def test_run_logs():
    record = {"action": "completed", "workflow_run": {"id": 7, "head_sha": "abc", "repository": {"name": "r", "owner": {"login": "o"}}}}
    told = feeds.run_of(json.dumps(record))
    assert told == {"path": "/repos/o/r/actions/runs/7/logs", "run_id": 7, "repo": "o/r", "sha": "abc"}
    record["workflow_run"]["repository"]["full_name"] = "a/b/c"
    assert feeds.run_of(json.dumps(record))["repo"] == "a/b/c"
    for other in ("{", "[]", '{"action":"completed"}', json.dumps(record | {"action": "requested"}), '{"action":"completed","workflow_run":{"id":"7"}}'):
        assert feeds.run_of(other) is None
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("d/", "")
        z.writestr("d/1.txt", "\ufeff2025-11-25T20:22:08.9Z   one \r\n \r\ntwo\n")
    got = [json.loads(x) for x in feeds.archive_events(out.getvalue(), told)]
    assert [(g["message"], g.get("key"), g["github"]["log_file"]) for g in got] == [("one", {"timestamp": "2025-11-25T20:22:08.9Z"}, "d/1.txt"), ("two", None, "d/1.txt")]


def test_runs_without_logs_come_out_alone(spark):
    raw = json.dumps({"action": "completed", "workflow_run": {"id": 7, "head_sha": "abc", "repository": {"full_name": "o/r"}}})
    df = spark.createDataFrame([(raw,), ('{"a":1}',)], "raw string")
    assert sorted(r.raw for r in feeds.expand_runs(df, "t", client=lambda r: {"status": 404, "error": None, "body": b""}).collect()) == sorted([raw, '{"a":1}'])


def test_registry_tells_a_version_once_while_it_is_recent():
    now = [datetime(2024, 1, 1, 12, tzinfo=timezone.utc)]
    document = {"versions": {"1": {"v": 1}, "2": {"v": 2}, "3": {"v": 3}, "4": {}}, "time": {"1": "2024-01-01T11:00:00Z", "2": "2023-12-31T00:00:00Z", "3": "soon", "4": "2024-01-01T11:00:00"}}
    registry = feeds.Registry("http://r", ["p"], None, now=lambda: now[0], client=lambda r: {"status": 200, "error": None, "body": json.dumps(document).encode()})
    assert [json.loads(x)["npm"] for x in registry.poll()] == [{"v": 1}] and registry.poll() == []
    now[0] = datetime(2024, 1, 2, tzinfo=timezone.utc)
    assert registry.poll() == [] and registry.told == {}
    with pytest.raises(ValueError):
        feeds.Registry("http://r", None, None)


def test_a_large_registry_comes_in_pages_and_is_told_once(monkeypatch):
    now = datetime(2024, 1, 1, 12, tzinfo=timezone.utc)
    document = json.dumps({"versions": {str(i): {"v": i} for i in range(1000)}, "time": {str(i): "2024-01-01T11:00:00.000001Z" for i in range(1000)}}).encode()
    registry = feeds.Registry("http://r", ["p", "q", "p"], None, now=lambda: now, client=lambda r: {"status": 200, "error": None, "body": document})
    monkeypatch.setattr(feeds, "PAGE", 3000)
    pages = list(registry.pages())
    assert len(pages) > 10 and max(sum(map(len, p)) for p in pages) < 3100
    assert sorted(json.loads(x)["npm"]["v"] for p in pages for x in p) == sorted([*range(1000)] * 2) and list(registry.pages()) == []
    assert len(registry.told) == 2000 and registry.told["q", "7"] == datetime(2024, 1, 1, 11, 0, 0, 1, tzinfo=timezone.utc)


def test_registry_query_does_not_bring_the_table_to_the_driver(spark, monkeypatch):
    from fieldmill.queries import engine

    monkeypatch.setattr(type(spark.range(1)), "toLocalIterator", lambda *a, **k: pytest.fail("rows at the driver"))
    monkeypatch.setattr(feeds.Registry, "poll", lambda *a: pytest.fail("all events at once"))
    assert engine.source_npm(spark, DATA).count() > 0


def test_services():
    asked = []
    client = lambda r: asked.append(r["url"]) or {"id": r["id"], "status": 200, "headers": [("a", "b")], "body": b"x", "error": None}
    cache = Cache()
    one, two = Services(cache, client), Services(cache, client)
    one.set("k", 1)
    assert one.get("k") == two.get("k") == 1 and one.acquire("l") and not two.acquire("l")
    got = one.call([{"id": str(i), "url": f"u{i % 2}", "cache_ttl_ms": 60_000} for i in range(2)]) + one.call([{"id": "9", "url": "u0", "cache_ttl_ms": 60_000}])
    assert [g["id"] for g in got] == ["0", "1", "9"] and sorted(asked) == ["u0", "u1"] and got[2]["body"] == b"x"
    assert Services(cache, client, disabled=True).call([{"id": "1", "url": "u"}])[0]["status"] == 204
    assert services_of({}) is services_of({}) and services_of({}) is not services_of({"disable_remote_calls": True})


def test_calls_keep_their_connections_and_come_side_by_side():
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    clients, seen = set(), []

    class Handler(BaseHTTPRequestHandler):
        protocol_version, wbufsize = "HTTP/1.1", -1

        def do_POST(self):
            clients.add(self.client_address)
            seen.append((self.path, self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(303 if self.path == "/away" else 500 if self.path == "/no" else 200)
            self.send_header("Location", "/here")
            self.send_header("Content-Length", "2")
            self.end_headers()
            self.wfile.write(b"ok")

        def do_GET(self):
            self.send_response(200)
            self.send_header("Content-Length", "3")
            self.end_headers()
            self.wfile.write(b"got")

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_address[1]}"
    ask = lambda i, path="": {"id": str(i), "method": "POST", "url": url + path, "body": str(i)}
    told = Services(Cache(), threads=4)
    got = told.call([ask(i) for i in range(200)])
    assert [g["id"] for g in got] == [str(i) for i in range(200)] and {(g["status"], g["body"]) for g in got} == {(200, b"ok")}
    assert sorted(int(b) for _, b in seen) == list(range(200)) and len(clients) <= 4
    seen.clear()
    assert [(g["status"], g["body"]) for g in told.call([ask(1, "/away"), ask(2, "/no")])] == [(200, b"got"), (500, b"ok")]
    assert sorted(seen) == [("/away", b"1"), ("/no", b"2")]  # nothing is posted twice
    server.shutdown()
    server.server_close()
    assert told.call([{"id": "x", "url": "http://127.0.0.1:9/"}])[0]["status"] == 0


def test_alerts_of_a_batch_are_told_together():
    from fieldmill.functions.logview import LogView
    from fieldmill.operators.mappers import DuplicateAlert

    asked = []

    class Told(Services):
        def call(self, requests):
            asked.append([json.loads(r["body"])["text"] for r in requests])
            return [{"status": 200, "error": None, "body": b'{"ok":true}'} for _ in requests]

    class Alert(DuplicateAlert):
        services = Told(Cache())

    logs = [LogView(json.dumps({"source": {"name": n}})) for n in "abaab"]
    assert [json.loads(x)["triggered"] for x in Alert("http://chat").run_batch(logs).splitlines()] == [False, False, True, True, True]
    assert asked == [["a came again", "a came again", "b came again"]]


def test_a_key_has_one_place_in_all_processes_of_a_host(tmp_path):
    one, two = Cache(str(tmp_path / "c.db")), Cache(str(tmp_path / "c.db"))
    for i in range(100):
        one.set(f"k{i}", i)
    assert [two.get(f"k{i}") for i in range(100)] == list(range(100)) and two.delete("k7") and one.get("k7") is None
    assert one.acquire("l") and not two.acquire("l")
    two.release("l")
    assert two.acquire("l")
    held = one.parts[0]
    held.execute("BEGIN IMMEDIATE")  # a writer in one file doesn't hold up the others
    free = [k for k in map(str, range(100)) if two._of(k) is not two.parts[0]]
    two.set(free[0], 1)
    held.execute("COMMIT")
    two.reset()
    assert one.get("k1") is None and len(free) > 50


def test_keys_are_spread_over_the_cores_and_stay_in_order(spark):
    from fieldmill.queries import engine

    rows = engine._in_order(spark, DATA, "source.name").selectExpr("spark_partition_id() p", "get_json_object(raw, '$.source.name') k", "cast(get_json_object(raw, '$.event_id') as bigint) n").collect()
    parts, last = {}, {}
    for r in rows:
        parts.setdefault(r.k, set()).add(r.p)
        assert last.get(r.k, -1) < r.n
        last[r.k] = r.n
    assert len(parts) == 5 and all(len(p) == 1 for p in parts.values()) and len(set.union(*parts.values())) > 1


def test_metrics():
    m = Metrics()
    for seconds in (0.00001, 0.003, 5.0):
        m.observe(seconds)
    port = m.serve(0, "127.0.0.1")
    text = urllib.request.urlopen(f"http://127.0.0.1:{port}/metrics", timeout=10).read().decode()
    m.close()
    assert 'fieldmill_batch_seconds_bucket{le="5e-05"} 1\n' in text and 'le="+Inf"} 3\n' in text and "fieldmill_batch_seconds_count 3\n" in text


def test_a_write_is_tried_again(spark, tmp_path, monkeypatch, caplog):
    tries, real = [], G.write

    def flaky(*a, **k):
        tries.append(1)
        if len(tries) < 3:
            raise OSError("the store is away")
        real(*a, **k)

    monkeypatch.setattr(G, "write", flaky)
    monkeypatch.setattr(G, "PAUSE", 0.01)
    config = G.Config({"in": {"type": "table"}}, {"out": {"type": "file", "path": str(tmp_path / "o")}})
    with caplog.at_level(logging.WARNING):
        G._write(config, "out", None, spark.createDataFrame([("{}",)], "raw string"), "q-1")
    assert len(tries) == 3 and [f for f in os.listdir(tmp_path / "o") if not f.startswith(".")] == ["q-1-00000.ndjson"]


def test_modes_and_schemes(spark, tmp_path):
    df, folder = spark.createDataFrame([('{"a":1}',)], "raw string"), str(tmp_path / "o")
    names = lambda: sorted(f for f in os.listdir(folder) if not f.startswith((".", "_")))
    write(df, folder, "ndjson", "zstd")
    write(df, folder, "ndjson", "zstd")
    write(df, folder, "ndjson", "zstd", mode="ignore")
    assert len(names()) == 2 and all(n.endswith("-00000.ndjson.zst") for n in names())
    with pytest.raises(FileExistsError):
        write(df, folder, "json", mode="error")
    write(df, folder, "json", mode="overwrite")
    assert len(names()) == 1 and names()[0].endswith(".json")
    with pytest.raises(Exception):  # no connector, and no local folder of that name either
        write(df, "s3a://no-such-bucket", "ndjson", "zstd")
    assert not os.path.exists("s3a:")


TEXTS = ['{"a":1} ', '{"a":1', '[{"a":2}]', "5", "{}", ' {"a":3}', "", "x", '{"a":NaN}', '{"a":null}', '{"A":7}', "{'a':1}", '{"a":01}', '{"x.y":null,"x":{"y":1}}', '{"x":{"y":"s"}}', '{"x":[{"y":2}],"a":"1"}', '{"a":18446744073709551615}', '{"t":["p",null,"q"]}', '{"t":["p",1,{"z":1},true]}', '{"t":"p"}']


class _Reads(Mapper):
    fields = ("a", "x.y", "x[0].y", "t")

    def __init__(self, selector):
        super().__init__()
        self.selector = selector

    def selectors(self):
        return [self.selector]

    def from_fields(self, df, v):
        return df.select("raw", S.bigint(access(v, "a")).alias("a"), S.kind(access(v, "x.y")).alias("k"), S.bigint(access(v, "x[0].y")).alias("i"), S.string_list(v, "t").alias("t"))


@pytest.mark.parametrize("selector", [Selector(), Selector(all=(Has("x.y"),)), Selector(none=(Has("a"),)), Selector(any=(Eq("a", 1), Eq("x.y", "s"), Has("t")))])
def test_single_fields_mean_the_same_as_whole_documents(spark, selector):
    df, mapper = spark.createDataFrame([(x,) for x in TEXTS], "raw string"), _Reads(selector)
    whole = apply(split_malformed(parsed(df))[0], mapper)
    assert sorted(map(str, apply_raw(df, mapper).collect())) == sorted(map(str, whole.collect()))


def test_keys_that_cannot_stand_side_by_side(spark):
    assert not Fields(["a", "A"]).usable and not Fields([""]).usable and Fields(["a.b", "a"]).roots == ["a.b", "a"]

    class Both(_Reads):
        fields = ("a", "A")

        def from_fields(self, df, v):
            return df.select(S.bigint(access(v, "a")).alias("x"), S.bigint(access(v, "A")).alias("y"))

    df = spark.createDataFrame([('{"a":1,"A":2}',)], "raw string")
    assert [tuple(r) for r in apply_raw(df, Both(Selector())).collect()] == [(1, 2)]
    assert apply_raw(df.limit(0), FlatDefaults()).count() == 0


@pytest.mark.parametrize("pattern,text,hit", [("^[[:alpha:]]+$", "abc", True), ("^[[:alpha:]]+$", "abç", False), ("[[:^digit:]]", "12", False), ("[^[:space:]]", " \t", False), ("^[[:punct:]-]+$", "!-~", True), ("[:alpha:]", "x:y", True)])
def test_posix_classes(spark, pattern, text, hit):
    df = parsed(spark.createDataFrame([(json.dumps({"m": text}),)], "raw string"))
    assert df.where(matches([Selector(all=(Regex("m", pattern),))], F.col("v"))).count() == int(hit)


def test_unknown_posix_class_is_refused():
    with pytest.raises(ValueError, match="smoke"):
        Regex("m", "[[:smoke:]]").column(F.col("v"))
