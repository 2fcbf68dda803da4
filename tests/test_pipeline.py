import json
import random
import socket
import time
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from fieldmill.operators import detect
from fieldmill.operators.lookup import call, enrich, http_lookup
from fieldmill.operators.mapper import Mapper, apply, parsed
from fieldmill.operators.mappers import Enrich, FlatDefaults, FlatDefaultsBatch, NetworkActivity
from fieldmill.operators.predicates import Selector
from fieldmill.plans import config as C
from fieldmill.plans import graph as G
from fieldmill.streaming.services import Cache
from fieldmill.tools.cli import main, scaffold
from fieldmill.tools.harness import compare, differing, passes, placed, run_mapper
from fieldmill.tools.synth import Synth, generate

FLAT = [{"msg": "my log", "msg.level": "info", "seen": 5, "duration": 6.3, "tags": ["tag1"], "source": {"name": "myservice"}}, {"source": {"name": "myservice"}, "seen": "5", "duration": 6}, {"source": {"name": "other"}}]


@pytest.mark.parametrize("mapper", [FlatDefaults(), FlatDefaultsBatch()])
def test_flat_projection(spark, mapper):
    got = [json.loads(x) for x in run_mapper(spark, mapper, json.dumps(FLAT).encode())]
    assert got[0] == {"message": "my log", "level": "info", "seen": 5, "duration": 6.3, "service": "myservice", "tags": ["tag1"]}
    assert {k: v for k, v in got[1].items() if v is not None} == {"message": "", "level": "", "seen": 0, "duration": 0.0, "service": "myservice"} and len(got) == 2


CONN = {
    "_path": "conn", "_system_name": "s1", "_write_ts": "2024-10-16T04:08:11.828325Z", "app": ["x"], "community_id": "1:a=", "conn_state": "SF", "duration": 65.338, "history": "Sh", "id.orig_h": "10.0.0.1",
    "id.orig_h_name.src": "N", "id.orig_h_name.vals": ["P"], "id.orig_p": 49227, "id.resp_h": "10.0.0.2", "id.resp_h_name.vals": ["h1", "h2"], "id.resp_p": 0, "local_orig": True, "local_resp": False, "orig_bytes": 164,
    "proto": "icmp", "resp_cc": "DE", "resp_bytes": 213, "service": "http", "spcap.rule": 1, "ts": "2024-10-16T04:07:01.489619Z", "uid": "C1", "vlan": 12, "missed_bytes": 0,
}


def test_network_activity(spark):
    out = [json.loads(x) for x in run_mapper(spark, NetworkActivity(), json.dumps([CONN, {"_path": "conn", "uid": "C2", "ts": "2024-10-16T04:07:01Z"}, {"_path": "dns", "uid": "C3"}]).encode())]
    a, b = sorted(out, key=lambda x: x["metadata"]["uid"])
    assert (a["time"], a["start_time"], a["end_time"], a["duration"]) == (1729051621489, 1729051621489, 1729051621554, 65)
    assert a["metadata"]["logged_time"] == 1729051691828 and a["metadata"]["loggers"] == [{"name": "s1"}] and a["type_uid"] == 400102
    assert a["connection_info"] == {"direction_id": 2, "protocol_name": "icmp", "community_uid": "1:a=", "flag_history": "Sh"}
    assert a["src_endpoint"] == {"ip": "10.0.0.1", "port": 49227} and a["dst_endpoint"] == {"ip": "10.0.0.2", "location": {"country": "DE"}}
    assert a["traffic"] == {"bytes_in": 213, "bytes_out": 164, "bytes_missed": 0, "bytes": 377, "packets": 0}
    assert [o["value"] for o in a["observables"]] == ["P", "h1", "h2"] and a["observables"][0]["reputation"]["provider"] == "N"
    assert json.loads(a["unmapped"]) == {"missed_bytes": 0, "vlan": 12, "app": ["x"], "local_orig": True, "local_resp": False, "spcap": {"rule": 1}}
    assert set(b) == {"metadata", "category_uid", "class_uid", "severity_id", "activity_id", "type_uid", "time", "unmapped"}


def test_enrichment(spark):
    table = spark.createDataFrame([("1.1.1.1", "DE"), ("1.1.1.1", "FR"), ("2.2.2.2", None)], "ip_address string, country string")
    rows = [{"ip_address": "1.1.1.1", "service": "myservice"}, {"ip_address": "2.2.2.2", "service": "myservice"}, {"service": "myservice"}, {"ip_address": "1.1.1.1", "service": "x"}]
    got = [json.loads(x) for x in run_mapper(spark, Enrich(table), json.dumps(rows).encode())]
    assert sorted((r["ip_address"], r["country"]) for r in got) == [("", ""), ("1.1.1.1", "DE"), ("2.2.2.2", "")]
    asked = http_lookup("ip", lambda k: f"http://x/{k}", "country", client=lambda r: {"id": r["id"], "status": 200, "body": b'{"country":"SE"}', "error": None})
    df = spark.createDataFrame([("a",), ("a",), (None,)], "ip string")
    assert sorted(r.country for r in enrich(df, "ip", asked, {"country": ""}).collect()) == ["", "SE", "SE"]
    assert call({"id": "1", "url": "http://127.0.0.1:1/", "timeout_ms": 200})["status"] == 0 and call({"id": "1", "url": "x"}, disabled=True)["status"] == 204


def test_error_policies(spark):
    class Failing(Mapper):
        def selectors(self):
            return [Selector()]

        def process_logs(self, logs):
            raise RuntimeError("no")

    df = parsed(spark.createDataFrame([('{"a":1}',)], "raw string"))
    m = Failing()
    assert apply(df, m).count() == 0
    m.on_error = "quarantine"
    assert [(r.out, r.error) for r in apply(df, m).collect()] == [('{"a":1}', "RuntimeError: no")]
    m.on_error = "fail"
    with pytest.raises(Exception, match="no"):
        apply(df, m).collect()
    assert Failing({"a": "x", "b": [1]}).config("a") == "x" and Failing({"b": [1]}).config("b") == "[1]" and Failing().config("z") is None


def test_detections(spark):
    minute = 60_000
    df = spark.createDataFrame([("k", 1, 0), ("k", 2, 9 * minute), ("k", 3, 10 * minute), ("k", 4, 11 * minute), ("k", 5, 40 * minute), (None, 6, 0), ("j", 7, 5)], "k string, id int, at bigint")
    assert {r.id: r.triggered for r in detect.seen_within(df, "k", F.col("at"), "id").collect()} == {1: False, 2: True, 3: False, 4: True, 5: False, 7: False}
    assert {r.id: r.triggered for r in detect.seen_before(df, "k", ["at"]).collect()} == {1: False, 2: True, 3: True, 4: True, 5: True, 6: False, 7: False}
    ties = spark.createDataFrame([("k", None, i) for i in range(3)] + [("k", 5, 9), (None, None, 8)], "k string, t bigint, triggered int")
    assert sorted(r.triggered for r in detect.seen_before(ties, "k", ["t"]).collect()) == [False, False, True, True, True] and detect.seen_before(ties.limit(0), "k", ["t"]).count() == 0
    assert detect.ttl_of(None) == 600_000 and detect.ttl_of(10**9) == 3_600_000
    lines = [
        ("s", "f", "+ early@1", 0, 1), ("s", "f", "##[group]Run npm publish --access public", 1, 2), ("s", "f", "npm notice name: p", 2, 3), ("s", "g", "+ other@1", 3, 4), ("s", "f", "+ pkg@1.0.0", 4, 5),
        (None, "f", "+ pkg@1", 5, 6), ("s", "f", "noise", 6, 7), ("s", "f", "+ late@1", 16 * minute, 8),
    ]
    got = detect.publish_sequence(spark.createDataFrame(lines, "sha string, f string, m string, at bigint, seq int"), "sha", "f", "m", "at", "seq").collect()
    assert {r.seq: r.triggered for r in got} == {1: False, 2: False, 3: False, 4: False, 5: True, 6: False, 8: False}


@pytest.mark.parametrize("ttl,span", [(10, 400), (50, 120), (1, 300), (1000, 300)])
def test_first_sights_over_many_partitions(spark, ttl, span):
    """A key with most of the rows, cut anywhere by partitions, against a plain loop."""
    pick = random.Random(ttl)
    rows = [(pick.choice(["hot", "hot", "hot", "a", "b", None]), i, pick.randrange(span)) for i in range(900)]
    want, anchors = {}, {}
    for k, i, at in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[2], r[1])):
        want[i] = k in anchors and at < anchors[k] + ttl
        if not want[i]:
            anchors[k] = at
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        df = spark.createDataFrame(rows, "k string, id int, at bigint")
        assert {r.id: r.triggered for r in detect.seen_within(df, "k", F.col("at"), "id", ttl).collect()} == want
        assert detect.seen_within(df.limit(0), "k", F.col("at"), "id", ttl).count() == 0
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_publications_over_many_partitions(spark):
    """One commit with nearly all lines, cut anywhere, against a plain loop."""
    pick, minute, lines, want, marks = random.Random(3), 60_000, [], {}, {}
    for i in range(700):
        sha, f = pick.choice(["hot"] * 8 + ["a", None, ""]), pick.choice(["f", "f", "g", ""])
        m = pick.choice(["##[group]Run npm publish", " + p@1", "+ p@1", "+ p@2", "npm notice name: x", "noise", None])
        lines.append((sha, f, m, i * minute // 2, i))
        if m not in (None, "noise", " + p@1"):
            want[i] = bool(sha and f and m.startswith("+") and marks.get(sha, ("", 0))[0] == f and i * minute // 2 < marks[sha][1] + 15 * minute)
            if sha and f and "publish" in m:
                marks[sha] = (f, i * minute // 2)
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        df = spark.createDataFrame(lines, "sha string, f string, m string, at bigint, seq int")
        assert {r.seq: r.triggered for r in detect.publish_sequence(df, "sha", "f", "m", "at", "seq").collect()} == want and any(want.values())
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_cache_and_locks():
    now = [0.0]
    c = Cache(clock=lambda: now[0])
    c.set("k", True)
    c.set("b", b"\x00", 60_000)
    assert c.get("k") is True and c.get("b") == b"\x00" and c.get("z") is None
    now[0] = 60.0
    assert c.get("b") is None and c.get("k") is True
    now[0] = 600.0
    assert c.get("k") is None and not c.delete("k")
    c.set("x", {"a": 1}, 10**12)
    now[0] = 600.0 + 3600
    assert c.get("x") is None
    assert c.acquire("l") and not c.acquire("l")
    c.release("l")
    c.release("unknown")
    assert c.acquire("l")
    c.reset()


YAML = """
sources: {in: {type: file, path: "${FOLDER}/in"}}
plugins:
  flat: {mapper: "fieldmill.operators.mappers:FlatDefaults"}
sinks:
  out: {type: file, path: "${FOLDER}/out"}
  nothing: {type: blackhole}
dag:
  - {from: {kind: source, name: in}, to: [{kind: plugin, name: flat}]}
  - {from: {kind: plugin, name: flat}, to: [{kind: sink, name: out, key_prefix: p}, {kind: sink, name: nothing}]}
"""


def test_config_rules():
    good = C.load(YAML, {"FOLDER": "/x"})
    assert good.sources["in"]["path"] == "/x/in" and [n.name for n in good.order()] == ["flat"] and good.warnings() == []
    assert C.expand("a ${X} ${Y} ${Z", {"X": "1"}) == "a 1  ${Z" and C.summary(good)["sinks"] == {"out": "file", "nothing": "blackhole"}
    bad = {
        "is not defined": YAML.replace("name: flat}]", "name: flap}]"), "cannot be a target": YAML.replace("to: [{kind: plugin, name: flat}]", "to: [{kind: source, name: in}]"), "unknown type": YAML.replace("type: blackhole", "type: hole"),
        "at least one": "sources: {}", "circle": YAML + "  - {from: {kind: plugin, name: flat}, to: [{kind: plugin, name: flat}]}\n", "cannot be compressed": YAML.replace("type: blackhole", "type: blackhole, encoding: parquet, compression: snappy"),
    }
    for message, text in bad.items():
        with pytest.raises(C.ConfigError, match=message):
            C.load(text, {})


def test_run_once_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.ndjson").write_text("\n".join(json.dumps(x) for x in FLAT) + "\n\n{broken\n")
    config = C.load(YAML, {"FOLDER": str(tmp_path)})
    made = G.run_once(spark, config)
    assert spark.read.text(str(tmp_path / "out/p")).count() == 2 and [r.raw for r in made.quarantined["flat"].collect()] == ["{broken"]
    for q in G.run_stream(spark, config, str(tmp_path / "checkpoint"), available_now=True):
        q.awaitTermination(120)
        assert q.exception() is None
    assert spark.read.text(str(tmp_path / "out/p")).count() == 4


def test_broadcast_routing_sends_to_every_plugin(spark):
    text = YAML.replace("plugins:\n", "plugins:\n  other: {mapper: 'fieldmill.operators.mappers:FlatDefaults'}\n") + "  - {from: {kind: plugin, name: other}, to: [{kind: sink, name: nothing}]}\n"
    raw = spark.createDataFrame([(json.dumps(x),) for x in FLAT], "raw string")
    config = C.load(text, {})
    assert G.compile(spark, config, {"in": raw}, routing="broadcast").sinks["nothing", None].count() == 4
    assert G.compile(spark, config, {"in": raw}).sinks["nothing", None].count() == 2


def test_listener(spark):
    from fieldmill.sources.sockets import LineListener, listener

    spark.dataSource.register(LineListener)
    with socket.socket() as probe:
        probe.bind(("127.0.0.1", 0))
        port = probe.getsockname()[1]
    made = listener(f"127.0.0.1:{port}")
    with socket.create_connection(("127.0.0.1", port)) as s:
        s.sendall(b'{"a":1}\n\n{"a":2}')
    for _ in range(50):
        if made.lines.qsize() == 2:
            break
        time.sleep(0.05)
    assert made.drain(10) == ['{"a":1}', '{"a":2}']
    made.close()
    assert LineListener.name() == "line_listener" and LineListener({}).schema() == "raw string"


def test_streaming_first_seen(spark, tmp_path):
    from fieldmill.streaming.state import ROCKSDB, publish_sequence, seen_within, stop_after

    for k, v in ROCKSDB.items():
        spark.conf.set(k, v)
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text("\n".join(json.dumps({"key": k, "raw": str(i)}) for i, k in enumerate("aab")) + "\n")
    stream = spark.readStream.schema("key string, raw string").json(str(src))
    q = seen_within(stream, "key", "raw").writeStream.format("memory").queryName("seen").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    stop_after(q, 3)
    assert sorted((r.key, r.triggered) for r in spark.table("seen").collect()) == [("a", False), ("a", True), ("b", False)]
    log = tmp_path / "log"
    log.mkdir()
    lines = ["+ early@1", "##[group]Run npm publish", "+ p@1"]
    (log / "1.json").write_text("\n".join(json.dumps({"sha": "s", "log_file": "f", "message": m}) for m in lines) + "\n")
    stream = spark.readStream.schema("sha string, log_file string, message string").json(str(log))
    q = publish_sequence(stream).writeStream.format("memory").queryName("published").outputMode("append").option("checkpointLocation", str(tmp_path / "d")).start()
    stop_after(q, 3)
    assert {r.message: r.triggered for r in spark.table("published").collect()} == dict(zip(lines, (False, False, True)))


def test_lines_are_compared_where_they_are(spark):
    rows = [{"a": i, "b": {"y": i / 2, "x": "{\"k\": 1}"}} for i in range(100)]
    made = lambda values, parts: placed(spark.createDataFrame(spark.sparkContext.parallelize([(json.dumps(v),) for v in values], parts), "raw string"))
    got = made(rows, 4)
    assert [(r.n, json.loads(r.text)["a"]) for r in got.orderBy("n").collect()] == [(i, i) for i in range(100)]
    want = [{"b": {"x": "{\"k\":1.0}", "y": r["b"]["y"]}, "a": float(r["a"])} for r in rows]
    assert passes(got, made(want, 3))
    assert [r.n for r in differing(got, made([*want[:7], {"a": 0}, *want[8:]], 3)).collect()] == [7]
    assert [(r.n, r.expected) for r in differing(got, made(want[:-1], 1)).collect()] == [(99, None)]
    assert [(r.n, r.actual) for r in differing(made(rows[:-1], 2), made(want, 3)).collect()] == [(99, None)]
    assert not passes(got, made([want[1], want[0], *want[2:]], 3))
    empty = placed(spark.createDataFrame([], "raw string"))
    assert not passes(empty, empty)


def test_golden_query_does_not_bring_the_table_to_the_driver(spark, monkeypatch):
    from compare import DATA
    from fieldmill.queries import engine

    kind, most = type(spark.range(1)), []
    collect, n = kind.collect, spark.read.parquet(f"{DATA}/events.parquet").count()
    monkeypatch.setattr(kind, "collect", lambda self: most.append(collect(self)) or most[-1])
    monkeypatch.setattr(kind, "toLocalIterator", lambda self: iter(self.collect()))
    assert dict(map(tuple, collect(engine.golden_test(spark, DATA)))) == {"same": True, "changed": False, "none": False}
    assert max(map(len, most)) < 100 < n


def test_harness_and_scaffold(tmp_path, capsys):
    assert compare(['{"b":1,"a":"{\\"x\\":2}"}'], '{"a":{"x":2.0},"b":1}') == "" and compare([], "{}") == "no output" and "-" in compare(['{"a":1}'], '{"a":2}')
    files = scaffold(str(tmp_path), "Mine")
    assert len(files) == 4 and "class Mine(Mapper)" in (tmp_path / "mapper.py").read_text()
    (tmp_path / "mapper.py").write_text("kept")
    scaffold(str(tmp_path), "Mine")
    assert (tmp_path / "mapper.py").read_text() == "kept"
    assert main(["check", "fieldmill.operators.mappers:FlatDefaults"]) == 0 and "native" in capsys.readouterr().out


FLAT_TEMPLATE = {
    "source": {"name": {"$const": "myservice"}}, "seen": {"$gte1": {"$int": {"min": 0, "max": 500}}}, "msg": {"$string": {"len": 8}}, "level": {"$oneOf": ["info", "warn", "error"]},
    "duration": {"$normal": {"mean": 6, "stdev": 0.8, "min": 0}}, "tags": {"$array": {"of": {"$oneOf": ["alpha", "beta", "prod"]}, "len": 2}},
}


def test_synth(spark):
    flat = Synth(FLAT_TEMPLATE, 3)
    for _ in range(200):
        r = flat.record()
        assert r["source"] == {"name": "myservice"} and 1 <= r["seen"] <= 500 and len(r["msg"]) == 8 and r["level"] in ("info", "warn", "error") and r["duration"] >= 0 and len(r["tags"]) == 2 and set(r["tags"]) <= {"alpha", "beta", "prod"}
    now = datetime(2024, 5, 1, 12, 0, 0, 250_000, tzinfo=timezone.utc)
    t = {
        "n": {"$inc": {"start": 5, "step": 2}}, "m": {"$map": {"of": {"a": {"$inc": {}}, "b": {"$const": {"$x": 1}}}}}, "w": {"$weighted": [["x", 1], [{"$const": "y"}, 0]]}, "i": {"$int": {"min": 7}}, "f": {"$float": {"min": 2}},
        "g": {"$normal": {"mean": 100, "stdev": 1, "max": 3}}, "u": {"$uuid": {}}, "t": {"$now": {"format": "unix_ms"}}, "s": {"$now": {"format": "unix"}}, "z": {"$now": {}}, "ip": {"$ip4": {}}, "base": 50,
        "l": {"$array": {"len": {"$gte1": {"$int": {"min": 0, "max": 0}}}, "of": {"$const": 1}}}, "r": {"$rangeFrom": {"base": "$ref:base", "pct": 0.1}}, "q": {"$rangeFrom": {"base": {"$const": 10}, "pct": 0}}, "k": {"$ref": "base"}, "p": {"deep": {"$ref": "p.lit"}, "lit": [1, {"$const": 2}]},
        "x": {"$let": {"vars": {"a": {"$const": 7}, "b": {"$fmt": {"template": "<{v}>", "vars": {"v": "$ref:a"}}}}, "in": {"$fmt": {"template": "{b}-{c}-{none}-{d}{", "vars": {"b": "$ref:b", "c": {"$ref": "a"}, "d": {"$oneOf": ["o"]}}}}}},
    }
    a, b = Synth(t, 3, now), Synth(t, 3, now)
    one, two = a.record(), a.record()
    assert one == b.record() and (one["n"], two["n"]) == (5, 7) and (one["m"], two["m"]["a"]) == ({"a": 0, "b": {"$x": 1}}, 1) and one["w"] == "x" and 7 <= one["i"] <= 107 and 2 <= one["f"] <= 3 and one["g"] == 3
    assert (one["t"], one["s"], one["z"]) == (1714564800250, 1714564800, "2024-05-01T12:00:00.250000+00:00") and len(one["ip"].split(".")) == 4 and one["l"] == [1] and 45 <= one["r"] <= 55 and one["q"] == 10 and one["k"] == 50
    assert one["p"] == {"deep": [1, {"$const": 2}], "lit": [1, 2]} and one["x"] == "<7>-7--o{" and len(one["u"]) == 36
    assert Synth({"a": {"b": {"$keep": None}}}).record() == {"a": {"b": {"$keep": None}}}
    for wrong in ({"$nope": 1}, {"a": {"$ref": "nowhere"}}):
        with pytest.raises(ValueError):
            Synth(wrong).record()
    assert generate(spark, FLAT_TEMPLATE, 100).count() == 100


@pytest.fixture
def broken_stream(spark, tmp_path, monkeypatch):
    """A configuration whose source has a malformed line and a payload that cannot be decoded."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.ndjson").write_text("\n".join(json.dumps(x) for x in FLAT) + "\n{broken\n")
    (tmp_path / "in/b.ndjson").write_text("no object\n")

    def source(spark, name, settings, streaming):
        from fieldmill.sources.decoding import decode

        files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(str(tmp_path / "in"))
        return decode(files, "content")

    monkeypatch.setattr(G, "read_source", source)
    return C.load(YAML, {"FOLDER": str(tmp_path)})


def finish(queries):
    for q in queries:
        q.awaitTermination(120)
        assert q.exception() is None


def test_a_stream_writes_its_quarantine(spark, tmp_path, broken_stream):
    broken_stream.runtime["quarantine"] = str(tmp_path / "quarantine")
    finish(G.run_stream(spark, broken_stream, str(tmp_path / "checkpoint"), available_now=True))
    got = {(r.kind, r.name, r.raw, bool(r.error)) for r in spark.read.schema("kind string, name string, raw string, error string").json(str(tmp_path / "quarantine")).collect()}
    assert got == {("plugin", "flat", "{broken", False), ("source", "in", None, True)}
    assert spark.read.text(str(tmp_path / "out/p")).count() == 2


def test_a_stream_without_a_folder_counts(spark, tmp_path, broken_stream, caplog):
    finish(G.run_stream(spark, broken_stream, str(tmp_path / "checkpoint"), available_now=True))
    assert sorted(r.getMessage() for r in caplog.records if r.name == G.__name__) == ["plugin flat: 1 rows could not be read", "source in: 1 rows could not be read"]


def test_run_once_writes_its_quarantine(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.ndjson").write_text("{broken\n")
    config = C.load(YAML, {"FOLDER": str(tmp_path)})
    config.runtime["quarantine"] = str(tmp_path / "quarantine")
    G.run_once(spark, config)
    assert [(r.kind, r["name"], r.raw) for r in spark.read.json(str(tmp_path / "quarantine")).collect()] == [("plugin", "flat", "{broken")]


def test_messages_that_cannot_be_decoded_leave_a_trace(spark):
    from types import SimpleNamespace

    from fieldmill.sources.queues import stream_kafka

    rows = spark.createDataFrame([(b'{"a":1}', None), (b"oops", None)], "value binary, headers array<struct<key string, value binary>>")
    reader = SimpleNamespace(format=lambda _: reader, options=lambda **_: reader, load=lambda: rows)
    assert sorted((r.raw or "~", bool(r.error)) for r in stream_kafka(SimpleNamespace(readStream=reader), {}).collect()) == [('{"a":1}', False), ("~", True)]
