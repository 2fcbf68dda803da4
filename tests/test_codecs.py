import gzip
import json

import pytest

from fieldmill.functions.msgpack import pack, unpack
from fieldmill.sinks.writers import check, encode, object_name, write
from fieldmill.sources.decoding import compress, decode, decode_payload, decompress, normalise, resolve_compression
from fieldmill.sources.files import read_records
from fieldmill.sources.queues import expand_message, kafka_options, object_key, poll_queue
from fieldmill.sources.webhooks import answer, log_events, signature_holds


def test_compression_is_settled_in_order():
    zst = compress(b"x", "zstd")[:8]
    assert resolve_compression("gzip", "zstd", "a.zst", zst) == "gzip"
    assert resolve_compression("auto", "x-GZIP", "a.zst", zst) == "gzip"
    assert resolve_compression("auto", "identity", "a.gz") == "none"
    assert resolve_compression("auto", None, "A.GZ") == "gzip" and resolve_compression("auto", None, "a.zstd") == "zstd"
    assert resolve_compression("auto", None, "a", zst) == "zstd" and resolve_compression("auto", None, None, b"\x1f\x8b") == "gzip"
    assert resolve_compression() == "none"


def test_formats():
    assert normalise(b'{"a":1}\n\n{"b":2}', "ndjson") == ['{"a":1}', '{"b":2}'] and normalise(b"", "ndjson") == []
    with pytest.raises(ValueError):
        normalise(b"[1]", "text")
    assert normalise(b'[{"b":1,"a":2},3]', "json-array") == ['{"a":2,"b":1}', "3"] and normalise(b'{"a":1}', "json") == ['{"a":1}']
    assert normalise(b'{"a":', "json") == ['{"a":']
    value = [{"a": 1, "b": [None, True, 2.5, "é", -7, 300, 2**40]}, {"c": {}}]
    assert unpack(pack(value)) == value and normalise(pack(value), "msgpack") == [json.dumps(v, ensure_ascii=False, separators=(",", ":")) for v in value]
    assert normalise(b"\xc1", "msgpack") == ["�"]
    for kind in ("gzip", "zstd", "none"):
        assert decompress(compress(b"data" * 99, kind), kind) == b"data" * 99
    assert decode_payload(gzip.compress(b'{"a":1}'), "ndjson", "auto", None, "wrong.json") == ['{"a":1}']


def test_decode_column(spark):
    df = spark.createDataFrame([(b'{"a":1}\n{"a":2}',), (b"oops",), (None,), (gzip.compress(b'{"a":3}'),)], "c binary")
    got = decode(df, "c").collect()
    assert sorted(r.raw for r in got if r.raw) == ['{"a":1}', '{"a":2}', '{"a":3}'] and sum(r.error is not None for r in got) == 1
    assert decode(df, "c", on_error="drop").where("error is not null").count() == 0


@pytest.mark.parametrize("encoding,compression", [("ndjson", "none"), ("ndjson", "gzip"), ("ndjson", "zstd"), ("json", "none"), ("json", "zstd"), ("parquet", "zstd"), ("parquet", "gzip")])
def test_round_trips(spark, tmp_path, encoding, compression):
    df = spark.createDataFrame([(i, f"é{i}\n") for i in range(50)], "n bigint, s string")
    folder = str(tmp_path / "out")
    write(df, folder, encoding, compression, key_prefix="p/q")
    at = folder + "/p/q"
    if encoding == "parquet":
        got = [tuple(r) for r in spark.read.parquet(at).collect()]
    else:
        got = [(json.loads(r.raw)["n"], json.loads(r.raw)["s"]) for r in read_records(spark, at, "json-array" if encoding == "json" else "ndjson").collect()]
    assert sorted(got) == [(i, f"é{i}\n") for i in range(50)]


def test_encoding_rules():
    assert encode(['{"a":1}\n', '{"a":2}'], "ndjson") == b'{"a":1}\n{"a":2}\n' and json.loads(encode(['{"a":1}'], "json")) == [{"a": 1}]
    assert object_name("x/", "ndjson", "zstd", "id") == "x/id.ndjson.zst" and object_name(None, "json", "none", "id") == "id.json"
    for bad in (("parquet", "snappy"), ("xml", "none"), ("ndjson", "snappy")):
        with pytest.raises(ValueError):
            check(*bad)


def test_size_rotation(spark, tmp_path):
    df = spark.range(100).coalesce(1)
    write(df, str(tmp_path / "o"), "ndjson", "zstd", max_bytes=200)
    assert len(list((tmp_path / "o").iterdir())) > 3 and read_records(spark, str(tmp_path / "o")).count() == 100


def test_queue_messages():
    notice = json.dumps({"Records": [{"s3": {"bucket": {"name": "b"}, "object": {"key": "a+b%2Bc.gz"}}}]})
    fetched = []
    assert expand_message(notice, lambda b, k: fetched.append((b, k)) or gzip.compress(b'{"a":1}')) == ['{"a":1}'] and fetched == [("b", "a b+c.gz")]
    assert expand_message('{"plain":1}', None) == ['{"plain":1}'] and object_key("%C3%A9") == "é"
    log = []
    n = poll_queue(lambda: [{"body": '{"a":1}', "receipt": "r"}], None, lambda r: log.append(("delete", r)), lambda x: log.append(("deliver", x)))
    assert n == 1 and log == [("deliver", ['{"a":1}']), ("delete", "r")]
    o = kafka_options("h:1", "t", scram={"username": "u", "password": 'p"'}, ssl={"ca_location": "x"})
    assert o["startingOffsets"] == "latest" and o["kafka.sasl.mechanism"] == "SCRAM-SHA-512" and '\\"' in o["kafka.sasl.jaas.config"]


def test_webhooks(spark):
    import hashlib
    import hmac

    sign = "sha256=" + hmac.new(b"k", b"{}", hashlib.sha256).hexdigest()
    assert signature_holds("k", b"{}", sign) and not signature_holds("k", b"{}", "sha256=0") and not signature_holds("k", b"{}", None)
    assert answer("ping", b"x", "k") == (200, []) and answer("push", b"{}", "k", "no")[0] == 401 and answer("push", b'{"a":1}\n', "k", "sha256=" + hmac.new(b"k", b'{"a":1}\n', hashlib.sha256).hexdigest()) == (202, ['{"a":1}'])
    files = spark.createDataFrame([(1, "o/r", "s", "f", "﻿2025-11-25T20:22:08.9044760Z ##[group]Run npm publish --access public\r\n\r\nplain log without ts")], "run_id int, repo string, sha string, log_file string, content string")
    a, b = log_events(files).orderBy("pos").collect()
    assert a.message == "##[group]Run npm publish --access public" and a["key"].timestamp == "2025-11-25T20:22:08.9044760Z" and b.message == "plain log without ts" and b["key"] is None


@pytest.mark.parametrize("kind", ["gzip", "zstd"])
def test_a_stream_cut_off_is_refused(spark, kind):
    whole = compress("".join(f'{{"a":{i}}}\n' for i in range(50_000)).encode(), kind)
    for cut in (whole[: len(whole) // 2], whole[:-1]):
        with pytest.raises(ValueError):
            decompress(cut, kind)
        df = spark.createDataFrame([(cut,)], "c binary")
        (row,) = decode(df, "c").collect()
        assert row.raw is None and "cut off" in row.error
        with pytest.raises(Exception):
            decode(df, "c", on_error="fail").collect()
    assert decompress(b"", kind) == b"" and spark.createDataFrame([(whole,)], "c binary").transform(lambda d: decode(d, "c")).count() == 50_000
