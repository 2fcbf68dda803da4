"""Queries that pass records through routing, decoding and encoding."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.msgpack import pack
from ..functions.paths import access
from ..operators.mapper import Mapper, parsed, split_malformed
from ..operators.predicates import Eq, Gt, Has, Selector
from ..plans.config import load
from ..plans.graph import compile, run_stream
from ..session import ensure_checkpoint_dir
from ..sinks.writers import write
from ..sources.decoding import compress, decode
from ..sources.files import read_records
from ..sources.webhooks import log_events, recent_versions, split_line
from .logs import logs
from .records import table


class Pick(Mapper):
    """event_id and the name of the branch, of records that one predicate selects."""

    def __init__(self, predicate, branch: str):
        super().__init__()
        self.predicate, self.branch = predicate, branch

    def selectors(self):
        return [Selector(all=(self.predicate,))]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select(S.bigint(access(F.col("v"), "event_id")).alias("event_id"), F.lit(self.branch).alias("branch"))


def _graph(edges: str) -> str:
    """A configuration from `source a > plugin b` lines; a sink may carry a prefix after a colon."""
    nodes: dict[str, set] = {"source": set(), "plugin": set(), "sink": set()}
    dag = []
    for line in edges.strip().splitlines():
        ends = []
        for end in line.split(">"):
            kind, name = end.split()
            name, _, prefix = name.partition(":")
            nodes[kind].add(name)
            ends.append(f"{{kind: {kind}, name: {name}" + (f", key_prefix: {prefix}" if prefix else "") + "}")
        dag.append(f"  - {{from: {ends[0]}, to: [{ends[1]}]}}")
    section = lambda kind, body: f"{kind}s:\n" + "".join(f"  {n}: {body}\n" for n in sorted(nodes[kind]))
    return section("source", "{type: table}") + section("plugin", "{}") + section("sink", "{type: blackhole}") + "dag:\n" + "\n".join(dag)


def _route(spark, sf_dir, edges: str, mappers: dict, sources: dict | None = None) -> DataFrame:
    """Everything that arrives at the sinks, with the sink's name."""
    made = compile(spark, load(_graph(edges)), sources or {"in": logs(spark, sf_dir)}, mappers)
    out = None
    for (sink, prefix), df in sorted(made.sinks.items(), key=str):
        if df.columns == ["raw"]:
            df = df.select(F.from_json("raw", "event_id bigint, branch string").alias("r")).select("r.*")
        part = df.select("event_id", "branch", F.lit(sink).alias("sink"), F.lit(prefix or "").alias("prefix"))
        out = part if out is None else out.unionByName(part)
    return out


def route_fanout(spark, sf_dir):
    return _route(spark, sf_dir, "source in > plugin a\nsource in > plugin b\nplugin a > sink x\nplugin b > sink x\nplugin b > sink y", {"a": Pick(Eq("seen", 3), "a"), "b": Pick(Gt("duration", 80.0), "b")})


def route_fanin(spark, sf_dir):
    raw = logs(spark, sf_dir)
    seen = S.bigint(access(F.try_parse_json("raw"), "seen"))
    return _route(spark, sf_dir, "source odd > plugin a\nsource even > plugin a\nplugin a > sink x", {"a": Pick(Has("msg"), "a")}, {"odd": raw.where(seen % 2 == 1), "even": raw.where(seen % 2 == 0)})


def route_chain(spark, sf_dir):
    return _route(spark, sf_dir, "source in > plugin a\nplugin a > plugin b\nplugin b > sink x", {"a": Pick(Gt("duration", 50.0), "a"), "b": Pick(Gt("event_id", 1000.0), "b")})


def route_key_prefix_counts(spark, sf_dir):
    found = _route(spark, sf_dir, "source in > plugin a\nsource in > plugin b\nplugin a > sink x:low\nplugin b > sink x:high", {"a": Pick(Eq("msg.level", "info"), "a"), "b": Pick(Eq("msg.level", "warn"), "b")})
    return found.groupBy("prefix").agg(F.count("*").alias("n"))


def malformed_quarantined(spark, sf_dir):
    """Every seventh record is cut off: it ends in quarantine, the others go on."""
    raw = logs(spark, sf_dir)
    number = F.regexp_extract("raw", r'"event_id":(\d+)', 1).cast("bigint")
    broken = raw.select(F.when(number % 7 == 0, F.substring("raw", 1, 40)).otherwise(F.col("raw")).alias("raw"))
    good, bad = split_malformed(parsed(broken.unionByName(spark.createDataFrame([("",), ("  ",)], "raw string"))))
    kind = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n")
    return kind(good, "records").unionByName(kind(bad, "quarantined"))


# Decoding: payloads are packed from groups of records and taken apart again -------------------------------------------


def _payloads(spark, sf_dir, form: str, compression: str = "none") -> DataFrame:
    """Binary payloads of a hundred records each."""

    def run(batches):
        for pdf in batches:
            out = []
            for raws in pdf["raws"]:
                rows = list(raws)
                if form == "msgpack":
                    import json

                    data = pack([json.loads(r) for r in rows])
                else:
                    data = ("[" + ",".join(rows) + "]" if form == "json-array" else "\n\n".join(rows)).encode()
                out.append(compress(data, compression))
            yield pdf.assign(content=out)[["content"]]

    grouped = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 100).alias("g"), F.to_json(F.struct("event_id", F.col("event_type").alias("msg"), "value")).alias("raw"))
    return grouped.groupBy("g").agg(F.collect_list("raw").alias("raws")).select("raws").mapInPandas(run, "content binary")


def _decoded(form: str, compression: str = "none"):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = decode(_payloads(spark, sf_dir, form, compression), "content", form).where(F.col("error").isNull())
        return rows.select(F.from_json("raw", "event_id bigint, msg string, value double").alias("r")).select("r.*")

    return query


def decode_fallback_raw(spark, sf_dir):
    """Payloads that are no JSON come out as they are."""
    cut = table(spark, sf_dir, "events").select(F.concat(F.lit('{"event_id": '), "event_id", F.lit(",")).alias("content"))
    return decode(cut, "content", "json").select("raw")


def logline_split(spark, sf_dir):
    line = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("﻿2025-11-25T20:22:08.9044760Z   "), "event_type", F.lit(" "))).otherwise(F.concat("event_type", F.lit(" 2025")))
    at, message = split_line(line)
    return table(spark, sf_dir, "events").select("event_id", at.alias("at"), message.alias("message"))


def ci_log_events(spark, sf_dir):
    files = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select(F.col("doc_id").alias("run_id"), F.col("repo"), F.lit("s").alias("sha"), F.col("path").alias("log_file"), F.col("text").alias("content"))
    return log_events(files).select(F.col("github.run_id").alias("run_id"), F.col("github.repo").alias("repo"), F.col("github.log_file").alias("log_file"), "pos", F.md5("message").alias("message"), F.col("key.timestamp").alias("at"))


def recent_versions_query(spark, sf_dir):
    at = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    spelled = F.when(F.col("event_id") % 5 == 0, F.lit("soon")).when(F.col("event_id") % 7 == 0, F.lit(None)).otherwise(at)
    docs = table(spark, sf_dir, "events").select(
        F.concat(F.lit("p"), "user_id").alias("name"), F.create_map(F.col("event_id").cast("string"), F.col("props")).alias("versions"), F.create_map(F.col("event_id").cast("string"), spelled).alias("time")
    )
    return recent_versions(docs, F.lit("2024-01-15 00:00:00").cast("timestamp")).select("kind", "name", "version", "document")


# Encoding: written and read again --------------------------------------------------------------------------------------


def _folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    return os.path.join(ensure_checkpoint_dir(spark), f"round-trip-{uuid.uuid4().hex}")


def _flat_events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("msg"), "value")


def _round_trip(encoding: str, compression: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = _folder(spark)
        write(_flat_events(spark, sf_dir), folder, encoding, compression)
        if encoding == "parquet":
            return spark.read.parquet(folder)
        return _read_back(spark, folder, encoding)

    return query


def _read_back(spark: SparkSession, folder: str, encoding: str) -> DataFrame:
    rows = read_records(spark, folder, "json-array" if encoding == "json" else "ndjson")
    return rows.select(F.from_json("raw", "event_id bigint, msg string, value double").alias("r")).select("r.*")


def _append_twice(encoding: str, compression: str):
    """Two appends to one folder: what the first wrote stays."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder, rows = _folder(spark), _flat_events(spark, sf_dir)
        for half in (0, 1):
            write(rows.where(F.col("event_id") % 2 == half), folder, encoding, compression)
        return _read_back(spark, folder, encoding)

    return query


def batch_written_again(spark, sf_dir):
    """A micro-batch that is written twice, as after a failure, beside another one: every record is there once."""
    folder, rows = _folder(spark), _flat_events(spark, sf_dir)
    for half in (0, 1, 0):
        write(rows.where(F.col("event_id") % 2 == half), folder, "ndjson", "zstd", batch=f"q-{half:08d}")
    return _read_back(spark, folder, "ndjson")


def sink_overwrite(spark, sf_dir):
    """A sink in mode overwrite keeps the last writing only."""
    folder, rows = _folder(spark), _flat_events(spark, sf_dir)
    for half in (0, 1):
        write(rows.where(F.col("event_id") % 2 == half), folder, "json", "gzip", mode="overwrite")
    return _read_back(spark, folder, "json")


_STREAM = """
sources: {{in: {{type: file, path: "{0}/in"}}}}
plugins: {{flat: {{}}}}
sinks:
  out: {{type: file, path: "{0}/out", encoding: ndjson, compression: zstd}}
runtime: {{quarantine: "{0}/quarantine"}}
dag:
  - {{from: {{kind: source, name: in}}, to: [{{kind: plugin, name: flat}}]}}
  - {{from: {{kind: plugin, name: flat}}, to: [{{kind: sink, name: out, key_prefix: some/place}}]}}
"""


class _Whole(Mapper):
    """Event records as they are."""

    def selectors(self):
        return [Selector()]

    def transform(self, df: DataFrame) -> DataFrame:
        v = F.col("v")
        return df.select(S.bigint(access(v, "event_id")).alias("event_id"), S.string(access(v, "msg")).alias("msg"), S.double(access(v, "value")).alias("value"))


def _streamed(spark: SparkSession, sf_dir: str) -> str:
    """A folder with the sink and the quarantine of a stream of two batches, in which every seventh record is cut off."""
    folder = _folder(spark)
    config = load(_STREAM.format(folder))
    for half in (0, 1):
        raw = F.to_json(F.struct("event_id", "msg", "value"))
        broken = F.when(F.col("event_id") % 7 == 0, F.substring(raw, 1, 20)).otherwise(raw)
        _flat_events(spark, sf_dir).where(F.col("event_id") % 2 == half).select(broken.alias("value")).write.mode("append").text(f"{folder}/in")
        for q in run_stream(spark, config, f"{folder}/checkpoint", {"flat": _Whole()}, available_now=True):
            q.awaitTermination()
            if q.exception() is not None:
                raise q.exception()
    return folder


def stream_two_batches(spark, sf_dir):
    return _read_back(spark, f"{_streamed(spark, sf_dir)}/out/some/place", "ndjson")


def quarantine_written(spark, sf_dir):
    """What a stream could not read, from its quarantine folder."""
    return spark.read.schema("kind string, name string, raw string, error string").json(f"{_streamed(spark, sf_dir)}/quarantine").select("kind", "name", "raw")


QUERIES = {f.__name__: f for f in (route_fanout, route_fanin, route_chain, route_key_prefix_counts, malformed_quarantined, decode_fallback_raw, logline_split, ci_log_events)}
QUERIES |= {"recent_versions": recent_versions_query} | {f.__name__: f for f in (batch_written_again, sink_overwrite, stream_two_batches, quarantine_written)}
QUERIES |= {"append_twice_zstd": _append_twice("ndjson", "zstd"), "append_twice_json": _append_twice("json", "none"), "append_twice_gzip": _append_twice("ndjson", "gzip")}
QUERIES |= {
    "decode_json_array": _decoded("json-array"), "decode_ndjson": _decoded("ndjson"), "decode_msgpack": _decoded("msgpack"), "decode_gzip_lines": _decoded("ndjson", "gzip"), "decode_zstd_array": _decoded("json-array", "zstd"),
    "encode_ndjson_roundtrip": _round_trip("ndjson", "none"), "encode_ndjson_gzip_roundtrip": _round_trip("ndjson", "gzip"), "encode_ndjson_zstd_roundtrip": _round_trip("ndjson", "zstd"),
    "encode_json_roundtrip": _round_trip("json", "none"), "encode_parquet_roundtrip": _round_trip("parquet", "zstd"),
}

_FLAT = "SELECT event_id, event_type AS msg, value FROM events"
SQL = {name: _FLAT for name in QUERIES if name.startswith(("decode_json", "decode_nd", "decode_ms", "decode_g", "decode_z", "encode_", "append_"))} | {
    "batch_written_again": _FLAT,
    "sink_overwrite": _FLAT + " WHERE event_id % 2 = 1",
    "stream_two_batches": _FLAT + " WHERE event_id % 7 <> 0",
    "quarantine_written": """SELECT 'plugin' AS kind, 'flat' AS name, substr('{"event_id":' || event_id || ',"msg":"' || event_type || '"', 1, 20) AS raw FROM events WHERE event_id % 7 = 0""",
    "route_fanout": """SELECT event_id, 'a' AS branch, 'x' AS sink, '' AS prefix FROM events WHERE user_id = 3
        UNION ALL SELECT event_id, 'b', s, '' FROM events, (VALUES ('x'), ('y')) AS t(s) WHERE value > 80""",
    "route_fanin": "SELECT event_id, 'a' AS branch, 'x' AS sink, '' AS prefix FROM events",
    "route_chain": "SELECT event_id, 'b' AS branch, 'x' AS sink, '' AS prefix FROM events WHERE value > 50 AND event_id > 1000",
    "route_key_prefix_counts": "SELECT CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS prefix, count(*) AS n FROM events GROUP BY ALL",
    "malformed_quarantined": "SELECT CASE WHEN event_id % 7 = 0 THEN 'quarantined' ELSE 'records' END AS kind, count(*) AS n FROM events GROUP BY ALL",
    "decode_fallback_raw": "SELECT '{\"event_id\": ' || event_id || ',' AS raw FROM events",
    "logline_split": """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '2025-11-25T20:22:08.9044760Z' END AS at, CASE WHEN event_id % 3 = 0 THEN event_type ELSE event_type || ' 2025' END AS message FROM events""",
    "ci_log_events": """SELECT doc_id AS run_id, repo, path AS log_file, CAST(i - 1 AS INT) AS pos, md5(regexp_replace(line, '^\ufeff', '')) AS message, CAST(NULL AS VARCHAR) AS at
        FROM (SELECT doc_id, repo, path, regexp_replace(unnest(lines), '^[\\s\\x0B]+|[\\s\\x0B]+$', '', 'g') AS line, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, repo, path, string_split_regex(text, '\\r?\\n') AS lines FROM documents WHERE text IS NOT NULL))
        WHERE line <> ''""",
    "recent_versions": """SELECT 'npm_package_version' AS kind, 'p' || user_id AS name, CAST(event_id AS VARCHAR) AS version, props AS document FROM events
        WHERE event_id % 5 <> 0 AND event_id % 7 <> 0 AND ts >= TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 500 MINUTE""",
}
