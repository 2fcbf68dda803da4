"""A pipeline compiled to DataFrames.

Nothing is scheduled here: every node becomes a DataFrame over those that feed it. One record fans out because several plans read
the same DataFrame, and fans in by a union.
"""

from __future__ import annotations

import importlib
import json
import logging
import time
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.mapper import Mapper, apply_raw, lines, parsed, split_malformed
from ..sinks.writers import discard, write
from ..sources.feeds import KINDS, read_feed, stop_all
from ..sources.files import read_records, stream_records
from .config import Config, ConfigError, Node, encoding_of


@dataclass
class Compiled:
    #: What arrives at each sink, by (name, key prefix).
    sinks: dict[tuple[str, str | None], DataFrame]
    #: (raw, error) of what each plugin could not read, error null, or failed on, by name.
    quarantined: dict[str, DataFrame] = field(default_factory=dict)
    #: (raw, error) of payloads that could not be decoded, by source.
    undecoded: dict[str, DataFrame] = field(default_factory=dict)
    #: Frames kept for several readers, to be given up after use.
    kept: list[DataFrame] = field(default_factory=list)


def make_mapper(settings: dict, runtime: dict | None = None) -> Mapper:
    """The mapper that a plugin entry names as `mapper: module:Class`."""
    spelled = settings.get("mapper")
    if not spelled or ":" not in spelled:
        raise ConfigError("a plugin needs `mapper: module:Class`")
    module, _, name = spelled.partition(":")
    made = getattr(importlib.import_module(module), name)(**(settings.get("arguments") or {}))
    made._config.update(settings.get("config") or {})
    made._config["__runtime"] = {k: v for k, v in (runtime or {}).items() if k in ("cache", "disable_remote_calls")}
    return made


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def read_source(spark: SparkSession, name: str, settings: dict, streaming: bool) -> DataFrame:
    """(raw) of a configured source; (raw, error) if its payloads may fail to decode, raw null where one did."""
    kind, how = settings["type"], settings.get("decoding") or {}
    form, compression = how.get("format", "ndjson"), how.get("compression", "auto")
    if kind == "file":
        return (stream_records if streaming else read_records)(spark, settings["path"], form, compression)
    if kind in KINDS:
        return read_feed(spark, name, settings, streaming)
    if kind == "msk":
        from ..sources.queues import kafka_options, stream_kafka

        return stream_kafka(spark, kafka_options(settings["bootstrap_servers"], settings["topic"], settings.get("group_id", "fieldmill"), settings.get("security_protocol", "PLAINTEXT"), settings.get("ssl"), settings.get("auth")), form, compression)
    raise ConfigError(f"source {name}: a {kind} is given to compile()")


def compile(spark: SparkSession, config: Config, sources: dict[str, DataFrame] | None = None, mappers: dict[str, Mapper] | None = None, routing: str = "dag", streaming: bool = False, keep: bool = False) -> Compiled:
    """sources and mappers given here replace configured ones of the same name.

    routing `dag` sends a record to the plugins its edges name; `broadcast` to every plugin, once for each edge to a plugin.
    keep persists what several nodes read of one plugin, so that it is computed once.
    """
    sources, mappers = dict(sources or {}), dict(mappers or {})
    out: dict[tuple[str, str], DataFrame] = {}
    for name, settings in config.sources.items():
        out["source", name] = sources[name] if name in sources else read_source(spark, name, settings, streaming)
    failed = {name: df for (_, name), df in out.items() if df.columns == ["raw", "error"]}
    for name, df in failed.items():
        out["source", name] = df.where(F.col("error").isNull()).select("raw")
    undecoded = {name: df.where(F.col("error").isNotNull()) for name, df in failed.items()}
    quarantined: dict[str, DataFrame] = {}
    kept: list[DataFrame] = []
    for node in config.order():
        origins = config.origins(node)
        if routing == "broadcast":
            origins = [a for a, b in config.edges if b.kind == "plugin" and a.kind == "source"] + [a for a in origins if a.kind == "plugin"]
        if not origins:
            continue
        fed = _union([lines(out[a.kind, a.name]) for a in origins if (a.kind, a.name) in out])
        quarantined[node.name] = split_malformed(parsed(fed))[1].select("raw", F.lit(None).cast("string").alias("error"))
        mapper = mappers.get(node.name) or make_mapper(config.plugins[node.name], config.runtime)
        out["plugin", node.name] = apply_raw(fed, mapper)
        sets_aside = not mapper.native and mapper.on_error == "quarantine"
        if keep and (sets_aside or len(config.targets(node)) > 1):
            out["plugin", node.name] = out["plugin", node.name].persist()
            kept.append(out["plugin", node.name])
        if sets_aside:
            failed = out["plugin", node.name].where(F.col("error").isNotNull()).select(F.col("out").alias("raw"), "error")
            quarantined[node.name] = quarantined[node.name].unionByName(failed)
    arriving: dict[tuple[str, str | None], list[DataFrame]] = {}
    for a, b in config.edges:
        if b.kind == "sink" and (a.kind, a.name) in out:
            arriving.setdefault((b.name, b.key_prefix), []).append(out[a.kind, a.name])
    return Compiled({k: frames[0] if len(frames) == 1 else _union([lines(f) for f in frames]) for k, frames in arriving.items()}, quarantined, undecoded, kept)


#: Tries of a sink's write, and the pause before the second; each further pause is twice as long.
TRIES, PAUSE = 4, 0.5


def _write(config: Config, name: str, prefix: str | None, df: DataFrame, batch: str | None = None) -> None:
    """df into a sink, tried again after a failure. A try leaves nothing that the next would repeat: Spark's committers and the staged
    names show an output only when it is whole.
    """
    s = config.sinks[name]
    for turn in range(TRIES):
        try:
            if s["type"] == "blackhole":
                discard(df)
                return
            encoding, compression = encoding_of(s)
            folder = s["path"] if s["type"] == "file" else f"s3a://{s['bucket_name']}"
            schema = s["encoding"].get("schema") if isinstance(s.get("encoding"), dict) else None
            max_bytes = int(s.get("max_file_bytes") or 64 << 20)
            write(df, folder, encoding, compression, prefix or s.get("key_prefix"), schema, batch=batch, max_bytes=max_bytes)
            return
        except Exception as e:
            if turn == TRIES - 1 or isinstance(e, (AnalysisException, ParseException)):
                raise
            logging.getLogger(__name__).warning("sink %s: try %d failed: %s", name, turn + 1, e)
            time.sleep(PAUSE * 2**turn)


def _set_aside(config: Config, made: Compiled, count: bool) -> None:
    """What could not be read, as JSON rows (kind, name, raw, error) in the folder `runtime.quarantine`; without one, counted and logged if asked for."""
    kinds = [("plugin", n, df) for n, df in made.quarantined.items()]
    kinds += [("source", n, df) for n, df in made.undecoded.items()]
    folder = config.runtime.get("quarantine")
    for kind, name, df in kinds:
        if folder:
            df.select(F.lit(kind).alias("kind"), F.lit(name).alias("name"), "raw", "error").write.mode("append").json(folder)
        elif count and (n := df.count()):
            logging.getLogger(__name__).warning("%s %s: %d rows could not be read", kind, name, n)


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def _batches(spark: SparkSession, config: Config) -> str | None:
    """Lets Python mappers get batches of at most `runtime.batch_size` KiB, 256 without it, or one larger record. Returns what was set before."""
    held = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, str(int(config.runtime.get("batch_size") or 256) << 10))
    return held


def run_once(spark: SparkSession, config: Config, **more) -> Compiled:
    """Every sink written from the sources as they are now, and what could not be read into the folder `runtime.quarantine`, if there is one.

    The records of a plugin that several nodes read are kept on the executors until all sinks are written.
    """
    held = _batches(spark, config)
    made = compile(spark, config, keep=True, **more)
    try:
        for (name, prefix), df in made.sinks.items():
            _write(config, name, prefix, df)
        _set_aside(config, made, count=False)
    finally:
        for df in made.kept:
            df.unpersist()
        spark.conf.set(_BATCH, held) if held is not None else spark.conf.unset(_BATCH)
    return made


def _query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave the query of a checkpoint; it survives restarts, and a new checkpoint has a new one."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first().value)["id"]


def run_stream(spark: SparkSession, config: Config, checkpoint: str, mappers: dict[str, Mapper] | None = None, available_now: bool = False, trigger: str | None = None) -> list:
    """One query per source. A batch's source offsets are committed after all its sinks returned.

    A batch's objects are named by the query and the number of the batch, so a batch that runs again after a failure replaces what it wrote
    before. A batch starts every `runtime.batch_age` milliseconds, a second without it. Malformed lines and undecodable payloads of a batch are written to the folder `runtime.quarantine`; without one they are
    counted in the log.
    """
    _batches(spark, config)
    trigger = trigger or (f"{int(config.runtime['batch_age'])} milliseconds" if config.runtime.get("batch_age") else "1 second")
    started = []
    for name, settings in config.sources.items():
        stream = read_source(spark, name, settings, streaming=True)
        empty = spark.createDataFrame([], "raw string")

        def each(batch: DataFrame, number: int, name: str = name) -> None:
            held = batch.select(*(c for c in ("raw", "error") if c in batch.columns)).persist()
            made = None
            try:
                given = {n: held if n == name else empty for n in config.sources}
                made = compile(spark, config, given, mappers, keep=True)
                for (sink, prefix), df in made.sinks.items():
                    _write(config, sink, prefix, df, f"{_query_id(spark, f'{checkpoint}/{name}')}-{number:08d}")
                _set_aside(config, made, count=True)
            finally:
                for df in [held, *(made.kept if made else [])]:
                    df.unpersist()

        writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{checkpoint}/{name}")
        started.append((writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=trigger)).start())
    return started


def stop(queries: list, seconds: float = 120.0) -> None:
    """Graceful end: feeds take nothing more and seal what they hold, each query works off what is there, and then stops."""
    stop_all(min(seconds, 30.0))
    until = time.monotonic() + seconds
    for q in queries:
        idle = False
        while q.isActive and not idle and time.monotonic() < until:
            status = q.status
            idle = not status["isDataAvailable"] and not status["isTriggerActive"]
            time.sleep(0.05)
        q.stop()


__all__ = ["Compiled", "Node", "compile", "make_mapper", "run_once", "run_stream", "stop"]
