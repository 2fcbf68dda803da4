"""Encodings and sinks."""

from __future__ import annotations

import json
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.mapper import lines
from ..sources.decoding import compress

CONTENT_TYPES = {"ndjson": "application/x-ndjson", "json": "application/json", "avro": "application/avro", "parquet": "application/vnd.apache.parquet"}
SUFFIXES = {"none": "", "gzip": ".gz", "zstd": ".zst", "snappy": ".snappy", "deflate": ".deflate"}
_PARQUET = {"none": "none", "gzip": "gzip", "zstd": "zstd"}
_AVRO = {"none": "uncompressed", "gzip": "uncompressed", "deflate": "deflate", "zstd": "zstandard", "snappy": "snappy"}


def check(encoding: str, compression: str) -> None:
    """Refuses what cannot be written, before anything runs."""
    allowed = {"ndjson": ("none", "gzip", "zstd"), "json": ("none", "gzip", "zstd"), "parquet": tuple(_PARQUET), "avro": tuple(_AVRO)}
    if encoding not in allowed:
        raise ValueError(f"unknown encoding: {encoding}; one of {', '.join(allowed)}")
    if compression not in allowed[encoding]:
        raise ValueError(f"{encoding} cannot be compressed by {compression}; one of {', '.join(allowed[encoding])}")


def object_name(prefix: str | None, encoding: str, compression: str, unique: str | None = None) -> str:
    """[prefix/]id.encoding[.codec]"""
    name = f"{unique or uuid.uuid4().hex}.{encoding}{SUFFIXES[compression]}"
    return f"{prefix.strip('/')}/{name}" if prefix else name


def encode(rows: list[str], encoding: str) -> bytes:
    """JSON lines as one payload."""
    if encoding == "ndjson":
        return "".join(r.rstrip("\n") + "\n" for r in rows).encode()
    if encoding == "json":
        for r in rows:
            json.loads(r)  # one that is no JSON would spoil the array
        return f"[{','.join(rows)}]".encode()
    raise ValueError(f"not a text encoding: {encoding}")


#: An empty skippable frame of zstd, all of whose bytes are ASCII: Spark's text writer puts it after every frame as its line separator.
ZSTD_SKIP = b"\x50\x2a\x4d\x18\x00\x00\x00\x00"
#: Bytes of NDJSON in one zstd frame.
FRAME = 4 << 20


def _payloads(raw: DataFrame, encoding: str, compression: str, level: int, most: int) -> DataFrame:
    """(content binary): the records as payloads of at most `most` plain bytes; a larger record is alone in one."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                n = len(text.encode()) + 1
                if held and size + n > most:
                    out.append(compress(encode(held, encoding), compression, level))
                    held, size = [], 0
                held.append(text)
                size += n
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["content"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([compress(encode(held, encoding), compression, level)], pa.binary())], names=["content"])

    return raw.select("raw").where(F.col("raw").isNotNull()).mapInArrow(run, "content binary")


def _stage(df: DataFrame, folder: str, encoding: str, compression: str, schema: str | None, mode: str, level: int, max_bytes: int) -> None:
    """df by one of Spark's writers, whose committer leaves nothing of tasks that failed."""
    if encoding in ("parquet", "avro"):
        typed = lines(df).select(F.from_json("raw", schema).alias("r")).select("r.*") if schema else df
        typed.write.mode(mode).option("compression", (_PARQUET if encoding == "parquet" else _AVRO)[compression]).format(encoding).save(folder)
    elif encoding == "ndjson" and compression != "zstd":
        lines(df).select(F.rtrim("raw").alias("value")).write.mode(mode).option("compression", compression).text(folder)
    else:
        # a row is one frame or one array; the writer knows neither, so it gets the bytes as they are, several frames or one array a file
        zstd, array = compression == "zstd", encoding == "json"
        made = _payloads(lines(df), encoding, "zstd" if zstd else "none", level, max_bytes if array else min(FRAME, max_bytes))
        writer = made.select(F.col("content").cast("string").alias("value")).write.mode(mode)
        writer = writer.option("lineSep", ZSTD_SKIP.decode() if zstd else "\n").option("maxRecordsPerFile", 1 if array else max(1, max_bytes // FRAME))
        writer.option("compression", "none" if zstd else compression).text(folder)


def _publish(df: DataFrame, staged: str, target: str, stem: str, suffix: str, clear: str | None) -> None:
    """The staged files that are not empty under their final names, by Hadoop's file system; what matches `clear` goes first."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    files = path(staged).getFileSystem(conf)
    if clear:
        for old in files.globStatus(path(f"{target}/{clear}")) or []:
            if not old.getPath().getName().startswith(("_", ".")):
                files.delete(old.getPath(), True)
    names = sorted(f.getPath().getName() for f in files.listStatus(path(staged)) if f.getLen() > 0)
    for i, name in enumerate(n for n in names if n.startswith("part-")):
        if not files.rename(path(f"{staged}/{name}"), path(f"{target}/{stem}-{i:05d}{suffix}")):
            raise OSError(f"{target}/{stem}-{i:05d}{suffix} could not be written")
    files.delete(path(staged), True)


def write(df: DataFrame, folder: str, encoding: str = "ndjson", compression: str = "none", key_prefix: str | None = None, schema: str | None = None, mode: str = "append", level: int = 3, max_bytes: int = 64 << 20, batch: str | None = None) -> None:
    """A mapper's output into a folder of any Hadoop file system.

    ndjson: a line per record. json: an array per object. parquet and avro: with the schema given (SQL DDL), else the columns as they are.

    Without a batch, what Spark writes by itself is written straight into the folder in the mode given. Text in zstd, JSON arrays and every
    batch are staged in a hidden folder beside and renamed when all of it is whole, to `[prefix/]id-number.encoding.codec`. The id is new for each
    call, so an append never touches earlier objects; a batch is its own id, so a batch written again takes the place of its first try.
    """
    check(encoding, compression)
    target = f"{folder.rstrip('/')}/{key_prefix.strip('/')}" if key_prefix else folder.rstrip("/")
    if batch is None and not (encoding == "json" or encoding == "ndjson" and compression == "zstd"):
        _stage(df, target, encoding, compression, schema, mode, level, max_bytes)
        return
    if batch is None and mode != "append":
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(target)
        if mode != "overwrite" and at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).exists(at):
            if mode == "ignore":
                return
            raise FileExistsError(target)
    stem = batch or uuid.uuid4().hex
    staged = f"{target}/_staged-{stem}"
    _stage(df, staged, encoding, compression, schema, "overwrite", level, max_bytes)
    clear = f"{stem}-*" if batch else "*" if mode == "overwrite" else None
    _publish(df, staged, target, stem, f".{encoding}{SUFFIXES[compression] if encoding in ('ndjson', 'json') else ''}", clear)


def discard(df: DataFrame, observation=None) -> None:
    """Everything is computed and nothing kept; an Observation counts records and bytes on the way."""
    raw = lines(df)
    if observation is not None:
        raw = raw.observe(observation, F.count("*").alias("records"), F.sum(F.octet_length("raw")).alias("bytes"))
    raw.write.format("noop").mode("overwrite").save()
