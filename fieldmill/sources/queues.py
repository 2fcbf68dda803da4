"""Message logs and queues."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decoding import decode, decode_payload


def kafka_options(bootstrap: str, topic: str, group_id: str = "fieldmill", security: str = "PLAINTEXT", ssl: dict | None = None, scram: dict | None = None, max_offsets: int | None = None) -> dict[str, str]:
    """The reader options of one topic: from the latest offsets, with headers; SCRAM-SHA-512 unless another mechanism is named."""
    out = {
        "kafka.bootstrap.servers": bootstrap, "subscribe": topic, "kafka.group.id": group_id, "kafka.security.protocol": security, "startingOffsets": "latest", "includeHeaders": "true",
        "kafka.fetch.max.bytes": str(10 << 20),
    }
    for name, value in (ssl or {}).items():
        out[f"kafka.ssl.{name.replace('_', '.')}"] = value
    if scram:
        quoted = {k: scram[k].replace("\\", "\\\\").replace('"', '\\"') for k in ("username", "password")}
        out["kafka.sasl.mechanism"] = scram.get("mechanism", "SCRAM-SHA-512")
        out["kafka.sasl.jaas.config"] = f'org.apache.kafka.common.security.scram.ScramLoginModule required username="{quoted["username"]}" password="{quoted["password"]}";'
    if max_offsets:
        out["maxOffsetsPerTrigger"] = str(max_offsets)
    return out


def stream_kafka(spark: SparkSession, options: dict[str, str], form: str = "ndjson", compression: str = "auto") -> DataFrame:
    """(raw, error) of a topic, raw null and the error told where a payload cannot be decoded. The connector is not part of Spark's core; without its package this fails when it is called."""
    messages = spark.readStream.format("kafka").options(**options).load()
    header = lambda key: F.get(F.filter("headers", lambda h: F.lower(h["key"]) == key)["value"], F.lit(0)).cast("string").alias(key)
    return decode(messages.select("value", header("filename"), header("content-encoding")), "value", form, compression, "filename", header="content-encoding")


def object_key(spelled: str) -> str:
    """An object's key as notifications spell it: plus signs are blanks, then escapes are undone."""
    return unquote(spelled.replace("+", " "))


def expand_message(body: str, fetch: Callable[[str, str], bytes], form: str = "ndjson", compression: str = "auto") -> list[str]:
    """The records of one queue message: of every object it announces, or of the body itself."""
    try:
        notice = json.loads(body)
    except ValueError:
        notice = None
    if isinstance(notice, dict) and isinstance(notice.get("Records"), list):
        out = []
        for r in notice["Records"]:
            bucket, key = r["s3"]["bucket"]["name"], object_key(r["s3"]["object"]["key"])
            out += decode_payload(fetch(bucket, key), form, compression, filename=key)
        return out
    data = body.encode()
    try:
        return decode_payload(data, form, compression)
    except (ValueError, OSError):
        return decode_payload(data, "ndjson", "none")


def poll_queue(receive: Callable[[], Iterable[dict]], fetch, delete: Callable[[str], None], deliver: Callable[[list[str]], None], form: str = "ndjson", compression: str = "auto") -> int:
    """One poll: every message {body, receipt} is expanded and delivered, and deleted only after that. Returns the records."""
    n = 0
    for message in receive():
        lines = expand_message(message["body"], fetch, form, compression)
        if lines:
            deliver(lines)
        delete(message["receipt"])
        n += len(lines)
    return n
