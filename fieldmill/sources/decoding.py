"""Decoding of payloads: compression and format are settled for each, then every payload becomes lines of JSON."""

from __future__ import annotations

import gzip
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.msgpack import unpack
from ..session import col

FORMATS = ("ndjson", "text", "json", "json-array", "msgpack")


def resolve_compression(setting: str | None = "auto", header: str | None = None, filename: str | None = None, head: bytes = b"") -> str:
    """gzip, zstd or none. An explicit setting wins, then the transfer header, the file's suffix, the first bytes."""
    if setting and setting != "auto":
        return {"gz": "gzip", "zst": "zstd", "identity": "none"}.get(setting, setting)
    h = (header or "").lower()
    if "gzip" in h:
        return "gzip"
    if "zst" in h:
        return "zstd"
    if "identity" in h or "none" in h:
        return "none"
    name = (filename or "").lower()
    if name.endswith((".gz", ".gzip")):
        return "gzip"
    if name.endswith((".zst", ".zstd")):
        return "zstd"
    if head[:2] == b"\x1f\x8b":
        return "gzip"
    return "zstd" if head[:4] == b"\x28\xb5\x2f\xfd" else "none"


def _unzstd(data: bytes) -> tuple[bytes, bool]:
    """The plain bytes of all frames, and whether the last one is whole. Skippable frames are skipped."""
    import zstandard

    out = []
    while data:
        if data[1:4] == b"\x2a\x4d\x18" and 0x50 <= data[0] <= 0x5F:
            end = 8 + int.from_bytes(data[4:8], "little")
            if len(data) < max(end, 8):
                return b"".join(out), False
            data = data[end:]
            continue
        reader = zstandard.ZstdDecompressor().decompressobj()
        out.append(reader.decompress(data))
        if not reader.eof:
            return b"".join(out), False
        data = reader.unused_data
    return b"".join(out), True


def decompress(data: bytes, kind: str) -> bytes:
    """The plain bytes; of gzip the first member, of zstd all frames. A stream that is cut off is refused; no bytes at all give none."""
    if kind in ("gzip", "zstd"):
        if kind == "gzip":
            reader = zlib.decompressobj(wbits=31)
            plain, whole = reader.decompress(data), reader.eof
        else:
            plain, whole = _unzstd(data)
        if data and not whole:
            raise ValueError(f"the {kind} stream is cut off")
        return plain
    if kind in ("none", "auto"):
        return data
    raise ValueError(f"unknown compression: {kind}")


def compress(data: bytes, kind: str, level: int = 3) -> bytes:
    if kind == "gzip":
        return gzip.compress(data, mtime=0)
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdCompressor(level=level).compress(data)
    return data


def _spell(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def normalise(data: bytes, form: str) -> list[str]:
    """The JSON lines of one payload. Blank lines are left out.

    ndjson and text must start with an object; json, json-array and msgpack give one line per element of a list, else one line; what
    cannot be read as these comes out as it is.
    """
    if form in ("ndjson", "text"):
        text = data.decode("utf-8", "replace")
        if text and not text.startswith("{"):
            raise ValueError("the payload does not start with an object")
        return [x for x in text.split("\n") if x.strip()]
    if form in ("json", "json-array", "msgpack"):
        try:
            value = unpack(data) if form == "msgpack" else json.loads(data)
        except (ValueError, RecursionError):
            return [data.decode("utf-8", "replace")]
        return [_spell(x) for x in value] if isinstance(value, list) else [_spell(value)]
    raise ValueError(f"unknown format: {form}; one of {', '.join(FORMATS)}")


def decode_payload(data: bytes, form: str = "ndjson", compression: str = "auto", header: str | None = None, filename: str | None = None) -> list[str]:
    return normalise(decompress(data, resolve_compression(compression, header, filename, data[:8])), form)


def decode(df: DataFrame, content: str, form: str = "ndjson", compression: str = "auto", filename: str | None = None, on_error: str = "quarantine", header: str | None = None) -> DataFrame:
    """(raw, error) of a column of binary payloads, one row per record.

    filename and header name columns with the payload's file name and transfer encoding, which tell its compression unless that is given.
    on_error: quarantine (one row with the error, raw null), drop, or fail. Null payloads give nothing.
    """
    told = lambda name: (col(name) if name else F.lit(None)).cast("string")
    picked = df.select(col(content).cast("binary").alias("c"), told(filename).alias("f"), told(header).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws, errors = [], []
            for data, name, encoding in zip(*(c.to_pylist() for c in batch.columns)):
                if data is None:
                    continue
                try:
                    got = decode_payload(data, form, compression, encoding, name)
                except Exception as e:
                    if on_error == "fail":
                        raise
                    got = []
                    if on_error == "quarantine":
                        raws.append(None)
                        errors.append(f"{type(e).__name__}: {e}")
                raws += got
                errors += [None] * len(got)
                if len(raws) >= 8192:
                    yield pa.RecordBatch.from_arrays([pa.array(raws, pa.string()), pa.array(errors, pa.string())], names=["raw", "error"])
                    raws, errors = [], []
            if raws:
                yield pa.RecordBatch.from_arrays([pa.array(raws, pa.string()), pa.array(errors, pa.string())], names=["raw", "error"])

    return picked.mapInArrow(run, "raw string, error string")
