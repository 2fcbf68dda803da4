"""Records from files, in batches or as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decoding import decode

_HADOOP_SUFFIXES = (".gz", ".zst", ".zstd", ".deflate", ".bz2", ".snappy", ".lz4")


def read_records(spark: SparkSession, path: str, form: str = "ndjson", compression: str = "auto") -> DataFrame:
    """(raw) of a file, folder or pattern.

    Plain lines, and compressed ones whose suffix says so, are read by the built-in reader, which splits plain files over
    tasks; every other case decodes whole files. A payload that cannot be decoded fails the query.
    """
    if form in ("ndjson", "text") and compression in ("auto", "none") and not path.lower().endswith(".gzip"):
        rows = spark.read.text(path).select(F.col("value").alias("raw"))
        return rows.where(F.length(F.trim("raw")) > 0)
    files = spark.read.format("binaryFile").load(path)
    return decode(files, "content", form, compression, "path", on_error="fail").select("raw")


def stream_records(spark: SparkSession, path: str, form: str = "ndjson", compression: str = "auto", max_files: int = 64) -> DataFrame:
    """The same of a folder that grows."""
    if form in ("ndjson", "text") and compression in ("auto", "none"):
        rows = spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
        return rows.select(F.col("value").alias("raw")).where(F.length(F.trim("raw")) > 0)
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", max_files).load(path)
    return decode(files, "content", form, compression, "path", on_error="fail").select("raw")
