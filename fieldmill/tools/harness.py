"""Golden tests of mappers: records from a JSON file through a mapper, compared with the expected JSON.

What doesn't fit the driver is compared as DataFrames of lines: `placed` both and look for what is `differing`.
"""

from __future__ import annotations

import difflib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.mapper import Mapper, apply_raw, lines
from ..session import ensure_checkpoint_dir
from ..sources.decoding import normalise


def stable(value):
    """A value with keys sorted at every level, and JSON inside strings taken apart."""
    if isinstance(value, dict):
        return {k: stable(value[k]) for k in sorted(value)}
    if isinstance(value, list):
        return [stable(x) for x in value]
    if isinstance(value, str) and value[:1] in "{[":
        try:
            return stable(json.loads(value))
        except ValueError:
            return value
    return float(value) if isinstance(value, int) and not isinstance(value, bool) else value


def run_mapper(spark: SparkSession, mapper: Mapper, payload: bytes) -> list[str]:
    """The output lines for the records of a JSON payload, in their order."""
    raws = spark.createDataFrame([(x,) for x in normalise(payload, "json-array")], "raw string").coalesce(1)
    return [r.raw for r in mapped(raws, mapper).collect()]


def mapped(raws: DataFrame, mapper: Mapper) -> DataFrame:
    """The output lines (raw) for the records of raws, in their order."""
    return lines(apply_raw(raws, mapper))


def spelled(value) -> str:
    """A stable value as text."""
    return json.dumps(stable(value), ensure_ascii=False)


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([spelled(json.loads(x)) for x in batch.column(0).to_pylist()], pa.string())], names=["text"])


def placed(df: DataFrame) -> DataFrame:
    """(n, text): the lines (raw) of df, stable, with their places in its order, written once."""
    spark, folder = df.sparkSession, f"{ensure_checkpoint_dir(df.sparkSession)}/golden-{uuid.uuid4().hex}"
    df.select("raw").mapInArrow(_spell, "text string").select(F.monotonically_increasing_id().alias("id"), "text").write.parquet(folder)
    held = spark.read.schema("id bigint, text string").parquet(folder).withColumn("part", F.shiftright("id", 33))
    starts, at = [], 0
    for r in held.groupBy("part").count().orderBy("part").toLocalIterator():  # a row for each partition
        starts.append((r.part, at))
        at += r["count"]
    numbered = held.join(F.broadcast(spark.createDataFrame(starts, "part bigint, start bigint")), "part")
    return numbered.select((F.col("start") + F.col("id").bitwiseAND((1 << 33) - 1)).alias("n"), "text")


def differing(got: DataFrame, expected: DataFrame) -> DataFrame:
    """(n, expected, actual) where placed lines are not the same; null where one side has no line."""
    both = expected.withColumnRenamed("text", "expected").join(got.withColumnRenamed("text", "actual"), "n", "full_outer")
    return both.where(~F.col("expected").eqNullSafe(F.col("actual"))).select("n", "expected", "actual")


def passes(got: DataFrame, expected: DataFrame) -> bool:
    """Whether placed lines are as expected; no lines at all never are."""
    return not got.isEmpty() and differing(got, expected).isEmpty()


def compare(got: list[str], expected: str, context: int = 3) -> str:
    """Empty if the output is as expected, else a diff. One line is compared as an object, several as a list."""
    if not got:
        return "no output"
    values = [json.loads(x) for x in got]
    shown = [json.dumps(stable(x), indent=2, ensure_ascii=False).splitlines() for x in (json.loads(expected), values if len(values) > 1 else values[0])]
    return "\n".join(difflib.unified_diff(*shown, "expected", "actual", lineterm="", n=context))


def check(spark: SparkSession, mapper: Mapper, input_path: str, expected_path: str) -> str:
    with open(input_path, "rb") as a, open(expected_path, encoding="utf-8") as b:
        return compare(run_mapper(spark, mapper, a.read()), b.read())
