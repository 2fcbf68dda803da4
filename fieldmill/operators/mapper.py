"""Mappers: what selects records and turns them into new ones.

A mapper says which records it wants (`selectors`) and either transforms a DataFrame (`transform`, preferred: the optimizer sees
through it) or works on batches of records in Python (`process_logs`). The selector always runs before Python is entered.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.logview import LogView
from ..functions.paths import CORRUPT, Fields
from .predicates import matches, necessary


class Mapper:
    name = "mapper"
    version = "0.1.0"
    #: What a failing batch does: skip_batch (its records are counted in the worker's log), fail, or quarantine (its records come out with the
    #: error, and a pipeline sets them aside).
    on_error = "skip_batch"

    def __init__(self, config: dict | None = None):
        self._config = dict(config or {})

    def config(self, key: str) -> str | None:
        """A configured value: strings as they are, anything else as JSON."""
        value = self._config.get(key)
        return value if value is None or isinstance(value, str) else json.dumps(value)

    def selectors(self) -> list:
        return []

    #: The paths that `from_fields` reads, if that is all a native mapper needs; only these are parsed then.
    fields: tuple[str, ...] | None = None

    def from_fields(self, df: DataFrame, v) -> DataFrame:
        """The result over df, where v is what `access` reads fields from: a document or single fields."""
        raise NotImplementedError

    def transform(self, df: DataFrame) -> DataFrame:
        """df has raw (string) and v (variant); the result is one row per output record."""
        return self.from_fields(df, F.col("v"))

    #: Batch mappers override one of these: a list of LogView to bytes of NDJSON lines, or one LogView to one record, None for none.
    process_logs = None
    process_log = None

    @property
    def native(self) -> bool:
        return self.process_logs is None and self.process_log is None

    def run_batch(self, logs: list[LogView]) -> bytes:
        if self.process_logs is not None:
            return self.process_logs(logs)
        made = (self.process_log(log) for log in logs)
        return "".join(json.dumps(x, ensure_ascii=False) + "\n" for x in made if x is not None).encode()

    @property
    def services(self):
        """The cache, locks and remote calls of the worker. Set up by the entries of `runtime` in the configuration."""
        from ..streaming.services import services_of

        return services_of(self._config.get("__runtime") or {})


def parsed(df: DataFrame) -> DataFrame:
    """df with v, raw as a variant; v is null for text that is no JSON.

    The variant comes from a generated row, which keeps the optimizer from parsing again in every expression that uses it.
    """
    return df.select("*", F.inline(F.array(F.struct(F.try_parse_json("raw").alias("v")))))


def split_malformed(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, quarantined): blank lines are in neither."""
    seen = df.where(F.length(F.trim("raw")) > 0)
    return seen.where(F.col("v").isNotNull()), seen.where(F.col("v").isNull())


def selected(df: DataFrame, mapper: Mapper) -> DataFrame:
    """The records a mapper wants. The condition on the text alone moves below the parser."""
    wanted = mapper.selectors()
    return df.where(necessary(wanted, F.col("raw"))).where(matches(wanted, F.col("v")))


def _opaque(mapper: Mapper):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column(0).to_pylist()
            out, error = [], None
            try:
                done = mapper.run_batch([LogView(r) for r in raws])
                out = [x for x in done.decode("utf-8").split("\n") if x.strip()]
            except Exception as e:
                if mapper.on_error == "fail":
                    raise
                if mapper.on_error == "quarantine":
                    out, error = raws, f"{type(e).__name__}: {e}"
                else:
                    logging.getLogger(__name__).warning("%s: %d records are left out: %s: %s", mapper.name, len(raws), type(e).__name__, e)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array([error] * len(out), pa.string())], names=["out", "error"])

    return run


def apply(df: DataFrame, mapper: Mapper) -> DataFrame:
    """The mapper's output over parsed records: its own columns if native, else `out` (one JSON line each) and `error`."""
    wanted = selected(df, mapper)
    return mapper.transform(wanted) if mapper.native else wanted.select("raw").mapInArrow(_opaque(mapper), "out string, error string")


def _paths(selectors) -> list[str]:
    return [p.path for s in selectors for p in (*s.any, *s.all, *s.none)]


def apply_raw(df: DataFrame, mapper: Mapper) -> DataFrame:
    """The mapper's output over lines (raw), blank and malformed ones left out.

    A mapper's selectors, and all of a native mapper that names its fields, need a few keys of each record: only these are parsed, with their
    kinds kept. Other native mappers get whole documents. Of a key that a record repeats, the last value holds.
    """
    wanted = mapper.selectors()
    fields = Fields([*(mapper.fields or ()), *_paths(wanted)])
    if (mapper.native and mapper.fields is None) or not fields.usable or not fields.roots:
        return apply(split_malformed(parsed(df))[0], mapper)
    near = df.select("raw").where(necessary(wanted, F.col("raw")) & (F.length(F.trim("raw")) > 0))
    is_object = F.ltrim("raw").startswith("{")
    read = F.from_json(F.when(is_object, F.col("raw")), fields.schema(), {"columnNameOfCorruptRecord": CORRUPT, "allowNonNumericNumbers": "false", "allowSingleQuotes": "false"})
    held = near.select("raw", F.inline(F.array(F.coalesce(read, F.from_json(F.lit("{}"), fields.schema())))))
    valid = F.when(is_object, F.col(CORRUPT).isNull()).otherwise(F.try_parse_json("raw").isNotNull())
    chosen = held.where(matches(wanted, fields) & valid)
    return mapper.from_fields(chosen, fields) if mapper.native else chosen.select("raw").mapInArrow(_opaque(mapper), "out string, error string")


def lines(df: DataFrame) -> DataFrame:
    """Any mapper's output as records again: one JSON text per row in `raw`."""
    if df.columns == ["out", "error"]:
        return df.where(F.col("error").isNull()).select(F.col("out").alias("raw"))
    return df if df.columns == ["raw"] else df.select(F.to_json(F.struct("*")).alias("raw"))
