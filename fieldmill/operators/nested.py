"""Nested records as flat tables that keep parent and place.

JSON text is read as a stream of records, each parsed into triples (path, ordinals, value) when its turn comes and then let go: the path names fields from the record's root with `[]`
for each array passed, the ordinals are the 0-based places in those arrays. Triples are grouped by their repeated ancestor, the
path up to the last `[]`, and each group is pivoted into one table whose key is the record and the ordinals, so that the leading
ordinals are the key of the parent row. Typed columns hold the same triples already; `typed_table` reads them from the schema.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..session import col

TRIPLES = "key string, rec_pos bigint, path string, ordinals array<bigint>, value string"
_ARROW = pa.schema([("key", pa.string()), ("rec_pos", pa.int64()), ("path", pa.string()), ("ordinals", pa.list_(pa.int64())), ("value", pa.string())])


def _no_constant(word: str):
    raise ValueError(word)


_DECODER = json.JSONDecoder(parse_constant=_no_constant, parse_float=lambda text: _Lexeme(text))


class _Lexeme(str):
    """A number as it was written."""


def _decode(text: str):
    return _DECODER.decode(text)


def _text(value) -> str | None:
    if value is None:
        return None
    if value is True or value is False:
        return "true" if value else "false"
    return str(value)


_BLANK = re.compile(r"[ \t\r\n]*")
#: Strings, and what opens or closes a value.
_BRACKET = re.compile(r'"(?:[^"\\]|\\.)*+"|[\[\]{}]', re.S)
_MEMBER = re.compile(r'[ \t\r\n]*("(?:[^"\\]|\\.)*+")[ \t\r\n]*:[ \t\r\n]*', re.S)
_SCALAR = re.compile(r"[^,}\]\s]*")


def _end(text: str, at: int) -> int:
    """Where the value that starts at `at` ends, from its brackets alone."""
    if text[at] not in '{["':
        return _SCALAR.match(text, at).end()
    depth = 0
    for found in _BRACKET.finditer(text, at):
        c = text[found.start()]
        depth += (c in "{[") - (c in "}]")
        if depth == 0:
            return found.end()
    raise ValueError("a value does not end")


def _spans(text: str, at: int) -> dict[str, int]:
    """Where the values of an object's keys start, from the object's opening brace; of a repeated key the last."""
    out, at = {}, at + 1
    while found := _MEMBER.match(text, at):
        out[json.loads(found.group(1))] = found.end()
        at = _BLANK.match(text, _end(text, found.end())).end()
        if text[at : at + 1] != ",":
            break
        at += 1
    return out


def _find(text: str, at: int, path: str) -> int | None:
    """Where the value of a dotted path within the object at `at` starts; a key that is the whole rest of the path wins."""
    spans = _spans(text, at)
    if path in spans:
        return spans[path]
    dot = path.rfind(".")
    while dot > 0:
        inner = spans.get(path[:dot])
        if inner is not None and text[inner] == "{" and (found := _find(text, inner, path[dot + 1 :])) is not None:
            return found
        dot = path.rfind(".", 0, dot)
    return None


def _elements(text: str, at: int) -> Iterator:
    """The elements of the list at `at`, parsed one after another; returns where the list ends."""
    at = _BLANK.match(text, at + 1).end()
    if text[at : at + 1] == "]":
        return at + 1
    while True:
        value, at = _DECODER.raw_decode(text, at)
        yield value
        at = _BLANK.match(text, at).end()
        if text[at : at + 1] == "]":
            return at + 1
        if text[at : at + 1] != ",":
            raise ValueError("a list does not go on")
        at = _BLANK.match(text, at + 1).end()


def stream_records(text: str, envelopes: Iterable[str] = ("records", "data.items")) -> Iterator:
    """The records of one payload, each parsed when its turn comes: the elements of a list, of the first envelope path present, or the one object itself.

    Raises ValueError at the latest after the last record if the payload is no valid JSON.
    """
    at = _BLANK.match(text).end()
    if text[at : at + 1] == "[":
        end = yield from _elements(text, at)
        if text[end:].strip(" \t\r\n"):
            raise ValueError("text follows the payload")
        return
    if text[at : at + 1] != "{":
        _decode(text)
        return
    for path in envelopes:
        if (path.split(".")[0] in text or "\\u" in text) and (found := _find(text, at, path)) is not None:
            end = _end(text, found)
            if text[found] == "[":
                yield from _elements(text, found)
            elif (value := _decode(text[found:end])) is not None:
                yield value
            _decode(text[:found] + "null" + text[end:])  # the rest of the envelope must be valid too
            return
    yield _decode(text)


class _Walk:
    """Yields the triples of a record. keep: leaf paths wanted, or None for all; others are passed by without descending."""

    def __init__(self, lists: Iterable[str], texts: Iterable[str], keep: Iterable[str] | None):
        self.lists, self.texts = frozenset(lists), frozenset(texts)
        self.keep = None if keep is None else frozenset(keep)
        self.roots = None if keep is None else frozenset(p for k in keep for p in self._above(k))

    @staticmethod
    def _above(path: str) -> Iterator[str]:
        yield path
        for i, c in enumerate(path):
            if c == "." or path.startswith("[]", i):
                yield path[:i]
                if c == "[":
                    yield path[: i + 2]

    def fields(self, obj: dict, path: str, ordinals: tuple, above: tuple = ()) -> Iterator[tuple]:
        """above: (object, length of its path) of the objects around obj within the same array element."""
        for key, value in obj.items():
            inner = f"{path}.{key}" if path else key
            if above and any(inner[n + 1 if n else 0 :] in holder for holder, n in above):
                continue  # the literal key further up wins
            yield from self.value(value, inner, ordinals, (*above, (obj, len(path))))

    def value(self, value, path: str, ordinals: tuple, above: tuple) -> Iterator[tuple]:
        if self.roots is not None and path not in self.roots:
            return
        if path in self.texts and isinstance(value, str):
            try:
                value = _decode(value)
            except (ValueError, RecursionError):
                pass
        if isinstance(value, list) or (path in self.lists and value is not None):
            inner = path + "[]"
            if self.roots is not None and inner not in self.roots:
                return
            for i, x in enumerate(value if isinstance(value, list) else [value]):
                if isinstance(x, dict):
                    yield from self.fields(x, inner, (*ordinals, i))
                elif isinstance(x, list):
                    yield from self.value(x, inner, (*ordinals, i), ())
                elif self.keep is None or inner in self.keep:
                    yield inner, (*ordinals, i), _text(x)
        elif isinstance(value, dict):
            yield from self.fields(value, path, ordinals, above)
        elif self.keep is None or path in self.keep:
            yield path, ordinals, _text(value)


def json_triples(
    df: DataFrame,
    key: str,
    payload: str,
    lists: Iterable[str] = (),
    texts: Iterable[str] = (),
    envelopes: Iterable[str] = ("records", "data.items"),
    keep: Iterable[str] | None = None,
) -> DataFrame:
    """The triples of JSON payloads: (key string, rec_pos, path, ordinals, value).

    A payload is one object, a list, or an envelope with the list. `lists` are paths at which a lone value stands for a list of
    one, `texts` paths whose strings may hold JSON. Nulls are kept as triples with a null value; elements that are no objects
    hold a place but give no triples; null, blank and invalid payloads give none. A literal dotted key wins over the nested path,
    even if null; of a key repeated in one object the last value holds. Numbers keep their written form. Repeated rows repeat
    their triples; an empty table gives an empty one. `keep` limits parsing to the leaf paths named.
    """
    walk = _Walk(lists, texts, keep)
    envelopes = tuple(envelopes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for k, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held = len(out)
                try:
                    for i, record in enumerate(stream_records(payload.strip("\ufeff \t\r\n"), envelopes) if payload else ()):
                        if isinstance(record, dict):
                            out.extend((k, i, path, ordinals, value) for path, ordinals, value in walk.fields(record, "", ()))
                except (ValueError, RecursionError, IndexError):
                    del out[held:]  # of a payload that is not valid to its end nothing is taken
                if len(out) >= 8192:
                    yield _batch(out)
                    out = []
        if out:
            yield _batch(out)

    return df.select(col(key).cast("string").alias("key"), col(payload).cast("string").alias("payload")).mapInArrow(run, TRIPLES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), _ARROW)], schema=_ARROW)


def table_of(path: str) -> str:
    """The repeated ancestor of a leaf path: the path up to its last [] (the record itself: empty)."""
    return path[: path.rfind("[]") + 2] if "[]" in path else ""


def leaf_name(path: str) -> str:
    """A leaf's column in its table: what follows the ancestor, `value` if nothing does."""
    return path[len(table_of(path)) :].lstrip(".") or "value"


def pivot_table(triples: DataFrame, table: str, leaves: Iterable[str]) -> DataFrame:
    """One flat table of the triples under a repeated ancestor: key, rec_pos, ordinals and a string column for each leaf.

    leaves are full leaf paths of the table; a column is named by what follows the ancestor (`value` if nothing does). The parent
    row is that of the same key and rec_pos whose ordinals are these without the last. Rows exist where any leaf has a triple;
    repeated triples collapse.
    """
    leaves = list(leaves)
    names = {p: p[len(table) :].lstrip(".") or "value" for p in leaves}
    kept = triples.where(F.col("path").isin(leaves))
    return kept.groupBy("key", "rec_pos", "ordinals").agg(*(F.max(F.when(F.col("path") == p, F.col("value"))).alias(n) for p, n in names.items()))


def flat_tables(triples: DataFrame, leaves: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """The flat table of each repeated ancestor, by ancestor; the leaves are grouped by it, without leaves all paths found.

    Paths are found by one pass; triples that are costly to make should be kept, as every table reads them.
    """
    if leaves is None:
        leaves = sorted(r.path for r in triples.select("path").distinct().collect())
    by: dict[str, list[str]] = {}
    for path in leaves:
        by.setdefault(table_of(path), []).append(path)
    return {table: pivot_table(triples, table, own) for table, own in by.items()}


def typed_record(df: DataFrame) -> DataFrame:
    """One row per row: the leaves of all structs as columns, named by their path with _ for dots. Arrays are left to their own tables."""

    def leaves(schema: StructType, at: tuple[str, ...]) -> Iterator[tuple[str, ...]]:
        for f in schema.fields:
            if isinstance(f.dataType, StructType):
                yield from leaves(f.dataType, (*at, f.name))
            elif not isinstance(f.dataType, ArrayType):
                yield (*at, f.name)

    return df.select(*(F.col(".".join(f"`{x}`" for x in path)).alias("_".join(path)) for path in leaves(df.schema, ())))


def typed_table(df: DataFrame, keys: dict[str, Column], array: Column, fields: dict[str, str] | None = None) -> DataFrame:
    """One flat table of a typed array column: the keys, pos (0-based, null elements counted) and the element or its fields.

    fields maps output names to field paths within an element; without it the element comes out as `value`. Null and empty arrays
    give no rows; a null element gives a row of nulls.
    """
    rows = df.select(*(c.alias(n) for n, c in keys.items()), F.posexplode(array).alias("pos", "__element"))
    inner = F.col("__element")

    def leaf(path: str) -> Column:
        at = inner
        for name in path.split("."):
            at = at[name]
        return at

    values = [leaf(p).alias(n) for n, p in fields.items()] if fields else [inner.alias("value")]
    return rows.select(*keys, F.col("pos").cast("bigint").alias("pos"), *values)
