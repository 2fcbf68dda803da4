"""Distinct counts per group and combination of groups, exactly, from membership patterns.

Each identifier of a scope is reduced to the set of groups that hold it, its pattern. Identifiers with the same pattern are counted
together, and the number of distinct identifiers in any group, coarser group, union, intersection or difference of groups is the sum of
the totals of the patterns that qualify: no identifier is looked at again. The error is zero.

A group is a numbered part, such as a day, within the values of further columns. Numbers are absolute, so parts of the data made
apart agree; a pattern is a list of cells (columns, word, bits), one for each word of numbers met, so it is as long as what the identifier
belongs to and not as the range of numbers. Partial results are tables of memberships (scope, identifier, columns, word, bits)
that a bitwise or combines, on the map side first. A scope with a third of all rows is spread by its identifiers.
"""

from __future__ import annotations

from functools import reduce
from itertools import chain, combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import col

#: Numbers per word of a pattern; the sign bit is left alone.
BITS = 62
#: What stands between the values of a projected cell, its escape, and a null value.
_SEP, _ESCAPE, _NULL = "\x01", "\x02", "\x02n"


def _columns(names) -> list[Column]:
    return [col(n) for n in names]


#: Columns that the tables here have besides the named ones.
_OWN = frozenset(("word", "bits", "cells", "n", "level", "index"))


def memberships(rows: DataFrame, scope: list[str], identifier: str, number: Column, groups: list[str] = ()) -> DataFrame:
    """scope, identifier, groups, word, bits: what holds each identifier of a scope. number numbers the part, null for none.

    Null identifiers are left out; a null scope or group value is a value; a row without a number makes its identifier count in the scope
    and in the groups, but in no numbered part; repeated rows change nothing. Other columns are
    ignored; word, bits, cells, n, level and index are no names for the columns used.
    """
    if taken := _OWN & {*scope, identifier, *groups}:
        raise ValueError(f"rename {', '.join(sorted(taken))}")
    n = number.cast("bigint")
    held = rows.select(*_columns(scope), col(identifier), *_columns(groups), n.alias("__n")).where(col(identifier).isNotNull())
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.col("__n"), F.lit(BITS)).cast("int"))
    word = F.floor(F.col("__n") / BITS)
    return held.withColumn("word", word).groupBy(*_columns(scope), col(identifier), *_columns(groups), "word").agg(F.bit_or(F.coalesce(bit, F.lit(0).cast("bigint"))).alias("bits"))


def merge(parts: DataFrame, scope: list[str], identifier: str, groups: list[str] = ()) -> DataFrame:
    """Memberships of several parts, or over scope and group columns that are not named, as one."""
    return parts.groupBy(*_columns(scope), col(identifier), *_columns(groups), "word").agg(F.bit_or("bits").alias("bits"))


def totals(held: DataFrame, scope: list[str], identifier: str, groups: list[str] = ()) -> DataFrame:
    """scope, cells, n: how many identifiers of the scope have each pattern. cells is a sorted array of (groups, word, bits)."""
    cell = F.struct(*(col(g).cast("string").alias(f"g{i}") for i, g in enumerate(groups)), "word", "bits")
    patterns = held.groupBy(*_columns(scope), col(identifier)).agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    return patterns.groupBy(*_columns(scope), "cells").agg(F.count("*").alias("n"))


def _numbers(c: Column) -> Column:
    places = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.getbit(c["bits"], i) == 1)
    return F.transform(places, lambda i: c["word"] * BITS + i)


def _coded(value: Column) -> Column:
    escaped = F.replace(F.replace(value, F.lit(_ESCAPE), F.lit(_ESCAPE + "b")), F.lit(_SEP), F.lit(_ESCAPE + "a"))
    return F.coalesce(escaped, F.lit(_NULL))


def _decoded(text: Column) -> Column:
    return F.when(text != _NULL, F.replace(F.replace(text, F.lit(_ESCAPE + "a"), F.lit(_SEP)), F.lit(_ESCAPE + "b"), F.lit(_ESCAPE)))


def per_group(counted: DataFrame, scope: list[str], groups: list[str] = ()) -> DataFrame:
    """scope, groups, level, index, n: distinct identifiers in each numbered part, and over all of them (index null), of every combination of the groups.

    level names the groups that are told apart, as a sorted array of their places; of the others the column is null.
    Every count is a sum over pattern totals, to which a pattern adds once for each projection of its cells.
    """
    if not groups:
        numbers = F.flatten(F.transform(F.filter("cells", lambda c: c["word"].isNotNull()), _numbers))
        each = counted.select(*_columns(scope), F.explode(F.concat(F.array(F.lit(None).cast("bigint")), numbers)).alias("index"), "n")
        return each.groupBy(*_columns(scope), "index").agg(F.sum("n").alias("n"))
    places = range(len(groups))
    levels = list(chain.from_iterable(combinations(places, k) for k in range(len(groups) + 1)))
    spelled = F.transform("cells", lambda c: F.struct(*(_coded(c[f"g{i}"]).alias(f"g{i}") for i in places), F.when(c["word"].isNotNull(), _numbers(c)).alias("at")))
    read = counted.select(*_columns(scope), "n", spelled.alias("__cells"))

    def key(level: int, c: Column, number: Column) -> Column:
        return F.concat_ws(_SEP, F.lit(str(level)), number, *(c[f"g{i}"] for i in levels[level]))

    def projections(level: int) -> list[Column]:
        """The distinct projections of a pattern's cells: without numbers, and with each."""
        numbered = F.transform(F.filter("__cells", lambda c: c["at"].isNotNull()), lambda c: F.transform(c["at"], lambda d: key(level, c, d.cast("string"))))
        return [F.array_distinct(F.transform("__cells", lambda c: key(level, c, F.lit("")))), F.array_distinct(F.flatten(numbered))]

    shown = [x for level in range(len(levels)) for x in projections(level)]
    summed = read.select(*_columns(scope), "n", F.explode(F.concat(*shown)).alias("__key")).groupBy(*_columns(scope), "__key").agg(F.sum("n").alias("n"))
    parts = F.split("__key", _SEP)
    level = parts[0].cast("int")
    at = {(k, i): levels[k].index(i) + 2 for k in range(len(levels)) for i in levels[k]}
    values = [F.coalesce(*(F.when(level == k, _decoded(parts[at[k, i]])) for k in range(len(levels)) if (k, i) in at)).alias(g) for i, g in enumerate(groups)]
    open_ = F.element_at(F.array(*(F.array(*(F.lit(i) for i in x)).cast("array<int>") for x in levels)), level + 1)
    return summed.select(*_columns(scope), *values, open_.alias("level"), F.when(parts[1] != "", parts[1]).cast("bigint").alias("index"), "n")


def combination(counted: DataFrame, scope: list[str], any_of: list[int] = (), all_of: list[int] = (), none_of: list[int] = ()) -> DataFrame:
    """scope, n: distinct identifiers that are in one of the numbered parts any_of (if given), in each of all_of and in none of none_of."""

    def words(numbers) -> dict[int, int]:
        out: dict[int, int] = {}
        for i in set(numbers):
            out[i // BITS] = out.get(i // BITS, 0) | 1 << (i % BITS)
        return out

    def bits(w: int) -> Column:
        """The bits of word w over all cells of the pattern."""
        return F.aggregate(F.filter("cells", lambda c: c["word"] == w), F.lit(0).cast("bigint"), lambda a, c: a.bitwiseOR(c["bits"]))

    fits = F.lit(True)
    if any_of:
        fits &= reduce(lambda x, y: x | y, (bits(w).bitwiseAND(F.lit(m)) != 0 for w, m in words(any_of).items()))
    for w, m in words(all_of).items():
        fits &= bits(w).bitwiseAND(F.lit(m)) == m
    for w, m in words(none_of).items():
        fits &= bits(w).bitwiseAND(F.lit(m)) == 0
    return counted.where(fits).groupBy(*_columns(scope)).agg(F.sum("n").alias("n"))
