"""Predicates over fields and selectors made of them. Every predicate is true or false, never null."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.paths import access

#: Numbers are equal if they differ by less than this.
EPSILON = 2.220446049250313e-16


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


@dataclass(frozen=True)
class Has:
    path: str

    def column(self, v: Column) -> Column:
        return access(v, self.path).isNotNull()


def _equal(x: Column, value) -> Column:
    if isinstance(value, bool):
        return _sure(S.boolean(x) == value)
    if isinstance(value, str):
        return _sure(S.string(x) == value)
    if isinstance(value, int):
        return _sure(S.bigint(x) == F.lit(value).cast("bigint")) | _sure(F.abs(S.double(x) - float(value)) < EPSILON)
    if isinstance(value, float):
        return _sure(F.abs(S.numeric(x) - value) < EPSILON)
    raise TypeError(f"not a scalar: {value!r}")


@dataclass(frozen=True)
class Eq:
    """Equality of the same kind; whole and real numbers compare as numbers."""

    path: str
    value: str | int | float | bool

    def column(self, v: Column) -> Column:
        return _equal(access(v, self.path), self.value)


@dataclass(frozen=True)
class In:
    path: str
    values: tuple

    def column(self, v: Column) -> Column:
        x = access(v, self.path)
        texts = [a for a in self.values if isinstance(a, str)]
        tests = [_sure(S.string(x).isin(texts))] if texts else []
        tests += [_equal(x, a) for a in self.values if not isinstance(a, str)]
        return reduce(lambda a, b: a | b, tests, F.lit(False))


@dataclass(frozen=True)
class Prefix:
    path: str
    text: str

    def column(self, v: Column) -> Column:
        return _sure(S.string(access(v, self.path)).startswith(self.text))


@dataclass(frozen=True)
class Gt:
    path: str
    bound: float

    def column(self, v: Column) -> Column:
        return _sure(S.numeric(access(v, self.path)) > float(self.bound))


#: The POSIX classes as they are within a class of ASCII characters.
POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t ", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": "!-~", "lower": "a-z",
    "print": " -~", "punct": r"!-/:-@\[-`{-~", "space": r"\t\n\x0B\f\r ", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
_POSIX = re.compile(r"\[:(\^?)(\w+):\]")


def java_pattern(pattern: str) -> str:
    """A linear-time regex in the form the JVM reads with the same meaning; look-around and back-references are refused.

    `$` means the very end of the text; character classes are Unicode ones, but POSIX classes hold ASCII characters.
    """
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            n = pattern[i + 1]
            if n.isdigit() or (n == "k" and pattern[i + 2 : i + 3] == "<"):
                raise ValueError(f"back-references are not supported: {pattern!r}")
            out.append("\\z" if n == "z" else c + n)
            i += 2
            continue
        if c == "[" and in_class and (found := _POSIX.match(pattern, i)):
            if found.group(2) not in POSIX:
                raise ValueError(f"unknown class in {pattern!r}: {found.group(2)}")
            out.append(f"[{found.group(1)}{POSIX[found.group(2)]}]")
            i = found.end()
            continue
        if c == "[" and not in_class:
            in_class = True
        elif c == "]" and in_class and pattern[i - 1] not in "[^":
            in_class = False
        elif not in_class:
            if re.match(r"\(\?(?:[=!]|<[=!]|>)", pattern[i:]):
                raise ValueError(f"look-around is not supported: {pattern!r}")
            if pattern.startswith("(?P<", i):
                out.append("(?<")
                i += 4
                continue
            if c == "$":
                out.append("\\z")
                i += 1
                continue
        out.append(c)
        i += 1
    return "(?U)" + "".join(out)


@dataclass(frozen=True)
class Regex:
    """An unanchored search."""

    path: str
    pattern: str

    def column(self, v: Column) -> Column:
        return _sure(S.string(access(v, self.path)).rlike(java_pattern(self.pattern)))


@dataclass(frozen=True)
class Selector:
    """(no `any`, or one of them) and each of `all` and none of `none`; an empty selector takes everything."""

    any: tuple = field(default=())
    all: tuple = field(default=())
    none: tuple = field(default=())

    def column(self, v: Column) -> Column:
        met = F.lit(True)
        if self.any:
            met &= reduce(lambda a, b: a | b, (p.column(v) for p in self.any))
        for p in self.all:
            met &= p.column(v)
        for p in self.none:
            met &= ~p.column(v)
        return met


def matches(selectors, v: Column) -> Column:
    """Whether one of the selectors holds; an empty list matches nothing."""
    return reduce(lambda a, b: a | b, (s.column(v) for s in selectors), F.lit(False))


def _texts(p) -> list[str]:
    """What a record's text must contain for a predicate to hold, if no escape hides it: the last key, and a string sought."""
    key = p.path.split(".")[-1].partition("[")[0]
    sought = p.value if isinstance(p, Eq) and isinstance(p.value, str) else p.text if isinstance(p, Prefix) else ""
    return [t for t in (sought, key) if t]


def necessary(selectors, raw: Column) -> Column:
    """A cheap condition on a record's text that holds wherever the selectors do: nothing needs to be parsed to rule a record out.

    A string in JSON is written as it is or with a backslash somewhere, so texts with a backslash always pass.
    """
    ways = [reduce(lambda a, b: a & b, (raw.contains(t) for p in s.all for t in _texts(p)), F.lit(True)) for s in selectors]
    return reduce(lambda a, b: a | b, ways, F.lit(False)) | raw.contains("\\")
