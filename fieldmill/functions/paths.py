"""Field paths over JSON documents held as VARIANT.

A path is first tried as one literal key of the root, dots included; a key that is present wins even if its value is null.
Otherwise it is split at dots into segments `key`, `key[i]`, `key[i][j]`. There are no wildcards, and literal dotted keys below the
root cannot be reached. Paths are read once, on the driver.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_INDEX = re.compile(r"\[([^\[\]]*)\]")


def segments(path: str) -> list[str | int] | None:
    """Keys and indexes of a nested path, or None if some index is no whole number from 0: such a path finds nothing.

    What stands between a closing bracket and the next opening one, or after the last, is ignored.
    """
    out: list[str | int] = []
    for part in path.split("."):
        key, bracket, rest = part.partition("[")
        out.append(key)
        if bracket:
            found = _INDEX.findall("[" + rest)
            if "[" + rest != "" and rest.count("[") + 1 != len(found):
                return None
            for index in found:
                if not index.isascii() or not index.isdigit():
                    return None
                out.append(int(index))
    return out


def _step(key: str | int) -> str:
    if isinstance(key, int):
        return f"[{key}]"
    if '"' in key and "'" in key:
        raise ValueError(f"a key with both kinds of quotes cannot be addressed: {key!r}")
    return f"['{key}']" if '"' in key else f'["{key}"]'


def _get(v: Column, keys: list[str | int]) -> Column:
    """The variant under keys; an empty key needs the map form."""
    run: list[str | int] = []
    for key in keys:
        if key == "":
            if run:
                v, run = F.try_variant_get(v, "$" + "".join(map(_step, run)), "variant"), []
            v = F.try_element_at(F.try_variant_get(v, "$", "map<string,variant>"), F.lit(""))
        else:
            run.append(key)
    return F.try_variant_get(v, "$" + "".join(map(_step, run)), "variant") if run else v


class Fields:
    """The keys of a record's root that some paths need, parsed by themselves: what `access` takes in the place of a whole document.

    A path needs its literal key and the first key of its nested form; other keys are skipped by the parser and never built.
    """

    def __init__(self, paths):
        self.roots: list[str] = []
        for path in paths:
            nested = segments(path) if "." in path or "[" in path else None
            for key in (path, *([nested[0]] if nested else [])):
                if key not in self.roots:
                    self.roots.append(key)

    @property
    def usable(self) -> bool:
        """Whether the keys can stand side by side as columns."""
        return len({k.lower() for k in self.roots}) == len(self.roots) and "" not in self.roots and not any(k.lower() == CORRUPT for k in self.roots)

    def schema(self) -> str:
        quoted = ("`" + k.replace("`", "``") + "` variant" for k in self.roots)
        return ", ".join([*quoted, f"{CORRUPT} string"])

    def at(self, path: str) -> Column:
        root = lambda key: F.col("`" + key.replace("`", "``") + "`")
        nested = segments(path) if "." in path or "[" in path else None
        if not nested:
            return root(path)
        return F.coalesce(root(path), _get(root(nested[0]), nested[1:]))


#: The column that holds a text that could not be parsed.
CORRUPT = "__corrupt"


def access(v: Column | Fields, path: str) -> Column:
    """The variant at a path: SQL NULL if nothing is there, a variant null if a JSON null is."""
    if isinstance(v, Fields):
        return v.at(path)
    literal = _get(v, [path])
    if "." not in path and "[" not in path:
        return literal
    nested = segments(path)
    return literal if nested is None else F.coalesce(literal, _get(v, nested))
