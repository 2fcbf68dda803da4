"""Synthetic records from a template: an object with one key that starts with $ is an operation, anything else stands for itself."""

from __future__ import annotations

import json
import random
import re
import string
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession


#: What $string draws from unless it names an alphabet.
ALPHABET = string.ascii_uppercase + string.ascii_lowercase + string.digits
_HOLE = re.compile(r"\{([^{}]*)\}")


class Synth:
    """Records of a template by seed; the same seed and time give the same records.

    $const value; $keep: the template at this place, untouched; $ref name: what $let bound, else the template at that path; $oneOf [..]; $weighted
    [[value, weight], ..]; $int {min, max} and $float {min, max}, both ends included; $normal {mean, stdev, min?, max?}; $string {len,
    alphabet?}; $uuid; $now {format: rfc3339, unix_ms or unix}; $ip4; $inc {start, step}, a counter for each place of the template; $array {of, len},
    len may be made too; $map {of: {key: template}}; $rangeFrom {base, pct}: base, a template or "$ref:name", times 1 plus or minus up to
    pct; $gte1: whole numbers below 1 become 1; $let {vars, in}: each variable sees the ones before; $fmt {template, vars}: names in braces
    replaced, unknown ones by nothing, variables may be "$ref:name".
    """

    def __init__(self, template, seed: int = 0, now: datetime | None = None):
        self.template, self.rng, self.now = template, random.Random(seed), now
        self.counters: dict[tuple, int] = {}

    def record(self):
        return self._make(self.template, (), {})

    def _make(self, t, path: tuple, bound: dict):
        if isinstance(t, list):
            return [self._make(x, path, bound) for x in t]
        if not isinstance(t, dict):
            return t
        if len(t) == 1:
            ((name, given),) = t.items()
            if name.startswith("$"):
                made = getattr(self, "op_" + name[1:], None)
                if made is None:
                    raise ValueError(f"unknown operation: {name}")
                return made(given, path, bound)
        return {k: self._make(x, (*path, k), bound) for k, x in t.items()}

    def _at(self, path):
        found = self.template
        for name in path:
            if not isinstance(found, dict) or name not in found:
                raise ValueError(f"nothing is at {'.'.join(path)}")
            found = found[name]
        return found

    def op_const(self, given, path, bound):
        return given

    def op_keep(self, given, path, bound):
        return self._at(path)

    def op_ref(self, given, path, bound):
        return bound[given] if given in bound else self._at(tuple(given.split(".")))

    def _value(self, given, path, bound):
        """A template, or the text `$ref:name`."""
        if isinstance(given, str) and given.startswith("$ref:"):
            return self.op_ref(given.removeprefix("$ref:"), path, bound)
        return self._make(given, path, bound)

    def op_oneOf(self, given, path, bound):
        return self._make(self.rng.choice(given), path, bound)

    def op_weighted(self, given, path, bound):
        values, weights = zip(*given)
        return self._make(self.rng.choices(values, weights)[0], path, bound)

    def op_int(self, given, path, bound):
        low = given.get("min", 0)
        return self.rng.randint(low, given.get("max", max(low, 0) + 100))

    def op_float(self, given, path, bound):
        low = given.get("min", 0.0)
        return self.rng.uniform(low, given.get("max", low + 1.0))

    def op_normal(self, given, path, bound):
        drawn = self.rng.gauss(given["mean"], given["stdev"])
        drawn = max(drawn, given["min"]) if given.get("min") is not None else drawn
        return min(drawn, given["max"]) if given.get("max") is not None else drawn

    def op_string(self, given, path, bound):
        return "".join(self.rng.choices(given.get("alphabet", ALPHABET), k=given.get("len", 8)))

    def op_uuid(self, given, path, bound):
        return str(uuid.UUID(int=self.rng.getrandbits(128), version=4))

    def op_now(self, given, path, bound):
        at, form = self.now or datetime.now(timezone.utc), given.get("format", "rfc3339") if isinstance(given, dict) else "rfc3339"
        return int(at.timestamp() * 1000) if form == "unix_ms" else int(at.timestamp()) if form == "unix" else at.isoformat()

    def op_ip4(self, given, path, bound):
        return ".".join(str(b) for b in self.rng.randbytes(4))

    def op_inc(self, given, path, bound):
        now = self.counters.get(path, given.get("start", 0))
        self.counters[path] = now + given.get("step", 1)
        return now

    def op_array(self, given, path, bound):
        n = self._make(given.get("len", 1), path, bound)
        n = n if isinstance(n, int) and n >= 0 else 1
        return [self._make(given["of"], path, bound) for _ in range(n)]

    def op_map(self, given, path, bound):
        return {k: self._make(x, (*path, k), bound) for k, x in given["of"].items()}

    def op_rangeFrom(self, given, path, bound):
        base = self._value(given["base"], path, bound)
        base = float(base) if isinstance(base, (int, float)) and not isinstance(base, bool) else 0.0
        return base * (1.0 + self.rng.uniform(-given["pct"], given["pct"]))

    def op_gte1(self, given, path, bound):
        made = self._make(given, path, bound)
        return 1 if isinstance(made, int) and not isinstance(made, bool) and made < 1 else made

    def op_let(self, given, path, bound):
        inner = dict(bound)
        for name, x in given["vars"].items():
            inner[name] = self._make(x, path, inner)
        return self._make(given["in"], path, inner)

    def op_fmt(self, given, path, bound):
        values = {name: self._value(x, path, bound) for name, x in given.get("vars", {}).items()}
        spelled = {name: x if isinstance(x, str) else json.dumps(x) for name, x in values.items()}
        return _HOLE.sub(lambda hole: spelled.get(hole.group(1), ""), given["template"])


def generate(spark: SparkSession, template, n: int, seed: int = 0, partitions: int = 8) -> DataFrame:
    """(raw) of n records, made on the executors; a partition's records depend only on seed and partition."""
    spelled = json.dumps(template)

    def run(batches):
        made = None
        for pdf in batches:
            if not len(pdf):
                continue
            if made is None:
                made = Synth(json.loads(spelled), seed * 1_000_003 + int(pdf["id"].iloc[0]))
            yield pdf.assign(raw=[json.dumps(made.record(), ensure_ascii=False) for _ in range(len(pdf))])[["raw"]]

    return spark.range(0, n, 1, partitions).mapInPandas(run, "raw string")
