"""The command line: run a pipeline, test mappers, start a new mapper, measure throughput, show a configuration."""

from __future__ import annotations

import argparse
import importlib
import json
import signal
import sys
import threading
import time
from pathlib import Path

from pyspark.sql import SparkSession

MAPPER = '''"""A mapper. Describe what it selects and what it makes of a record."""

from fieldmill.functions import scalars as S
from fieldmill.functions.paths import access
from fieldmill.operators.mapper import Mapper
from fieldmill.operators.predicates import Eq, Selector
from pyspark.sql import functions as F


class {name}(Mapper):
    name = "{name}"

    def selectors(self):
        return [Selector(all=(Eq("source.name", "myservice"),))]

    def transform(self, df):
        return df.select(F.coalesce(S.string(access(F.col("v"), "msg")), F.lit("")).alias("message"))
'''


def _session(cores: str) -> SparkSession:
    from ..streaming.state import ROCKSDB

    made = SparkSession.builder.master(f"local[{cores}]").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
    for k, v in ROCKSDB.items():
        made = made.config(k, v)
    spark = made.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _mapper(spelled: str, config: dict | None = None):
    module, _, name = spelled.partition(":")
    sys.path.insert(0, ".")
    return getattr(importlib.import_module(module), name)(**({"config": config} if config else {}))


def scaffold(folder: str, name: str) -> list[str]:
    """A new mapper with its test files; nothing that exists is written over."""
    root = Path(folder)
    (root / "tests").mkdir(parents=True, exist_ok=True)
    files = {
        root / "mapper.py": MAPPER.format(name=name),
        root / "tests/input.json": json.dumps([{"msg": "my log", "source": {"name": "myservice"}}], indent=2),
        root / "tests/expected.json": json.dumps({"message": "my log"}, indent=2),
        root / "tests/bench.json": json.dumps({"msg": {"$string": {"len": 8}}, "source": {"name": {"$const": "myservice"}}}, indent=2),
    }
    for path, text in files.items():
        if not path.exists():
            path.write_text(text + "\n", encoding="utf-8")
    return [str(p) for p in files]


def throughput(spark: SparkSession, raw, mapper) -> dict:
    """Bytes and records a second of a mapper over records held in memory, after one warm-up."""
    from ..operators.mapper import apply_raw
    from ..sinks.writers import discard

    raw = raw.persist()
    total = raw.selectExpr("count(*) AS n", "sum(octet_length(raw) + 1) AS b").first()
    for _ in range(2):
        began = time.perf_counter()
        discard(apply_raw(raw, mapper))
        took = time.perf_counter() - began
    raw.unpersist()
    return {"records": total.n, "bytes": total.b, "seconds": took, "mb_per_second": total.b / took / 1e6, "records_per_second": total.n / took}


def main(args: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="fieldmill")
    top.add_argument("--cores", default="*")
    sub = top.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run")
    run.add_argument("--config", required=True)
    run.add_argument("--once", action="store_true")
    run.add_argument("--checkpoint", default="checkpoint")
    run.add_argument("--metrics-port", type=int, default=0)
    show = sub.add_parser("show")
    show.add_argument("--config", required=True)
    test = sub.add_parser("test")
    test.add_argument("--config", required=True)
    test.add_argument("--plugin")
    new = sub.add_parser("scaffold")
    new.add_argument("folder")
    new.add_argument("--name", default="MyMapper")
    check = sub.add_parser("check")
    check.add_argument("mapper")
    bench = sub.add_parser("bench")
    bench.add_argument("mapper")
    bench.add_argument("--payload", required=True)
    bench.add_argument("--records", type=int, default=100_000)
    bench.add_argument("--synthesize", action="store_true")
    a = top.parse_args(args)
    if a.command == "scaffold":
        print("\n".join(scaffold(a.folder, a.name)))
        return 0
    if a.command == "check":
        made = _mapper(a.mapper)
        print(f"{made.name} {made.version}: {len(made.selectors())} selectors, {'native' if made.native else 'batch'}")
        return 0
    from ..plans import config as C
    from ..plans import graph as G
    from ..streaming.metrics import Metrics

    if a.command == "show":
        print(json.dumps(C.summary(C.load_file(a.config)), indent=2))
        return 0
    spark = _session(a.cores)
    if a.command == "bench":
        from .synth import generate

        payload = json.loads(Path(a.payload).read_text(encoding="utf-8"))
        template = payload if a.synthesize else {"$oneOf": [{"$const": x} for x in (payload if isinstance(payload, list) else [payload])]}
        print(json.dumps(throughput(spark, generate(spark, template, a.records), _mapper(a.mapper))))
        return 0
    config = C.load_file(a.config)
    if a.command == "test":
        from .harness import check as golden

        failed = 0
        for name, settings in config.plugins.items():
            if a.plugin and name != a.plugin:
                continue
            for t in settings.get("tests") or ():
                base = Path(a.config).parent
                diff = golden(spark, G.make_mapper(settings, config.runtime), str(base / t["input"]), str(base / t["expected"]))
                print(f"{name} {t['input']}: " + ("ok" if not diff else "FAILED\n" + diff))
                failed += bool(diff)
        return int(failed > 0)
    metrics = Metrics()
    spark.streams.addListener(metrics)
    if a.metrics_port:
        print(f"metrics on port {metrics.serve(a.metrics_port)}", file=sys.stderr)
    for w in config.warnings():
        print(f"warning: {w}", file=sys.stderr)
    if a.once:
        G.run_once(spark, config)
        return 0
    queries = G.run_stream(spark, config, a.checkpoint)
    ended = threading.Event()
    for s in (signal.SIGINT, signal.SIGTERM):
        signal.signal(s, lambda *_: ended.set())
    while not ended.wait(0.5) and all(q.isActive for q in queries):
        pass
    G.stop(queries)
    failed = [q.exception() for q in queries if q.exception() is not None]
    if failed:
        raise failed[0]
    return 0


if __name__ == "__main__":
    sys.exit(main())
