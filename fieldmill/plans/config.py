"""Pipeline configuration: YAML with ${VAR}, read into plain objects and checked."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass, field

import yaml

from ..sinks.writers import check

SOURCE_KINDS = ("file", "tcp", "socket", "msk", "sqs", "github_webhook", "npm_registry", "table")
SINK_KINDS = ("blackhole", "file", "s3")


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Node:
    kind: str
    name: str
    key_prefix: str | None = None

    def __str__(self) -> str:
        return f"{self.kind} {self.name}"


@dataclass
class Config:
    sources: dict[str, dict]
    sinks: dict[str, dict]
    plugins: dict[str, dict] = field(default_factory=dict)
    edges: list[tuple[Node, Node]] = field(default_factory=list)
    runtime: dict = field(default_factory=dict)

    def targets(self, node: Node) -> list[Node]:
        """The nodes that node feeds, in the order written; several entries with the same origin add up."""
        return [b for a, b in self.edges if (a.kind, a.name) == (node.kind, node.name)]

    def origins(self, node: Node) -> list[Node]:
        return [a for a, b in self.edges if (b.kind, b.name) == (node.kind, node.name)]

    def warnings(self) -> list[str]:
        """Nodes that lead nowhere."""
        ends = [Node("source", s) for s in self.sources] + [Node("plugin", p) for p in self.plugins]
        return [f"{n} has no outputs; its records are dropped" for n in ends if not self.targets(n)]

    def validate(self) -> Config:
        """Raises ConfigError for anything that could not run."""
        if not self.sources or not self.sinks or not self.edges:
            raise ConfigError("a pipeline needs at least one source, one sink and one edge")
        known = {"source": self.sources, "plugin": self.plugins, "sink": self.sinks}
        for a, b in self.edges:
            for n in (a, b):
                if n.kind not in known:
                    raise ConfigError(f"unknown kind of node: {n.kind}")
                if n.name not in known[n.kind]:
                    raise ConfigError(f"{n} is not defined")
            if b.kind == "source":
                raise ConfigError(f"{b} cannot be a target")
            if a.kind == "sink":
                raise ConfigError(f"{a} cannot be an origin")
        for name, s in self.sources.items():
            if s.get("type") not in SOURCE_KINDS:
                raise ConfigError(f"source {name}: unknown type {s.get('type')!r}")
        for name, s in self.sinks.items():
            if s.get("type") not in SINK_KINDS:
                raise ConfigError(f"sink {name}: unknown type {s.get('type')!r}")
            encoding, compression = encoding_of(s)
            try:
                check(encoding, compression)
            except ValueError as e:
                raise ConfigError(f"sink {name}: {e}") from None
        self.order()
        return self

    def order(self) -> list[Node]:
        """Plugins so that each comes after those that feed it."""
        left = {p: {a.name for a in self.origins(Node("plugin", p)) if a.kind == "plugin"} for p in self.plugins}
        out: list[Node] = []
        while left:
            ready = [p for p, needs in left.items() if not needs & left.keys()]
            if not ready:
                raise ConfigError(f"plugins feed each other in a circle: {', '.join(sorted(left))}")
            for p in ready:
                out.append(Node("plugin", p))
                del left[p]
        return out


def encoding_of(sink: dict) -> tuple[str, str]:
    """(encoding, compression) of a sink's settings; NDJSON, and zstd for objects but nothing for files."""
    e, c = sink.get("encoding") or "ndjson", sink.get("compression")
    e = e.get("type", "ndjson") if isinstance(e, dict) else e
    c = c.get("type", "none") if isinstance(c, dict) else c
    return e, c if c is not None else ("zstd" if sink.get("type") == "s3" and e == "ndjson" else "none")


def expand(text: str, env=os.environ) -> str:
    """${VAR} by its value, nothing if it is unset; an unclosed one stays."""
    return re.sub(r"\$\{([^}]*)\}", lambda m: env.get(m.group(1), ""), text)


def _node(raw: dict) -> Node:
    try:
        return Node(raw["kind"], raw["name"], raw.get("key_prefix"))
    except (KeyError, TypeError):
        raise ConfigError(f"not a node: {raw!r}") from None


def load(text: str, env=os.environ) -> Config:
    raw = yaml.safe_load(expand(text, env)) or {}
    edges = [(_node(e["from"]), _node(t)) for e in raw.get("dag") or () for t in e.get("to") or ()]
    return Config(dict(raw.get("sources") or {}), dict(raw.get("sinks") or {}), dict(raw.get("plugins") or {}), edges, dict(raw.get("runtime") or {})).validate()


def load_file(path: str, env=os.environ) -> Config:
    with open(path, encoding="utf-8") as f:
        return load(f.read(), env)


def summary(config: Config) -> dict:
    return {
        "sources": {n: s["type"] for n, s in config.sources.items()}, "plugins": sorted(config.plugins), "sinks": {n: s["type"] for n, s in config.sinks.items()},
        "edges": [f"{a} -> {b}" for a, b in config.edges], "warnings": config.warnings(),
    }
