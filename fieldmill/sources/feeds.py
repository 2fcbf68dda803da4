"""Feeds that a configuration can name: listeners, a webhook server, a queue and a package registry, each into a spool."""

from __future__ import annotations

import json
import logging
import re
import sqlite3
import threading
import time
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from io import BytesIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..operators.lookup import call
from ..session import ensure_checkpoint_dir
from .cloud import Queue
from .queues import poll_queue
from .sockets import Listener
from .spool import Spool
from .webhooks import STAMPED, answer

_LOG = logging.getLogger(__name__)
KINDS = ("tcp", "socket", "sqs", "github_webhook", "npm_registry")


class Feed:
    """Something that fills a spool until it is stopped. `turn` does one round; a round that fails is logged and tried again."""

    def __init__(self, spool: Spool, turn: Callable[[], None] | None = None, pause: float = 0.0, stop: Callable[[], None] | None = None, address=None):
        self.spool, self.turn, self.pause, self.address = spool, turn, pause, address
        self._stop, self._ended, self._thread = stop, threading.Event(), None

    def start(self) -> Feed:
        if self.turn is not None:
            self._thread = threading.Thread(target=self._run, daemon=True)
            self._thread.start()
        return self

    def _run(self) -> None:
        while not self._ended.is_set():
            try:
                self.turn()
            except Exception as e:
                _LOG.warning("a round of a feed failed: %s", e)
                self._ended.wait(1.0)
            self._ended.wait(self.pause)

    def stop(self, seconds: float = 30.0) -> None:
        """No new records; the round that runs may end, and what is held is sealed."""
        self._ended.set()
        if self._stop:
            self._stop()
        if self._thread:
            self._thread.join(seconds)
        self.spool.close()


def line_feed(spool: Spool, address: str) -> Feed:
    """Lines of clients of a TCP port or a Unix socket."""
    listener = Listener(address)

    def turn() -> None:
        lines = listener.drain(10_000)
        if lines:
            spool.put(lines)
        else:
            time.sleep(0.02)

    def stop() -> None:
        listener.close()
        while lines := listener.drain(10_000):
            spool.put(lines)

    return Feed(spool, turn, stop=stop, address=listener.address)


def webhook_feed(spool: Spool, address: str, path: str, secret: str | None = None) -> Feed:
    """Records posted to one path; a request is answered when its records are sealed."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self) -> None:
            body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            status, records = (404, []) if self.path != path else answer(self.headers.get("X-GitHub-Event"), body, secret, self.headers.get("X-Hub-Signature-256"))
            try:
                if records:
                    spool.seal(records)
            except Exception as e:
                _LOG.warning("a request could not be sealed: %s", e)
                status = 503
            self.send_response(status)
            self.send_header("Content-Length", "0")
            self.end_headers()

        def do_GET(self) -> None:
            self.send_response(405)
            self.send_header("Content-Length", "0")
            self.end_headers()

        def log_message(self, *_) -> None:
            pass

    host, _, port = address.rpartition(":")
    server = ThreadingHTTPServer((host or "0.0.0.0", int(port)), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def stop() -> None:
        server.shutdown()
        server.server_close()

    return Feed(spool, stop=stop, address=server.server_address)


def queue_feed(spool: Spool, queue: Queue, form: str = "ndjson", compression: str = "auto") -> Feed:
    """Messages of a queue and the objects they announce; a message is deleted when its records are sealed."""
    return Feed(spool, lambda: poll_queue(queue.receive, queue.fetch, queue.delete, spool.seal, form, compression))


#: Versions published within so many minutes are new.
RECENT_MINUTES = 500
#: Characters of events after which a page of them is given out.
PAGE = 4 << 20
_EPOCH, _MICRO = datetime(1970, 1, 1, tzinfo=timezone.utc), timedelta(microseconds=1)


class Registry:
    """Polls a package registry: each version published of late is told once while it is recent.

    One package's document is in memory at a time; what was told is in a temporary file.
    """

    def __init__(self, url: str, packages: list[str] | None, orgs: list[str] | None, token: str | None = None, client: Callable[[dict], dict] = call, now: Callable[[], datetime] = lambda: datetime.now(timezone.utc)):
        if not packages and not orgs:
            raise ValueError("a registry needs packages or orgs")
        self.url, self.packages, self.orgs, self.client, self.now = url.rstrip("/"), packages, orgs, client, now
        self.headers = {"Authorization": f"Bearer {token}"} if token else {}
        self._held = sqlite3.connect("", isolation_level=None, check_same_thread=False)
        self._held.execute("CREATE TABLE told (name TEXT, version TEXT, at INTEGER, PRIMARY KEY (name, version)) WITHOUT ROWID")

    @property
    def told(self) -> dict[tuple[str, str], datetime]:
        return {(name, version): _EPOCH + at * _MICRO for name, version, at in self._held.execute("SELECT name, version, at FROM told")}

    def _tell(self, new: list[tuple[str, str, int]]) -> None:
        self._held.execute("BEGIN")
        self._held.executemany("INSERT OR REPLACE INTO told VALUES (?, ?, ?)", new)
        self._held.execute("COMMIT")
        new.clear()

    def _get(self, path: str):
        got = self.client({"id": path, "method": "GET", "url": f"{self.url}/{path}", "headers": self.headers})
        if got["error"] or not 200 <= got["status"] < 300:
            raise OSError(f"{self.url}/{path}: status {got['status']} {got['error'] or ''}")
        return json.loads(got.pop("body").decode())

    def _names(self) -> list[str]:
        return list(self.packages) if self.packages else sorted({name for org in self.orgs for name in self._get(f"-/user/{org}/package")})

    def poll(self) -> list[str]:
        """The events of new versions, all at once."""
        return [line for page in self.pages() for line in page]

    def pages(self) -> Iterator[list[str]]:
        """The events of new versions, some megabytes at a time; a package that cannot be read is logged and the others go on."""
        since, out, size, new = self.now() - timedelta(minutes=RECENT_MINUTES), [], 0, []
        self._held.execute("DELETE FROM told WHERE at < ?", ((since - _EPOCH) // _MICRO,))
        for name in self._names():
            document = None  # the last one's, before the next is read
            try:
                document = self._get(name)
            except (OSError, ValueError) as e:
                _LOG.warning("%s", e)
                continue
            known = {version for (version,) in self._held.execute("SELECT version FROM told WHERE name = ?", (name,))}
            times = document.get("time") or {}
            for version, held in (document.get("versions") or {}).items():
                try:
                    at = datetime.fromisoformat(times[version])
                except (KeyError, TypeError, ValueError):
                    continue
                if at.tzinfo is not None and at >= since and version not in known:
                    new.append((name, version, (at - _EPOCH) // _MICRO))
                    out.append(json.dumps({"kind": "npm_package_version", "npm": held}, ensure_ascii=False))
                    size += len(out[-1])
                    if size >= PAGE:
                        self._tell(new)
                        yield out
                        out, size = [], 0
            self._tell(new)
        if out:
            yield out


def registry_feed(spool: Spool, registry: Registry, seconds: float = 5.0) -> Feed:
    def turn() -> None:
        for page in registry.pages():
            spool.seal(page)

    return Feed(spool, turn, max(seconds, 5.0))


# Run logs ----------------------------------------------------------------------------------------------------------------

API = "https://api.github.com"


def run_of(raw: str) -> dict | None:
    """{url path, run_id, repo, sha} of a record that tells of a completed workflow run, else None."""
    try:
        record = json.loads(raw)
        run = record.get("workflow_run")
        if run is None or record.get("action") != "completed":
            return None
        repository = run["repository"]
        owner, slash, name = (repository.get("full_name") or "").partition("/")
        if not slash:
            owner, name = repository["owner"]["login"], repository["name"]
        if not isinstance(run["id"], int):
            return None
        return {"path": f"/repos/{owner}/{name}/actions/runs/{run['id']}/logs", "run_id": run["id"], "repo": f"{owner}/{name}", "sha": run["head_sha"]}
    except (ValueError, KeyError, TypeError, AttributeError):
        return None


def archive_events(archive: bytes, run: dict) -> Iterator[str]:
    """One event per line that is not blank of the files of a log archive, in the order of the archive."""
    stamped = re.compile(STAMPED.replace(r"\z", r"\Z"), re.S)
    with zipfile.ZipFile(BytesIO(archive)) as z:
        for info in z.infolist():
            if info.is_dir():
                continue
            for line in re.split(r"\r?\n", z.read(info).decode("utf-8", "replace")):
                text = line.strip().lstrip("﻿")
                if not text:
                    continue
                found = stamped.match(text)
                event = {"kind": "github_ci_log", "github": {"run_id": run["run_id"], "repo": run["repo"], "sha": run["sha"], "log_file": info.filename}, "message": found.group(2).strip() if found else text}
                if found:
                    event["key"] = {"timestamp": found.group(1)}
                yield json.dumps(event, ensure_ascii=False)


def expand_runs(df: DataFrame, token: str, api: str = API, client: Callable[[dict], dict] = call) -> DataFrame:
    """(raw): every record, and after a completed workflow run the lines of its logs, fetched by the executors.

    A record whose logs cannot be fetched comes out by itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                out, told = [raw], run_of(raw)
                if told is not None:
                    got = client({"id": raw, "method": "GET", "url": api + told["path"], "headers": {"Authorization": f"Bearer {token}", "User-Agent": "fieldmill"}})
                    try:
                        if got["error"] or not 200 <= got["status"] < 300:
                            raise OSError(f"status {got['status']} {got['error'] or ''}")
                        out += archive_events(got["body"], told)
                    except (OSError, zipfile.BadZipFile) as e:
                        _LOG.warning("the logs of run %s could not be read: %s", told["run_id"], e)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["raw"])

    return df.select("raw").mapInArrow(run, "raw string")


# From a configuration ---------------------------------------------------------------------------------------------------

#: Feeds that run, by the folder of their spool.
_RUNNING: dict[str, Feed] = {}


def spool_folder(spark: SparkSession, name: str, settings: dict) -> str:
    """Where a source's records are sealed: `spool` of its settings, else a folder beside the checkpoints."""
    return settings.get("spool") or f"{ensure_checkpoint_dir(spark).rstrip('/')}/spool/{name}"


def make_feed(spark: SparkSession, name: str, s: dict) -> Feed:
    spool, how = Spool(spark, spool_folder(spark, name, s)), s.get("decoding") or {}
    if s["type"] == "tcp":
        return line_feed(spool, s.get("bind_address", "0.0.0.0:9000"))
    if s["type"] == "socket":
        return line_feed(spool, f"unix:{s.get('socket_path', '/tmp/sidecar.sock')}")
    if s["type"] == "github_webhook":
        return webhook_feed(spool, s.get("bind_address", "0.0.0.0:9000"), s["path"], s.get("secret"))
    if s["type"] == "npm_registry":
        registry = Registry(s.get("url", "https://registry.npmjs.org"), s.get("packages"), s.get("orgs"), s.get("token"))
        return registry_feed(spool, registry, s.get("interval_secs", 5))
    queue = Queue(s["queue_url"], s.get("region"), s.get("object_url"), s.get("access_key_id"), s.get("secret_access_key"), wait_seconds=s.get("wait_time_seconds", 20), visibility_seconds=s.get("visibility_timeout"))
    return queue_feed(spool, queue, how.get("format", "ndjson"), how.get("compression", "auto"))


def running(spark: SparkSession, name: str, settings: dict) -> Feed:
    """The source's feed, started once."""
    folder = spool_folder(spark, name, settings)
    if folder not in _RUNNING:
        _RUNNING[folder] = make_feed(spark, name, settings).start()
    return _RUNNING[folder]


def stop_all(seconds: float = 30.0) -> None:
    for folder in list(_RUNNING):
        _RUNNING.pop(folder).stop(seconds)


def read_feed(spark: SparkSession, name: str, settings: dict, streaming: bool) -> DataFrame:
    """(raw) of a configured feed. A stream starts it; a batch takes one round of a poller and what is sealed."""
    if streaming:
        feed = running(spark, name, settings)
        rows = feed.spool.records(True)
    elif settings["type"] in ("sqs", "npm_registry"):
        feed = make_feed(spark, name, settings)
        feed.turn()
        feed.spool.close()
        rows = feed.spool.records(False)
    else:
        spool = Spool(spark, spool_folder(spark, name, settings))
        spool.close()
        rows = spool.records(False)
    if settings["type"] == "github_webhook":
        return expand_runs(rows, settings.get("token", ""), settings.get("api", API))
    return rows
