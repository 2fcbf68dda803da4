"""Services for batch mappers of one host: a cache with time to live, and try-locks, in SQLite files.

State over a cluster belongs into keyed state (see state); this serves mappers that ask for a key by themselves.
"""

from __future__ import annotations

import json
import sqlite3
import threading
import time
import zlib
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from ..operators.detect import ttl_of
from ..operators.lookup import call


def _opened(path: str) -> sqlite3.Connection:
    db = sqlite3.connect(path, timeout=30, isolation_level=None, check_same_thread=False)
    until = time.monotonic() + 30
    while path != ":memory:":
        try:
            db.execute("PRAGMA journal_mode=WAL")
            db.execute("PRAGMA synchronous=NORMAL")
            break
        except sqlite3.OperationalError:  # another process sets the new file up; SQLite doesn't wait for that by itself
            if time.monotonic() > until:
                raise
            time.sleep(0.01)
    db.execute("CREATE TABLE IF NOT EXISTS cache (key TEXT PRIMARY KEY, kind TEXT, value BLOB, expires_at INTEGER, updated_at INTEGER)")
    db.execute("CREATE TABLE IF NOT EXISTS locks (key TEXT PRIMARY KEY)")
    return db


class Cache:
    """A file has one writer at a time, so keys are dealt over PARTS files, `path` and others beside it, and processes rarely meet."""

    PARTS = 32

    def __init__(self, path: str = ":memory:", clock: Callable[[], float] = time.time):
        self.clock, self.lock, self.path = clock, threading.Lock(), path
        self.parts: list[sqlite3.Connection | None] = [None] * (1 if path == ":memory:" else self.PARTS)
        self._part(0)

    def _part(self, i: int) -> sqlite3.Connection:
        if self.parts[i] is None:
            self.parts[i] = _opened(f"{self.path}.{i}" if i else self.path)
        return self.parts[i]

    def _of(self, key: str) -> sqlite3.Connection:
        """What holds a key, the same in every process."""
        i = zlib.crc32(key.encode()) % len(self.parts)
        return self.parts[i] or self._part(i)

    def _now(self) -> int:
        return int(self.clock() * 1000)

    def get(self, key: str):
        """The value, or None; one whose time has come is deleted."""
        row = self._of(key).execute("SELECT kind, value, expires_at FROM cache WHERE key = ?", (key,)).fetchone()
        if row is None:
            return None
        if row[2] <= self._now():
            self._of(key).execute("DELETE FROM cache WHERE key = ?", (key,))
            return None
        return bytes(row[1]) if row[0] == "bytes" else json.loads(row[1])

    def set(self, key: str, value, ttl_ms: int | None = None) -> None:
        kind = "bytes" if isinstance(value, bytes) else type(value).__name__
        now = self._now()
        stored = value if kind == "bytes" else json.dumps(value)
        self._of(key).execute(
            "INSERT INTO cache VALUES (?, ?, ?, ?, ?) ON CONFLICT (key) DO UPDATE SET kind = excluded.kind, value = excluded.value, expires_at = excluded.expires_at, updated_at = excluded.updated_at",
            (key, kind, stored, now + ttl_of(ttl_ms), now),
        )

    def delete(self, key: str) -> bool:
        return self._of(key).execute("DELETE FROM cache WHERE key = ?", (key,)).rowcount > 0

    def reset(self) -> None:
        for i in range(len(self.parts)):
            self._part(i).execute("DELETE FROM cache")

    def acquire(self, key: str) -> bool:
        """Takes a lock if it is free; never waits."""
        db = self._of(key)
        if db.execute("SELECT 1 FROM locks WHERE key = ?", (key,)).fetchone():  # no need to write
            return False
        return db.execute("INSERT OR IGNORE INTO locks VALUES (?)", (key,)).rowcount > 0

    def release(self, key: str) -> None:
        self._of(key).execute("DELETE FROM locks WHERE key = ?", (key,))


class Services:
    """What a mapper may ask for: the cache and the locks, which all mappers of a worker share, and remote calls in batches."""

    def __init__(self, cache: Cache, client: Callable[[dict], dict] = call, disabled: bool = False, threads: int = 8):
        self._cache, self.client, self.disabled, self.threads = cache, client, disabled, threads
        self._pool: ThreadPoolExecutor | None = None  # its threads stay, and so do their connections
        self.get, self.set, self.delete, self.acquire, self.release = cache.get, cache.set, cache.delete, cache.acquire, cache.release

    def call(self, requests: list[dict]) -> list[dict]:
        """The answers {id, status, headers, body, error} in the order of the requests, asked side by side. An answer to a GET is kept for its `cache_ttl_ms`."""
        if self.disabled:
            return [call(r, disabled=True) for r in requests]
        if len(requests) == 1:
            return [self._one(requests[0])]
        self._pool = self._pool or ThreadPoolExecutor(self.threads)
        rest, out = iter(enumerate(requests)), [None] * len(requests)

        def work(_) -> None:
            for i, request in rest:
                out[i] = self._one(request)

        list(self._pool.map(work, range(min(self.threads, len(requests)))))
        return out

    def _one(self, request: dict) -> dict:
        ttl, kept = request.get("cache_ttl_ms"), f"\0http\0{request['url']}"
        if ttl and request.get("method", "GET") == "GET":
            with self._cache.lock:
                held = self._cache.get(kept)
            if held is not None:
                return {"id": request["id"], "status": held["status"], "headers": held["headers"], "body": bytes.fromhex(held["body"]), "error": None}
        got = self.client(request)
        if ttl and request.get("method", "GET") == "GET" and not got["error"] and 200 <= got["status"] < 300:
            with self._cache.lock:
                self._cache.set(kept, {"status": got["status"], "headers": got.get("headers") or [], "body": got["body"].hex()}, ttl)
        return got


_MADE: dict[tuple, Services] = {}


def services_of(runtime: dict) -> Services:
    """A worker's services. `runtime.cache` is the cache's file, in memory without one; `runtime.disable_remote_calls` answers calls by 204."""
    key = (runtime.get("cache"), bool(runtime.get("disable_remote_calls")))
    if key not in _MADE:
        _MADE[key] = Services(Cache(runtime.get("cache") or ":memory:"), disabled=key[1])
    return _MADE[key]
