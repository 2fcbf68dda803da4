"""Enrichment by lookup: distinct keys are fetched once and joined back."""

from __future__ import annotations

import http.client
import json
import select
import threading
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_ROWS, col


def enrich(df: DataFrame, key: str, lookup: DataFrame | Callable[[DataFrame], DataFrame], defaults: dict[str, str]) -> DataFrame:
    """df with the lookup's columns, null ones replaced by defaults. Keys that are null or empty are not looked up.

    The lookup is broadcast if a count bounded by the limit shows it to be small; else it is joined by a shuffle. Of a key listed
    twice one row is kept, the smallest.
    """
    if callable(lookup):
        keys = df.where(col(key).isNotNull() & (col(key) != "")).select(col(key)).distinct()
        lookup = lookup(keys)
    names = [c for c in lookup.columns if c != key]
    one = lookup.where(col(key).isNotNull()).groupBy(col(key)).agg(F.min(F.struct(*(col(c) for c in names))).alias("__found"))
    small = one.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    out = df.join(F.broadcast(one) if small else one, key, "left").select("*", *(F.col("__found")[c].alias(c) for c in names)).drop("__found")
    return out.withColumns({c: F.coalesce(col(c), F.lit(d)) for c, d in defaults.items()})


def call(request: dict, disabled: bool = False) -> dict:
    """One HTTP request {id, method, url, headers, body, timeout_ms}: {id, status, headers, body, error}. A transport error gives status 0."""
    if disabled:
        return {"id": request["id"], "status": 204, "headers": [], "body": b"", "error": None}
    at = urlsplit(request["url"])
    if at.scheme in ("http", "https") and at.hostname and "@" not in at.netloc:
        try:
            return _kept(request, at)
        except Exception as e:
            _HELD.__dict__.pop(at[:2], None)
            return {"id": request["id"], "status": 0, "headers": [], "body": b"", "error": str(e) or type(e).__name__}
    return _alone(request)


#: Each thread's open connections, by scheme and address.
_HELD = threading.local()


def _kept(request: dict, at) -> dict:
    """The answer over the thread's connection to the address, which stays open. Proxies and redirections are left to `_alone`."""
    conn = _HELD.__dict__.get(at[:2])
    if conn is None:
        if at.scheme in urllib.request.getproxies() and not urllib.request.proxy_bypass(at.netloc):
            return _alone(request)
        conn = _HELD.__dict__[at[:2]] = (http.client.HTTPSConnection if at.scheme == "https" else http.client.HTTPConnection)(at.netloc)
    if conn.sock is not None and select.select([conn.sock], [], [], 0)[0]:  # closed from the other side meanwhile
        conn.close()
    conn.timeout = (request.get("timeout_ms") or 30_000) / 1000
    if conn.sock is not None:
        conn.sock.settimeout(conn.timeout)
    body, method = request.get("body"), request.get("method", "GET")
    headers = {"User-Agent": f"Python-urllib/{urllib.request.__version__}"} | {k.title(): v for k, v in dict(request.get("headers") or {}).items()}
    if body is not None:
        headers.setdefault("Content-Type", "application/x-www-form-urlencoded")
    conn.request(method, (at.path or "/") + (f"?{at.query}" if at.query else ""), body.encode() if isinstance(body, str) else body, headers)
    got = conn.getresponse()
    out = {"id": request["id"], "status": got.status, "headers": list(got.headers.items()), "body": got.read(), "error": None}
    if got.status in (301, 302, 303, 307, 308) and "Location" in got.headers:
        if method in ("GET", "HEAD"):
            return _alone(request)
        if method == "POST" and got.status <= 303:  # what was posted is not posted again
            headers = {k: v for k, v in headers.items() if not k.startswith("Content-")}
            return _alone({"id": request["id"], "url": urljoin(request["url"], got.headers["Location"]), "headers": headers, "timeout_ms": request.get("timeout_ms")})
    return out


def _alone(request: dict) -> dict:
    """The answer over a connection of its own."""
    body = request.get("body")
    made = urllib.request.Request(request["url"], data=body.encode() if isinstance(body, str) else body, headers=dict(request.get("headers") or {}), method=request.get("method", "GET"))
    try:
        with urllib.request.urlopen(made, timeout=(request.get("timeout_ms") or 30_000) / 1000) as got:
            return {"id": request["id"], "status": got.status, "headers": list(got.headers.items()), "body": got.read(), "error": None}
    except urllib.error.HTTPError as e:
        return {"id": request["id"], "status": e.code, "headers": list(e.headers.items()), "body": e.read(), "error": None}
    except Exception as e:
        return {"id": request["id"], "status": 0, "headers": [], "body": b"", "error": str(e)}


def http_lookup(key: str, url: Callable[[str], str], field: str, client: Callable[[dict], dict] = call, threads: int = 8) -> Callable[[DataFrame], DataFrame]:
    """A lookup that asks a JSON service for each distinct key; any error or status other than 200 fails the batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for pdf in batches:
                got = list(pool.map(client, [{"id": k, "method": "GET", "url": url(k)} for k in pdf[key]]))
                bad = next((r for r in got if r["error"] or r["status"] != 200), None)
                if bad:
                    raise RuntimeError(f"lookup of {bad['id']!r} failed: status {bad['status']}, {bad['error']}")
                yield pd.DataFrame({key: pdf[key], field: [json.loads(r["body"]).get(field) or "" for r in got]})

    return lambda keys: keys.mapInPandas(run, f"`{key}` string, `{field}` string")
