"""Signed requests to a message queue and an object store over plain HTTP (AWS Signature Version 4, as published)."""

from __future__ import annotations

import hashlib
import hmac
import json
import os
from collections.abc import Callable
from datetime import datetime, timezone
from urllib.parse import quote, urlsplit

from ..operators.lookup import call


def _hmac(key: bytes, text: str) -> bytes:
    return hmac.new(key, text.encode(), hashlib.sha256).digest()


def sign(method: str, url: str, headers: dict[str, str], body: bytes, key_id: str, secret: str, region: str, service: str, at: datetime, token: str | None = None) -> dict[str, str]:
    """The headers of a request with those that its signature needs."""
    parts = urlsplit(url)
    stamp, day = at.strftime("%Y%m%dT%H%M%SZ"), at.strftime("%Y%m%d")
    every = {k.lower(): v.strip() for k, v in headers.items()} | {"host": parts.netloc, "x-amz-date": stamp}
    if token:
        every["x-amz-security-token"] = token
    digest = hashlib.sha256(body).hexdigest()
    if service == "s3":
        every["x-amz-content-sha256"] = digest
    names = ";".join(sorted(every))
    query = "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    spelled = "\n".join([method, parts.path or "/", query, *(f"{k}:{every[k]}" for k in sorted(every)), "", names, digest])
    scope = f"{day}/{region}/{service}/aws4_request"
    key = b"AWS4" + secret.encode()
    for step in (day, region, service, "aws4_request"):
        key = _hmac(key, step)
    signature = _hmac(key, "\n".join(["AWS4-HMAC-SHA256", stamp, scope, hashlib.sha256(spelled.encode()).hexdigest()])).hex()
    return every | {"authorization": f"AWS4-HMAC-SHA256 Credential={key_id}/{scope}, SignedHeaders={names}, Signature={signature}"}


class Queue:
    """Receives and deletes messages of one queue and fetches the objects they announce."""

    def __init__(self, url: str, region: str | None = None, object_url: str | None = None, key_id: str | None = None, secret: str | None = None, token: str | None = None, wait_seconds: int = 20, visibility_seconds: int | None = None, client: Callable[[dict], dict] = call):
        self.url, self.region, self.client = url, region or os.environ.get("AWS_REGION", "us-east-1"), client
        self.object_url = object_url or f"https://{{bucket}}.s3.{self.region}.amazonaws.com"
        self.keys = (key_id or os.environ.get("AWS_ACCESS_KEY_ID", ""), secret or os.environ.get("AWS_SECRET_ACCESS_KEY", ""), token or os.environ.get("AWS_SESSION_TOKEN"))
        self.wait, self.visibility = wait_seconds, visibility_seconds

    def _send(self, method: str, url: str, headers: dict, body: bytes, service: str) -> bytes:
        key_id, secret, token = self.keys
        signed = sign(method, url, headers, body, key_id, secret, self.region, service, datetime.now(timezone.utc), token)
        signed.pop("host")
        got = self.client({"id": url, "method": method, "url": url, "headers": signed, "body": body or None, "timeout_ms": (self.wait + 30) * 1000})
        if got["error"] or got["status"] != 200:
            raise OSError(f"{method} {url}: status {got['status']} {got['error'] or ''}")
        return got["body"]

    def _ask(self, action: str, more: dict) -> dict:
        parts = urlsplit(self.url)
        headers = {"content-type": "application/x-amz-json-1.0", "x-amz-target": f"AmazonSQS.{action}"}
        got = self._send("POST", f"{parts.scheme}://{parts.netloc}/", headers, json.dumps({"QueueUrl": self.url} | more).encode(), "sqs")
        return json.loads(got or b"{}")

    def receive(self) -> list[dict]:
        more = {"MaxNumberOfMessages": 10, "WaitTimeSeconds": self.wait} | ({"VisibilityTimeout": self.visibility} if self.visibility else {})
        return [{"body": m.get("Body", ""), "receipt": m["ReceiptHandle"]} for m in self._ask("ReceiveMessage", more).get("Messages") or ()]

    def delete(self, receipt: str) -> None:
        self._ask("DeleteMessage", {"ReceiptHandle": receipt})

    def fetch(self, bucket: str, key: str) -> bytes:
        return self._send("GET", f"{self.object_url.format(bucket=bucket)}/{quote(key)}", {}, b"", "s3")
