"""Build webhooks and package documents as DataFrame transformations."""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STAMPED = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2}))\s+(.*)\z"


def signature_holds(secret: str, body: bytes, header: str | None) -> bool:
    """Whether a request carries the HMAC-SHA256 signature of its body."""
    made = "sha256=" + hmac.new(secret.encode(), body, hashlib.sha256).hexdigest()
    return header is not None and hmac.compare_digest(made, header)


def answer(event: str | None, body: bytes, secret: str | None = None, signature: str | None = None) -> tuple[int, list[str]]:
    """(status, records) of one webhook request: pings are accepted unsigned, a wrong signature is refused and the source goes on."""
    if event == "ping":
        return 200, []
    if secret and not signature_holds(secret, body, signature):
        return 401, []
    return 202, [x for x in body.decode("utf-8", "replace").split("\n") if x.strip()]


def split_line(line: Column) -> tuple[Column, Column]:
    """(timestamp or null, message) of a line of a build log."""
    bare = F.regexp_replace(line, "^﻿", "")
    stamped = bare.rlike(STAMPED)
    return F.when(stamped, F.regexp_extract(bare, STAMPED, 1)), F.when(stamped, F.trim(F.regexp_extract(bare, STAMPED, 2))).otherwise(bare)


def log_events(files: DataFrame) -> DataFrame:
    """One event per line that is not blank of log files (run_id, repo, sha, log_file, content)."""
    bare = F.regexp_replace("line", r"^\s+|\s+\z", "").alias("line")
    lines = files.select("run_id", "repo", "sha", "log_file", F.posexplode(F.split("content", r"\r?\n")).alias("pos", "line"))
    lines = lines.select("run_id", "repo", "sha", "log_file", "pos", bare).where("line <> ''")
    at, message = split_line(F.col("line"))
    github = F.struct("run_id", "repo", "sha", "log_file")
    return lines.select(F.lit("github_ci_log").alias("kind"), github.alias("github"), message.alias("message"), F.when(at.isNotNull(), F.struct(at.alias("timestamp"))).alias("key"), "pos")


def expands(v_action: Column, v_kind: Column) -> Column:
    """Whether a webhook record also brings the logs of its run: a completed workflow run."""
    return F.coalesce((v_kind == "workflow_run") & (v_action == "completed"), F.lit(False))


def recent_versions(documents: DataFrame, now: Column, minutes: int = 500) -> DataFrame:
    """One event per version published within the last minutes, of package documents (name, versions map<string,string>, time
    map<string,string>). Versions whose time is missing or cannot be read are left out."""
    each = documents.select("name", "time", F.explode("versions").alias("version", "document"))
    at = F.try_element_at("time", F.col("version"))
    at = F.when(at.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})\z"), at).try_cast("timestamp")
    return each.where(at >= now - F.expr(f"INTERVAL {minutes} MINUTES")).select(F.lit("npm_package_version").alias("kind"), "name", "version", at.alias("published_at"), "document")
