"""Ready mappers: flat projection, network activity, enrichment by lookup, version alerts."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.paths import Fields, access
from .mapper import Mapper
from .predicates import Eq, Has, Selector


def _once(df: DataFrame, v=None, **columns: Column) -> DataFrame:
    """Only these columns, each computed once: a generated row keeps the optimizer from copying them into later uses. Single fields are columns already."""
    if isinstance(v, Fields):
        return df.select(*(c.alias(n) for n, c in columns.items()))
    return df.select(F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


class FlatDefaults(Mapper):
    """A flat record with a default for every field that is missing or of another kind; tags stay null if absent."""

    name = "flat_defaults"

    def __init__(self, service: str = "myservice", config: dict | None = None):
        super().__init__(config)
        self.service = service

    def selectors(self):
        return [Selector(all=(Eq("source.name", self.service),))]

    fields = ("msg", "msg.level", "seen", "duration", "source.name", "tags")

    def from_fields(self, df: DataFrame, v) -> DataFrame:
        got = _once(df, v, msg=access(v, "msg"), level=access(v, "msg.level"), seen=access(v, "seen"), duration=access(v, "duration"), service=access(v, "source.name"), tags=S.string_list(v, "tags"))
        return got.select(
            F.coalesce(S.string(F.col("msg")), F.lit("")).alias("message"), F.coalesce(S.string(F.col("level")), F.lit("")).alias("level"),
            F.coalesce(S.bigint(F.col("seen")), F.lit(0).cast("bigint")).alias("seen"), F.coalesce(S.double(F.col("duration")), F.lit(0.0)).alias("duration"),
            F.coalesce(S.string(F.col("service")), F.lit("")).alias("service"), "tags",
        )


class FlatDefaultsBatch(FlatDefaults):
    """The same over batches in Python."""

    name = "flat_defaults_batch"

    def process_logs(self, logs) -> bytes:
        def of(log, path, kinds, default):
            x = log.get(path)
            return x if isinstance(x, kinds) and not (isinstance(x, bool) and bool not in kinds) else default

        out = bytearray()
        for log in logs:
            tags = log.get_list("tags")
            row = {
                "message": of(log, "msg", (str,), ""), "level": of(log, "msg.level", (str,), ""), "seen": of(log, "seen", (int,), 0),
                "duration": of(log, "duration", (float,), 0.0), "service": of(log, "source.name", (str,), ""), "tags": tags,
            }
            out += json.dumps(row).encode() + b"\n"
        return bytes(out)


def _present(*columns: Column) -> Column:
    return F.coalesce(*(F.when(c.isNotNull(), F.lit(True)) for c in columns), F.lit(False))


def _epoch_ms(text: Column) -> Column:
    return F.floor(F.unix_micros(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})\z"), text).try_cast("timestamp")) / 1000)


class NetworkActivity(Mapper):
    """Connection records as network activity events. Absent parts are null, and leave no key when written as JSON.

    Works on parsed JSON through `transform`, and on typed columns of the same names through `from_columns`.
    """

    name = "network_activity"

    TEXT = ("_path", "_system_name", "_write_ts", "ts", "uid", "community_id", "conn_state", "history", "proto", "service", "id.orig_h", "id.resp_h", "id.orig_h_name.src", "id.resp_h_name.src", "orig_l2_addr", "resp_l2_addr", "resp_cc", "spcap.trigger", "spcap.url")
    WHOLE = ("id.orig_p", "id.resp_p", "vlan", "spcap.rule", "missed_bytes", "orig_bytes", "resp_bytes", "orig_ip_bytes", "resp_ip_bytes", "orig_pkts", "resp_pkts")
    REAL = ("duration", "pcr")
    FLAG = ("local_orig", "local_resp", "corelight_shunted")
    LISTS = ("app", "suri_ids", "tunnel_parents", "id.orig_h_name.vals", "id.resp_h_name.vals")

    def selectors(self):
        return [Selector(all=(Has("uid"), Eq("_path", "conn")))]

    fields = (*TEXT, *WHOLE, *REAL, *FLAG, *LISTS)

    def from_fields(self, df: DataFrame, v) -> DataFrame:
        raw = _once(df, v, **{p: access(v, p) for p in (*self.TEXT, *self.WHOLE, *self.REAL, *self.FLAG)}, **{p: S.string_list(v, p) for p in self.LISTS})
        q = lambda p: F.col(f"`{p}`")
        typed = [S.string(q(p)).alias(p) for p in self.TEXT] + [S.bigint(q(p)).alias(p) for p in self.WHOLE] + [S.numeric(q(p)).alias(p) for p in self.REAL]
        return self.from_columns(raw.select(*typed, *(S.boolean(q(p)).alias(p) for p in self.FLAG), *(q(p) for p in self.LISTS)))

    def from_columns(self, df: DataFrame) -> DataFrame:
        c = lambda p: F.col(f"`{p}`")
        time, lasts = _epoch_ms(c("ts")), F.round(c("duration")).cast("bigint")
        direction = F.when(c("local_orig") & ~c("local_resp"), 2).when(~c("local_orig") & c("local_resp"), 1)

        def endpoint(host: str, port: str, mac: str, country: str | None = None) -> Column:
            fields = [F.when(c(host) != "", c(host)).alias("ip"), F.when(c(port) != 0, c(port).cast("int")).alias("port"), c(mac).alias("mac")]
            if country:
                fields.append(F.when(c(country).isNotNull(), F.struct(c(country).alias("country"))).alias("location"))
            return F.when(c(host).isNotNull() & c(port).isNotNull(), F.struct(*fields))

        proto = F.when(c("proto") != "", c("proto"))
        number = F.when(c("proto") == "tcp", 6).when(c("proto") == "udp", 17)
        connection = F.struct(
            direction.alias("direction_id"), proto.alias("protocol_name"), number.alias("protocol_num"), c("community_id").alias("community_uid"), c("history").alias("flag_history")
        )
        zero = lambda p: F.coalesce(c(p).cast("bigint"), F.lit(0).cast("bigint"))
        counted = _present(*(c(p) for p in ("orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts")))
        traffic = F.struct(
            c("resp_bytes").cast("bigint").alias("bytes_in"), c("resp_pkts").cast("bigint").alias("packets_in"), c("orig_bytes").cast("bigint").alias("bytes_out"),
            c("orig_pkts").cast("bigint").alias("packets_out"), c("missed_bytes").cast("bigint").alias("bytes_missed"),
            F.when(counted, zero("orig_bytes") + zero("resp_bytes")).alias("bytes"), F.when(counted, zero("orig_pkts") + zero("resp_pkts")).alias("packets"),
        )

        def observed(side: str, name: str) -> Column:
            provider = c(f"id.{side}_h_name.src")
            values = F.filter(c(f"id.{side}_h_name.vals"), lambda x: x.isNotNull())
            made = F.transform(
                values,
                lambda x: F.struct(
                    F.lit(name).alias("name"), F.lit(1).alias("type_id"), x.alias("value"),
                    F.struct(provider.alias("provider"), F.lit(0.0).alias("base_score"), F.lit(0).alias("score_id")).alias("reputation"),
                ),
            )
            return F.coalesce(made, F.array().cast(OBSERVABLES))

        seen = F.concat(observed("orig", "src_endpoint.hostname"), observed("resp", "dst_endpoint.hostname"))
        left_over = F.to_json(
            F.struct(
                c("missed_bytes"), c("vlan"), *(F.when(F.size(c(p)) > 0, c(p)).alias(p) for p in ("app", "tunnel_parents", "suri_ids")), c("local_orig"), c("local_resp"), c("orig_ip_bytes"), c("resp_ip_bytes"),
                c("pcr"), c("corelight_shunted"), F.struct(c("spcap.url").alias("url"), c("spcap.rule").alias("rule"), c("spcap.trigger").alias("trigger")).alias("spcap"),
            )
        )
        written = _epoch_ms(c("_write_ts"))
        metadata = F.struct(
            F.lit("1.5.0").alias("version"), F.struct(F.lit("Zeek").alias("name"), F.lit("Zeek").alias("vendor_name")).alias("product"), F.when(written != 0, written).alias("logged_time"),
            F.when(c("_system_name").isNotNull(), F.array(F.struct(c("_system_name").alias("name")))).alias("loggers"), c("_path").alias("log_name"), c("uid").alias("uid"),
        )
        return df.select(
            metadata.alias("metadata"), F.lit(4).alias("category_uid"), F.lit(4001).alias("class_uid"), F.lit(1).alias("severity_id"), F.lit(2).alias("activity_id"), F.lit(400102).cast("bigint").alias("type_uid"),
            F.when(_present(proto, c("history")), connection).alias("connection_info"), time.alias("time"), F.when(lasts.isNotNull(), time).alias("start_time"), (time + lasts).alias("end_time"), lasts.alias("duration"),
            endpoint("id.orig_h", "id.orig_p", "orig_l2_addr").alias("src_endpoint"), endpoint("id.resp_h", "id.resp_p", "resp_l2_addr", "resp_cc").alias("dst_endpoint"),
            c("service").alias("app_name"), c("conn_state").alias("status_code"), F.when(counted | c("missed_bytes").isNotNull(), traffic).alias("traffic"),
            F.when(F.size(seen) > 0, seen).alias("observables"), left_over.alias("unmapped"),
        )


OBSERVABLES = "array<struct<name:string,type_id:int,value:string,reputation:struct<provider:string,base_score:double,score_id:int>>>"


class Enrich(Mapper):
    """ip_address, country, service: each distinct address is looked up once and joined back; unknown ones give ''."""

    name = "enrich"

    def __init__(self, lookup, service: str = "myservice", config: dict | None = None):
        """lookup: a DataFrame (ip_address, country), or a function from a DataFrame of distinct ip_address to such a one."""
        super().__init__(config)
        self.lookup, self.service = lookup, service

    def selectors(self):
        return [Selector(all=(Eq("service", self.service),))]

    def transform(self, df: DataFrame) -> DataFrame:
        from .lookup import enrich

        v = F.col("v")
        rows = _once(df, ip=access(v, "ip_address"), svc=access(v, "service")).select(F.coalesce(S.string(F.col("ip")), F.lit("")).alias("ip_address"), F.coalesce(S.string(F.col("svc")), F.lit("")).alias("service"))
        return enrich(rows, "ip_address", self.lookup, {"country": ""}).select("ip_address", "country", "service")


class VersionAlert(Mapper):
    """One alert per package version event, with the checksum of its archive."""

    name = "version_alert"

    def selectors(self):
        return [Selector(all=(Eq("kind", "npm_package_version"),))]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.select(S.string(access(F.col("v"), "npm.dist.shasum")).alias("shasum"), F.lit(False).alias("triggered"))


class DuplicateAlert(Mapper):
    """{triggered}: whether the source's name was seen before within the cache's time to live; each repeat is told to a chat service, if one is named.

    Runs record by record against the worker's cache, and the repeats of a batch are told side by side; `detect.seen_within` and `state.seen_within`
    say the same over a cluster.
    """

    name = "duplicate_alert"
    on_error = "fail"

    def __init__(self, url: str | None = None, channel: str = "alerts", token: str | None = None, service: str | None = None, config: dict | None = None):
        super().__init__(config)
        self.url, self.channel, self.token, self.service = url, channel, token, service

    def selectors(self):
        return [Selector(all=(Eq("source.name", self.service) if self.service else Has("source.name"),))]

    def process_logs(self, logs) -> bytes:
        told, out, alerts = self.services, [], []
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {self.token}"}
        for log in logs:
            name = log.get("source.name")
            again = told.get(str(name)) is not None
            if not again:
                told.set(str(name), True)
            elif self.url is not None:
                body = json.dumps({"text": f"{name} came again", "channel": self.channel})
                alerts.append({"id": "alert", "method": "POST", "url": self.url, "headers": headers, "body": body})
            out.append('{"triggered": true}\n' if again else '{"triggered": false}\n')
        for got in told.call(alerts) if alerts else []:
            if got["status"] != 204 and not (got["status"] == 200 and json.loads(got["body"] or b"{}").get("ok")):
                raise RuntimeError(f"the alert was not taken: status {got['status']} {got['error'] or ''}")
        return "".join(out).encode()
