"""Queries of the record engine over the events table, rendered as JSON lines first so that every one goes through the parser."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.paths import access
from ..operators import detect
from ..operators.lookup import enrich
from ..operators.mapper import apply, apply_raw, parsed
from ..operators.mappers import Enrich, FlatDefaults, FlatDefaultsBatch, NetworkActivity, VersionAlert
from ..operators.predicates import Eq, Gt, Has, In, Prefix, Regex, Selector, matches
from ..session import col, widened
from .records import table

LOG = (
    "to_json(named_struct('event_id', event_id, 'msg', event_type, 'msg.level', if(value > 50, 'warn', 'info'), 'seen', user_id, 'duration', value, 'tags', array(event_type, 't'), "
    "'source', named_struct('name', concat('svc', user_id % 5)), 'props', from_json(props, 'k bigint'), 'ok', value > 50, 'nothing', cast(null as string)), map('ignoreNullFields', 'false'))"
)


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.expr(LOG).alias("raw"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed(logs(spark, sf_dir))


def _ids(df: DataFrame) -> DataFrame:
    return df.select(S.bigint(access(F.col("v"), "event_id")).alias("event_id"))


def _selecting(*selectors: Selector):
    return lambda spark, sf_dir: _ids(records(spark, sf_dir).where(matches(selectors, F.col("v"))))


def _flat(df: DataFrame) -> DataFrame:
    return df.select("message", "level", "seen", "duration", "service", F.array_join("tags", ",").alias("tags"))


def map_flat_defaults(spark, sf_dir):
    return _flat(apply_raw(logs(spark, sf_dir), FlatDefaults("svc1")))


def opaque_mapper_equals_native(spark, sf_dir):
    out = apply_raw(logs(spark, sf_dir), FlatDefaultsBatch("svc1"))
    return _flat(out.select(F.from_json("out", "message string, level string, seen bigint, duration double, service string, tags array<string>").alias("o")).select("o.*"))


# Selectors: name -> (selectors, SQL condition) -------------------------------------------------------------------------

_P = Selector
SELECTORS = {
    "sel_has_nested": ([_P(all=(Has("source.name"),))], "true"),
    "sel_has_missing": ([_P(all=(Has("source.nope"),))], "false"),
    "sel_has_null": ([_P(all=(Has("nothing"),))], "true"),
    "sel_eq_string": ([_P(all=(Eq("msg", "click"),))], "event_type = 'click'"),
    "sel_eq_int": ([_P(all=(Eq("seen", 8),))], "user_id = 8"),
    "sel_eq_int_as_float": ([_P(all=(Eq("seen", 8.0),))], "user_id = 8"),
    "sel_eq_bool": ([_P(all=(Eq("ok", True),))], "value > 50"),
    "sel_eq_type_mismatch": ([_P(all=(Eq("seen", "8"),))], "false"),
    "sel_in_strings": ([_P(all=(In("source.name", ("svc1", "svc3")),))], "user_id % 5 IN (1, 3)"),
    "sel_in_numbers": ([_P(all=(In("seen", (3, 4.0, "5")),))], "user_id IN (3, 4)"),
    "sel_in_empty": ([_P(all=(In("seen", ()),))], "false"),
    "sel_prefix": ([_P(all=(Prefix("msg", "p"),))], "starts_with(event_type, 'p')"),
    "sel_gt_int": ([_P(all=(Gt("seen", 100),))], "user_id > 100"),
    "sel_gt_float": ([_P(all=(Gt("duration", 99.5),))], "value > 99.5"),
    "sel_regex_unanchored": ([_P(all=(Regex("msg", "[aeiou]r"),))], "regexp_matches(event_type, '[aeiou]r')"),
    "sel_regex_end_anchor": ([_P(all=(Regex("msg", "[a-m]$"),))], "regexp_matches(event_type, '[a-m]$')"),
    "sel_regex_posix": ([_P(all=(Regex("msg", "^[[:alpha:]_]+[[:^digit:]]$"),))], "regexp_matches(event_type, '^[[:alpha:]_]+[[:^digit:]]$')"),
    "sel_regex_posix_none": ([_P(all=(Regex("msg", "[[:digit:]:]"),))], "regexp_matches(event_type, '[[:digit:]:]')"),
    "sel_any_all_none": (
        [_P(any=(Eq("seen", 3), Gt("duration", 20.0)), all=(Has("msg"), In("source.name", ("svc0", "svc1", "svc2"))), none=(Eq("msg", "click"),))],
        "(user_id = 3 OR value > 20.0) AND user_id % 5 IN (0, 1, 2) AND event_type <> 'click'",
    ),
    "sel_two_selectors": ([_P(all=(Eq("seen", 3),)), _P(all=(Eq("seen", 4),))], "user_id IN (3, 4)"),
    "sel_empty_matches_all": ([_P()], "true"),
    "sel_no_selectors_matches_none": ([], "false"),
    "path_literal_beats_nested": ([_P(all=(Eq("msg.level", "warn"),))], "value > 50"),
    "path_array_index": ([_P(all=(Eq("tags[0]", "click"),))], "event_type = 'click'"),
    "path_index_out_of_range": ([_P(all=(Has("tags[2]"),))], "false"),
    "path_null_present": ([_P(all=(Has("nothing"),), none=(Eq("nothing", ""),))], "true"),
}


# Accessors -------------------------------------------------------------------------------------------------------------


def acc_scalars(spark, sf_dir):
    v = F.col("v")
    return records(spark, sf_dir).select(
        S.bigint(access(v, "event_id")).alias("event_id"), S.string(access(v, "msg")).alias("msg"), S.double(access(v, "duration")).alias("duration"), S.boolean(access(v, "ok")).alias("ok"),
        S.string(access(v, "seen")).alias("not_a_string"), S.bigint(access(v, "props.k")).alias("k"), S.kind(access(v, "source")).alias("source_kind"), S.kind(access(v, "nothing")).alias("null_kind"),
    )


def acc_len_bytes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select(F.to_json(F.struct("doc_id", "text")).alias("raw"))
    v = F.col("v")
    return parsed(docs).select(S.bigint(access(v, "doc_id")).alias("doc_id"), S.length(v, "text").cast("bigint").alias("n_bytes"))


def acc_list(spark, sf_dir):
    v = F.col("v")
    return records(spark, sf_dir).select(S.bigint(access(v, "event_id")).alias("event_id"), F.array_join(S.string_list(v, "tags"), ",").alias("tags"), S.length(v, "tags").cast("bigint").alias("n"))


def acc_map(spark, sf_dir):
    v = F.col("v")
    entries = F.map_entries(S.get_map(v, "source"))
    return records(spark, sf_dir).select(S.bigint(access(v, "event_id")).alias("event_id"), F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("source"))


def acc_keys(spark, sf_dir):
    v = F.col("v")
    return records(spark, sf_dir).select(S.bigint(access(v, "event_id")).alias("event_id"), F.array_join(S.keys(v, "props"), ",").alias("keys"), F.size(S.keys(v, "missing")).cast("bigint").alias("none"))


# Mappers of the examples -----------------------------------------------------------------------------------------------


def _activity_columns(out: DataFrame) -> DataFrame:
    return out.select(
        F.col("metadata.uid").alias("uid"), F.col("metadata.logged_time").alias("logged_time"), "type_uid", "time", "start_time", "end_time", "duration",
        F.col("connection_info.direction_id").alias("direction_id"), F.col("connection_info.protocol_num").alias("protocol_num"), F.col("connection_info.community_uid").alias("community_uid"),
        F.col("src_endpoint.ip").alias("src_ip"), F.col("src_endpoint.port").alias("src_port"), F.col("dst_endpoint.ip").alias("dst_ip"), F.col("dst_endpoint.location.country").alias("dst_country"),
        F.col("traffic.bytes").alias("bytes"), F.col("traffic.packets").alias("packets"), F.col("traffic.bytes_missed").alias("bytes_missed"), F.size("observables").alias("n_observables"),
        F.get_json_object("unmapped", "$.spcap.rule").cast("int").alias("rule"), F.get_json_object("unmapped", "$.vlan").cast("int").alias("vlan"),
    )


def _finite_conn(spark, sf_dir) -> DataFrame:
    conn = table(spark, sf_dir, "conn")
    d = F.col("duration")
    return conn.withColumn("duration", F.when((F.abs(d) < float("inf")), d))


def network_activity(spark, sf_dir):
    """Every conn record written as JSON, parsed again, selected and mapped. The text is made once, whatever reads it."""
    conn = widened(_finite_conn(spark, sf_dir))
    raw = conn.select(F.inline(F.array(F.struct(F.to_json(F.struct(*(col(c) for c in conn.columns))).alias("raw")))))
    return _activity_columns(apply_raw(raw, NetworkActivity()))


def network_activity_typed(spark, sf_dir):
    """The same from the typed columns, without a detour through JSON."""
    conn = _finite_conn(spark, sf_dir).where(F.col("uid").isNotNull() & (F.col("_path") == "conn"))
    return _activity_columns(NetworkActivity().from_columns(conn))


_ACTIVITY_SQL = """
    WITH c AS (SELECT *, CASE WHEN isfinite(duration) THEN duration END AS d FROM conn WHERE uid IS NOT NULL AND _path = 'conn'),
    t AS (SELECT *, CAST(floor(epoch_us(CAST(ts AS TIMESTAMPTZ)) / 1000) AS BIGINT) AS t_ms, CAST(round(d) AS BIGINT) AS r,
            CASE WHEN regexp_full_match(_write_ts, '\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}(\\.\\d+)?(Z|[+-]\\d{2}:\\d{2})') THEN CAST(floor(epoch_us(TRY_CAST(_write_ts AS TIMESTAMPTZ)) / 1000) AS BIGINT) END AS w_ms,
            len(list_filter("id.orig_h_name.vals", lambda x: x IS NOT NULL)) AS n1, len(list_filter("id.resp_h_name.vals", lambda x: x IS NOT NULL)) AS n2,
            (orig_bytes IS NOT NULL OR resp_bytes IS NOT NULL OR orig_pkts IS NOT NULL OR resp_pkts IS NOT NULL) AS counted,
            (nullif(proto, '') IS NOT NULL OR history IS NOT NULL) AS connected, ("id.orig_h" IS NOT NULL AND "id.orig_p" IS NOT NULL) AS has_src, ("id.resp_h" IS NOT NULL AND "id.resp_p" IS NOT NULL) AS has_dst FROM c)
    SELECT uid, w_ms AS logged_time, CAST(400102 AS BIGINT) AS type_uid, t_ms AS time, CASE WHEN r IS NOT NULL THEN t_ms END AS start_time, t_ms + r AS end_time, r AS duration,
        CASE WHEN connected THEN CASE WHEN local_orig AND NOT local_resp THEN 2 WHEN NOT local_orig AND local_resp THEN 1 END END AS direction_id,
        CASE WHEN connected THEN CASE proto WHEN 'tcp' THEN 6 WHEN 'udp' THEN 17 END END AS protocol_num, CASE WHEN connected THEN community_id END AS community_uid,
        CASE WHEN has_src THEN nullif("id.orig_h", '') END AS src_ip, CASE WHEN has_src THEN nullif("id.orig_p", 0) END AS src_port,
        CASE WHEN has_dst THEN nullif("id.resp_h", '') END AS dst_ip, CASE WHEN has_dst THEN resp_cc END AS dst_country,
        CASE WHEN counted THEN coalesce(orig_bytes, 0) + coalesce(resp_bytes, 0) END AS bytes, CASE WHEN counted THEN coalesce(orig_pkts, 0) + coalesce(resp_pkts, 0) END AS packets,
        missed_bytes AS bytes_missed, CASE WHEN coalesce(n1, 0) + coalesce(n2, 0) > 0 THEN CAST(coalesce(n1, 0) + coalesce(n2, 0) AS INT) END AS n_observables,
        "spcap.rule" AS rule, vlan FROM t"""


def _sources(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.concat(F.lit("svc"), F.col("user_id") % 5).alias("name"), "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))


def dedupe_first_seen(spark, sf_dir):
    return detect.seen_before(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).select("event_id", "triggered")


def dedupe_ttl(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return detect.seen_within(events, "user_id", F.unix_millis(F.col("ts").cast("timestamp")), "event_id").select("user_id", "event_id", "triggered")


_TTL_SQL = """
    WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_ms(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS r FROM events),
    walk AS (
        SELECT user_id, event_id, r, t AS anchor, false AS triggered FROM e WHERE r = 1
        UNION ALL SELECT e.user_id, e.event_id, e.r, CASE WHEN e.t >= w.anchor + 600000 THEN e.t ELSE w.anchor END, e.t < w.anchor + 600000
        FROM walk w JOIN e ON e.user_id = w.user_id AND e.r = w.r + 1)
    SELECT user_id, event_id, triggered FROM walk"""


def sequence_publish(spark, sf_dir):
    """Events read as lines of a build log: types become messages, users become commits."""
    message = F.expr("""case event_type when 'click' then '##[group]Run npm publish --access public' when 'view' then 'npm notice name: p' when 'purchase' then concat('+ p@', event_id) else 'other' end""")
    sha, log_file = F.nullif((F.col("user_id") % 40).cast("string"), F.lit("7")), F.when(F.col("user_id") % 40 == 9, "").otherwise(F.concat(F.lit("log"), F.col("user_id") % 2))
    rows = table(spark, sf_dir, "events").select(sha.alias("sha"), log_file.alias("log_file"), message.alias("message"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), F.struct("ts", "event_id").alias("seq"), "event_id")
    found = detect.publish_sequence(rows, "sha", "log_file", "message", "at_ms", "seq", 6 * 3_600_000)
    return found.select("sha", F.col("seq.event_id").alias("event_id"), "step", "triggered")


_SEQUENCE_SQL = """
    WITH m AS (SELECT nullif(CAST(user_id % 40 AS VARCHAR), '7') AS sha, CASE WHEN user_id % 40 = 9 THEN '' ELSE 'log' || (user_id % 2) END AS f, epoch_ms(ts) AS t, ts, event_id,
            CASE event_type WHEN 'click' THEN 'start' WHEN 'view' THEN 'name' WHEN 'purchase' THEN 'published' END AS step FROM events WHERE event_type IN ('click', 'view', 'purchase')),
    s AS (SELECT sha, f, t, ts, event_id, row_number() OVER (PARTITION BY sha ORDER BY ts, event_id) AS r, step FROM m),
    w AS (SELECT a.sha, a.event_id, a.step, a.f, a.t, (SELECT max(b.r) FROM s b WHERE b.sha = a.sha AND b.r < a.r AND b.step = 'start') AS mark FROM s a)
    SELECT w.sha, w.event_id, w.step, coalesce(w.step = 'published' AND w.f <> '' AND b.f = w.f AND w.t < b.t + 21600000, false) AS triggered
    FROM w LEFT JOIN s b ON b.sha = w.sha AND b.r = w.mark"""


def enrich_lookup(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("ip_address"), F.col("n_name").alias("country"))
    raw = table(spark, sf_dir, "customer").select(F.to_json(F.struct(F.col("c_nationkey").cast("string").alias("ip_address"), F.lower("c_mktsegment").alias("service"))).alias("raw"))
    return apply(parsed(raw), Enrich(nations, "building"))


def enrich_distinct_keys(spark, sf_dir):
    """A lookup that sees each distinct key once, here a function over the keys."""
    answer = lambda keys: keys.select("event_type", F.upper("event_type").alias("shout"))
    return enrich(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", answer, {"shout": ""})


def version_alert(spark, sf_dir):
    raw = table(spark, sf_dir, "part").select(F.to_json(F.struct(F.when(F.col("p_size") % 2 == 0, "npm_package_version").otherwise("other").alias("kind"), F.struct(F.struct(F.col("p_name").alias("shasum")).alias("dist")).alias("npm"))).alias("raw"))
    return apply(parsed(raw), VersionAlert())


QUERIES = {"map_flat_defaults": map_flat_defaults} | {name: _selecting(*s) for name, (s, _) in SELECTORS.items()}
QUERIES |= {
    f.__name__: f
    for f in (
        opaque_mapper_equals_native, acc_scalars, acc_len_bytes, acc_list, acc_map, acc_keys, network_activity, network_activity_typed, dedupe_first_seen, dedupe_ttl, sequence_publish,
        enrich_lookup, enrich_distinct_keys, version_alert,
    )
}

_FLAT_SQL = """SELECT event_type AS message, CASE WHEN value > 50 THEN 'warn' ELSE 'info' END AS level, user_id AS seen, value AS duration, 'svc1' AS service,
    event_type || ',t' AS tags FROM events WHERE user_id % 5 = 1"""

SQL = {name: f"SELECT event_id FROM events WHERE {where}" for name, (_, where) in SELECTORS.items()} | {
    "map_flat_defaults": _FLAT_SQL,
    "opaque_mapper_equals_native": _FLAT_SQL,
    "acc_scalars": """SELECT event_id, event_type AS msg, value AS duration, value > 50 AS ok, CAST(NULL AS VARCHAR) AS not_a_string, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
        'map' AS source_kind, 'none' AS null_kind FROM events""",
    "acc_len_bytes": "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents WHERE text IS NOT NULL",
    "acc_list": "SELECT event_id, event_type || ',t' AS tags, CAST(2 AS BIGINT) AS n FROM events",
    "acc_map": "SELECT event_id, 'name=svc' || (user_id % 5) AS source FROM events",
    "acc_keys": "SELECT event_id, 'k' AS keys, CAST(0 AS BIGINT) AS none FROM events",
    "network_activity": _ACTIVITY_SQL,
    "network_activity_typed": _ACTIVITY_SQL,
    "dedupe_first_seen": "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1 AS triggered FROM events",
    "dedupe_ttl": _TTL_SQL,
    "sequence_publish": _SEQUENCE_SQL,
    "enrich_lookup": "SELECT CAST(c_nationkey AS VARCHAR) AS ip_address, coalesce(n_name, '') AS country, lower(c_mktsegment) AS service FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey WHERE c_mktsegment = 'BUILDING'",
    "enrich_distinct_keys": "SELECT event_id, event_type, upper(event_type) AS shout FROM events",
    "version_alert": "SELECT p_name AS shasum, false AS triggered FROM part WHERE p_size % 2 = 0",
}
