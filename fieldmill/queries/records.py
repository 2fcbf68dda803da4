"""Queries over connection records: instants (p2), sessions (p3), nested tables (p4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.instants import CANONICAL, FIRST, LAST, MICRO, convert, estimate_offsets, normalise, settled_histories
from ..operators.nested import flat_tables, json_triples, leaf_name, pivot_table, table_of, typed_record, typed_table
from ..operators.sessions import sessions
from ..session import col, durable, widened

GAP_US = 30 * 60 * MICRO


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def valid_duration(d: Column) -> Column:
    """d if it is not null, not NaN, finite and at least 0, else null."""
    return F.when((d >= 0) & (d < float("inf")), d)


def declared_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(place, zone) of the sensors listed with a zone."""
    return table(spark, sf_dir, "sensor_zone").select(F.col("system_name").alias("place"), F.col("tz_name").alias("zone")).where("place IS NOT NULL AND zone IS NOT NULL")


def zone_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The estimated offset history of each sensor: zoneless texts are aligned with the end of their connection."""
    conn = table(spark, sf_dir, "conn").select("_system_name", "_write_ts", "ts", "duration")
    ended = F.unix_micros(F.try_to_timestamp("ts")) + F.coalesce(F.floor(valid_duration(F.col("duration")) * MICRO), F.lit(0))
    return estimate_offsets(conn, "_system_name", "_write_ts", ended, zones=declared_zones(spark, sf_dir))


def write_instants(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """conn's named columns with utc_us, the instant of `_write_ts`, zoneless texts by the settled history of their sensor.

    A sensor without a declared zone is left out of the histories: its zoneless texts denote nothing here.
    """
    zones = declared_zones(spark, sf_dir)
    histories = durable(settled_histories(zone_histories(spark, sf_dir).where(F.col("zone").isNotNull()), zones))
    conn = table(spark, sf_dir, "conn").select("_system_name", "_write_ts", *(col(c) for c in columns))
    return convert(conn, "_write_ts", "_system_name", histories)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    conn = write_instants(spark, sf_dir, "uid").where(F.col("utc_us").isNotNull() & ~F.col("_write_ts").rlike(CANONICAL))
    log = normalise(table(spark, sf_dir, "input_log").select("log_id", "seen"), "seen", fixed_zone="UTC")
    log = log.where(F.col("utc_us").isNotNull() & ~((F.col("seen") >= FIRST) & (F.col("seen") < LAST)))
    return (
        conn.select(F.lit("conn").alias("tbl"), F.col("uid").alias("rec_key"), "utc_us")
        .unionByName(log.select(F.lit("input_log").alias("tbl"), F.col("log_id").cast("string").alias("rec_key"), "utc_us"))
        .distinct()
    )


def p2_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offset history of each sensor estimated from its zoneless readings, beside the declared zone and what it violates."""
    spelled = lambda c: F.date_format(F.timestamp_micros(c), "yyyy-MM-dd HH:mm").alias(c)
    return zone_histories(spark, sf_dir).select(F.col("place").alias("system_name"), spelled("from_us"), spelled("to_us"), "offset_minutes", "readings", "violations", F.col("zone").alias("tz_name"), "declared_violations")


def p2_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offset of each sensor with a declared zone at noon of each day of conn, as estimated from its readings alone."""
    spans = settled_histories(zone_histories(spark, sf_dir), declared_zones(spark, sf_dir).limit(0)).join(declared_zones(spark, sf_dir).select("place").distinct(), "place")
    first, last = table(spark, sf_dir, "conn").agg(F.min(F.to_date(F.substring("ts", 1, 10))), F.max(F.to_date(F.substring("ts", 1, 10)))).first()
    each = spans.select("place", "spans", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("at"))
    noon = F.unix_date("at").cast("bigint") * 86400 * MICRO + 43200 * MICRO
    begun = F.filter("spans", lambda s: s["from_us"] <= noon)
    span = F.when(F.size(begun) > 0, F.element_at(begun, -1)).otherwise(F.get("spans", F.lit(0)))
    return each.select(F.col("place").alias("system_name"), F.col("at").cast("string").alias("day"), (span["offset_us"] / (60 * MICRO)).cast("bigint").alias("offset_minutes"))


def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per uid: orig_h, start_us, end_us. The end is the earliest instant any of its rows denotes."""
    rows = write_instants(spark, sf_dir, "uid", "id.orig_h", "duration").where(F.col("utc_us").isNotNull() & col("id.orig_h").isNotNull())
    lasts = F.coalesce(F.round(valid_duration(F.col("duration")) * MICRO).cast("bigint"), F.lit(0))
    rows = rows.select("uid", col("id.orig_h").alias("orig_h"), "utc_us", lasts.alias("lasts"))
    # repeated rows of a uid agree in host and duration; where they did not, the smallest of each is taken
    one = rows.groupBy("uid").agg(F.min("utc_us").alias("end_us"), F.min("orig_h").alias("orig_h"), F.max("lasts").alias("lasts"))
    return one.select("uid", "orig_h", (F.col("end_us") - F.col("lasts")).alias("start_us"), "end_us")


def p3_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = connections(spark, sf_dir)
    found = sessions(rows, F.col("orig_h"), F.col("start_us"), F.col("end_us"), GAP_US, tie=F.col("uid"))
    return found.select(F.col("key").alias("orig_h"), "start_us", "end_us", (F.col("end_us") - F.col("start_us")).alias("lasts_us"), "n")


def p3_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sessions of the rows whose `_write_ts` is canonical."""
    conn = table(spark, sf_dir, "conn").where(F.col("_write_ts").rlike(CANONICAL) & col("id.orig_h").isNotNull())
    lasts = F.coalesce(F.round(valid_duration(F.col("duration")) * MICRO).cast("bigint"), F.lit(0))
    rows = conn.select("uid", col("id.orig_h").alias("orig_h"), F.unix_micros(F.col("_write_ts").try_cast("timestamp")).alias("end_us"), lasts.alias("lasts"))
    rows = rows.where(F.col("end_us").isNotNull())
    found = sessions(rows, F.col("orig_h"), F.col("end_us") - F.col("lasts"), F.col("end_us"), GAP_US, tie=F.col("uid"))
    return found.select(F.col("key").alias("orig_h"), "start_us", "end_us", "n")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_sessions(spark, sf_dir).where(F.col("n") >= 3).select("orig_h", "start_us", "end_us")


#: Paths of the raw payloads: those at which a lone value stands for a list, and the one whose text may hold JSON.
RAW_LISTS = ("id.orig_h_name.vals", "id.resp_h_name.vals", "spcap.rule", "unmapped.spcap.rule", "observables", "app", "suri_ids", "tunnel_parents")
RAW_TEXTS = ("unmapped",)
LEAVES = {
    "id.orig_h_name.vals[]": "orig_h_name",
    "spcap.rule[]": "spcap_rule",
    "unmapped.spcap.rule[]": "spcap_rule",
    "observables[].reputation.score_id": "score_id",
}


def raw_triples(spark: SparkSession, sf_dir: str, keep=None) -> DataFrame:
    return json_triples(widened(table(spark, sf_dir, "conn_raw").select("raw_id", "payload")), "raw_id", "payload", RAW_LISTS, RAW_TEXTS, keep=keep)


def observables(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "conn_out")
    fields = {"name": "name", "value": "value", "provider": "reputation.provider", "base_score": "reputation.base_score", "score_id": "reputation.score_id"}
    return typed_table(out, {"uid": F.col("metadata.uid")}, F.col("observables"), fields)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = observables(spark, sf_dir).where(F.col("score_id").isNotNull())
    out = typed.select(F.lit("conn_out").alias("tbl"), F.col("uid").alias("rec_key"), F.lit(0).cast("bigint").alias("rec_pos"), F.lit("score_id").alias("field"), "pos", F.col("score_id").cast("string").alias("val"))
    for ancestor, rows in flat_tables(durable(raw_triples(spark, sf_dir, LEAVES))).items():
        for path, field in LEAVES.items():
            if table_of(path) == ancestor and (name := leaf_name(path)) in rows.columns:
                held = rows.where(col(name).isNotNull())
                out = out.unionByName(held.select(F.lit("conn_raw").alias("tbl"), F.col("key").alias("rec_key"), "rec_pos", F.lit(field).alias("field"), F.col("ordinals")[0].alias("pos"), col(name).alias("val")))
    return out.distinct()


def p4_raw_observables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of observables in the raw payloads, each row linked to its record (key, rec_pos) and place."""
    leaves = [f"observables[].{x}" for x in ("name", "type_id", "value", "reputation.provider", "reputation.base_score", "reputation.score_id")]
    rows = pivot_table(raw_triples(spark, sf_dir, leaves), "observables[]", leaves)
    names = {f"`{x}`": x.replace("reputation.", "") for x in ("name", "type_id", "value", "reputation.provider", "reputation.base_score", "reputation.score_id")}
    return rows.select(F.col("key").alias("raw_id"), "rec_pos", F.col("ordinals")[0].alias("pos"), *(F.col(k).alias(v) for k, v in names.items()))


def p4_raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of records in the raw payloads: one row per record that has any of these fields."""
    leaves = ["uid", "_path", "ts", "service", "proto", "id.orig_h", "id.resp_h", "metadata.uid", "class_uid"]
    rows = pivot_table(raw_triples(spark, sf_dir, leaves), "", leaves)
    return rows.select(F.col("key").alias("raw_id"), "rec_pos", *(col(x).alias(x.replace(".", "_")) for x in leaves))


def p4_raw_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of host names in the raw payloads, each row linked to its record and place."""
    path = "id.orig_h_name.vals[]"
    (rows,) = flat_tables(raw_triples(spark, sf_dir, [path]), [path]).values()
    return rows.select(F.col("key").alias("raw_id"), "rec_pos", F.col("ordinals")[0].alias("pos"), F.col("value").alias("name"))


def p4_raw_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of capture rules in the raw payloads, each row linked to its record, the object that holds it and its place."""
    paths = [p for p, field in LEAVES.items() if field == "spcap_rule"]
    out = None
    for ancestor, rows in flat_tables(durable(raw_triples(spark, sf_dir, paths)), paths).items():
        part = rows.select(F.col("key").alias("raw_id"), "rec_pos", F.lit(ancestor.removesuffix(".rule[]")).alias("parent"), F.col("ordinals")[0].alias("pos"), F.col("value").alias("rule"))
        out = part if out is None else out.unionByName(part)
    return out


def p4_out_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of records of conn_out: one row per row."""
    return typed_record(table(spark, sf_dir, "conn_out"))


def p4_out_observables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observables(spark, sf_dir)


def p4_conn_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = typed_table(table(spark, sf_dir, "conn"), {"uid": F.col("uid"), "write_ts": F.col("_write_ts"), "src": col("id.orig_h_name.src")}, col("id.orig_h_name.vals"))
    return rows.withColumnRenamed("value", "name")


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_zones, p2_offsets, p3_found, p3_sessions, p3_canonical, p4_found, p4_raw_observables, p4_raw_records, p4_raw_names, p4_raw_rules, p4_out_records, p4_out_observables, p4_conn_names)
}

_STRUCTS = {
    "metadata": "version product.name product.vendor_name logged_time log_name uid", "connection_info": "direction_id protocol_name protocol_num community_uid flag_history",
    "src_endpoint": "ip port mac", "dst_endpoint": "ip port mac location.country", "traffic": "bytes_in packets_in bytes_out packets_out bytes_missed bytes packets",
}
_OUT = ["category_uid", "class_uid", "severity_id", "activity_id", "type_uid", "time", "start_time", "end_time", "duration", "app_name", "status_code", "unmapped"]
_OUT += [f"{k}.{x} AS {k}_{x.replace('.', '_')}" for k, names in _STRUCTS.items() for x in names.split()]

#: (raw_id, rec_pos, r): the records of the valid payloads.
_RAW = """
    WITH valid AS (SELECT raw_id, CAST(payload AS JSON) AS p FROM conn_raw WHERE json_valid(payload)),
    held AS (SELECT raw_id, CASE WHEN json_type(p) = 'ARRAY' THEN p
                                 WHEN json_exists(p, '$."records"') THEN json_extract(p, '$."records"')
                                 WHEN json_exists(p, '$."data.items"') THEN json_extract(p, '$."data.items"')
                                 WHEN json_exists(p, '$.data.items') THEN json_extract(p, '$.data.items')
                                 ELSE json_array(p) END AS l FROM valid WHERE json_type(p) IN ('ARRAY', 'OBJECT')),
    rec AS (SELECT raw_id, i AS rec_pos, json_extract(l, '$[' || i || ']') AS r
            FROM (SELECT raw_id, CASE json_type(l) WHEN 'ARRAY' THEN l WHEN 'NULL' THEN '[]' ELSE json_array(l) END AS l FROM held) h, unnest(range(0, CAST(json_array_length(l) AS BIGINT))) AS t(i)
            WHERE json_type(json_extract(l, '$[' || i || ']')) = 'OBJECT')"""


def _raw_at(record: str, path: str) -> str:
    """A dotted path of a record as JSON: the literal key wins, even if null."""
    nested = "$" + "".join(f'."{x}"' for x in path.split("."))
    literals = [f'$."{path}"']
    if path.count(".") > 1:
        head, _, last = path.rpartition(".")
        first, _, rest = path.partition(".")
        literals += [f'$."{head}"."{last}"', f'$."{first}"."{rest}"']
    whens = " ".join(f"WHEN json_exists({record}, '{x}') THEN json_extract({record}, '{x}')" for x in [*literals, nested])
    return f"CASE {whens} END"


def _raw_list(record: str, path: str) -> str:
    """A path's list; a lone value stands for a list of one, a null for none."""
    x = _raw_at(record, path)
    return f"(SELECT CASE WHEN y IS NULL OR json_type(y) = 'NULL' THEN '[]' WHEN json_type(y) = 'ARRAY' THEN y ELSE json_array(y) END FROM (SELECT {x} AS y))"


def _text(x: str) -> str:
    return f"json_extract_string({x}, '$')"


_UNMAPPED = "(SELECT CASE WHEN json_type(u) = 'VARCHAR' THEN CASE WHEN json_valid(json_extract_string(u, '$')) THEN CAST(json_extract_string(u, '$') AS JSON) END ELSE u END FROM (SELECT json_extract(r, '$.unmapped') AS u))"


def _raw_values(record: str, path: str, extra: str = "") -> str:
    return f"""SELECT raw_id, rec_pos, {extra}i AS pos, {_text("json_extract(l, '$[' || i || ']')")} AS v
        FROM (SELECT raw_id, rec_pos, {_raw_list("x", path)} AS l FROM (SELECT raw_id, rec_pos, {record} AS x FROM rec)), unnest(range(0, CAST(json_array_length(l) AS BIGINT))) AS t(i)"""


_OBSERVED = {"name": "name", "type_id": "type_id", "value": "value", "provider": "reputation.provider", "base_score": "reputation.base_score", "score_id": "reputation.score_id"}
_RECORD = ["uid", "_path", "ts", "service", "proto", "id.orig_h", "id.resp_h", "metadata.uid", "class_uid"]

SQL = {
    "p4_raw_names": f"{_RAW} SELECT DISTINCT CAST(raw_id AS VARCHAR) AS raw_id, rec_pos, pos, v AS name FROM ({_raw_values('r', 'id.orig_h_name.vals')})",
    "p4_raw_rules": f"""{_RAW} SELECT DISTINCT CAST(raw_id AS VARCHAR) AS raw_id, rec_pos, parent, pos, v AS rule FROM (
        {_raw_values('r', 'spcap.rule', "'spcap' AS parent, ")} UNION ALL {_raw_values(_UNMAPPED, 'spcap.rule', "'unmapped.spcap' AS parent, ")})""",
    "p4_raw_observables": f"""{_RAW} SELECT CAST(raw_id AS VARCHAR) AS raw_id, * EXCLUDE (raw_id) FROM (
        SELECT raw_id, rec_pos, i AS pos, {", ".join(f"{_text(_raw_at('o', p))} AS {n}" for n, p in _OBSERVED.items())}
        FROM (SELECT raw_id, rec_pos, i, json_extract(l, '$[' || i || ']') AS o FROM (SELECT raw_id, rec_pos, {_raw_list("r", "observables")} AS l FROM rec), unnest(range(0, CAST(json_array_length(l) AS BIGINT))) AS t(i))
        WHERE json_type(o) = 'OBJECT' AND ({" OR ".join(f"{_raw_at('o', p)} IS NOT NULL" for p in _OBSERVED.values())}))""",
    "p4_raw_records": f"""{_RAW} SELECT CAST(raw_id AS VARCHAR) AS raw_id, rec_pos, {", ".join(f"{_text(_raw_at('r', p))} AS {p.replace('.', '_')}" for p in _RECORD)}
        FROM rec WHERE {" OR ".join(f"{_raw_at('r', p)} IS NOT NULL" for p in _RECORD)}""",
    "p2_offsets": """
        WITH d AS (SELECT unnest(generate_series(min(CAST(substr(ts, 1, 10) AS DATE)), max(CAST(substr(ts, 1, 10) AS DATE)), INTERVAL 1 DAY)) AS day FROM conn)
        SELECT DISTINCT system_name, strftime(day, '%Y-%m-%d') AS day,
               date_diff('minute', CAST(day AS TIMESTAMP) + INTERVAL 12 HOUR, timezone(tz_name, timezone('UTC', CAST(day AS TIMESTAMP) + INTERVAL 12 HOUR))) AS offset_minutes
        FROM d, sensor_zone WHERE tz_name IS NOT NULL AND system_name IS NOT NULL""",
    "p3_canonical": """
        WITH r AS (SELECT uid, "id.orig_h" AS orig_h, epoch_us(CAST(_write_ts AS TIMESTAMPTZ)) AS end_us,
                          CASE WHEN isfinite(duration) AND duration >= 0 THEN CAST(round(duration * 1000000) AS BIGINT) ELSE 0 END AS lasts
                   FROM conn WHERE regexp_full_match(_write_ts, '\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}\\.\\d{6}Z') AND "id.orig_h" IS NOT NULL),
        s AS (SELECT *, end_us - coalesce(lasts, 0) AS start_us FROM r),
        o AS (SELECT *, max(end_us) OVER (PARTITION BY orig_h ORDER BY start_us, uid, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
        g AS (SELECT *, sum(CASE WHEN before IS NULL OR start_us > before + 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY orig_h ORDER BY start_us, uid, end_us ROWS UNBOUNDED PRECEDING) AS k FROM o)
        SELECT orig_h, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS n FROM g GROUP BY orig_h, k""",
    "p4_out_records": f"SELECT {', '.join(_OUT)} FROM conn_out",
    "p4_out_observables": """
        SELECT o.metadata.uid AS uid, CAST(i - 1 AS BIGINT) AS pos, o.observables[i].name AS name, o.observables[i].value AS value,
               o.observables[i].reputation.provider AS provider, o.observables[i].reputation.base_score AS base_score,
               o.observables[i].reputation.score_id AS score_id
        FROM conn_out o, unnest(range(1, len(o.observables) + 1)) AS t(i)""",
    "p4_conn_names": """
        SELECT c.uid, c._write_ts AS write_ts, c."id.orig_h_name.src" AS src, CAST(i - 1 AS BIGINT) AS pos, c."id.orig_h_name.vals"[i] AS name
        FROM conn c, unnest(range(1, len(c."id.orig_h_name.vals") + 1)) AS t(i)""",
}
