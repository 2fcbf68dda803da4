"""Queries of the operators in this package and the SQL that must agree with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import broadcast_if_small, col, durable, widened
from . import distinct, mixing, percentiles, residue, tokens



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Percentiles -----------------------------------------------------------------------------------------------------------

AT = [0.5, 0.95]


def _durations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Valid durations as (tbl, part, grp, day, v): by service and day, and by source."""
    valid = lambda d: F.when((d >= 0) & (d < float("inf")), d)
    conn = table(spark, sf_dir, "conn").select(F.lit("conn").alias("tbl"), F.col("service").alias("grp"), F.substring("ts", 1, 10).alias("day"), valid(F.col("duration")).alias("v"))
    log = table(spark, sf_dir, "input_log").select(F.lit("input_log").alias("tbl"), F.col("source.name").alias("grp"), F.lit("").alias("day"), valid(F.col("duration")).alias("v"))
    return conn.where(F.col("v").isNotNull()), log.where(F.col("v").isNotNull())


GROUPS = ["tbl", "part", "grp", "day"]


def duration_percentiles(spark: SparkSession, sf_dir: str, at: list[float] = AT) -> DataFrame:
    """Exact percentiles of every group (part `group`) and of its reference (part `all`), from states that are added up."""
    conn, log = _durations(spark, sf_dir)
    fine = conn.unionByName(log).withColumn("part", F.lit("group"))
    rows = fine.where(F.col("grp").isNotNull())
    of_service = conn.where(F.col("grp").isNotNull()).select("tbl", F.lit("all").alias("part"), "grp", F.lit("").alias("day"), "v")
    of_table = log.select("tbl", F.lit("all").alias("part"), F.lit(None).cast("string").alias("grp"), F.lit("").alias("day"), "v")
    every = rows.select(*GROUPS, "v").unionByName(of_service).unionByName(of_table)
    # one state of days and sources; the states of whole services and of the whole table are sums of it
    state = durable(percentiles.state(fine, GROUPS, "v"))
    whole = state.select("tbl", F.lit("all").alias("part"), F.when(F.col("tbl") == "conn", F.col("grp")).alias("grp"), F.lit("").alias("day"), "cell", "n", "low", "high")
    whole = percentiles.merge_states(whole.where((F.col("tbl") != "conn") | F.col("grp").isNotNull()), GROUPS)
    merged = state.where(F.col("grp").isNotNull()).select(*GROUPS, "cell", "n", "low", "high").unionByName(whole.select(*GROUPS, "cell", "n", "low", "high"))
    return percentiles.percentiles(every, GROUPS, "v", at, merged=merged)


def p1_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = duration_percentiles(spark, sf_dir)
    return found.select("tbl", "part", "grp", "day", "q", F.col("n").alias("n_rows"), F.col("low").alias("value"))


def p1_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of conn by service and day from the mergeable state alone: each lies between low and high."""
    conn, _ = _durations(spark, sf_dir)
    found = percentiles.intervals(percentiles.state(conn, ["grp", "day"], "v"), ["grp", "day"], [0.25, 0.5, 0.75, 0.9, 0.95, 0.99])
    return found.select("grp", "day", "q", F.col("n").alias("n_rows"), "low", "high")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = durable(duration_percentiles(spark, sf_dir))
    own = found.where((F.col("part") == "group") & (F.col("n") >= 40))
    reference = found.where(F.col("part") == "all").select(F.col("tbl").alias("r_tbl"), F.col("grp").alias("r_grp"), F.col("q").alias("r_q"), F.col("low").alias("r_low"))
    same = (F.col("tbl") == F.col("r_tbl")) & (F.col("q") == F.col("r_q")) & (F.when(F.col("tbl") == "conn", F.col("grp")).eqNullSafe(F.col("r_grp")))
    met = own.join(broadcast_if_small(reference, reference.count()), same)
    return met.where(F.col("low") > 4 * F.col("r_low")).select("tbl", "grp", "day").distinct()


# Distinct counts -------------------------------------------------------------------------------------------------------


def _day():
    """The day of a row, in days since 1970; none if `ts` does not start with a date."""
    return F.unix_date(F.expr("try_cast(substr(ts, 1, 10) as date)"))


def _spelled(day):
    return F.date_from_unix_date(day.cast("int")).cast("string")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    conn = table(spark, sf_dir, "conn").select(col("id.orig_h").alias("orig_h"), col("id.resp_h").alias("resp_h"), "community_id", "ts").where(F.col("orig_h").isNotNull())

    def counted(identifier: str) -> DataFrame:
        held = distinct.memberships(conn, ["orig_h"], identifier, _day())
        return distinct.per_group(distinct.totals(held, ["orig_h"], identifier), ["orig_h"])

    def rows(counts: DataFrame, per_day: str, day_limit: int, overall: str | None, all_limit: int) -> DataFrame:
        grain = F.when(F.col("index").isNotNull() & (F.col("n") > day_limit), F.lit(per_day))
        if overall:
            grain = F.coalesce(grain, F.when(F.col("index").isNull() & (F.col("n") > all_limit), F.lit(overall)))
        return counts.select(grain.alias("grain"), "orig_h", F.coalesce(_spelled(F.col("index")), F.lit("")).alias("day")).where(F.col("grain").isNotNull())

    found = rows(counted("resp_h"), "resp_per_orig_day", 50, "resp_per_orig", 100)
    return found.unionByName(rows(counted("community_id"), "flow_per_orig_day", 60, None, 0))


def _cubed(spark: SparkSession, sf_dir: str, identifiers: tuple[str, ...], fixed: list[str]) -> DataFrame:
    """Distinct identifiers by the fixed columns and every combination of service, sensor and day. `*` stands for all values of a column."""
    conn = table(spark, sf_dir, "conn")
    conn = conn.select(col("id.orig_h").alias("orig_h"), col("id.orig_h").alias("host"), col("id.resp_h").alias("resp_h"), "community_id", "service", F.col("_system_name").alias("sensor"), "ts")
    groups, out = ["service", "sensor"], None
    for name in identifiers:
        held = distinct.memberships(conn, fixed, name, _day(), groups)
        counts = distinct.per_group(distinct.totals(held, fixed, name, groups), fixed, groups)
        shown = [F.coalesce(F.col(c), F.lit("(none)")).alias(c) for c in fixed]
        shown += [F.when(F.array_contains("level", i), F.coalesce(F.col(c), F.lit("(none)"))).otherwise("*").alias(c) for i, c in enumerate(groups)]
        part = counts.select(F.lit(name).alias("identifier"), *shown, F.coalesce(_spelled(F.col("index")), F.lit("*")).alias("day"), F.col("n").alias("n_distinct"))
        out = part if out is None else out.unionByName(part)
    return out


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct identifiers by every combination of service, sensor and day. `*` in a column stands for all of its values."""
    return _cubed(spark, sf_dir, ("orig_h", "resp_h", "community_id"), [])


def p5_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct peers and flows of each host, by every combination of service, sensor and day as in p5_counts."""
    return _cubed(spark, sf_dir, ("resp_h", "community_id"), ["host"])


def p5_week_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per sensor: hosts seen in the first week, in the second, in both, and in the first only, from one table of totals."""
    conn = table(spark, sf_dir, "conn").select(col("id.orig_h").alias("orig_h"), F.col("_system_name").alias("sensor"), "ts").where(F.col("_system_name").isNotNull())
    totals = durable(distinct.totals(distinct.memberships(conn, ["sensor"], "orig_h", _day()), ["sensor"], "orig_h"))
    first = conn.agg(F.min(_day())).first()[0] or 0
    one, two = list(range(first, first + 7)), list(range(first + 7, first + 14))
    kinds = {"first": (one, []), "second": (two, []), "either": (one + two, []), "first_only": (one, two)}
    out = None
    for name, (some, none) in kinds.items():
        part = distinct.combination(totals, ["sensor"], any_of=some, none_of=none).select("sensor", F.lit(name).alias("weeks"), F.col("n").alias("n_distinct"))
        out = part if out is None else out.unionByName(part)
    return out


# Texts -----------------------------------------------------------------------------------------------------------------


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(widened(table(spark, sf_dir, "documents").select("doc_id", "text")), ["doc_id"], "text")


def p6_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_chars and hash of each document's ids decoded again."""
    coded = tokens.encode(widened(table(spark, sf_dir, "documents").select("doc_id", "text")), ["doc_id"], "text")
    decoded = tokens.decode(coded, ["doc_id"], "ids", out="decoded")
    return decoded.select("doc_id", F.octet_length("decoded").cast("bigint").alias("n_bytes"), F.length("decoded").cast("bigint").alias("n_chars"), F.md5(F.col("decoded").cast("binary")).alias("hash"))


def p7_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.sized(widened(table(spark, sf_dir, "documents").select("doc_id", "source", "text")), "doc_id", "source", "text")
    return mixing.select(docs, table(spark, sf_dir, "mix_targets")).select("mix", F.col("doc").alias("doc_id"), "source", "n_tokens", "copies")


def p7_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole blocks that each source of a mixture is given, sizes in characters here."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "source", F.col("n_chars").alias("n_tokens"))
    return mixing.quotas(docs, table(spark, sf_dir, "mix_targets")).select("mix", "source", "blocks")


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = mixing.sized(widened(table(spark, sf_dir, "documents").select("doc_id", "source", "text")), "doc_id", "source", "text")
    targets = table(spark, sf_dir, "mix_targets")
    return mixing.shares(mixing.select(docs, targets), docs, targets)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = widened(table(spark, sf_dir, "documents").select("doc_id", "text", "cells", "path", "repo"))
    found = residue.residue(docs, "doc_id", "text", "cells", "path", "repo")
    return found.where("flagged").select(F.col("key").cast("bigint").alias("doc_id"))


def p8_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the corpus alone shows to be residue, without the detectors, and the weights that decide it."""
    docs = widened(table(spark, sf_dir, "documents").select("doc_id", "text", "cells", "path", "repo"))
    found = residue.residue(docs, "doc_id", "text", "cells", "path", "repo", detectors=False)
    return found.where("flagged").select(F.col("key").cast("bigint").alias("doc_id"), "learned", "total")


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_percentiles, p1_bounds, p5_found, p5_counts, p5_hosts, p5_week_overlap, p6_ids, p6_round_trip, p7_selection, p7_quotas, p7_shares, p8_found, p8_corpus)
}

_PERCENTILES = """
    WITH valid AS (
        SELECT 'conn' AS tbl, 'group' AS part, service AS grp, substr(ts, 1, 10) AS day, duration AS v FROM conn WHERE service IS NOT NULL
        UNION ALL SELECT 'conn', 'all', service, '', duration FROM conn WHERE service IS NOT NULL
        UNION ALL SELECT 'input_log', 'group', source.name, '', duration FROM input_log WHERE source.name IS NOT NULL
        UNION ALL SELECT 'input_log', 'all', NULL, '', duration FROM input_log),
    ranked AS (
        SELECT tbl, part, grp, day, v, row_number() OVER (PARTITION BY tbl, part, grp, day ORDER BY v) AS r, count(*) OVER (PARTITION BY tbl, part, grp, day) AS n
        FROM valid WHERE v IS NOT NULL AND NOT isnan(v) AND NOT isinf(v) AND v >= 0),
    found AS (
        SELECT tbl, part, grp, day, q, n AS n_rows, v AS value FROM ranked, (VALUES (CAST(0.5 AS DOUBLE)), (CAST(0.95 AS DOUBLE))) AS t(q)
        WHERE r = greatest(1, CAST(ceil(q * n) AS BIGINT)))"""

_DISTINCT = " UNION ALL ".join(
    f"""SELECT '{name}' AS identifier, CASE WHEN grouping(s) = 1 THEN '*' ELSE s END AS service, CASE WHEN grouping(n) = 1 THEN '*' ELSE n END AS sensor,
        CASE WHEN grouping(day) = 1 THEN '*' ELSE day END AS day, count(DISTINCT id) AS n_distinct
        FROM (SELECT coalesce(service, '(none)') AS s, coalesce(_system_name, '(none)') AS n, substr(ts, 1, 10) AS day, "{column}" AS id FROM conn WHERE "{column}" IS NOT NULL)
        GROUP BY CUBE (s, n, day)"""
    for name, column in (("orig_h", "id.orig_h"), ("resp_h", "id.resp_h"), ("community_id", "community_id"))
)

_HOSTS = " UNION ALL ".join(
    f"""SELECT '{name}' AS identifier, h AS host, CASE WHEN grouping(s) = 1 THEN '*' ELSE s END AS service, CASE WHEN grouping(n) = 1 THEN '*' ELSE n END AS sensor,
        CASE WHEN grouping(day) = 1 THEN '*' ELSE day END AS day, count(DISTINCT id) AS n_distinct
        FROM (SELECT coalesce("id.orig_h", '(none)') AS h, coalesce(service, '(none)') AS s, coalesce(_system_name, '(none)') AS n, substr(ts, 1, 10) AS day, "{column}" AS id FROM conn WHERE "{column}" IS NOT NULL)
        GROUP BY h, CUBE (s, n, day)"""
    for name, column in (("resp_h", "id.resp_h"), ("community_id", "community_id"))
)

SQL = {
    "p1_percentiles": _PERCENTILES + " SELECT tbl, part, grp, day, q, n_rows, value FROM found",
    "p1_found": _PERCENTILES + """
        SELECT DISTINCT a.tbl, a.grp, a.day FROM found a JOIN found b
        ON b.part = 'all' AND a.part = 'group' AND a.tbl = b.tbl AND a.q = b.q AND (a.tbl = 'input_log' OR a.grp = b.grp)
        WHERE a.n_rows >= 40 AND a.value > 4 * b.value""",
    "p5_found": """
        SELECT 'resp_per_orig_day' AS grain, "id.orig_h" AS orig_h, substr(ts, 1, 10) AS day FROM conn WHERE "id.orig_h" IS NOT NULL GROUP BY ALL HAVING count(DISTINCT "id.resp_h") > 50
        UNION ALL SELECT 'resp_per_orig', "id.orig_h", '' FROM conn WHERE "id.orig_h" IS NOT NULL GROUP BY ALL HAVING count(DISTINCT "id.resp_h") > 100
        UNION ALL SELECT 'flow_per_orig_day', "id.orig_h", substr(ts, 1, 10) FROM conn WHERE "id.orig_h" IS NOT NULL GROUP BY ALL HAVING count(DISTINCT community_id) > 60""",
    "p5_counts": _DISTINCT,
    "p5_hosts": _HOSTS,
    "p5_week_overlap": """
        WITH d AS (SELECT _system_name AS sensor, "id.orig_h" AS h, date_diff('day', (SELECT min(CAST(substr(ts, 1, 10) AS DATE)) FROM conn WHERE _system_name IS NOT NULL), CAST(substr(ts, 1, 10) AS DATE)) AS i
                   FROM conn WHERE _system_name IS NOT NULL AND "id.orig_h" IS NOT NULL),
        m AS (SELECT sensor, h, bool_or(i < 7) AS a, bool_or(i BETWEEN 7 AND 13) AS b FROM d GROUP BY ALL)
        SELECT sensor, 'first' AS weeks, count(*) AS n_distinct FROM m WHERE a GROUP BY ALL
        UNION ALL SELECT sensor, 'second', count(*) FROM m WHERE b GROUP BY ALL
        UNION ALL SELECT sensor, 'either', count(*) FROM m WHERE a OR b GROUP BY ALL
        UNION ALL SELECT sensor, 'first_only', count(*) FROM m WHERE a AND NOT b GROUP BY ALL""",
    "p6_round_trip": "SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars, md5(coalesce(text, '')) AS hash FROM documents",
    "p7_quotas": """
        WITH held AS (SELECT source, sum(n_chars) AS n FROM documents WHERE source IS NOT NULL AND n_chars > 0 GROUP BY ALL),
        t AS (SELECT mix, source, sum(CASE WHEN isfinite(weight) AND weight > 0 THEN weight ELSE 0 END) AS w, min(max_repeats) AS most FROM mix_targets WHERE mix IS NOT NULL AND source IS NOT NULL GROUP BY ALL),
        j AS (SELECT mix, t.source, w, most, coalesce(n, 0) AS n FROM t LEFT JOIN held USING (source)),
        m AS (SELECT mix, CAST(sum(CASE WHEN w > 0 THEN n ELSE 0 END) AS DOUBLE) AS size FROM j GROUP BY ALL),
        b AS (SELECT j.*, greatest(1.0, size / 10000) AS block, CAST(round_even(size / greatest(1.0, size / 10000), 0) AS BIGINT) AS seats FROM j JOIN m USING (mix)),
        q AS (SELECT mix, source, w / (2 * k + 1) AS quotient, seats FROM b, unnest(range(0, 10000)) AS r(k) WHERE w > 0 AND n > 0 AND k < coalesce(ceil(most * n / block), 10000)),
        won AS (SELECT mix, source, count(*) AS blocks FROM (SELECT *, row_number() OVER (PARTITION BY mix ORDER BY quotient DESC, source) AS r FROM q) WHERE r <= seats GROUP BY ALL)
        SELECT mix, source, CAST(coalesce(blocks, 0) AS BIGINT) AS blocks FROM j LEFT JOIN won USING (mix, source)""",
}
