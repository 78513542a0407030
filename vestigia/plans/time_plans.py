"""Dates, offsets and time-based identifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from vestigia.functions import dates as dt
from vestigia.operators.common import computed_once, emit, rule
from vestigia.operators.matching import lookup
from vestigia.plans import bindings as b
from vestigia.plans.registry import query

# Two dates per document; offsets, a bad month, a missing zone and an empty text come from the keys.
ZONES = ["Z", "+01''00''", "-03''30''", "+05''45''", "", "+0200", "-08", "z"]
STAMP = "lpad(CAST(1990 + o_orderkey % 30 AS STRING), 4, '0') || lpad(CAST({m} AS STRING), 2, '0') || '15' || lpad(CAST(o_custkey % 24 AS STRING), 2, '0') || '3045'"
ZONE = "CASE {i} " + " ".join(f"WHEN {i} THEN '{z}'" for i, z in enumerate(ZONES)) + " END"
RAW1 = f"'D:' || {STAMP.format(m='1 + o_custkey % 13')} || {ZONE.format(i='(o_custkey % 8)')}"
RAW2 = f"CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE ' D:' || {STAMP.format(m='1 + o_orderkey % 12')} || {ZONE.format(i='(o_orderkey % 8)')} END"
STAMPS = f"SELECT o_orderkey AS doc_id, 'created' AS field, {RAW1} AS raw FROM {{t}} UNION ALL SELECT o_orderkey, 'modified', {RAW2} FROM {{t}}"
PARSED = f"""s AS ({STAMPS.format(t='orders')}),
g AS (SELECT doc_id, field, trim(raw) AS raw, regexp_extract(trim(raw), 'D:([0-9]*)', 1) AS d,
 regexp_extract(trim(raw), 'D:[0-9]{{14}}(.*)$', 1) AS z FROM s),
o AS (SELECT *, CASE WHEN z = '' OR lower(z) = 'z' THEN 0 ELSE CASE WHEN z[1] = '-' THEN -1 ELSE 1 END
 * (CAST(z[2:3] AS INT) * 60 + CAST(CASE WHEN length(replace(z, '''', '')) > 3 THEN replace(z, '''', '')[4:5] ELSE '0' END AS INT)) END
 AS offset_min FROM g),
p AS (SELECT doc_id, field, raw, offset_min, z, try_strptime(d[1:14], '%Y%m%d%H%M%S') AS local_ts FROM o)"""


def stamps(spark, folder):
    from vestigia.sources.tables import table
    table(spark, folder, "orders").createOrReplaceTempView("_v_orders")
    return spark.sql(STAMPS.format(t="_v_orders"))


def parsed(spark, folder):
    once = computed_once(stamps(spark, folder), "p", dt.parse_document_date(F.col("raw")))
    return once.filter("p IS NOT NULL").select("doc_id", "field", "p.*")


FMT = "yyyy-MM-dd HH:mm:ss"
DFMT = "'%Y-%m-%d %H:%M:%S'"


@query("parse_d_date", f"""WITH {PARSED} SELECT doc_id, field, strftime(local_ts, {DFMT}) AS local_ts,
 strftime(local_ts - INTERVAL 1 MINUTE * offset_min, {DFMT}) AS utc_ts, CAST(offset_min AS INT) AS offset_min,
 CASE WHEN z = '' OR lower(z) = 'z' THEN 'Z (UTC)' ELSE z[1:3] || ':' || lpad(CAST(abs(offset_min) % 60 AS VARCHAR), 2, '0') END
 AS label FROM p WHERE local_ts IS NOT NULL""")
def parse_d_date(spark, folder):
    found = parsed(spark, folder)
    return found.select("doc_id", "field", F.date_format("local_ts", FMT).alias("local_ts"),
                        F.date_format("utc_ts", FMT).alias("utc_ts"), "offset_min", "label")


ISO = ("o_orderkey AS doc_id, CASE o_custkey % 6 WHEN 0 THEN '2001-02-03T04:05:06Z' WHEN 1 THEN '2001-02-03 04:05:' || "
       "lpad(CAST(o_orderkey % 60 AS STRING), 2, '0') WHEN 2 THEN '2001-02-' || lpad(CAST(1 + o_orderkey % 31 AS STRING), 2, '0') "
       "WHEN 3 THEN '03.02.2001' WHEN 4 THEN '' ELSE '2001-02-03T04:05:06.789+01:00' END AS raw")


@query("parse_iso_variants", f"""WITH s AS (SELECT {ISO} FROM orders), h AS (SELECT doc_id, raw, substr(raw, 1, 19) AS h FROM s)
SELECT doc_id, raw, strftime(coalesce(try_strptime(h, '%Y-%m-%dT%H:%M:%S'), try_strptime(h, '%Y-%m-%d %H:%M:%S'),
 try_strptime(h, '%Y-%m-%d')), {DFMT}) AS ts FROM h""")
def parse_iso_variants(spark, folder):
    texts = b.derived(spark, folder, "orders", ISO)
    return texts.select("doc_id", "raw", F.date_format(dt.parse_iso(F.col("raw")), FMT).alias("ts"))


# Identifier text: a version 1 id twice (upper and lower case) and a version 4 id that must be ignored.
CREATED_S = "(1072915200 + o_orderkey * 37)"
DELTA = "CASE o_custkey % 7 WHEN 0 THEN 0 WHEN 1 THEN 60 WHEN 2 THEN 61 WHEN 3 THEN 3600 WHEN 4 THEN 3601 WHEN 5 THEN -100 ELSE 90000 END"
TICKS = f"(({CREATED_S} + {DELTA}) * 10000000 + 122192928000000000 + (o_custkey % 10))"
UUID = (f"lpad(lower(hex({TICKS} & 4294967295)), 8, '0') || '-' || lpad(lower(hex(({TICKS} >> 32) & 65535)), 4, '0') || '-1' || "
        f"lpad(lower(hex(({TICKS} >> 48) & 4095)), 3, '0') || '-8abc-0123456789ab'")
ID_TEXT = f"'id ' || upper({UUID}) || ' ref ' || {UUID} || ' x 11111111-2222-4333-8444-555555555555'"
IDS = f"o_orderkey AS doc_id, {CREATED_S} AS created_s, {ID_TEXT} AS text"


def decoded(spark, folder):
    found = b.derived(spark, folder, "orders", IDS).select(
        "doc_id", "created_s", F.explode(dt.uuids1(F.col("text"))).alias("uuid"))
    return found.withColumn("micros", dt.uuid1_micros(F.col("uuid"))).withColumn(
        "delta_us", F.abs(F.col("micros") - F.col("created_s") * 1_000_000))


@query("uuid1_time", f"""SELECT o_orderkey AS doc_id, {UUID} AS uuid, CAST(({TICKS} - 122192928000000000 + 5) // 10 AS BIGINT)
 AS micros FROM orders""")
def uuid1_time(spark, folder):
    return decoded(spark, folder).select("doc_id", "uuid", "micros")


@query("uuid_time_delta", f"""WITH d AS (SELECT o_orderkey AS doc_id, abs(CAST(({TICKS} - 122192928000000000 + 5) // 10 AS BIGINT)
 - {CREATED_S} * 1000000) AS delta_us FROM orders)
SELECT doc_id, delta_us, CASE WHEN delta_us > 3600000000 THEN 'HIGH' WHEN delta_us > 60000000 THEN 'MEDIUM' END AS severity FROM d""")
def uuid_time_delta(spark, folder):
    severity = dt.uuid_severity(F.col("delta_us") / 1_000_000)
    return decoded(spark, folder).select("doc_id", "delta_us", severity.alias("severity"))


FILETIME = f"o_orderkey AS doc_id, CASE WHEN o_custkey % 10 = 0 THEN 0 ELSE ({CREATED_S} + 11644473600) * 10000000 END AS ticks"


@query("filetime_to_ts", f"""SELECT o_orderkey AS doc_id, CASE WHEN o_custkey % 10 > 0 THEN {CREATED_S} * 1000000 END AS micros
 FROM orders""")
def filetime_to_ts(spark, folder):
    stored = b.derived(spark, folder, "orders", FILETIME)
    return stored.select("doc_id", F.unix_micros(dt.filetime(F.col("ticks"))).alias("micros"))


@query("format_offset", f"""WITH {PARSED}, v AS (SELECT DISTINCT doc_id, CAST(offset_min AS INT) AS offset_min FROM p WHERE local_ts IS NOT NULL)
SELECT doc_id, offset_min, CASE WHEN offset_min < 0 THEN '-' ELSE '+' END || CAST(abs(offset_min) // 60 AS VARCHAR) || ':'
 || lpad(CAST(abs(offset_min) % 60 AS VARCHAR), 2, '0') AS shown, offset_min % 60 <> 0 AS half_hour FROM v""")
def format_offset(spark, folder):
    distinct = parsed(spark, folder).select("doc_id", "offset_min").distinct()
    return distinct.select("doc_id", "offset_min", dt.format_offset(F.col("offset_min")).alias("shown"),
                           (F.col("offset_min") % 60 != 0).alias("half_hour"))


REGIONS = b.values_table(list(dt.OFFSET_REGIONS.items()), "offset_min, region", "regions")


@query("offset_region_lookup", f"""WITH {PARSED}, {REGIONS}, q AS (SELECT doc_id, field, CAST(offset_min AS INT) AS offset_min FROM p
 WHERE local_ts IS NOT NULL)
SELECT doc_id, field, offset_min, coalesce(region, 'unbekannt (' || offset_min || ')') AS region FROM q LEFT JOIN regions USING (offset_min)""")
def offset_region_lookup(spark, folder):
    regions = spark.createDataFrame(list(dt.OFFSET_REGIONS.items()), "offset_min int, region string")
    found = lookup(parsed(spark, folder), "offset_min", F.broadcast(regions), {"region": F.format_string("unbekannt (%d)", "offset_min")})
    return found.select("doc_id", "field", "offset_min", "region")


def offsets_per_document(dates):
    """Most frequent offset (the smaller one on a tie), the distinct offsets, and how many dates are in UTC."""
    counted = dates.groupBy("doc_id", "offset_min").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == dt.UTC_LABEL).alias("n_utc"))
    return counted.groupBy("doc_id").agg(
        F.max_by("offset_min", F.struct("n", -F.col("offset_min"))).alias("modal_offset"),
        F.array_sort(F.collect_set("offset_min")).alias("offsets"),
        F.sum("n").alias("n_dates"), F.sum("n_utc").alias("n_utc"),
    ).withColumn("consistent", F.size("offsets") <= 1)


@query("modal_value", f"""WITH {PARSED}, {REGIONS}, c AS (SELECT doc_id, CAST(offset_min AS INT) AS o, count(*) AS n FROM p
 WHERE local_ts IS NOT NULL GROUP BY ALL),
m AS (SELECT doc_id, arg_max(o, n * 10000 - o) AS modal_offset, count(*) <= 1 AS consistent, string_agg(o, ',' ORDER BY o) AS offsets
 FROM c GROUP BY 1) SELECT m.*, region AS region_hint FROM m LEFT JOIN regions ON offset_min = modal_offset""")
def modal_value(spark, folder):
    regions = spark.createDataFrame(list(dt.OFFSET_REGIONS.items()), "modal_offset int, region_hint string")
    found = offsets_per_document(parsed(spark, folder)).join(F.broadcast(regions), "modal_offset", "left")
    return found.select("doc_id", "modal_offset", "consistent", "region_hint", F.array_join(
        F.transform("offsets", lambda o: o.cast("string")), ",").alias("offsets"))


@query("utc_share", f"""WITH {PARSED}, c AS (SELECT doc_id, count(*) AS n_dates, count(*) FILTER (z = '' OR lower(z) = 'z') AS n_utc
 FROM p WHERE local_ts IS NOT NULL GROUP BY 1)
SELECT doc_id, n_dates, CAST(n_utc AS BIGINT) AS n_utc, CASE WHEN n_utc > 0 AND n_dates > 1 THEN 'INFO' END AS severity FROM c""")
def utc_share(spark, folder):
    found = offsets_per_document(parsed(spark, folder))
    severity = F.when((F.col("n_utc") > 0) & (F.col("n_dates") > 1), "INFO")
    return found.select("doc_id", "n_dates", "n_utc", severity.alias("severity"))


@query("timezone_findings", f"""WITH {PARSED}, q AS (SELECT doc_id, CAST(offset_min AS INT) AS o, z FROM p WHERE local_ts IS NOT NULL)
SELECT doc_id, 'MEDIUM' AS severity, 'inconsistent_offsets' AS code, CAST(count(DISTINCT o) AS VARCHAR) AS detail FROM q GROUP BY 1 HAVING count(DISTINCT o) > 1
UNION ALL SELECT DISTINCT doc_id, 'INFO', 'half_hour_offset', CAST(o AS VARCHAR) FROM q WHERE o % 60 <> 0
UNION ALL SELECT doc_id, 'INFO', 'utc_dates', CAST(count(*) FILTER (z = '' OR lower(z) = 'z') AS VARCHAR) FROM q GROUP BY 1
 HAVING count(*) > 1 AND count(*) FILTER (z = '' OR lower(z) = 'z') > 0""")
def timezone_findings(spark, folder):
    found = offsets_per_document(parsed(spark, folder))
    whole = emit(found, ["doc_id"], [
        rule("NOT consistent", "MEDIUM", "timezone", "inconsistent_offsets", F.size("offsets")),
        rule("n_utc > 0 AND n_dates > 1", "INFO", "timezone", "utc_dates", F.col("n_utc")),
    ])
    each = emit(found.select("doc_id", F.explode("offsets").alias("offset_min")), ["doc_id"], [
        rule("offset_min % 60 <> 0", "INFO", "timezone", "half_hour_offset", F.col("offset_min"))])
    return whole.unionByName(each).drop("category")
