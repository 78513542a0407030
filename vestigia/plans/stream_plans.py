"""Streams over the provided tables, run until everything available is processed."""

from __future__ import annotations

from pyspark.sql import functions as F

from vestigia.plans.bindings import EV, SEVERITY
from vestigia.plans.network_plans import d_ips, d_mails, d_private, d_susp, d_urls
from vestigia.plans.registry import query
from vestigia.sources import stores
from vestigia.sources.formats import MAX_SIZE_BYTES
from vestigia.sources.tables import table
from vestigia.streaming import flows

LIMIT = MAX_SIZE_BYTES


def _stream(spark, folder, name):
    return flows.arriving(spark, folder, f"{name}.parquet", table(spark, folder, name).schema)


def _events(spark, folder):
    return _stream(spark, folder, "events").select(
        "event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), F.expr(SEVERITY).alias("severity"), "event_type", "props")


def _result(spark, stream, name, partition=None):
    path = stores.new_folder(spark, name)
    flows.run_to_files(stream, f"{path}/data", f"{path}/state", partition)
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


@query("ingest_stream", f"""WITH d AS (SELECT doc_id, strlen(text) AS size_bytes, {d_urls('text')} AS u, {d_ips('text')} AS i, {d_mails('text')} AS m FROM documents),
c AS (SELECT doc_id, size_bytes <= {LIMIT} AS ok, CASE WHEN size_bytes <= {LIMIT} THEN len(u) + len(i) + len(m) ELSE 0 END AS n, len(list_filter(i, lambda x: NOT {d_private('x')})) > 0 AS ext,
 len(list_filter(i, lambda x: {d_private('x')})) > 0 AS int_, len(list_filter(u, lambda x: {d_susp('x')})) > 0 AS susp, len(list_filter(u, lambda x: contains(lower(x), '.onion'))) > 0 AS onion FROM d)
SELECT doc_id, CASE WHEN ok THEN 'ok' ELSE 'error' END AS status, CAST(n AS BIGINT) AS total_indicators, CASE WHEN NOT ok THEN 'UNKNOWN' WHEN onion THEN 'HIGH' WHEN ext OR susp THEN 'MEDIUM'
 WHEN int_ THEN 'LOW' ELSE 'CLEAN' END AS risk_level FROM c""")
def ingest_stream(spark, folder):
    """Documents analysed as they arrive, one status row each, appended per risk level."""
    done = flows.analysed(_stream(spark, folder, "documents").select("doc_id", "text"), "text", LIMIT).select(
        "doc_id", "status", "total_indicators", "risk_level")
    return _result(spark, done, "ingest", "risk_level").select("doc_id", "status", "total_indicators", "risk_level")


@query("dedup_stream", "SELECT DISTINCT sha256(event_type || props) AS digest FROM events")
def dedup_stream(spark, folder):
    """One result per digest although items arrive again. The lateness covers the whole period here."""
    hashed = _events(spark, folder).select("ts", F.sha2(F.concat("event_type", "props"), 256).alias("digest"))
    return _result(spark, flows.once_per_digest(hashed, "digest", "ts", "60 days").select("digest"), "dedup")


def _complete(spark, folder, flow, name):
    """All windows of the flow, the newest included: the events first, then a closing row two days after the last one."""
    events, path = _events(spark, folder), stores.new_folder(spark, name)
    last = table(spark, folder, "events").agg(F.max("ts").cast("timestamp").alias("ts"))
    row = last.select(*[(F.col("ts") + F.expr("INTERVAL 2 DAYS") if c == "ts" else F.lit(None).cast(t)).alias(c) for c, t in events.dtypes])
    spark.createDataFrame([], events.schema).write.parquet(f"{path}/closing")
    stream = flow(flows.closing(events, f"{path}/closing"))
    flows.run_to_files(stream, f"{path}/data", f"{path}/state")
    row.write.mode("append").parquet(f"{path}/closing")
    flows.run_to_files(flow(flows.closing(_events(spark, folder), f"{path}/closing")), f"{path}/data", f"{path}/state")
    return spark.read.schema(stream.schema).parquet(f"{path}/data")


@query("severity_windows", f"""WITH {EV}, w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS s, severity FROM ev)
SELECT strftime(s, '%Y-%m-%d %H:%M') AS window_start, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low
 FROM w GROUP BY s""")
def severity_windows(spark, folder):
    """Hourly windows."""
    done = _complete(spark, folder, lambda s: flows.severity_windows(s, "ts", "10 minutes"), "windows")
    return done.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "high", "medium", "low")


@query("sliding_windows", f"""WITH {EV}, w AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE * o AS s, severity FROM ev, (VALUES (0), (1), (2), (3)) t(o))
SELECT strftime(s, '%Y-%m-%d %H:%M') AS window_start, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low
 FROM w GROUP BY s""")
def sliding_windows(spark, folder):
    done = _complete(spark, folder, lambda s: flows.severity_windows(s, "ts", "10 minutes", "1 hour", "15 minutes"), "sliding")
    return done.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "high", "medium", "low")


@query("actor_sessions", f"""WITH {EV}, g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY doc_id ORDER BY ts, finding_id) + INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS b FROM ev),
s AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY ts, finding_id) AS sid FROM g)
SELECT doc_id AS user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 300000000 AS end_us, count(*) AS n_events, count(*) FILTER (severity = 'HIGH') AS high FROM s GROUP BY doc_id, sid""")
def actor_sessions(spark, folder):
    done = _complete(spark, folder, lambda s: flows.actor_sessions(s, "user_id", "ts", "10 minutes"), "sessions")
    return done.select("user_id", F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"), "n_events", "high")
