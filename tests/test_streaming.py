"""Streams: restart without loss or repetition, late rows, equality with the batch result."""

import datetime as dt

from pyspark.sql import functions as F

from vestigia.sources.stores import new_folder
from vestigia.streaming import flows


def write(spark, rows, path, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_restart_takes_only_new_files(spark):
    base = new_folder(spark, "stream-test")
    schema = "doc_id bigint, text string"
    write(spark, [(1, "8.8.8.8"), (2, "x" * 50)], f"{base}/in", schema)

    def run():
        source = flows.arriving(spark, f"{base}/in", "*.parquet", spark.read.schema(schema).parquet(f"{base}/in").schema)
        done = flows.analysed(source, "text", 40).select("doc_id", "status", "risk_level")
        flows.run_to_files(done, f"{base}/out", f"{base}/state", "risk_level")
        return {(r.doc_id, r.status, r.risk_level) for r in spark.read.parquet(f"{base}/out").collect()}

    first = {(1, "ok", "MEDIUM"), (2, "error", "UNKNOWN")}
    assert run() == first
    write(spark, [(3, "10.0.0.1")], f"{base}/in", schema)
    assert run() == first | {(3, "ok", "LOW")}
    assert spark.read.parquet(f"{base}/out").count() == 3


def test_late_rows_within_the_bound_count(spark):
    base = new_folder(spark, "late-test")
    schema = "ts timestamp, severity string"
    t0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    minute = dt.timedelta(minutes=1)
    typed = spark.createDataFrame([], schema).schema

    def run():
        source = flows.arriving(spark, f"{base}/in", "*.parquet", typed)
        flows.run_to_files(flows.severity_windows(source, "ts", "10 minutes"), f"{base}/out", f"{base}/state")
        rows = spark.read.parquet(f"{base}/out").select(F.unix_seconds("window_start").alias("s"), "high").collect()
        return {(r.s - int(t0.timestamp())) // 3600: r.high for r in rows}

    write(spark, [(t0, "HIGH"), (t0 + 65 * minute, "HIGH")], f"{base}/in", schema)
    assert run() == {}
    write(spark, [(t0 + 58 * minute, "HIGH")], f"{base}/in", schema)
    write(spark, [(t0 + 200 * minute, "LOW")], f"{base}/in", schema)
    assert run() == {0: 2, 1: 1}
    write(spark, [(t0 + 1 * minute, "HIGH"), (t0 + 400 * minute, "LOW")], f"{base}/in", schema)
    assert run()[0] == 2


def test_a_table_of_several_files_arrives(spark):
    base = new_folder(spark, "parts-test")
    spark.range(40).selectExpr("id AS doc_id", "'8.8.8.8' AS text").repartition(4).write.parquet(f"{base}/in/documents.parquet")
    spark.range(3).write.parquet(f"{base}/in/pages.parquet")
    schema = spark.read.parquet(f"{base}/in/documents.parquet").schema
    flows.run_to_files(flows.analysed(flows.arriving(spark, f"{base}/in", "documents.parquet", schema), "text", 40).select("doc_id", "risk_level"),
                       f"{base}/out", f"{base}/state")
    assert {r.doc_id: r.risk_level for r in spark.read.parquet(f"{base}/out").collect()} == {i: "MEDIUM" for i in range(40)}
