"""Result tables: append, point reads, updates, deletes, schema changes, JSON export."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vestigia.operators.common import join_reduced
from vestigia.session import checkpoint_folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh place on the shared storage for one run."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def append_results(results: DataFrame, path: str, partition: str = "risk_level") -> None:
    """Append, one folder per risk level. No shuffle: each task writes its own rows of every level, so a
    level that holds most rows stays spread over all tasks."""
    results.write.mode("append").partitionBy(partition).parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """All columns that any part file has; older rows show null in later columns."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def upsert_column(base: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """New value where an update exists, the old one elsewhere."""
    new = updates.select(key, F.col(column).alias("_new"), F.lit(True).alias("_hit"))
    merged = base.join(new, key, "left")
    return merged.withColumn(column, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(column))).drop("_new", "_hit")


def delete_keys(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return join_reduced(base, keys.select(key).distinct(), key, "left_anti")


def deleted_count(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    hit = join_reduced(base, keys.select(key).distinct(), key, "left_semi")
    return hit.agg(F.count(F.lit(1)).alias("deleted"))


def reuse_cached(items: DataFrame, cached: DataFrame, key: str, compute: dict[str, Column],
                 force: bool = False) -> DataFrame:
    """Stored values where present, computed ones elsewhere; `force` recomputes everything."""
    fresh = items.select(key, *[e.alias(c) for c, e in compute.items()], F.lit(False).alias("from_cache"))
    if force:
        return fresh
    kept = cached.join(items.select(key), key, "left_semi").select(
        key, *compute, F.lit(True).alias("from_cache")
    )
    return fresh.join(cached.select(key).distinct(), key, "left_anti").unionByName(kept)


def evolve(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new, allowMissingColumns=True)


def as_json(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.to_json(F.struct("*")).alias("document"))


def from_json_record(df: DataFrame, column: str, schema: str, out: str = "record") -> DataFrame:
    return df.withColumn(out, F.from_json(column, schema))


def batch_status(items: DataFrame, batch: str, error: Column) -> DataFrame:
    """One status row per item; the error text is kept to 200 characters for display."""
    return items.withColumn("error", F.substring(error, 1, 200)).withColumn(
        "status", F.when(F.col("error").isNull(), "ok").otherwise("error")
    )


def batch_totals(status: DataFrame, batch: str) -> DataFrame:
    return status.groupBy(batch).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "ok").alias("ok"),
        F.count_if(F.col("status") == "error").alias("errors"),
    )
