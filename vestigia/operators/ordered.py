"""Ordered computations over groups that may be very large.

A plain window puts a whole group into one task. Here the rows are cut into chunks that follow the order
(ranges of key and order of about equal size, or blocks of positions); the window runs per (group, chunk) and one small
row per chunk carries the state over to the next chunk. Results equal the plain window.

Rows: null keys are a group of their own, null orders come first, null values count as values. Rows that are equal in key and
whole order stand in one chunk, in any order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vestigia.session import cut_lineage

CHUNK = "_chunk"


def with_range_chunk(df: DataFrame, keys: Sequence[str], order: Sequence[Column], chunks: int | None = None) -> DataFrame:
    """Chunks of about equal size whatever the keys are: Spark samples (key, order) and cuts its range, so one key, one day or one
    minute with very many rows is spread over all tasks. `chunks` defaults to the shuffle partitions. The cut depends on a
    sample, so the table is written once: every later step, and a repeated task, sees the same chunks."""
    by = [*[F.col(k).asc_nulls_first() for k in keys], *order]
    ranged = df.repartitionByRange(chunks, *by) if chunks else df.repartitionByRange(*by)
    return cut_lineage(ranged.withColumn(CHUNK, F.spark_partition_id()))


def with_block_chunk(df: DataFrame, pos: str, rows: int = 100_000) -> DataFrame:
    return df.withColumn(CHUNK, F.floor(F.col(pos) / rows))


def _inside(keys: Sequence[str], order: Sequence[Column]):
    return W.partitionBy(*keys, CHUNK).orderBy(*order)


def _across(keys: Sequence[str]):
    return W.partitionBy(*keys).orderBy(CHUNK)


def _with_chunk(df: DataFrame, carried: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join on keys and chunk; rows with a null key or chunk are kept."""
    names = [*keys, CHUNK]
    renamed = carried.withColumnsRenamed({k: f"_c_{k}" for k in names})
    same = [df[k].eqNullSafe(renamed[f"_c_{k}"]) for k in names]
    return df.join(renamed, same).drop(*[f"_c_{k}" for k in names])


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "rn") -> DataFrame:
    local = df.withColumn("_local", F.row_number().over(_inside(keys, order)))
    # The size of a chunk is its last number, so the same exchange serves both sides of the join.
    sizes = local.groupBy(*keys, CHUNK).agg(F.max("_local").alias("_n"))
    before = F.sum("_n").over(_across(keys).rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select(*keys, CHUNK, F.coalesce(before, F.lit(0)).alias("_offset"))
    return (
        _with_chunk(local, offsets, keys)
        .withColumn(out, (F.col("_local") + F.col("_offset")).cast("long"))
        .drop("_local", "_offset")
    )


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, out: str) -> DataFrame:
    """Sum of `value` over this row and all earlier ones."""
    sums = df.groupBy(*keys, CHUNK).agg(F.sum(value).alias("_s"))
    before = F.sum("_s").over(_across(keys).rowsBetween(W.unboundedPreceding, -1))
    offsets = sums.select(*keys, CHUNK, F.coalesce(before, F.lit(0)).alias("_offset"))
    inside = F.sum(value).over(_inside(keys, order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return (
        _with_chunk(df.withColumn("_local", inside), offsets, keys)
        .withColumn(out, F.coalesce(F.col("_local"), F.lit(0)) + F.col("_offset"))
        .drop("_local", "_offset")
    )


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, out: str) -> DataFrame:
    """`value` of the preceding row (null for the first one)."""
    tails = df.groupBy(*keys, CHUNK).agg(F.max_by(F.struct(value), F.struct(*order)).alias("_tail"))
    carried = tails.select(*keys, CHUNK, F.lag("_tail").over(_across(keys)).alias("_carry"))
    return (
        _with_chunk(df.withColumn("_lag", F.lag(F.struct(value)).over(_inside(keys, order))), carried, keys)
        .withColumn(out, F.coalesce("_lag", "_carry")[value])
        .drop("_lag", "_carry")
    )


def following(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, out: str) -> DataFrame:
    """`value` of the next row (null for the last one)."""
    heads = df.groupBy(*keys, CHUNK).agg(F.min_by(F.struct(value), F.struct(*order)).alias("_head"))
    carried = heads.select(*keys, CHUNK, F.lead("_head").over(_across(keys)).alias("_carry"))
    return (
        _with_chunk(df.withColumn("_lead", F.lead(F.struct(value)).over(_inside(keys, order))), carried, keys)
        .withColumn(out, F.coalesce("_lead", "_carry")[value])
        .drop("_lead", "_carry")
    )


def upper_median(df: DataFrame, key: str, value: str, out: str = "median") -> DataFrame:
    """The value at place n div 2 + 1 in ascending order, per key. Equal values are counted first and the counts summed in chunks of
    the order: no task holds the values of a key. Null values do not count; a key without values has no row."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    chunked = with_range_chunk(counts, [key], [F.col(value)])
    summed = running_sum(chunked, [key], [F.col(value)], "_n", "_upto")
    half = chunked.groupBy(F.col(key).alias("_key")).agg((F.expr("sum(_n) div 2") + 1).alias("_place"))
    return (
        summed.join(half, F.col(key).eqNullSafe(F.col("_key")))
        .filter((F.col("_upto") >= F.col("_place")) & (F.col("_upto") - F.col("_n") < F.col("_place")))
        .select(key, F.col(value).alias(out))
    )
