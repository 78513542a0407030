"""Finding records, severity order and bounded broadcasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITIES = ["HIGH", "MEDIUM", "LOW", "INFO"]


def lit_or_col(value: object) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def severity_rank(severity: Column) -> Column:
    """3 = HIGH … 0 = INFO; anything else ranks below INFO."""
    return (
        F.when(severity == "HIGH", 3).when(severity == "MEDIUM", 2)
        .when(severity == "LOW", 1).when(severity == "INFO", 0).otherwise(-1)
    )


def rank_to_risk(rank: Column) -> Column:
    """Highest non-INFO severity as risk level; no such finding means CLEAN."""
    return (
        F.when(rank == 3, "HIGH").when(rank == 2, "MEDIUM").when(rank == 1, "LOW").otherwise("CLEAN")
    )


def rule(condition: Column | str, severity: object, category: str, code: str, detail: object = None) -> Column:
    """One finding struct if the condition holds, else null. A text condition is an SQL expression."""
    return F.when(
        F.expr(condition) if isinstance(condition, str) else condition,
        F.struct(
            lit_or_col(severity).cast("string").alias("severity"),
            F.lit(category).alias("category"),
            F.lit(code).alias("code"),
            lit_or_col(detail).cast("string").alias("detail"),
        ),
    )


def emit(df: DataFrame, keys: Sequence[str], rules: Sequence[Column]) -> DataFrame:
    """One row per fired rule. A narrow projection: no shuffle, no join."""
    fired = F.filter(F.array(*rules), lambda f: f.isNotNull())
    return df.select(*keys, F.explode(fired).alias("f")).select(*keys, "f.*")


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A costly value as a column that later steps read and do not build again: filters and fields are not moved below it."""
    return df.withColumn(name, F.explode_outer(F.array(value)))


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def join_reduced(large: DataFrame, reduced: DataFrame, keys: str | Sequence[str], how: str = "inner") -> DataFrame:
    """Join with a side that an aggregate has reduced to one row per key. Spark splits a hot key only if both sides of a
    join are shuffled for it; the rebalance keeps the aggregate's own partitioning out of the join."""
    return large.join(reduced.hint("rebalance"), keys if isinstance(keys, str) else list(keys), how)


def joined(values: Column, sep: str = ",") -> Column:
    return F.array_join(values, sep)


def first_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str, k: int, out: str) -> DataFrame:
    """The first k values per key as a list. The row limit is pushed below the shuffle by Spark's
    window group limit, so a hot key sends k rows per task."""
    from pyspark.sql import Window as W

    ranked = df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("_rn") <= k)
    return ranked.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_rn", value))), lambda s: s[value]).alias(out)
    )
