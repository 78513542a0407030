"""Tables, stored intermediate results and connected components."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vestigia.operators.graph import hooked
from vestigia.session import checkpoint_folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def worker_state(key: tuple, make: Callable):
    """An object that stays in a worker process for its later tasks, such as a bounded cache. Results must not depend on it."""
    kept = sys.modules.setdefault("_llm_worker_state", types.ModuleType("_llm_worker_state")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def set_apart(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """`docs` with every column c renamed to `_in_c`, and the columns that give `docs` back: operators can then add columns of any
    name."""
    names = [f"_in_{c}" for c in docs.columns]
    return docs.toDF(*names), [F.col(f"`{n}`").alias(c) for n, c in zip(names, docs.columns)]


def let(value: Column, use) -> Column:
    """`use(value)` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(edges: DataFrame) -> DataFrame:
    """`(node, component)` for each node of the undirected edges `(a, b)`: the smallest node reachable.

    Each round takes the smallest label among the neighbours of a node, gives it to the node and to the node that its label
    names, so that whole trees are hung below smaller ones, and then takes the label of the label. Rounds grow with the logarithm of
    a chain's length whatever the order of its ids; the loop ends when no label changes. Every round is stored; joins have plain
    tables on both sides, so a hot node can be split."""
    both = edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct()
    both = stored(both, "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"))
                    .select("node", F.least("node", "b").alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("_m"))
        lower = hooked(labels.join(near, "node"), "node")
        target = labels.select(F.col("node").alias("_new"), F.col("label").alias("_jump"))
        step = stored(lower.join(target, "_new").select("node", "label", F.least("_new", "_jump").alias("_new")), "labels")
        labels = step.select("node", F.col("_new").alias("label"))
        if step.filter("label <> _new").isEmpty():
            return labels.withColumnRenamed("label", "component")
