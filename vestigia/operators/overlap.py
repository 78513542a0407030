"""Search by shared values: for many probes at once, the documents that share a value with them.

Values held by few documents are an inverted list: their pairs of probe and document are listed, at most `heavy` a row. Values held by
more than `heavy` documents are never opened into pairs of documents: documents of equal sets of such values are one class, and only
pairs of classes are built, so a value that a third of all documents hold costs one row a class. Listed pairs carry the values of both
kinds, so no link is lost and none is counted twice.

Rows: null ids and null values take no part; repeated rows count once; a probe without any match has no row; other columns are ignored.
Classes are told apart by two 64-bit sums over the hashes of their values and by their number (documents of unequal sets meet with a
chance below 2^-100 a pair); values are read from the first document of a class, so a document's set is never one array.

Rows and pairs are dealt out before they are counted, into as many parts as their number asks for: that of the pairs is known from the
sizes of the values, so the memory of a task that counts does not grow with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vestigia.operators.common import join_reduced
from vestigia.session import cut_lineage

HEAVY_DOCS = 1_000
ROWS_FOR_TASK = 1_000_000


def dealt(rows: DataFrame, expected: int | None, *keys: str) -> DataFrame:
    """`rows` by `keys`, in parts of about ROWS_FOR_TASK and in no fewer than other shuffles have."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(parts, -(-int(expected or 0) // ROWS_FOR_TASK)), *keys)


def shared_values(items: DataFrame, is_probe: Column, key: str = "doc_id", value: str = "value",
                  heavy: int = HEAVY_DOCS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """`(listed, classes, members)`.

    `listed(probe_id, doc_id, n_shared, in_classes)`: pairs with a value of the inverted list, and whether their classes share one too;
    `classes(probe_class, class, n_shared, n_docs)`: pairs of classes, the class of the probe with itself included;
    `members(doc_id, class, is_probe)`: the class of each document that holds a heavy value."""
    given = items.select(F.col(key).alias("doc_id"), F.col(value).alias("value"), is_probe.alias("is_probe")).filter(
        "doc_id IS NOT NULL AND value IS NOT NULL")
    held = cut_lineage(dealt(given, items.count(), "doc_id", "value").groupBy("doc_id", "value").agg(F.bool_or("is_probe").alias("is_probe")))
    sizes = held.groupBy("value").agg(F.count(F.lit(1)).alias("_n"), F.count_if("is_probe").alias("_p"))
    wanted = cut_lineage(sizes.filter("_p > 0 AND _n > 1").select("value", (F.col("_n") > heavy).alias("heavy"), (F.col("_n") * F.col("_p")).alias("_pairs")))
    n_light = wanted.filter("NOT heavy").agg(F.sum("_pairs")).first()[0]
    split = cut_lineage(join_reduced(held, wanted.drop("_pairs"), "value"))

    many = split.filter("heavy")
    sums = many.groupBy("doc_id").agg(
        F.bit_xor(F.xxhash64("value")).alias("_x"), F.bit_xor(F.xxhash64(F.lit(1), "value")).alias("_y"),
        F.count(F.lit(1)).alias("_k"), F.bool_or("is_probe").alias("is_probe"))
    sums = cut_lineage(sums)
    same = ["_x", "_y", "_k"]
    firsts = sums.groupBy(*same).agg(F.min("doc_id").alias("class"), F.count(F.lit(1)).alias("n_docs"), F.bool_or("is_probe").alias("_p"))
    firsts = cut_lineage(firsts)
    members = cut_lineage(join_reduced(sums, firsts.select(*same, "class"), same).select("doc_id", "class", "is_probe"))
    opened = cut_lineage(many.select("doc_id", "value").join(firsts.select(F.col("class").alias("doc_id"), "n_docs", "_p"), "doc_id"))
    asked = opened.filter("_p").select("value", F.col("doc_id").alias("probe_class"))
    n_classes = opened.groupBy("value").agg((F.count(F.lit(1)) * F.count_if("_p")).alias("_pairs")).agg(F.sum("_pairs")).first()[0]
    met = opened.join(asked, "value").select("probe_class", F.col("doc_id").alias("class"), "n_docs")
    classes = cut_lineage(dealt(met, n_classes, "probe_class", "class").groupBy("probe_class", "class").agg(
        F.count(F.lit(1)).alias("n_shared"), F.max("n_docs").alias("n_docs")))

    # Documents bring their classes along, so that pairs are shuffled once.
    few = split.filter("NOT heavy").join(members.select("doc_id", "class"), "doc_id", "left")
    probes = few.filter("is_probe").select("value", F.col("doc_id").alias("probe_id"), F.col("class").alias("probe_class"))
    pairs = few.join(probes, "value").filter("doc_id <> probe_id").select("probe_id", "doc_id", "probe_class", "class")
    light = dealt(pairs, n_light, "probe_id", "doc_id").groupBy("probe_id", "doc_id").agg(
        F.count(F.lit(1)).alias("_light"), F.max("probe_class").alias("probe_class"), F.max("class").alias("class"))
    listed = (light
              .join(classes.select("probe_class", "class", F.col("n_shared").alias("_heavy")), ["probe_class", "class"], "left")
              .select("probe_id", "doc_id", (F.col("_light") + F.coalesce("_heavy", F.lit(0))).alias("n_shared"),
                      F.col("_heavy").isNotNull().alias("in_classes")))
    return listed, classes, members


def match_counts(listed: DataFrame, classes: DataFrame, members: DataFrame) -> DataFrame:
    """`probe_id, n_matches, most_shared` of each probe with a match: how many documents share a value with it, and the largest number
    of values shared with one of them."""
    alone = (F.col("probe_class") == F.col("class")) & (F.col("n_docs") == 1)
    per_class = classes.groupBy(F.col("probe_class").alias("class")).agg(
        (F.sum("n_docs") - 1).alias("n"), F.max(F.when(~alone, F.col("n_shared"))).alias("most"))
    by_class = join_reduced(members.filter("is_probe"), per_class, "class").select(F.col("doc_id").alias("probe_id"), "n", "most")
    by_pair = listed.groupBy("probe_id").agg(F.count_if(~F.col("in_classes")).alias("n"), F.max("n_shared").alias("most"))
    return by_class.unionByName(by_pair).groupBy("probe_id").agg(
        F.sum("n").alias("n_matches"), F.max("most").alias("most_shared")).filter("n_matches > 0")
