"""Comparison of small document sets (2 to 4 documents each), many sets at once.

A comparison never pairs documents across sets, so a set yields at most six pairs however large the
corpus is. Sets of another size are rejected before their rows are gathered, so a wrong set that holds
millions of rows is never collected into one group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vestigia.operators import ordered
from vestigia.operators.common import first_k, join_reduced
from vestigia.session import cut_lineage

MIN_DOCUMENTS = 2
MAX_DOCUMENTS = 4
TIME_WINDOW_SECONDS = 300
# Severity of each kind of match between two documents of a set.
PAIR_SEVERITIES = {"identical_content": "HIGH", "created_close": "MEDIUM", "same_producer": "INFO", "shared_ids": "HIGH"}


def set_sizes(members: DataFrame, set_col: str = "comparison_id") -> DataFrame:
    sizes = members.groupBy(set_col).agg(F.count(F.lit(1)).alias("n_documents"))
    return sizes.withColumn(
        "error",
        F.when(F.col("n_documents") < MIN_DOCUMENTS, "at least 2 documents needed")
        .when(F.col("n_documents") > MAX_DOCUMENTS, "at most 4 documents allowed"),
    )


def valid_members(members: DataFrame, set_col: str = "comparison_id") -> DataFrame:
    valid = set_sizes(members, set_col).filter("error IS NULL").select(set_col)
    return join_reduced(members, valid, set_col, "left_semi")


def gathered(members: DataFrame, fields: list[str], set_col: str = "comparison_id", key: str = "doc_id") -> DataFrame:
    """One row per valid set with its documents as an array in key order."""
    record = F.struct(key, *fields)
    return valid_members(members.select(set_col, key, *fields), set_col).groupBy(set_col).agg(
        F.array_sort(F.collect_list(record)).alias("docs")
    )


def pairs_of(items: Column) -> Column:
    """All ordered pairs (a before b) of a short array."""
    positions = F.sequence(F.lit(1), F.size(items))
    pair = F.transform(
        positions,
        lambda i: F.transform(
            F.filter(positions, lambda j: j > i),
            lambda j: F.struct(F.element_at(items, i).alias("a"), F.element_at(items, j).alias("b")),
        ),
    )
    return F.flatten(pair)


def pairs(members: DataFrame, fields: list[str], set_col: str = "comparison_id", key: str = "doc_id") -> DataFrame:
    sets = gathered(members, fields, set_col, key)
    return sets.select(set_col, F.explode(pairs_of(F.col("docs"))).alias("p")).select(set_col, "p.a", "p.b")


def identical_pairs(members: DataFrame, digest: str = "sha256", key: str = "doc_id") -> DataFrame:
    equal = pairs(members, [digest], key=key).filter(F.col(f"a.{digest}") == F.col(f"b.{digest}"))
    return equal.select("comparison_id", F.col(f"a.{key}").alias("doc_a"), F.col(f"b.{key}").alias("doc_b"),
                        F.col(f"a.{digest}").alias(digest))


def time_proximity_pairs(members: DataFrame, ts: str, key: str = "doc_id",
                         window_seconds: int = TIME_WINDOW_SECONDS) -> DataFrame:
    """Pairs created strictly less than the window apart."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    timed = members.filter(F.col(ts).isNotNull()).withColumn("_us", micros)
    delta = F.abs(F.col("a._us") - F.col("b._us"))
    near = pairs(timed, ["_us"], key=key).withColumn("delta_us", delta)
    return near.filter(F.col("delta_us") < window_seconds * 1_000_000).select(
        "comparison_id", F.col(f"a.{key}").alias("doc_a"), F.col(f"b.{key}").alias("doc_b"), "delta_us"
    )


def time_proximity_groups(items: DataFrame, ts: str, key: str = "doc_id",
                          window_seconds: int = TIME_WINDOW_SECONDS) -> DataFrame:
    """`key, ts_us, class_id, n_links` over the whole corpus: the number of other items strictly less than the window apart, and the
    smallest id that chains of such links reach. No pair is built: items are reduced to their times, every time lays a mark one window
    before and after itself, and the running count over times and marks, in chunks of the order, gives the items between the marks.
    A class begins where a time has no earlier one within the window.

    Rows: a null time has no row; a null id counts as an item but is no class id; equal rows are items of their own."""
    span = window_seconds * 1_000_000
    timed = items.select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("ts_us")).filter("ts_us IS NOT NULL")
    times = cut_lineage(timed.groupBy("ts_us").agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias("_first")))
    # At equal places the upper mark of one time stands before the items and the lower mark of another behind them.
    mark = lambda at, k, w: F.struct(at.alias("_at"), F.lit(k).alias("_side"), w.cast("long").alias("_w"))
    us = F.col("ts_us")
    marks = times.select("ts_us", F.inline(F.array(mark(us + span, 0, F.lit(0)), mark(us, 1, F.col("_n")), mark(us - span, 2, F.lit(0)))))
    place = [F.col("_at"), F.col("_side")]
    swept = ordered.running_sum(ordered.with_range_chunk(marks, [], place), [], place, "_w", "_upto")
    side = lambda k: F.max(F.when(F.col("_side") == k, F.col("_upto")))
    counted = swept.groupBy("ts_us").agg(
        (side(0) - side(2) - 1).alias("n_links"), (side(1) - F.max("_w") == side(2)).cast("long").alias("_start"), F.max("_w").alias("_n"))
    by_time = [F.col("ts_us")]
    numbered = cut_lineage(ordered.running_sum(
        ordered.with_range_chunk(counted, [], by_time), [], by_time, "_start", "_class").drop(ordered.CHUNK))
    first = numbered.join(times.select("ts_us", "_first"), "ts_us")
    classes = first.groupBy("_class").agg(F.min("_first").alias("class_id"))
    placed = join_reduced(numbered, classes, "_class").select("ts_us", "class_id", "n_links")
    return join_reduced(timed, placed, "ts_us").select(key, "ts_us", "class_id", "n_links")


def equal_value_pairs(members: DataFrame, column: str, out: str, key: str = "doc_id") -> DataFrame:
    """Pairs with the same non-empty value."""
    same = pairs(members, [column], key=key).filter(
        (F.col(f"a.{column}") == F.col(f"b.{column}")) & (F.col(f"a.{column}") != "")
    )
    return same.select("comparison_id", F.col(f"a.{key}").alias("doc_a"), F.col(f"b.{key}").alias("doc_b"),
                       F.col(f"a.{column}").alias(out))


def pair_findings(found: dict[str, DataFrame]) -> DataFrame:
    """Findings `(comparison_id, doc_a, doc_b, code, severity)` from the pairs of each kind."""
    parts = [df.select("comparison_id", "doc_a", "doc_b", F.lit(code).alias("code"), F.lit(PAIR_SEVERITIES[code]).alias("severity"))
             for code, df in found.items()]
    return reduce(DataFrame.unionByName, parts)


def shared_id_pairs(members: DataFrame, ids: DataFrame, show: int = 5, key: str = "doc_id",
                    id_col: str = "id") -> DataFrame:
    """Pairs of a set that share embedded ids: how many, and the first few. Ids are grouped per set, so
    an id that occurs in every document of the corpus still meets only four documents at a time."""
    owned = valid_members(members.select("comparison_id", key)).join(ids.select(key, id_col).distinct(), key)
    holders = owned.groupBy("comparison_id", id_col).agg(F.array_sort(F.collect_list(key)).alias("docs"))
    matched = holders.filter(F.size("docs") > 1).select(
        "comparison_id", id_col, F.explode(pairs_of(F.col("docs"))).alias("p")
    ).select("comparison_id", F.col("p.a").alias("doc_a"), F.col("p.b").alias("doc_b"), id_col)
    keys = ["comparison_id", "doc_a", "doc_b"]
    counts = matched.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_shared"))
    return counts.join(first_k(matched, keys, [F.col(id_col)], id_col, show, "shared"), keys)


def common_categories(members: DataFrame, findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """Categories present in every document of a set; documents without findings count as having none."""
    valid = valid_members(members.select("comparison_id", key))
    sizes = valid.groupBy("comparison_id").agg(F.count(F.lit(1)).alias("n_documents"))
    seen = findings.select(key, "category").distinct()
    per_set = valid.join(seen, key).groupBy("comparison_id", "category").agg(F.count(F.lit(1)).alias("n"))
    return per_set.join(sizes, "comparison_id").filter("n = n_documents").select("comparison_id", "category")


def metadata_diff(members: DataFrame, fields: list[str], key: str = "doc_id") -> DataFrame:
    """Fields with more than one filled and more than one distinct value in a set."""
    long = members.select("comparison_id", key, F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields
    ])).alias("x")).select("comparison_id", key, "x.field", "x.value")
    valid = set_sizes(members).filter("error IS NULL").select("comparison_id")
    filled = long.filter(F.coalesce(F.col("value"), F.lit("")) != "").join(valid.hint("rebalance"), "comparison_id", "left_semi")
    grouped = filled.groupBy("comparison_id", "field").agg(
        F.array_sort(F.collect_list(F.struct(key, "value"))).alias("entries")
    )
    differing = grouped.filter(
        (F.size("entries") > 1) & (F.size(F.array_distinct(F.transform("entries", lambda e: e["value"]))) > 1)
    )
    shown = F.transform("entries", lambda e: F.concat_ws("=", e[key].cast("string"), e["value"]))
    return differing.select("comparison_id", "field", F.array_join(shown, "; ").alias("entries"))


def partial_presence(members: DataFrame, flag: str, revisions: str, key: str = "doc_id") -> DataFrame:
    """Flag in some but not all documents; documents with several revisions."""
    sets = valid_members(members.select("comparison_id", key, flag, revisions)).groupBy("comparison_id").agg(
        F.count(F.lit(1)).alias("n_documents"), F.count_if(F.col(flag)).alias("n_flagged"),
        F.count_if(F.col(revisions) > 1).alias("n_multi_revision"),
    )
    return sets.withColumns({
        "flag_severity": F.when((F.col("n_flagged") > 0) & (F.col("n_flagged") < F.col("n_documents")), "HIGH"),
        "revision_severity": F.when(F.col("n_multi_revision") > 0, "MEDIUM"),
    })


def attribute_matrix(members: DataFrame, attributes: list[str], key: str = "doc_id") -> DataFrame:
    """Attribute rows against document columns: doc_1 … doc_4 in key order."""
    texts = members.select("comparison_id", key, *[F.col(a).cast("string").alias(a) for a in attributes])
    sets = gathered(texts, attributes)
    rows = F.array(*[
        F.struct(
            F.lit(a).alias("attribute"),
            *[F.get(F.col("docs"), F.lit(i))[a].alias(f"doc_{i + 1}") for i in range(MAX_DOCUMENTS)],
        )
        for a in attributes
    ])
    return sets.select("comparison_id", F.explode(rows).alias("r")).select("comparison_id", "r.*")
