"""Checks on the objects, index entries, layers, ranges and revisions of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vestigia.operators.common import first_k, join_reduced

# Thresholds.
MANY_UNINDEXED = 5
FULL_COVER_SUFFIX = 5
RANGE_END_SLACK = 10
BYTES_AFTER_RANGE = 100
MAX_RANGE_DEFINITIONS = 2
MANY_LAYERS = 10
MANY_CHANGES = 20
MANY_REVISIONS = 5
SMALL_REVISION = 1024
TRAILING_BYTES = 20
A4 = (595.28, 841.89)
A4_TOLERANCE = 5.0


def orphan_objects(content: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """Objects found in the content that the active index does not list."""
    return join_reduced(content, index.select(*keys).distinct(), keys, "left_anti")


def unindexed_refs(objects: DataFrame, in_use: DataFrame, free: DataFrame) -> DataFrame:
    """Per document: objects (except 0) in neither list. Both lists are reduced to distinct keys first."""
    keys = ["doc_id", "obj_no"]
    listed = in_use.select(*keys).unionByName(free.select(*keys)).distinct()
    missing = objects.select(*keys).distinct().filter("obj_no <> 0").join(listed, keys, "left_anti")
    counts = missing.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_unindexed"))
    return counts.withColumn("severity", F.when(F.col("n_unindexed") > MANY_UNINDEXED, "MEDIUM"))


def offset_consistency(entries: DataFrame, starts: DataFrame, sizes: DataFrame) -> DataFrame:
    """Index entries that point beyond the file or to a place where no object starts."""
    found = starts.select("doc_id", "offset").distinct().withColumn("_start", F.lit(True))
    sized = entries.join(sizes.select("doc_id", "file_size"), "doc_id")
    # Free entries (offset 0) have no start to be found, and would all meet in one place.
    placed = join_reduced(sized.filter("offset > 0"), found, ["doc_id", "offset"], "left")
    checked = placed.unionByName(sized.filter("offset <= 0"), allowMissingColumns=True)
    error = F.when(F.col("offset") > F.col("file_size"), "beyond_end").when(
        (F.col("offset") > 0) & F.col("_start").isNull(), "no_object_start")
    return checked.withColumn("error", error).filter("error IS NOT NULL").drop("_start")


def revision_changes(index: DataFrame) -> DataFrame:
    """Change rows between consecutive revisions.

    `index(doc_id, revision, obj_no, rewritten)` lists the objects of each revision; `rewritten` marks
    those written anew in it. One pass over (doc_id, obj_no): a gap before an entry means added, a gap
    after it means removed."""
    last = index.groupBy("doc_id").agg(F.min("revision").alias("_first"), F.max("revision").alias("_last"))
    w = W.partitionBy("doc_id", "obj_no").orderBy("revision")
    seen = index.withColumns({"_prev": F.lag("revision").over(w), "_next": F.lead("revision").over(w)})
    joined = join_reduced(seen, last, "doc_id")
    present_before = F.col("_prev") == F.col("revision") - 1
    events = F.array(
        F.when((F.col("revision") > F.col("_first")) & ~F.coalesce(present_before, F.lit(False)),
               F.struct(F.col("revision").alias("at"), F.lit("added").alias("change"))),
        F.when(F.coalesce(present_before, F.lit(False)) & F.col("rewritten"),
               F.struct(F.col("revision").alias("at"), F.lit("modified").alias("change"))),
        F.when((F.col("revision") < F.col("_last")) & ~F.coalesce(F.col("_next") == F.col("revision") + 1, F.lit(False)),
               F.struct((F.col("revision") + 1).alias("at"), F.lit("removed").alias("change"))),
    )
    return joined.select("doc_id", "obj_no", F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e")).select(
        "doc_id", F.col("e.at").alias("revision"), "obj_no", "e.change")


def revision_diff(index: DataFrame, show: int = 20) -> DataFrame:
    """Counts, the first objects of each kind and a summary per revision."""
    changes = revision_changes(index)
    keys = ["doc_id", "revision"]
    kinds = ["added", "modified", "removed"]
    counts = changes.groupBy(*keys).agg(*[F.count_if(F.col("change") == k).alias(f"n_{k}") for k in kinds])
    lists = first_k(changes, [*keys, "change"], [F.col("obj_no")], "obj_no", show, "objs")
    wide = lists.groupBy(*keys).agg(*[
        F.max(F.when(F.col("change") == k, F.array_join("objs", ","))).alias(f"{k}_objects") for k in kinds])
    parts = [F.when(F.col(f"n_{k}") > 0, F.concat_ws(" ", F.col(f"n_{k}").cast("string"), F.lit(k))) for k in kinds]
    summary = F.coalesce(F.nullif(F.concat_ws(", ", *parts), F.lit("")), F.lit("no changes"))
    return counts.join(wide, keys, "left").withColumns({
        "summary": summary,
        "severity": F.when(F.col("n_added") + F.col("n_modified") > MANY_CHANGES, "MEDIUM"),
    })


def revision_findings(index: DataFrame, types: Column) -> DataFrame:
    """Changed catalogue, info or metadata objects, and documents with many revisions."""
    touched = revision_changes(index).filter("change = 'modified'").withColumn("type", types)
    core = touched.filter(F.col("type").isin("Catalog", "Info", "Metadata")).select(
        "doc_id", "revision", "obj_no", F.lit("HIGH").alias("severity"))
    many = index.groupBy("doc_id").agg(F.countDistinct("revision").alias("n")).filter(F.col("n") > MANY_REVISIONS)
    return core.unionByName(many.select("doc_id", F.lit("MEDIUM").alias("severity")), allowMissingColumns=True)


def layer_state(layers: DataFrame, locked: DataFrame, hidden: DataFrame, usage: DataFrame) -> DataFrame:
    """One row per layer: locked, hidden, number of pages that use it and the first and last of them."""
    keys = ["doc_id", "layer"]
    pages = usage.select(*keys, "page").distinct().groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_pages"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))
    def flag(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys).distinct().withColumn(name, F.lit(True))
    joined = layers.select(*keys).distinct().join(flag(locked, "locked"), keys, "left").join(
        flag(hidden, "hidden"), keys, "left").join(pages, keys, "left")
    return joined.select(*keys, F.coalesce("locked", F.lit(False)).alias("locked"),
                         F.coalesce("hidden", F.lit(False)).alias("hidden"),
                         F.coalesce("n_pages", F.lit(0)).alias("n_pages"), "first_page", "last_page")


def layer_findings(state: DataFrame) -> DataFrame:
    per_doc = state.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_layers"), F.count_if("hidden").alias("n_hidden"))
    return per_doc.withColumns({
        "hidden_severity": F.when(F.col("n_hidden") > 0, "HIGH"),
        "many_severity": F.when(F.col("n_layers") > MANY_LAYERS, "MEDIUM"),
    })


def interval_coverage(ranges: DataFrame) -> DataFrame:
    """Signed range (o1, l1, o2, l2) against the file size."""
    end = F.col("o2") + F.col("l2")
    return ranges.withColumns({
        "prefix_bytes": F.col("o1"), "suffix_bytes": F.col("file_size") - end, "range_end": end,
    }).withColumn(
        "covers_full", (F.col("prefix_bytes") == 0) & (F.col("suffix_bytes") <= FULL_COVER_SUFFIX)
    ).withColumn("severity", F.when(~F.col("covers_full"), "HIGH"))


def objects_after_range(ranges: DataFrame, objects: DataFrame) -> DataFrame:
    """Objects or index markers behind the end of a signed range.

    Only the last position matters for the test, so the objects of a document are reduced to two maxima
    and joined on the document alone: no range join, however many objects a document has."""
    last = objects.groupBy("doc_id").agg(
        F.max(F.when(~F.col("is_index"), F.col("offset"))).alias("_last_object"),
        F.max(F.when(F.col("is_index"), F.col("offset"))).alias("_last_index"))
    joined = ranges.join(last, "doc_id", "left")
    open_end = F.col("range_end") < F.col("file_size") - RANGE_END_SLACK
    obj = open_end & F.coalesce(F.col("_last_object") >= F.col("range_end"), F.lit(False))
    idx = open_end & F.coalesce(F.col("_last_index") >= F.col("range_end"), F.lit(False))
    after = F.when(open_end, F.col("file_size") - F.col("range_end")).otherwise(F.lit(0))
    return joined.withColumns({
        "has_object_after": obj, "has_index_after": idx, "bytes_after": after,
    }).withColumn(
        "severity",
        F.when(F.col("has_object_after") | F.col("has_index_after"), "HIGH")
        .when(F.col("bytes_after") > BYTES_AFTER_RANGE, "MEDIUM"),
    ).drop("_last_object", "_last_index")


def range_definitions(ranges: DataFrame) -> DataFrame:
    counts = ranges.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_ranges"))
    return counts.withColumn("severity", F.when(F.col("n_ranges") > MAX_RANGE_DEFINITIONS, "HIGH"))


def duplicate_numbers(objects: DataFrame) -> DataFrame:
    return objects.groupBy("doc_id", "obj_no").agg(F.count(F.lit(1)).alias("occurrences")).filter("occurrences > 1")


def duplicate_offsets(entries: DataFrame) -> DataFrame:
    """Entries whose non-zero offset is shared by several objects, one row each, with the group size."""
    keys = ["doc_id", "offset"]
    once = entries.filter("offset <> 0").select(*keys, "obj_no").distinct()
    shared = once.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_objects")).filter("n_objects > 1")
    return join_reduced(once, shared, keys)


def required_member(free: DataFrame) -> DataFrame:
    per_doc = free.groupBy("doc_id").agg(
        F.countDistinct("obj_no").alias("chain_length"), F.bool_or(F.col("obj_no") == 0).alias("has_zero"))
    return per_doc.withColumn("severity", F.when(~F.col("has_zero"), "MEDIUM"))


def type_distribution(objects: DataFrame) -> DataFrame:
    """Objects per type: counted first, then put side by side."""
    counts = objects.groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n"))
    entry = F.concat_ws("=", "type", F.col("n").cast("string"))
    return counts.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(entry)), ",").alias("types"))


def size_profile(pages: DataFrame, shown: int = 20) -> DataFrame:
    """Distinct page sizes to one decimal, their number and the first few; more than one is a LOW finding."""
    size = F.format_string("%.1fx%.1f", F.abs(F.col("width").cast("double")), F.abs(F.col("height").cast("double")))
    distinct = pages.select("doc_id", size.alias("size")).distinct()
    counts = distinct.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sizes"))
    profile = counts.join(first_k(distinct, ["doc_id"], [F.col("size")], "size", shown, "_sizes"), "doc_id")
    mixed = F.col("n_sizes") > 1
    return profile.select("doc_id", F.array_join("_sizes", ", ").alias("sizes"), "n_sizes", mixed.alias("mixed"), F.when(mixed, "LOW").alias("severity"))


def is_a4(width: Column, height: Column) -> Column:
    def near(a: Column, target: float) -> Column:
        return F.abs(a - F.lit(target)) < A4_TOLERANCE
    return (near(width, A4[0]) & near(height, A4[1])) | (near(width, A4[1]) & near(height, A4[0]))


def orientation(width: Column, height: Column) -> Column:
    return F.when(width < height, "portrait").when(width > height, "landscape").otherwise("square")


def structure_counts(facts: DataFrame, parts: list[str]) -> DataFrame:
    """Part counts in long form without zeros; a document with nothing at all still shows one page."""
    core = [F.coalesce(F.col(p), F.lit(0)) for p in parts[:4]]
    empty = sum(core[1:], core[0]) == 0
    fixed = facts.withColumn(parts[0], F.when(empty, F.lit(1).cast("long")).otherwise(F.col(parts[0])))
    rows = F.array(*[F.struct(F.lit(p).alias("part"), F.col(p).cast("long").alias("n")) for p in parts])
    return fixed.select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.part", "r.n").filter("n > 0")


def stream_totals(containers: DataFrame) -> DataFrame:
    return containers.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("n_objects").alias("n_contained"))
