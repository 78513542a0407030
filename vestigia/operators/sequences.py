"""Ordered operators: segments, ranges, timelines, gaps, tops per group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vestigia.functions.numbers import label_text
from vestigia.operators import ordered
from vestigia.operators.common import join_reduced
from vestigia.operators.structure import SMALL_REVISION, TRAILING_BYTES
from vestigia.session import cut_lineage


def first_occurrence(df: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    """First position of each value. A minimum, not a window: partial aggregation removes repeats early."""
    return df.groupBy(*keys).agg(F.min(pos).alias(pos))


def revision_segments(df: DataFrame, text: str, marker: str, key: str = "doc_id") -> DataFrame:
    """Segments that end with the marker: number, start, end, size. Positions are summed within one
    document's text, which was one row to begin with."""
    pieces = df.select(key, F.posexplode(F.split(F.col(text), f"\\Q{marker}\\E", -1)).alias("i", "piece"),
                       F.size(F.split(F.col(text), f"\\Q{marker}\\E", -1)).alias("n"))
    ended = pieces.filter(F.col("i") < F.col("n") - 1).select(
        key, (F.col("i") + 1).alias("revision"), (F.length("piece") + len(marker)).cast("long").alias("size"))
    end = F.sum("size").over(W.partitionBy(key).orderBy("revision").rowsBetween(W.unboundedPreceding, 0))
    return ended.withColumn("end", end).select(key, "revision", (F.col("end") - F.col("size")).alias("start"), "end", "size")


def revision_summary(df: DataFrame, text: str, marker: str, key: str = "doc_id") -> DataFrame:
    """Number of revisions, size of the last one and the rest behind it, straight from each row."""
    parts = F.split(F.col(text), f"\\Q{marker}\\E", -1)
    n = F.size("_parts") - 1
    last = F.when(n > 0, F.length(F.element_at("_parts", -2)) + len(marker))
    rest = F.when(n > 0, F.length(F.element_at("_parts", -1))).otherwise(F.lit(0))
    counted = df.withColumn("_parts", parts).select(
        key, n.cast("long").alias("revisions"), last.cast("long").alias("last_size"), rest.cast("long").alias("trailing_size"))
    return counted.withColumns({
        "several": F.when(F.col("revisions") > 1, "HIGH"),
        "small_last": F.when((F.col("revisions") > 1) & (F.col("last_size") < SMALL_REVISION), "MEDIUM"),
        "trailing_severity": F.when(F.col("trailing_size") > TRAILING_BYTES, "MEDIUM"),
    })


def label_spans(ranges: DataFrame, pages: DataFrame) -> DataFrame:
    """Each label range with its end: the next start, or the page count for the last one. Ranges of one start follow each other
    by their other columns."""
    order = [F.col("start"), *[F.col(c) for c in ranges.columns if c not in ("doc_id", "start")]]
    chunked = ordered.with_range_chunk(ranges, ["doc_id"], order)
    ended = ordered.following(chunked, ["doc_id"], order, "start", "_next").drop(ordered.CHUNK)
    return ended.join(pages, "doc_id").withColumn("end", F.coalesce("_next", "page_count")).drop("_next")


PAGE_BLOCK = 10_000


def page_labels(spans: DataFrame) -> DataFrame:
    """The label of every page that a range covers. Ranges are opened in blocks, so a range declared over very many pages is
    never one array."""
    covered = spans.filter(F.col("end") > F.col("start"))
    blocks = covered.withColumn("_from", F.explode(F.sequence(F.col("start"), F.col("end") - 1, F.lit(PAGE_BLOCK))))
    pages = blocks.withColumn("page", F.explode(F.sequence("_from", F.least(F.col("_from") + PAGE_BLOCK, F.col("end")) - 1))).drop("_from")
    number = F.col("first") + F.col("page") - F.col("start")
    return pages.select("doc_id", "page", label_text(F.col("style"), F.col("prefix"), number).alias("label"))


def label_checks(spans: DataFrame) -> DataFrame:
    """Declared against actual page count and the range rules, without expanding the labels."""
    length = F.greatest(F.lit(0), F.col("end") - F.col("start"))
    per_doc = spans.groupBy("doc_id").agg(
        F.first("page_count").alias("page_count"), F.sum(length).alias("declared"), F.count(F.lit(1)).alias("n_ranges"),
        F.bool_or(F.col("start") >= F.col("page_count")).alias("range_past_end"),
        F.min_by("first", "start").alias("_first"))
    return per_doc.select(
        "doc_id", "page_count", "declared", "n_ranges",
        F.when(F.col("declared") != F.col("page_count"), "HIGH").alias("count_severity"),
        F.when(F.col("range_past_end"), "HIGH").alias("past_end_severity"),
        F.when(F.col("n_ranges") > F.col("page_count"), "HIGH").alias("too_many_severity"),
        F.when(F.col("_first") != 1, "LOW").alias("first_severity"))


def duplicate_to_earliest(parts: DataFrame, keys: Sequence[str], pos: str, digest: str) -> DataFrame:
    """Every repeated part with the earliest equal one. The earliest positions are aggregated first, so a
    digest that fills a document meets one row."""
    first = parts.groupBy(*keys, digest).agg(F.min(pos).alias("first_pos"), F.count(F.lit(1)).alias("_n"))
    return join_reduced(parts, first.filter("_n > 1"), [*keys, digest]).filter(F.col(pos) > F.col("first_pos")).drop("_n")


def united(sources: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, sources)


def timeline(sources: Sequence[DataFrame], keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Union of dated events with their place per document; unknown times come first. Chunks are ranges of document and time, so a
    document with very many events, in one minute too, is numbered in parallel."""
    order = [F.col("ts").asc_nulls_first(), F.col("source"), F.col("detail")]
    chunked = ordered.with_range_chunk(united(sources), list(keys), order)
    return ordered.row_numbers(chunked, list(keys), order, "place").drop(ordered.CHUNK)


def block_outliers(df: DataFrame, key: str, block: str, value: str) -> DataFrame:
    """Hot blocks per document: mean above 2.5 times the overall mean and above 15. Means are exact: sums run over whole
    millionths, and the quotient is rounded once, to four decimals."""
    units = F.round(F.col(value) * 1_000_000).cast("decimal(20,0)")
    blocks = df.groupBy(key, block).agg(F.sum(units).alias("_s"), F.count(value).alias("_n"),
                                        F.sum(F.col(value) * F.col(value)).alias("_q"))

    def mean(total: str, n: str) -> Column:
        return F.expr(f"(2 * {total} + 100 * {n}) div (200 * {n})") / 10_000

    total = blocks.groupBy(key).agg(F.sum("_s").alias("_ts"), F.sum("_n").alias("_tn"), F.sum("_q").alias("_tq"))
    joined = join_reduced(blocks, total, key)
    exact = F.col("_ts").cast("double") / F.col("_tn") / 1_000_000
    hot = F.expr("2 * _s * _tn > 5 * _ts * _n AND _s > 15000000 * _n")
    return joined.select(
        key, block, mean("_s", "_n").alias("block_mean"), mean("_ts", "_tn").alias("overall_mean"),
        F.sqrt(F.greatest(F.lit(0.0), F.col("_tq") / F.col("_tn") - F.pow(exact, 2))).alias("overall_std"), hot.alias("hot"))


def outlier_verdict(blocks: DataFrame, key: str) -> DataFrame:
    per_doc = blocks.groupBy(key).agg(
        F.first("overall_mean").alias("overall_mean"), F.first("overall_std").alias("overall_std"),
        F.count(F.lit(1)).alias("n_blocks"), F.count_if("hot").alias("hot_blocks"))
    share = F.col("hot_blocks") / F.col("n_blocks") * 100
    verdict = F.when((F.col("overall_mean") > 20) | (share > 15), "SUSPICIOUS").when(
        (F.col("overall_mean") < 2) & (F.col("overall_std") < 1), "LOW_SIGNAL").otherwise("NORMAL")
    return per_doc.select(key, F.round("overall_mean", 4).alias("overall_mean"), "n_blocks", "hot_blocks",
                          F.round(share, 4).alias("hot_share"), verdict.alias("verdict"))


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "place") -> DataFrame:
    """The first k rows per group; the limit is applied in every task before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).filter(F.col(out) <= k)


GRID_TOLERANCE = 8
GRID_MIN_POINTS = 6


def regular_spacing(df: DataFrame, key: str, position: str, tie: str, points: int | None = None) -> DataFrame:
    """Even spacing of all points, or of the first `points`: gaps above 2, the upper median, at least half within ±8. Gaps are
    taken inside chunks of key and position and carried over their borders, and the median is found by counting, so a key with
    very many points is read in parallel."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_points")).filter(F.col("n_points") >= GRID_MIN_POINTS)
    used = df.select(key, F.col(position).cast("double").alias("_p"), tie)
    if points is not None:
        used = top_per_group(used, [key], [F.col("_p"), F.col(tie)], points, "_i").drop("_i")
    order = [F.col("_p"), F.col(tie)]
    chunked = ordered.with_range_chunk(used, [key], order)
    gaps = cut_lineage(ordered.previous(chunked, [key], order, "_p", "_before").select(
        key, (F.col("_p") - F.col("_before")).alias("_gap")).filter("_gap > 2"))
    medians = ordered.upper_median(gaps, key, "_gap")
    near = join_reduced(gaps, medians, key).groupBy(key).agg(
        F.max("median").alias("median"), F.avg((F.abs(F.col("_gap") - F.col("median")) <= GRID_TOLERANCE).cast("int")).alias("share"))
    return near.filter("median >= 2 AND share >= 0.5").join(n, key).select(key, "n_points", F.round("median", 1).alias("spacing"))


def neighbour_noise(df: DataFrame, key: str, ts: str, tie: str, value: str) -> DataFrame:
    """Spread of the differences between neighbours in time; ranges of key and time are the chunks of the order."""
    order = [F.col(ts), F.col(tie)]
    chunked = ordered.with_range_chunk(df.select(key, ts, tie, value), [key], order)
    pairs = ordered.previous(chunked, [key], order, value, "_before")
    return pairs.groupBy(key).agg(
        F.round(F.stddev_pop(F.col(value) - F.col("_before")), 6).alias("noise"), F.count("_before").alias("n_pairs"))


def last_n_then_filter(df: DataFrame, key: str, seq: str, n: int, keep: Column) -> DataFrame:
    """The last n entries of each conversation, filtered afterwards, in order."""
    return top_per_group(df, [key], [F.col(seq).desc()], n, "_r").filter(keep).drop("_r")


def audit_log(items: DataFrame, steps: Sequence[str], key: str, intact: str) -> DataFrame:
    """Start row, one numbered row per step, end row with the integrity flag."""
    rows = [F.struct(F.lit(0).alias("seq"), F.lit("analysis_start").alias("action"), F.lit(None).cast("string").alias("detail"))]
    rows += [F.struct(F.lit(i).alias("seq"), F.lit(f"analyzer_{i:02d}").alias("action"), F.lit(s).alias("detail"))
             for i, s in enumerate(steps, 1)]
    rows.append(F.struct(F.lit(len(steps) + 1).alias("seq"), F.lit("analysis_complete").alias("action"),
                         F.lit(str(len(steps))).alias("detail")))
    logged = items.select(key, intact, F.explode(F.array(*rows)).alias("r"))
    return logged.select(key, "r.*", F.when(F.col("r.action") == "analysis_complete", F.col(intact)).alias("evidence_intact"))
