"""Chunked windows equal plain windows, also when one key holds a third of the rows."""

import datetime
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vestigia.operators import compare, ordered, sequences


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(3)
    data = [(0 if i % 3 == 0 else rnd.randint(1, 40), rnd.randint(0, 5000), i, float(rnd.randint(-9, 9))) for i in range(3000)]
    return spark.createDataFrame(data, "k int, pos int, id int, v double")


ORDER = ["pos", "id"]


def same(a, b, columns):
    return sorted(a.select(*columns).collect()) == sorted(b.select(*columns).collect())


def test_row_numbers(rows):
    got = ordered.row_numbers(ordered.with_block_chunk(rows, "pos", 100), ["k"], ORDER, "x")
    want = rows.withColumn("x", F.row_number().over(W.partitionBy("k").orderBy(*ORDER)).cast("long"))
    assert same(got, want, ["id", "x"])


def test_running_sum(rows):
    got = ordered.running_sum(ordered.with_block_chunk(rows, "pos", 100), ["k"], ORDER, "v", "x")
    w = W.partitionBy("k").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, 0)
    assert same(got, rows.withColumn("x", F.sum("v").over(w)), ["id", "x"])


@pytest.mark.parametrize("name,fn", [("previous", F.lag), ("following", F.lead)])
def test_neighbours(rows, name, fn):
    got = getattr(ordered, name)(ordered.with_block_chunk(rows, "pos", 100), ["k"], ORDER, "v", "x")
    want = rows.withColumn("x", fn("v").over(W.partitionBy("k").orderBy(*ORDER)))
    key = lambda df: sorted((r.id, str(r.x)) for r in df.select("id", "x").collect())
    assert key(got) == key(want)


@pytest.fixture(scope="module")
def burst(spark):
    """One actor whose rows all fall into one minute, a null actor, null values and repeated rows."""
    rnd = random.Random(5)
    start = datetime.datetime(2024, 3, 1)
    data = [(7, start + datetime.timedelta(milliseconds=rnd.randint(0, 59_999)), i, None if i % 11 == 0 else float(rnd.randint(-9, 9)))
            for i in range(4000)]
    data += [(None if i % 9 == 0 else i % 5, start + datetime.timedelta(hours=rnd.randint(0, 900)), 4000 + i, float(i % 7)) for i in range(500)]
    return spark.createDataFrame(data, "k int, ts timestamp, id int, v double")


def test_a_burst_is_spread_over_all_chunks(burst):
    order = [F.col("ts"), F.col("id")]
    chunked = ordered.with_range_chunk(burst, ["k"], order, 8)
    sizes = sorted(r["count"] for r in chunked.groupBy(ordered.CHUNK).count().collect())
    assert len(sizes) == 8 and sizes[-1] < 4500 / 8 * 2
    for name, fn in (("previous", F.lag), ("following", F.lead)):
        got = getattr(ordered, name)(chunked, ["k"], order, "v", "x")
        want = burst.withColumn("x", fn("v").over(W.partitionBy("k").orderBy("ts", "id")))
        key = lambda df: sorted((r.id, str(r.x)) for r in df.select("id", "x").collect())
        assert key(got) == key(want)
    got = ordered.running_sum(chunked, ["k"], order, "v", "x")
    want = burst.withColumn("x", F.coalesce(F.sum("v").over(W.partitionBy("k").orderBy("ts", "id")), F.lit(0.0)))
    assert same(got, want, ["id", "x"])


def test_upper_median_counts(burst):
    got = {r.k: r.m for r in ordered.upper_median(burst, "k", "v", "m").collect()}
    values: dict = {}
    for r in burst.filter("v IS NOT NULL").collect():
        values.setdefault(r.k, []).append(r.v)
    assert got == {k: sorted(v)[len(v) // 2] for k, v in values.items()}
    assert ordered.upper_median(burst.limit(0), "k", "v").collect() == []


def test_timeline_and_noise_of_a_burst(burst):
    dated = burst.selectExpr("k AS doc_id", "'event' AS source", "CAST(id AS STRING) AS detail", "CASE WHEN id % 3 > 0 THEN ts END AS ts")
    got = sequences.timeline([dated]).select("detail", "place").collect()
    w = W.partitionBy("doc_id").orderBy(F.col("ts").asc_nulls_first(), "source", "detail")
    assert sorted(got) == sorted(dated.select("detail", F.row_number().over(w).cast("long").alias("place")).collect())
    noise = sequences.neighbour_noise(burst, "k", "ts", "id", "v").collect()
    pairs = burst.withColumn("b", F.lag("v").over(W.partitionBy("k").orderBy("ts", "id")))
    want = pairs.groupBy("k").agg(F.round(F.stddev_pop(F.col("v") - F.col("b")), 6), F.count("b")).collect()
    assert sorted(map(str, map(tuple, noise))) == sorted(map(str, map(tuple, want)))


def test_label_spans_of_one_document(spark):
    rows = [(1, 3 * i, i) for i in range(400)] + [(2, 0, 1), (None, 5, 1)]
    ranges = spark.createDataFrame(rows, "doc_id int, start long, first long")
    pages = spark.createDataFrame([(1, 1300), (2, 9)], "doc_id int, page_count long")
    got = sorted((r.doc_id, r.start, r.end) for r in sequences.label_spans(ranges, pages).collect())
    assert got == [(1, 3 * i, 3 * i + 3 if i < 399 else 1300) for i in range(400)] + [(2, 0, 9)]


def test_time_groups_equal_all_pairs(spark):
    rnd = random.Random(11)
    start = datetime.datetime(2024, 1, 1)
    # A third of all rows in one burst, the edge of the window exactly met, equal times, a null time and a null id.
    seconds = [rnd.randint(0, 90) for _ in range(100)] + [10_000 + 30 * k for k in range(60)] + [rnd.randint(20_000, 90_000) for _ in range(140)]
    rows = [(i, start + datetime.timedelta(seconds=s)) for i, s in enumerate(seconds)] + [(900, None), (None, start + datetime.timedelta(seconds=95_000))]
    items = spark.createDataFrame(rows, "doc_id int, ts timestamp").withColumn("class_id", F.lit("other"))
    got = {r.doc_id: (r.class_id, r.n_links) for r in compare.time_proximity_groups(items, "ts", window_seconds=30).collect()}
    links = {i: [j for j, t in enumerate(seconds) if j != i and abs(s - t) < 30] for i, s in enumerate(seconds)}
    label = dict.fromkeys(links)
    for i in links:
        todo = [i] if label[i] is None else []
        while todo:
            j = todo.pop()
            if label[j] is None:
                label[j] = i
                todo += links[j]
    assert got == {**{i: (label[i], len(links[i])) for i in links}, None: (None, 0)}
    assert compare.time_proximity_groups(items.limit(0), "ts").collect() == []
