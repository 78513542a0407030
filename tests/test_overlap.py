"""Documents that share values with probes, held against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from vestigia.operators import overlap


def brute(rows):
    sets: dict = {}
    for d, v in rows:
        if d is not None and v is not None:
            sets.setdefault(d, set()).add(v)
    return {(p, d): len(sets[p] & sets[d]) for p in sets if p % 10 == 0 for d in sets if d != p and sets[p] & sets[d]}


@pytest.mark.parametrize("heavy", [0, 5, 1_000])
def test_matches_equal_all_pairs(spark, heavy):
    rnd = random.Random(heavy)
    rows = [(d, rnd.randint(0, 60)) for d in range(90) for _ in range(rnd.randint(1, 3))]
    rows += [(d, 1000) for d in range(30)] + [(d, 1001) for d in range(20, 50)]  # two values that a third of the documents hold
    rows += rows[:40] + [(None, 1000), (10, None), (500, 1002), (501, 1003), (502, 1003)]
    items = spark.createDataFrame(rows, "doc_id int, value int").withColumn("is_probe", F.lit("other")).withColumn("class", F.lit(1))
    found = overlap.shared_values(items, F.col("doc_id") % 10 == 0, heavy=heavy)
    want = brute(rows)
    per_probe: dict = {}
    for (p, _), n in want.items():
        per_probe.setdefault(p, []).append(n)
    got = {r.probe_id: (r.n_matches, r.most_shared) for r in overlap.match_counts(*found).collect()}
    assert got == {p: (len(n), max(n)) for p, n in per_probe.items()}

    listed, classes, members = ([r.asDict() for r in f.collect()] for f in found)
    group = {r["doc_id"]: r["class"] for r in members}
    pairs = {(r["probe_id"], r["doc_id"]): r["n_shared"] for r in listed}
    shared = {(r["probe_class"], r["class"]): r["n_shared"] for r in classes}
    for pair, n in want.items():
        assert pairs.get(pair) or shared[group[pair[0]], group[pair[1]]] == n
    assert all(want[pair] == n for pair, n in pairs.items())


def test_a_value_of_all_documents_is_no_list_of_pairs(spark):
    items = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("value"))
    listed, classes, members = overlap.shared_values(items, F.col("doc_id") % 10 == 0)
    assert listed.count() == 0 and classes.count() == 1 and members.count() == 4000
    counts = overlap.match_counts(listed, classes, members)
    assert counts.agg(F.count("*"), F.min("n_matches"), F.max("n_matches")).first()[:] == (400, 3999, 3999)
    assert overlap.match_counts(*overlap.shared_values(items.limit(0), F.lit(True))).collect() == []


def test_parts_grow_with_the_pairs(spark, monkeypatch):
    """Ten documents of each value, one of them a probe: the pairs are counted in parts of a bounded size."""
    monkeypatch.setattr(overlap, "ROWS_FOR_TASK", 40, raising=False)
    items = spark.range(400).selectExpr("id AS doc_id", "id DIV 10 AS value")
    listed = overlap.shared_values(items, F.col("doc_id") % 10 == 0)[0]
    sizes = [len(part) for part in listed.rdd.glom().collect()]
    assert sum(sizes) == 40 * 9 and len(sizes) >= 10
