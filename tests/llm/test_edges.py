"""Nulls, empty tables, long texts, repeated rows and clashing columns, for every query and every stage."""

import pytest
from tests.llm import samples

import corpus_pipeline
from vestigia.llm import registry

PAGES = [
    (1, "https://a.example.org/es/x?y#z", "<p>same</p>"), (2, "HTTP://B.example.COM/fr/1", "<p>same</p>"), (3, None, None), (4, "no scheme", ""),
    (5, "http://", "x" * 200_000), (None, "http://c.org/", "<p>same</p>"), (7, "http://x.com/de/\r\nevil: 1", "a\r\n\r\nWARC/1.1\r\n\r\n"),
    (8, "http://" + "a/" * 20_000, "<p>same</p>"), (8, "http://" + "a/" * 20_000, "<p>same</p>"), (9, "é://ü?", "日本"),
]
LABELS = [(1, 1, 0), (1, 0, 0), (9, 0, 0), (None, 0, 0), (6, None, None), (999, 1, 0)]
BENCHMARK = [(1, "one two three four five six seven"), (2, None), (3, "..."), (None, "ab cd"), (5, "cd")]
CONVERSATIONS = [(1, 1, "user", "a" * 100_000), (1, 1, "user", "a" * 100_000), (None, None, None, None), (2, None, "system", "x."), (2, 0, "", ""), (3, 5, "user", "Hi.")]
COUNTS = {"op1": len(PAGES), "op5": len(PAGES), "op12": len({c for c, *_ in CONVERSATIONS})}


@pytest.fixture(scope="module")
def full(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("full")
    return samples.write_tables(spark, folder, samples.clashing(samples.documents(spark)), LABELS, BENCHMARK, PAGES, CONVERSATIONS)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return samples.write_tables(spark, tmp_path_factory.mktemp("empty"), samples.documents(spark, []))


QUERIES = sorted(set(registry.QUERIES) - {"pipeline"})


@pytest.mark.parametrize("name", QUERIES)
def test_odd_rows(spark, full, name):
    rows = registry.QUERIES[name](spark, full).collect()
    if name == "op11_vector_packing":  # rows are pieces: those at place 0 are the documents
        rows = [r for r in rows if r.start == 0]
    assert len(rows) == COUNTS.get(name.split("_")[0], len(samples.TEXTS))


@pytest.mark.parametrize("name", [*QUERIES, "pipeline"])
def test_empty_tables(spark, empty, name):
    assert registry.QUERIES[name](spark, empty).collect() == []


def test_unlabelled_documents_and_no_benchmark(spark, tmp_path):
    folder = samples.write_tables(spark, tmp_path, samples.documents(spark))
    for name in ("op4_quality_rules", "op5_url_language_model", "op7_benchmark_decontamination", "pipeline"):
        registry.QUERIES[name](spark, folder).collect()


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_keep_all_columns(spark, full, name, stage):
    docs = spark.read.parquet(f"{full}/documents.parquet")
    out = stage(spark, docs, full)
    rows = out.collect()
    if name == "encode":
        assert out.columns == [*docs.columns, "piece_ids", "decoded"]
    else:
        assert out.schema == docs.schema
    if name in ("mask_personal_data", "encode"):
        assert len(rows) == len(samples.TEXTS)
    if name == "near_dedup":
        assert sorted(r.doc_id for r in rows if r.doc_id) == [1, 2, 3, 4, 5, 6, 7, 9, 11, 12, 13]
        assert sum(r.doc_id is None for r in rows) == 2
    if name == "decontamination":
        assert {7, 8, 9, 10}.isdisjoint(r.doc_id for r in rows)
