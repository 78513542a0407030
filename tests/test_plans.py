"""Plan shapes: no nested-loop or cross joins, no Python in the plan, limits and filters pushed down."""

import pytest

from vestigia.plans import catalog

FOLDER = "/root/testdata/sf0.001"
STREAMS = {"ingest_stream", "dedup_stream", "severity_windows", "sliding_windows", "actor_sessions"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - STREAMS))
def test_no_forbidden_operator(spark, name):
    text = plan(catalog.QUERIES[name](spark, FOLDER))
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "EvalPython", "InPandas", "InArrow"):
        assert word not in text


def test_row_local_overview_has_no_shuffle(spark):
    assert "Exchange" not in plan(catalog.QUERIES["risk_overview"](spark, FOLDER))


def test_top_per_group_limits_before_the_shuffle(spark):
    text = plan(catalog.QUERIES["top_per_group"](spark, FOLDER))
    assert text.count("WindowGroupLimit") == 2


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(catalog.QUERIES["get_by_key"](spark, FOLDER))
    assert "EqualTo(user_id,17)" in text and "ReadSchema: struct<user_id:bigint,props:string>" in text
    assert "GreaterThanOrEqual(o_orderdate" in plan(catalog.QUERIES["history_search"](spark, FOLDER))


def test_dates_are_built_once(spark):
    text = catalog.QUERIES["modal_value"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("explode(array(CASE WHEN") == 1 and "isnotnull(CASE" not in text


def test_tools_are_searched_once_per_side(spark):
    text = catalog.QUERIES["known_tool_lookup"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Contains(") + text.count("contains(") < 200


def test_timeline_reads_its_input_once(spark):
    df = catalog.QUERIES["timeline"](spark, FOLDER)
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


def test_hidden_text_is_shuffled_once(spark):
    text = plan(catalog.QUERIES["token_state_ffill"](spark, FOLDER))
    assert text.count("Exchange hashpartitioning(doc_id") == 2  # the pages, and the final count


@pytest.mark.parametrize("name", ["token_state_ffill", "hidden_text_findings"])
def test_keys_and_not_drawn_pages_are_shuffled(spark, name):
    text = plan(catalog.QUERIES[name](spark, FOLDER))
    assert text.index("concat(BT /F1") < text.rindex("Exchange hashpartitioning(doc_id")  # drawn above the exchange that stands nearest to the scan


def test_a_section_is_built_once_for_the_coverage(spark):
    text = catalog.QUERIES["analyzer_coverage"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("get_json_object") < 50


def test_a_font_name_is_prepared_once(spark):
    text = catalog.QUERIES["origin_histogram"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("regexp_") <= 4


def test_texts_and_not_words_are_shuffled(spark):
    text = plan(catalog.QUERIES["first_occurrence"](spark, FOLDER))
    assert text.count("Exchange") == 1 and text.index("Generate") < text.index("Exchange")  # the exchange stands below, nearer to the scan
