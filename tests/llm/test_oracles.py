"""Queries against their SQL, and every query against the shape that its contract names."""

import pytest

import __spark_entry__ as entry
from tests.compare import differences, duck
from vestigia.llm import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, con, name):
    assert differences(spark, con, FOLDER, registry.QUERIES[name], registry.ORACLES[name]) is None


def test_entry_has_all_queries():
    assert set(registry.QUERIES) <= set(entry.queries()) and set(registry.ORACLES) <= set(entry.oracle_sql())
    assert [f"op{n}" for n in range(1, 14)] == sorted((q.split("_")[0] for q in registry.QUERIES if q != "pipeline"), key=lambda x: int(x[2:]))


@pytest.mark.parametrize("name", ["op3_license_sentences", "op4_quality_rules", "op5_url_language_model", "op7_benchmark_decontamination"])
def test_native_plans_hold_no_python(spark, name):
    plan = registry.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))
