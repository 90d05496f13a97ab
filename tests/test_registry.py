"""Registered queries against DuckDB, and the shape of their plans."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as registry
from tests.conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
QUICK = [
    "profile_frequency_sttm_customer", "profile_top_actb_history", "profile_counts_sttm_kyc_retail", "profile_stats_actb_history",
    "profile_cross_checks", "udf_stdcusac", "udf_stdkycmn", "aml_102_metrics", "aml_105_sample", "aml_202_sample", "aml_301_sample",
    "aml_401_sample", "aml_402_metrics", "aml_403_sample", "aml_404_metrics", "aml_405_metrics", "aml_407_metrics", "aml_410_metrics",
    "coherence_section_1", "coherence_section_3", "coherence_section_6", "coh_3_21_sample", "coh_6_2_sample", "coh_7_9_sample",
    "coh_7_14_accounts", "coh_7_19_sample", "coh_8_0_sample", "coh_8_13_sample",
]
NAMES = sorted(registry.oracle_sql()) if os.environ.get("ALL_QUERIES") else QUICK


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def test_every_query_has_its_sql():
    own = {n for n in registry.queries() if not n.startswith("op") and n != "pipeline"}
    assert own == {n for n in registry.oracle_sql() if not n.startswith("op") and n != "pipeline"}
    assert len(registry.queries()) > 200


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    cursor = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    got = sorted([tuple(plain(r[c]) for c in columns) for r in df.collect()], key=repr)
    expected = sorted([tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()], key=repr)
    assert got == expected


@pytest.mark.parametrize("name", ["aml_401_metrics", "aml_402_metrics", "aml_407_metrics", "coh_7_14_sample", "coh_8_10_sample", "coh_7_9_sample"])
def test_plans_stay_in_the_jvm_and_join_by_key(spark, name):
    plan = registry.queries()[name](spark, DATA)._jdf.queryExecution().toString()
    assert "Python" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_date_and_amount_filters_reach_the_scan(spark):
    plan = registry.queries()["aml_401_metrics"](spark, DATA)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ts,2024-01-16T09:30)" in plan
    assert "props" not in plan.split("ReadSchema: ")[1].split(">")[0]


def test_entry_runs(spark):
    df = registry.entry(spark)
    assert {"check_id", "metric", "grp", "n", "amount", "total", "pct"} == set(df.columns)
    assert df.count() == 3
