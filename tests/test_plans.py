"""What the plans must and must not hold."""

from __future__ import annotations

import re

import pytest

from densika.plans import queries

ONE_ROW = {"lig_extract", "common_prefix"}  # join tables of one row each


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_no_nested_loops(frame, name):
    plan = physical(frame(name))
    if name not in ONE_ROW:
        assert not re.search("CartesianProduct|NestedLoop", plan), plan
    assert "BatchEvalPython" not in plan


def test_scans_read_only_what_they_need(spark, sf_dir):
    plan = physical(queries.queries()["ensemble_snr"](spark, sf_dir))
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert read and all(set(re.findall(r"(\w+):", r)) == {"l_partkey", "l_quantity", "l_extendedprice", "l_linenumber"} for r in read)


def test_filters_reach_the_scan(spark, sf_dir):
    plan = physical(queries.queries()["job_pending"](spark, sf_dir))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(o_orderstatus,F\)", plan)


def test_an_ensemble_is_grouped_without_a_second_shuffle_of_values(spark, sf_dir):
    plan = physical(queries.queries()["ensemble_snr"](spark, sf_dir))
    assert plan.count("Exchange hashpartitioning") == 1
