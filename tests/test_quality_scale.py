"""Integrity checks on large tables: only violating rows become lists, keys are counted as they are stored."""

import pytest

from staylake.operators import quality
from staylake.session import cut_lineage


@pytest.fixture
def services(spark):
    rows = [(1, 1, "a|b", 5), (2, 1, "a|b", -1), (3, None, "a|b", None), (4, None, "a|b", 2), (4, 2, "c", 1), (None, 2, None, 1), (None, 2, None, 1)]
    return cut_lineage(spark.createDataFrame(rows, "id long, hotel_id long, name string, unit_price int"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_row_rules_filter_in_the_scan(services):
    t = {"services": services}
    rules = {"services": [("not_null", services[c].isNull(), quality.F.lit(c)) for c in ("id", "hotel_id", "name", "unit_price")]}
    found = quality._row_rules(t, rules)
    pushed = plan(found).split("PushedFilters: ")[1].split("]")[0]
    assert "IsNull(unit_price)" in pushed and "IsNull(id)" in pushed
    got = sorted((r["key"], r["detail"]) for r in found.collect())
    assert got == [("", "id"), ("", "id"), ("", "name"), ("", "name"), ("3", "hotel_id"), ("3", "unit_price"), ("4", "hotel_id")]


def test_unknown_conditions_are_no_violation(services):
    found = quality._row_rules({"services": services}, {"services": [("negative", quality.F.expr("unit_price < 0"), quality.F.lit("x"))]})
    assert [(r["key"], r["rule"]) for r in found.collect()] == [("2", "negative")]


def test_keys_are_counted_as_stored(services, monkeypatch):
    monkeypatch.setattr(quality, "UNIQUE", {"services": [["id"], ["hotel_id", "name"], ["not_there"]]})
    found = quality.dq_unique({"services": services})
    shuffled = plan(found)
    assert "hashpartitioning(id" in shuffled and "hashpartitioning(hotel_id" in shuffled and "Generate" not in shuffled
    got = {(r["rule"], r["table_name"], r["key"], r["detail"]) for r in found.collect()}
    assert got == {("unique_id", "services", "4", "2"), ("unique_hotel_id_name", "services", "1|a|b", "2")}
