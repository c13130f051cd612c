"""Versioned tables: touched partitions, readers that keep their version, failed and competing changes."""

import datetime as dt
import json
from decimal import Decimal as D

import golden
import pytest
from pyspark.sql import functions as F

from staylake.plans import money
from staylake.sources import versions as v
from staylake.sources.schemas import TABLES

KEYS = {"bookings": ["id"], "invoices": ["booking_id"]}


def booking(i, month, paid=0):
    start = dt.datetime(2026, month, 1 + i % 20, 15)
    return {"id": i, "hotel_id": 1, "customer_id": 1, "status": "Active", "idempotency_key": f"k{i}", "check_in": start, "check_out": start + dt.timedelta(days=2),
            "total_amount": D(100), "amount_paid": D(paid), "cancel_reason": f"kept {i}"}


def rows(spark, name, dicts):
    fields = [f.name for f in TABLES[name]]
    return spark.createDataFrame([tuple(d.get(c) for c in fields) for d in dicts], TABLES[name])


@pytest.fixture
def lake(spark, tmp_path):
    """60 bookings over six months and their invoices, as version 0."""
    path = f"{tmp_path}/lake"
    bookings = [booking(i, 1 + i // 10) for i in range(60)]
    bills = [{"id": i, "booking_id": i, "total_amount": D(100), "amount_paid": D(0), "balance": D(100), "status": "Issued"} for i in range(60)]
    tables = {"bookings": rows(spark, "bookings", bookings), "invoices": rows(spark, "invoices", bills)}
    assert v.create_versions(spark, path, tables, list(tables)) == 0
    return path


def manifest(path, version):
    return json.load(open(f"{path}/versions/{version:012d}.json"))


def everything(spark, path, version=None):
    t = v.read_version(spark, path, version)
    return sorted(map(repr, t["bookings"].collect())), sorted(map(repr, t["invoices"].collect()))


def test_ten_payments_rewrite_two_months(spark, lake):
    before, opened = everything(spark, lake), v.read_version(spark, lake)["bookings"]
    t = golden.two_stays(spark).replaced(**v.read_version(spark, lake))
    pays = spark.createDataFrame([(s, b, D(10), 7) for s, b in enumerate([11, 12, 13, 11, 15, 41, 42, 43, 44, 45])], "seq bigint, booking_id bigint, amount decimal(18,2), staff_id bigint")
    state = money.apply_payments(t, pays, golden.AS_OF)
    assert state["changed_bookings"].count() == 9
    now = v.commit(spark, lake, 0, {n: state[f"changed_{n}"] for n in KEYS}, KEYS)
    old, new = manifest(lake, 0), manifest(lake, now)
    assert {p for p in old["bookings"] if old["bookings"][p] != new["bookings"][p]} == {"2026-02", "2026-05"} and set(old["bookings"]) == set(new["bookings"])
    got = {r.id: r.amount_paid for r in v.read_version(spark, lake)["bookings"].collect()}
    assert got == {i: D(20) if i == 11 else D(10) if i in (12, 13, 15, 41, 42, 43, 44, 45) else D(0) for i in range(60)}
    # the same state as writing the whole table, other columns kept
    whole = sorted(map(repr, state["bookings"].select(*[f.name for f in TABLES["bookings"]]).collect()))
    assert everything(spark, lake)[0] == whole
    # a reader that opened version 0 still sees it
    assert everything(spark, lake, 0) == before and opened.filter("amount_paid > 0").count() == 0


def test_failed_change_leaves_the_version(spark, lake):
    before = everything(spark, lake)
    bad = v.read_version(spark, lake)["bookings"].withColumn("amount_paid", F.expr("IF(id = 33, CAST(raise_error('lost') AS DECIMAL(18,2)), amount_paid)"))
    with pytest.raises(Exception, match="lost"):
        v.commit(spark, lake, 0, {"bookings": bad}, KEYS)
    assert v.versions(spark, lake) == [0] and everything(spark, lake) == before


def test_two_changes_to_one_version(spark, lake):
    change = {"bookings": rows(spark, "bookings", [booking(3, 1, paid=5)])}
    assert v.commit(spark, lake, 0, change, KEYS) == 1
    with pytest.raises(v.StaleVersion):
        v.commit(spark, lake, 0, {"bookings": rows(spark, "bookings", [booking(4, 1, paid=6)])}, KEYS)
    assert v.read_version(spark, lake)["bookings"].filter("amount_paid > 0").collect()[0].id == 3


def test_moved_new_and_deleted_rows(spark, lake):
    """A row whose date moves leaves its old month; new keys come in; a month without rows goes."""
    moved, fresh = booking(3, 12), booking(99, 3)
    gone = spark.createDataFrame([(i,) for i in range(50, 60)], "id bigint")
    now = v.commit(spark, lake, 0, {"bookings": rows(spark, "bookings", [moved, fresh])}, KEYS, {"bookings": gone})
    parts = manifest(lake, now)["bookings"]
    assert set(parts) == {"2026-01", "2026-02", "2026-03", "2026-04", "2026-05", "2026-12"}
    after = {r.id: r.check_in.month for r in v.read_version(spark, lake)["bookings"].collect()}
    assert after == {**{i: 1 + i // 10 for i in range(50)}, 3: 12, 99: 3}
    assert v.commit(spark, lake, now, {"bookings": rows(spark, "bookings", [])}, KEYS) == now + 1
    assert manifest(lake, now + 1) == manifest(lake, now)
    removed = v.drop_unused(spark, lake, keep=1)
    assert len(removed) == 3 and v.versions(spark, lake) == [now + 1] and v.read_version(spark, lake)["bookings"].count() == 51
