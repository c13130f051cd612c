"""Edge rows of the billing, period and integrity rules."""

import datetime as dt
from decimal import Decimal as D

import golden
from pyspark.sql import functions as F
from staylake.functions.calc import calendar_age, period_bounds
from staylake.operators import billing, calendar, filters, occupancy, reports
from staylake.sources.schemas import TABLES
from staylake.sources.tables import append_to_snapshot, date_spine, scan_tables, write_snapshot


def ts(*a):
    return dt.datetime(2026, 7, *a)


def booking(id_, ci, co, **more):
    return {"id": id_, "hotel_id": 1, "customer_id": 1, "status": "Active", "check_in": ci, "check_out": co, "total_amount": 0, "amount_paid": 0, **more}


def detail(id_, b, n=1, k=1, price=100):
    return {"id": id_, "booking_id": b, "room_type_id": k, "agreed_price": price, "quantity": n}


def test_same_day_stay_bills_one_night_and_holds_none(spark):
    t = golden.two_stays(spark, bookings=[booking(1, ts(10, 9), ts(10, 20))], booking_details=[detail(1, 1, 2)])
    assert billing.booking_total(t).first().total_amount == 200
    assert occupancy.nightly_demand(t).count() == 0


def test_time_surcharge_bounds(spark):
    policies = [
        {"id": 1, "policy_type": "EarlyCheckIn", "multiplier": "0.50", "start_sec": 21600, "end_sec": 50400, "is_active": True},
        {"id": 2, "policy_type": "EarlyCheckIn", "multiplier": "1", "start_sec": 79200, "end_sec": 3600, "is_active": True},
        {"id": 3, "policy_type": "EarlyCheckIn", "multiplier": "1", "start_sec": None, "end_sec": 50400, "is_active": True},
        {"id": 4, "policy_type": "EarlyCheckIn", "multiplier": "1", "start_sec": 0, "end_sec": 86399, "is_active": False},
        {"id": 5, "policy_type": "LateCheckOut", "multiplier": "0", "start_sec": 0, "end_sec": 86399, "is_active": True},
    ]
    stays = [
        booking(1, ts(10, 6), ts(11, 10)), booking(2, ts(10, 14), ts(11, 10)), booking(3, ts(10, 14, 0, 1), ts(11, 10)),
        booking(4, ts(10, 14, 0, 0, 500), ts(11, 10)), booking(5, ts(10, 23), ts(11, 10)),
    ]
    t = golden.two_stays(spark, surcharge_policies=policies, bookings=stays, booking_details=[detail(i, i) for i in range(1, 6)])
    got = [(r.booking_id, r.policy_id, r.amount) for r in billing.time_surcharges(t).orderBy("booking_id", "policy_id").collect()]
    assert [g for g in got if g[1] == 1] == [(1, 1, 50), (2, 1, 50)]
    assert [g for g in got if g[1] == 5] == [(i, 5, 0) for i in range(1, 6)]  # a zero surcharge shows up in the checks
    assert {g[1] for g in got} == {1, 5}


def test_occupancy_rounding_and_empty_inventory(spark):
    rows = [
        {"room_type_id": 1, "date": dt.date(2026, 7, n), "total_inventory": inv, "total_reserved": res}
        for n, inv, res in ((1, 16, 1), (2, 32, 1), (3, 0, 0), (4, 3, 2))
    ]
    t = golden.two_stays(spark, room_type_inventory=rows)
    got = [r.occupancy_rate for r in occupancy.daily_occupancy(t).orderBy("date").collect()]
    assert got == [D("6.25"), D("3.13"), 0, D("66.67")]


def test_calendar_age(spark):
    born = [dt.date(2008, 2, 29), dt.date(2008, 3, 1), dt.date(2008, 2, 28), dt.date(2007, 12, 31)]
    df = spark.createDataFrame([(b,) for b in born], "b date")
    age = lambda day: [r[0] for r in df.select(calendar_age("b", day)).collect()]
    assert age("2026-02-28") == [17, 17, 18, 18]
    assert age("2026-03-01") == [18, 18, 18, 18]


def test_periods():
    assert period_bounds("last_month", "2026-01-31") == (dt.date(2025, 12, 1), dt.date(2026, 1, 1))
    assert period_bounds("this_quarter", "2026-11-02") == (dt.date(2026, 10, 1), dt.date(2027, 1, 1))
    assert period_bounds("anything", "2026-11-02") is None


def test_spine_guard(spark):
    assert date_spine(spark, "2026-07-10", "2026-07-12").count() == 3
    assert date_spine(spark, "2026-07-10", "2026-07-10").count() == 1
    assert date_spine(spark, "2026-07-10", "2026-07-09").count() == 0


def test_back_to_back_stays_do_not_overlap_and_text_order_of_rooms(spark):
    def stay(i, room, a, b):
        return {"id": i, "booking_id": i, "room_id": room, "check_in": a, "check_out": b, "is_cancelled": False}

    rooms = [{"id": i, "hotel_id": 1, "room_number": n, "room_type_id": 1, "status": "Maintenance"} for i, n in ((1, "9"), (2, "10"))]
    stays = [stay(1, 1, ts(10, 9), ts(12, 9)), stay(2, 1, ts(12, 9), ts(13, 9)), stay(3, 1, ts(11, 9), ts(12, 10))]
    t = golden.two_stays(spark, rooms=rooms, room_assignments=stays)
    got = {r.assignment_id: r.n_overlaps for r in calendar.assignment_overlaps(t).collect()}
    assert got == {1: 1, 2: 1, 3: 2}
    assert {r.assignment_id for r in calendar.first_overlap_per_room(t).collect()} == {2, 3}
    req = spark.createDataFrame([("a", 1, 1, ts(13, 9), ts(14, 9)), ("b", 1, 1, ts(12, 9), ts(14, 9))],
                                "request_id string, hotel_id int, room_type_id int, check_in timestamp_ntz, check_out timestamp_ntz")
    assert {(r.request_id, r.room_number) for r in calendar.first_free_room(t, req).collect()} == {("a", "10"), ("b", "10")}
    assert {(r.request_id, r.room_number) for r in calendar.free_rooms(t, req).collect()} == {("a", "10"), ("a", "9"), ("b", "10")}


def test_rows_that_outer_joins_keep(spark):
    stays = [{"id": 1, "booking_id": 1, "room_id": 1, "check_in": ts(10, 9), "check_out": ts(12, 9), "is_cancelled": False}]
    t = golden.two_stays(spark, bookings=[booking(1, ts(10, 9), ts(12, 9), status="Completed")], room_assignments=stays)
    rows = calendar.calendar_window(t, "2026-07-10", "2026-07-16").collect()
    assert len(rows) == 3 and [r.assignment_id for r in rows if r.room_id == 1] == [1]
    assert all(r.booking_id is None for r in rows)
    assert len(calendar.calendar_window(t, "2026-07-13", "2026-07-19").filter("assignment_id IS NOT NULL").collect()) == 0
    assert reports.booking_summary(t).count() == 0 and billing.booking_total(t).count() == 1


def test_service_keywords(spark):
    names = ["Spa", "spaghetti", "100% juice", "Laundry"]
    t = golden.two_stays(spark, services=[{"id": i, "hotel_id": 1, "name": n, "unit_price": 1, "category": "x"} for i, n in enumerate(names)])
    count = lambda kw, h=None: filters.service_search(t, h, kw).count()
    assert (count(""), count("SPA"), count("%"), count("_", 1), count("a", 2)) == (4, 2, 4, 4, 0)


def test_snapshot_round_trip(spark, tmp_path):
    t = golden.seed(spark)
    path = str(tmp_path / "v1")
    write_snapshot(t, list(TABLES), path)
    back = scan_tables(spark, path)
    assert sorted(back["bookings"].collect()) == sorted(t["bookings"].collect())
    append_to_snapshot(t["rooms"].limit(1).withColumn("id", F.lit(99)), path, "rooms")
    assert scan_tables(spark, path)["rooms"].count() == 15


def test_an_application_leaves_nothing_behind(tmp_path):
    """Written tables, snapshots and stream folders are below the application's own folder, which is gone after it ends."""
    import os
    import subprocess
    import sys
    import time

    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import os, sys
sys.path.insert(0, {home!r})
from pyspark.sql import SparkSession
import __spark_entry__ as entry
spark = SparkSession.builder.master("local[2]").config("spark.checkpoint.dir", {str(tmp_path)!r}).config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert entry.queries()["customer_intake"](spark, "/root/testdata/sf0.001").count()
assert entry.queries()["scan_tables"](spark, "/root/testdata/sf0.001").count()
written = [f for at, _, names in os.walk({str(tmp_path)!r}) for f in names if f.endswith(".parquet")]
assert len(written) > 2
spark.stop()
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=300, capture_output=True)
    for _ in range(60):  # the JVM ends a little after Python
        if not any(n.startswith("staylake-") for n in os.listdir(tmp_path)):
            break
        time.sleep(1)
    assert [f for _, _, names in os.walk(tmp_path) for f in names if f.endswith(".parquet")] == []
