"""Rules at their edges: repeated room types, reasons, declared types, null keys, sparse numbers, foreign working folders."""

import datetime as dt
import os
import subprocess
import sys
from decimal import Decimal

import golden
from pyspark.sql import functions as F
from staylake.functions.windows import running
from staylake.operators import quality, reports
from staylake.plans import admission, bookings, pipeline
from staylake.plans.common import number_rows
from staylake.sources.tables import scan_tables, write_snapshot

AS_OF = golden.AS_OF


def ts(*a):
    return dt.datetime(2026, 7, *a)


def stay(id_, status="Pending", **more):
    return {"id": id_, "hotel_id": 1, "customer_id": 1, "status": status, "idempotency_key": f"k{id_}", "check_in": ts(10, 14), "check_out": ts(12, 12), "total_amount": 0, "amount_paid": 0, **more}


def hotel(spark, **more):
    nights = [{"room_type_id": k, "date": dt.date(2026, 7, d), "total_inventory": 5, "total_reserved": 0} for k in (1, 2) for d in (10, 11)]
    types = [{"id": k, "hotel_id": 1, "type_name": n, "base_price": 100 * k, "max_capacity": 2} for k, n in ((1, "Standard"), (2, "Deluxe"))]
    rooms = [{"id": 10 * k + i, "hotel_id": 1, "room_number": f"{k}0{i}", "room_type_id": k, "status": "Available"} for k in (1, 2) for i in range(3)]
    rows = {"hotels": [{"id": 1, "name": "h", "address": "a"}], "room_types": types, "rooms": rooms, "room_type_inventory": nights}
    return golden.tables(spark, **{**rows, **more})


LINES = "seq bigint, booking_id bigint, room_type_id bigint, quantity int, is_breakfast_included boolean"


def test_a_booking_holds_a_room_type_once(spark):
    held = [{"id": 7, "booking_id": 2, "room_type_id": 1, "agreed_price": 100, "quantity": 1}]
    t = hotel(spark, bookings=[stay(1), stay(2), stay(3)], booking_details=held)
    req = spark.createDataFrame([(1, 1, 1, 1, False), (2, 1, 1, 1, False), (3, 2, 1, 1, False), (4, 3, 1, 1, False), (5, 3, 2, 1, True)], LINES)
    state = admission.reserve_inventory(t, req, AS_OF)
    assert {r.booking_id: r.code for r in state["results"].collect()} == {1: "DUPLICATE", 2: "DUPLICATE", 3: None}
    assert sorted((r.booking_id, r.room_type_id) for r in state["booking_details"].collect()) == [(2, 1), (3, 1), (3, 2)]
    assert sum(r.total_reserved for r in state["room_type_inventory"].collect()) == 4


def test_room_lines_with_breakfast_in_the_price(spark):
    t = hotel(spark, bookings=[stay(1), stay(2)])
    req = spark.createDataFrame([(1, 1, 1, 1, True), (2, 1, 2, 1, False), (3, 2, 99, 1, True)], LINES)
    state = admission.add_room_lines(t, req, AS_OF)
    assert {r.booking_id: r.code for r in state["results"].collect()} == {1: None, 2: "NOT_FOUND"}
    assert {r.room_type_id: r.agreed_price for r in state["booking_details"].collect()} == {1: 150100, 2: 200}


def test_resumed_booking_keeps_one_detail_per_type(spark):
    held = [{"id": 7, "booking_id": 1, "room_type_id": 1, "agreed_price": 100, "quantity": 1}]
    t = hotel(spark, bookings=[stay(1)], booking_details=held)
    req = spark.createDataFrame(
        [(1, "r1", 1, 1, ts(10, 14), ts(12, 12), "k1", 1), (2, "r2", 1, 1, ts(10, 14), ts(12, 12), "new", 1)],
        "seq bigint, request_id string, hotel_id bigint, customer_id bigint, check_in timestamp_ntz, check_out timestamp_ntz, idempotency_key string, staff_id bigint",
    )
    rooms = spark.createDataFrame([("r1", 1, 1, False), ("r2", 1, 1, False)], "request_id string, room_type_id bigint, quantity int, is_breakfast_included boolean")
    none = spark.createDataFrame([], "request_id string, service_id bigint, quantity int")
    state = pipeline.create_bookings(t, req, rooms, none, AS_OF)
    assert {r.request_id: r.code for r in state["results"].collect()} == {"r1": "DUPLICATE", "r2": None}
    assert state["booking_details"].groupBy("booking_id", "room_type_id").count().filter("count > 1").isEmpty()


def test_cancelling_without_a_reason_keeps_the_stored_one(spark):
    t = hotel(spark, bookings=[stay(1, "Active", cancel_reason="asked by phone"), stay(2, "Active")])
    req = spark.createDataFrame([(1, 1, None), (2, 2, "ill")], "seq bigint, booking_id bigint, reason string")
    state = bookings.cancel_bookings(t, req, AS_OF)
    assert {r.id: r.cancel_reason for r in state["bookings"].collect()} == {1: "asked by phone", 2: "ill"}


def test_state_is_written_and_read_back_for_the_next_job(spark, tmp_path):
    t = hotel(spark, bookings=[stay(1), stay(2)])
    first = admission.reserve_inventory(t, spark.createDataFrame([(1, 1, 1, 1, False)], LINES), AS_OF)
    after = t.replaced(booking_details=first["booking_details"], room_type_inventory=first["room_type_inventory"])
    write_snapshot(after, list(after), str(tmp_path / "v1"))
    again = scan_tables(spark, str(tmp_path / "v1"))
    second = admission.reserve_inventory(again, spark.createDataFrame([(1, 2, 1, 5, False), (2, 1, 1, 1, False)], LINES), AS_OF)
    assert {r.booking_id: r.code for r in second["results"].collect()} == {1: "DUPLICATE", 2: "OVERBOOKING"}


def test_kpi_sums_beyond_eighteen_digits(spark):
    rich = Decimal("6300000000000000.00")
    rows = [stay(i, "Completed", amount_paid=rich) for i in (1, 2, 3)]
    details = [{"id": i, "booking_id": i, "room_type_id": 1, "agreed_price": rich / 2, "quantity": 1} for i in (1, 2, 3)]
    r = reports.kpi_report(hotel(spark, bookings=rows, booking_details=details), AS_OF).first()
    assert r.total_revenue == r.total_collected == 3 * rich


def test_missing_columns_are_reported(spark):
    t = hotel(spark)
    lost = quality.dq_missing_columns(t.replaced(rooms=t["rooms"].drop("updated_by"), staff=t["staff"].drop("name"))).collect()
    assert {(r.table_name, r.detail) for r in lost} == {("rooms", "updated_by"), ("staff", "name")}
    assert quality.dq_missing_columns(t).isEmpty()


def test_running_keeps_rows_with_null_keys(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 6), (None, 1, 7), (None, None, 8)], "k string, seq bigint, v bigint")
    got = running(df, ["k"], F.floor(F.col("seq") / 1), ["seq"], {"s": ("sum", "v", 0)}, inclusive=True)
    assert sorted((str(r.k), r.s) for r in got.collect()) == [("None", 8), ("None", 15), ("a", 5), ("a", 11)]


def test_numbers_do_not_depend_on_gaps(spark):
    df = spark.range(500).select((F.col("id") * 1_000_003).alias("seq"), (F.col("id") % 7).alias("x")).repartition(5)
    got = number_rows(df, F.lit(100).cast("bigint"), "seq", "x")
    assert [(r.seq, r.id) for r in got.orderBy("seq").collect()] == [(i * 1_000_003, 101 + i) for i in range(500)]
    assert got.columns == ["seq", "x", "id"]


def test_python_workers_get_the_package(tmp_path):
    """A session started in another folder, without the repository on the workers' path."""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        f"import sys; sys.path.insert(0, {repo!r})\n"
        "import __spark_entry__ as e\nfrom pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        "print('ROWS', e.queries()['defragment_rooms'](s, '/root/testdata/sf0.001').count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "ROWS " in done.stdout and int(done.stdout.split("ROWS ")[1].split()[0]) > 0, done.stderr[-2000:]
