"""Nested booking details against the flat rows, moves into other room types, derived keys, the heat map's pivot."""

import datetime as dt

import golden
from pyspark.sql import functions as F

from staylake.operators import filters, occupancy, reports
from staylake.plans import bookings
from staylake.plans.common import derived_key, with_derived_keys
from staylake.sources.schemas import REQUESTS


def drinks(n):
    return [{"id": i, "booking_id": 1 + i % 2, "service_id": 1, "quantity": 1 + i % 3} for i in range(1, n + 1)]


BAR = [{"id": 1, "hotel_id": 1, "name": "Bar", "unit_price": 25, "category": "F&B"}]


def test_nested_and_flat_agree(spark):
    t = golden.seed(spark, service_usage=drinks(30), services=BAR)
    flat: dict = {}
    for r in reports.booking_children(t).collect():
        flat.setdefault((r.booking_id, r.child), []).append((r.label, r.quantity))
    nested = reports.booking_details_nested(t).collect()
    assert len(nested) == t["bookings"].count()
    got: dict = {}
    for r in nested:
        assert (r.n_surcharges, r.n_room_assignments, r.n_services) == (len(r.surcharges or []), len(r.room_assignments or []), len(r.services or []))
        got[r.booking_id, "surcharge"] = [(x.surcharge_type, 1) for x in r.surcharges or []]
        got[r.booking_id, "room"] = [(x.room_number, 1) for x in r.room_assignments or []]
        got[r.booking_id, "service"] = [(x.service_name, x.quantity) for x in r.services or []]
    assert {k: sorted(v) for k, v in got.items() if v} == {k: sorted(v) for k, v in flat.items()}
    held = {c for c in t["service_usage"].columns if c != "booking_id"} | {"service_name", "unit_price"}
    assert set(next(r for r in nested if r.services).services[0].asDict()) == held


def test_long_lists_are_cut_before_the_shuffle(spark):
    t = golden.seed(spark, service_usage=drinks(50), services=BAR)
    df = reports.booking_details_nested(t, most=4)
    rows = {r.booking_id: r for r in df.collect()}
    assert rows[1].n_services == rows[2].n_services == 25 and len(rows[1].services) == 4
    assert [(x.quantity, x.id) for x in rows[2].services] == [(1, 3), (1, 9), (1, 15), (1, 21)]
    assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()


def test_long_lists_are_whole(spark):
    t = golden.seed(spark, service_usage=drinks(2402), services=BAR)
    rows = {r.booking_id: r for r in reports.booking_details_nested(t).collect()}
    for b in (1, 2):
        assert rows[b].n_services == len(rows[b].services) == 1201
        assert [(x.quantity, x.id) for x in rows[b].services] == sorted((x["quantity"], x["id"]) for x in drinks(2402) if x["booking_id"] == b)


def test_moves_into_other_types(spark):
    t = golden.seed(spark)
    d = t["booking_details"].select("booking_id", "room_type_id").collect()
    rooms = t["rooms"].select("id", "room_type_id").collect()
    held = {(x.booking_id, x.room_type_id) for x in d}
    ids = sorted({x.booking_id for x in d})
    moves = [(10 * b + r.id, b, r.id) for b in ids for r in rooms] + [(999, ids[0], 12345)]
    got = {r.seq for r in filters.room_type_match(t, spark.createDataFrame(moves, "seq bigint, booking_id bigint, to_room_id bigint")).collect()}
    kind = {r.id: r.room_type_id for r in rooms}
    assert got == {s for s, b, r in moves if (b, kind.get(r)) not in held}


def test_a_batch_sent_twice_books_once(spark):
    t = golden.two_stays(spark, bookings=[])
    a = dt.datetime(2026, 7, 12, 14)
    rows = [(i, f"r{i}", 1, 1 + i % 2, a, a + dt.timedelta(days=1 + i // 2), None, 1) for i in range(6)]
    req = with_derived_keys(spark.createDataFrame(rows, REQUESTS["booking_requests"]))
    first = bookings.booking_intake(t, req, golden.AS_OF)
    assert first["results"].filter("accepted").count() == 6
    again = bookings.booking_intake(t.replaced(bookings=first["bookings"]), req, golden.AS_OF)
    assert again["results"].filter("resumed").count() == 6 and again["bookings"].count() == first["bookings"].count()
    ids = lambda s: {r.seq: r.booking_id for r in s["results"].collect()}
    assert ids(first) == ids(again)


def test_derived_keys_tell_values_apart(spark):
    rows = spark.createDataFrame([("1", "23"), ("12", "3"), (None, "23"), ("", "23"), ("-", "23")], "a string, b string")
    keys = [r.k for r in rows.select(derived_key("a", "b").alias("k")).collect()]
    assert len(set(keys)) == 5 and all(len(k) == 64 for k in keys)


def test_pivot_has_the_cells_of_the_long_form(spark):
    t = golden.seed(spark)
    wide = occupancy.heatmap_matrix(t, golden.AS_OF).collect()
    long = {(r.type_name, str(r.date)): r.rate for r in occupancy.heatmap_long(t, golden.AS_OF).collect()}
    assert {(r.type_name, c): r[c] for r in wide for c in r.asDict() if c != "type_name"} == long and long


def test_counts_by_hotel_name(spark):
    t = golden.seed(spark)
    (row,) = [r for r in reports.e2e_counts(t).collect() if r.bookings][:1]
    mine = t["bookings"].join(t["hotels"].filter(F.col("name") == row.hotel_name).select(F.col("id").alias("hotel_id")), "hotel_id")
    assert (row.bookings, row.guests) == (mine.count(), mine.select("customer_id").distinct().count())
