"""Hand-checked values on the two small data sets."""

import datetime as dt
from decimal import Decimal as D

import golden
from golden import AS_OF, DAY
from pyspark.sql import functions as F
from staylake.operators import billing, calendar, occupancy, quality, reports
from staylake.plans import admission, bookings, money, rooms
from staylake.sources.schemas import REQUESTS


def pairs(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def test_totals_equal_the_stated_ones(spark):
    t = golden.seed(spark)
    got = dict(pairs(billing.booking_total(t), "booking_id", "total_amount"))
    assert got == {b[0]: D(b[6]) for b in golden.BOOKINGS}
    assert quality.dq_total_drift(t).count() == 0


def test_nightly_reserved(spark):
    t = golden.seed(spark)
    got = {(r.room_type_id, (r.date - DAY).days): r.reserved for r in occupancy.nightly_reserved(t).collect()}
    for k in (1, 2):
        assert [got[k, off] for off in range(-5, 10)] == golden.DEMAND[k]
    assert not any(n for (k, _), n in got.items() if k == 3)
    assert quality.dq_inventory_drift(t).count() == 0


def test_revenue_and_kpi(spark):
    t = golden.seed(spark)
    [r] = reports.monthly_revenue(t).collect()
    assert (r.hotel_id, r.report_month) == (1, dt.date(2026, 7, 1))
    assert (r.total_room_cost, r.total_surcharges, r.total_services, r.total_revenue, r.actual_collected) == (D(8400000), 0, 0, D(8400000), 0)
    for period in ("all", "this_month", "this_quarter", "no such period"):
        [k] = reports.kpi_report(t, AS_OF, period).collect()
        assert (k.avg_occupancy_7d, k.adr, k.bookings_count) == (D("7.1"), D(186667), 13)
        assert (k.total_revenue, k.total_outstanding) == (D(8400000), D(8400000))
    assert list(map(float, reports.kpi_report(t, AS_OF, "last_month").first())) == [0] * 6


def test_rooms_now_and_overlaps(spark):
    t = golden.seed(spark)
    now = {r.room_number: r.booking_id for r in calendar.room_status_now(t, AS_OF).collect()}
    assert len(now) == 14 and {k: v for k, v in now.items() if v} == {"101": 1, "201": 2, "205": 9}
    assert calendar.assignment_overlaps(t).count() == 0 and quality.dq_no_overlap(t).count() == 0


SPOTS = {
    3: [2, 3], 5: [1, 7], 6: [4], 8: [2, 3], 10: [1, 6], 11: [4], 13: [2], 7: [6], 4: [7, 8], 12: [7, 8],
}


def test_defragment(spark):
    t = golden.seed(spark)
    hotel = spark.createDataFrame([(1,)], "hotel_id int")
    for rows in (1_000_000, 4):  # the second run cuts every group into small slices
        state = admission.defragment_rooms(t, hotel, AS_OF, rows)
        got: dict = {}
        for b, r in pairs(state["placed"], "booking_id", "room_id"):
            got.setdefault(b, []).append(r)
        assert got == SPOTS and state["unplaced"].count() == 0
    after = t.replaced(room_assignments=state["room_assignments"])
    assert calendar.assignment_overlaps(after).count() == 0
    assert reports.rooms_expected_vs_assigned(after).count() == 0


def requests(spark, name, rows):
    return spark.createDataFrame(rows, REQUESTS[name])


def test_two_stays_from_reserve_to_rooms(spark):
    t = golden.two_stays(spark)
    lines = spark.createDataFrame(
        [(1, 1, 1, 1, False), (1, 1, 2, 1, True), (2, 2, 1, 1, False)],
        "seq bigint, booking_id int, room_type_id int, quantity int, is_breakfast_included boolean",
    )
    state = admission.reserve_inventory(t, lines)
    assert pairs(state["results"], "booking_id", "accepted") == [(1, True), (2, True)]
    t = t.replaced(room_type_inventory=state["room_type_inventory"], booking_details=state["booking_details"])
    rates = {(r.type_name, r.date.day): r.occupancy_rate for r in occupancy.daily_occupancy(t).collect()}
    assert [rates["Deluxe", n] for n in range(10, 14)] == [50, 100, 50, 0]
    assert [rates["Suite", n] for n in range(10, 14)] == [100, 100, 0, 0]

    def free(a, b):
        return pairs(occupancy.rooms_available(t, f"2026-07-{a}", f"2026-07-{b}"), "type_name", "min_available", "has_missing_dates")

    assert free(10, 13) == [("Deluxe", 0, False), ("Suite", 0, False)]
    assert free(12, 14) == [("Deluxe", 1, False), ("Suite", 1, False)]
    assert free(13, 15) == [("Deluxe", 0, True), ("Suite", 0, True)]
    assert free(13, 13) == []

    done = bookings.finalize_bookings(t, requests(spark, "check_outs", [(1, 1, 1), (2, 2, 1), (3, 2, 1)]), AS_OF)
    assert pairs(done["results"], "seq", "accepted") == [(1, True), (2, True), (3, False)]
    t = t.replaced(bookings=done["bookings"], booking_surcharges=done["booking_surcharges"])
    assert pairs(t["booking_surcharges"], "booking_id", "amount") == [(1, 36), (1, 60), (1, 66), (1, 110), (2, 60)]
    assert pairs(t["bookings"], "id", "total_amount", "status") == [(1, 952, "Active"), (2, 300, "Active")]
    # working the surcharges out again changes nothing
    again = bookings.with_time_surcharges(t, t["bookings"].select(F.col("id").alias("booking_id")), AS_OF)
    assert pairs(again, "booking_id", "amount") == pairs(t["booking_surcharges"], "booking_id", "amount")

    moves = requests(spark, "room_moves", [(1, 1, None, 1, 1), (2, 1, None, 3, 1), (3, 2, None, 1, 1), (4, 2, None, 2, 1), (5, 2, None, 3, 1)])
    for rows in (1_000_000, 2):
        moved = admission.pre_assign_rooms(t, moves, AS_OF, rows)
        assert pairs(moved["results"].fillna(""), "seq", "code") == [
            (1, ""), (2, ""), (3, "ROOM_OVERLAP"), (4, ""), (5, "ROOM_TYPE_MISMATCH"),
        ]
    t = t.replaced(room_assignments=moved["room_assignments"])
    packed = admission.defragment_rooms(t, t["hotels"].select(F.col("id").alias("hotel_id")), AS_OF)
    assert pairs(packed["placed"], "booking_id", "room_id") == [(1, 1), (1, 3), (2, 2)]
    t = t.replaced(room_assignments=packed["room_assignments"])
    [c] = reports.hotel_counts(t).collect()
    assert (c.bookings, c.details, c.live_assignments) == (2, 3, 3)


def test_stay_at_the_desk(spark):
    """Check in, move out early, clean: states and refusals on the seed set."""
    t = golden.seed(spark)
    ins = requests(spark, "check_ins", [(1, 3, 2, 1), (2, 4, 2, 1), (3, 3, 3, 1), (4, 1, 6, 1), (5, 99, 4, 1), (6, 4, 9, 1)])
    state = rooms.check_in_batch(t, ins, AS_OF)
    assert pairs(state["results"].fillna(""), "seq", "code") == [
        (1, ""), (2, "ROOM_NOT_AVAILABLE"), (3, ""), (4, "ROOM_NOT_AVAILABLE"), (5, "NOT_FOUND"), (6, ""),
    ]
    assert state["room_assignments"].count() == t["room_assignments"].count() + 1  # room 9 is new for booking 4
    outs = requests(spark, "check_outs", [(1, 1, 7), (2, 9, 7), (3, 3, 7), (4, 1, 7)])
    out = rooms.check_out_batch(t, outs, AS_OF)
    assert pairs(out["results"], "seq", "accepted") == [(1, True), (2, True), (3, False), (4, False)]
    dirty = out["rooms"].filter("status = 'Dirty'")
    assert pairs(dirty, "id", "updated_by") == [(1, 7), (10, 7)]
    cut = out["room_assignments"].filter(F.col("check_out") == F.lit(AS_OF).cast("timestamp_ntz"))
    assert pairs(cut, "booking_id") == [(1,), (9,)]
    # booking 3 is checked in ahead of its stay: it cannot be cut to now
    early = t.replaced(bookings=state["bookings"])
    assert rooms.check_out_batch(early, requests(spark, "check_outs", [(1, 3, 7)]), AS_OF)["results"].first().code == "ASSIGNMENT_PERIOD"
    clean = rooms.housekeeping_batch(t.replaced(rooms=out["rooms"]), requests(spark, "housekeeping", [(1, 1, 7), (2, 1, 7), (3, 2, 7), (4, 77, 7)]), AS_OF)
    assert pairs(clean["results"].fillna(""), "seq", "code") == [(1, ""), (2, "HOUSEKEEPING_INVALID"), (3, "HOUSEKEEPING_INVALID"), (4, "NOT_FOUND")]


def test_cancel_releases_nights_and_rooms(spark):
    t = golden.seed(spark)
    state = bookings.cancel_bookings(t, requests(spark, "check_outs", [(1, 8, 1), (2, 1, 1), (3, 8, 1)]), AS_OF)
    assert pairs(state["results"], "seq", "accepted") == [(1, True), (2, False), (3, False)]
    after = t.replaced(bookings=state["bookings"], room_type_inventory=state["room_type_inventory"], room_assignments=state["room_assignments"])
    assert quality.dq_inventory_drift(after).count() == 0
    gone = state["room_assignments"].filter("is_cancelled")
    assert pairs(gone, "booking_id") == [(8,), (8,)]
    [b] = state["bookings"].filter("id = 8").collect()
    assert b.status == "Cancelled" and b.cancelled_at == dt.datetime(2026, 7, 10, 13)


def test_invoice_and_payments(spark):
    t = golden.seed(spark)
    issued = money.issue_invoices(t, requests(spark, "check_outs", [(1, 1, 4), (2, 3, 4), (3, 99, 4)]), AS_OF)
    assert pairs(issued["results"].fillna(""), "seq", "code") == [(1, ""), (2, ""), (3, "NOT_FOUND")]
    t = t.replaced(invoices=issued["invoices"])
    pays = requests(spark, "payments", [
        (1, 1, D(3000000), "Card", 1), (2, 1, D(2000000), "Card", 1), (3, 1, D(0), "Card", 1), (4, 1, D(400000), "Cash", 1),
        (5, 1, D(1), "Cash", 1), (6, 3, D(100), "Cash", 1), (7, 99, D(5), "Cash", 1),
    ])
    state = money.apply_payments(t, pays, AS_OF)
    assert pairs(state["results"].fillna(""), "seq", "code") == [
        (1, "OVERPAYMENT"), (2, ""), (3, "INVALID_AMOUNT"), (4, ""), (5, "OVERPAYMENT"), (6, ""), (7, "NOT_FOUND"),
    ]
    got = {r.booking_id: (r.amount_paid, r.balance, r.status) for r in state["invoices"].collect()}
    assert got == {1: (2400000, 0, "Paid"), 3: (100, 3199900, "Issued")}
    # issuing again after payment sets Issued, a void invoice stays
    paid = t.replaced(bookings=state["bookings"], invoices=state["invoices"].withColumn("status", F.expr("IF(booking_id = 3, 'Void', status)")))
    again = money.issue_invoices(paid, requests(spark, "check_outs", [(1, 1, 4), (2, 3, 4)]), AS_OF)["invoices"]
    assert pairs(again, "booking_id", "status") == [(1, "Issued"), (3, "Void")]
