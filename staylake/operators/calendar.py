"""Rooms over time: current guests, calendar, free rooms, overlapping assignments."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from ..functions.calc import OPEN_STATES, as_date, live, money, timestamp
from ..functions.windows import running
from ..sources.schemas import ROOM_STATES
from .gaps import fitting_gaps


def _rooms_with_type(t: Mapping) -> DataFrame:
    types = t["room_types"].select(F.col("id").alias("room_type_id"), "type_name")
    rooms = t["rooms"].select(
        F.col("id").alias("room_id"), "hotel_id", "room_number", "room_type_id", F.col("status").alias("room_status")
    )
    return rooms.join(types, "room_type_id")


def room_status_now(t: Mapping, as_of) -> DataFrame:
    """Every room with its checked-in guest at ``as_of``.

    Assignments are cut to the moment and bookings to the state before the outer joins,
    so rooms without a guest stay and no range join is left.
    """
    now = timestamp(as_of)
    current = t["room_assignments"].filter(live() & (F.col("check_in") <= now) & (F.col("check_out") > now))
    staying = t["bookings"].filter(F.col("status") == "Checked-in").select(
        F.col("id").alias("booking_id"), "customer_id", F.col("check_out").alias("expected_check_out")
    )
    guests = t["customers"].select(F.col("id").alias("customer_id"), F.col("full_name").alias("current_guest"))
    # inner parts first: an assignment whose booking is not checked in shows a room without guest
    found = staying.join(guests, "customer_id", "left")
    shown = current.select("room_id", "booking_id").join(
        found.withColumn("guest_booking_id", F.col("booking_id")), "booking_id", "left"
    )
    return _rooms_with_type(t).join(shown.drop("booking_id"), "room_id", "left").select(
        "hotel_id", "room_id", "room_number", "type_name", F.col("room_status").alias("physical_status"),
        "current_guest", "expected_check_out", F.col("guest_booking_id").alias("booking_id"),
    )


def _calendar(t: Mapping, assignments: DataFrame) -> DataFrame:
    open_bookings = t["bookings"].filter(F.col("status").isin(OPEN_STATES))
    money_cols = [c for c in ("total_amount", "amount_paid") if c in open_bookings.columns]
    b = open_bookings.select(
        F.col("id").alias("booking_id"), F.col("status").alias("booking_status"), "customer_id", *money_cols,
        F.col("updated_at").alias("booking_updated_at"),
    )
    guests = t["customers"].select(
        F.col("id").alias("customer_id"), F.col("full_name").alias("customer_name"), F.col("phone_number").alias("customer_phone")
    )
    a = assignments.select(
        F.col("id").alias("assignment_id"), "room_id", F.col("booking_id").alias("held_by"), "check_in", "check_out"
    )
    a = a.join(b.withColumnRenamed("booking_id", "b_id"), F.col("held_by") == F.col("b_id"), "left")
    a = a.join(guests, "customer_id", "left")
    return _rooms_with_type(t).join(a, "room_id", "left").withColumnRenamed("b_id", "booking_id").drop("held_by", "customer_id")


def calendar_full(t: Mapping) -> DataFrame:
    """Rooms with all live assignments; booking columns are empty unless the booking is open."""
    rows = _calendar(t, t["room_assignments"].filter(live()))
    return rows.select(
        "assignment_id", "hotel_id", "room_type_id", "type_name", "room_id", "room_number", "room_status", "booking_id",
        "booking_status", "customer_name", "customer_phone", "check_in", "check_out", "total_amount", "amount_paid",
        money(F.col("total_amount") - F.col("amount_paid")).alias("balance"), "booking_updated_at",
    )


def calendar_window(t: Mapping, start, end) -> DataFrame:
    """The calendar cut to stays that meet [start, end) (midnights), ordered for display.

    ``offset_days`` and ``length_days`` place a bar on the page.
    """
    a, b = timestamp(as_date(start)), timestamp(as_date(end))
    met = t["room_assignments"].filter(live() & (F.col("check_in") < b) & (F.col("check_out") > a))

    def days(x, y):
        return F.timestamp_diff("SECOND", x, y).cast("double") / F.lit(86400.0)

    return (
        _calendar(t, met)
        .select(
            "hotel_id", "room_type_id", "type_name", "room_id", "room_number", "room_status", "assignment_id", "booking_id",
            "booking_status", "customer_name", "customer_phone", "check_in", "check_out",
            days(a, F.col("check_in")).alias("offset_days"), days(F.col("check_in"), F.col("check_out")).alias("length_days"),
        )
        .orderBy("type_name", "room_number", "check_in", "assignment_id", "room_id")
    )


def rooms_by_status(t: Mapping) -> DataFrame:
    """Rooms per hotel, type and state, one column per state."""
    counted = _rooms_with_type(t).groupBy("hotel_id", "type_name")
    return counted.agg(
        *[F.count_if(F.col("room_status") == s).alias(s.lower()) for s in ROOM_STATES], F.count(F.lit(1)).alias("rooms")
    )


def free_rooms(t: Mapping, req: DataFrame) -> DataFrame:
    """All rooms that could take each request (request_id, hotel_id, room_type_id, check_in, check_out).

    Only free rooms are listed: each request meets the gaps of its type and check-in day as arrays, not every room of the type.
    """
    found = fitting_gaps(t, req).select("request_id", "room_type_id", F.explode("gaps").alias("g"))
    # a stay without length can touch two gaps of a room
    return found.select("request_id", "room_type_id", "g.room_id", "g.room_number").distinct()


def first_free_room(t: Mapping, req: DataFrame) -> DataFrame:
    """The free room with the lowest number as text per request; requests without one are left out.

    A request meets one index row per block of rooms, and the first gap that holds its stay is the answer there.
    """
    first = fitting_gaps(t, req).withColumn("best", F.try_element_at("gaps", F.lit(1))).filter("best IS NOT NULL")
    best = first.groupBy("request_id", "room_type_id").agg(F.min(F.struct("best.room_number", "best.room_id")).alias("best"))
    return best.select("request_id", "room_type_id", "best.room_id", "best.room_number")


def first_overlap_per_room(t: Mapping) -> DataFrame:
    """Live assignments that start before an earlier one of the same room has ended."""
    a = t["room_assignments"].filter(live()).select(F.col("id").alias("assignment_id"), "booking_id", "room_id", "check_in", "check_out")
    run = running(
        a, ["room_id"], F.trunc(F.to_date("check_in"), "month"), ["check_in", "assignment_id"],
        {"busy_until": ("max", "check_out", None)}, inclusive=False,
    )
    return run.filter(F.col("busy_until") > F.col("check_in")).select(
        "assignment_id", "booking_id", "room_id", "check_in", "busy_until"
    )


def assignment_overlaps(t: Mapping) -> DataFrame:
    """How many other live assignments each assignment collides with, where any.

    Counted from sorted starts and ends (starts before my end, minus ends up to my
    start, minus myself), so colliding pairs are never listed, however many there are.
    """
    a = t["room_assignments"].filter(live() & (F.col("check_in") < F.col("check_out")))
    marks = F.array(
        F.struct(F.col("check_out").alias("at"), F.lit(0).alias("is_start")),
        F.struct(F.col("check_in").alias("at"), F.lit(1).alias("is_start")),
    )
    events = a.select(F.col("id").alias("assignment_id"), "room_id", F.explode(marks).alias("m")).select(
        "assignment_id", "room_id", "m.at", "m.is_start", (F.lit(1) - F.col("m.is_start")).alias("is_end")
    )
    run = running(
        events, ["room_id"], F.trunc(F.to_date("at"), "month"), ["at", "is_start", "assignment_id"],
        {"starts": ("sum", "is_start", 0), "ends": ("sum", "is_end", 0)}, inclusive=False,
    )
    counted = run.groupBy("assignment_id", "room_id").agg(
        (F.sum(F.when(F.col("is_end") == 1, F.col("starts"))) - F.sum(F.when(F.col("is_start") == 1, F.col("ends"))) - 1)
        .cast("bigint")
        .alias("n_overlaps")
    )
    return counted.filter("n_overlaps > 0")
