"""Whole flows: create bookings from requests, finalize with a repack of the hotel."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from ..functions.calc import BREAKFAST_PRICE, nights, timestamp
from ..operators.billing import booking_total, selection_merge, time_surcharges
from ..operators.changes import append_rows, update_from_join
from ..operators.reports import rooms_expected_vs_assigned
from ..session import cut_lineage, with_measured_joins
from .admission import _fit_columns, decide_rooms, defragment_rooms, inventory_after, new_assignments
from .bookings import booking_intake, finalize_bookings, new_bookings, release_bookings, without_time_surcharges
from .common import BAD_QUANTITY, DUPLICATE, NO_ROOM, NOT_FOUND, WRONG_TYPE, State, accepted, max_id, number_rows, patched, verdict
from .ordered import GROUP_ROWS

NO_SPOT = "no free room on the calendar"


@with_measured_joins
def create_bookings(t: Mapping, req: DataFrame, rooms: DataFrame, services: DataFrame, as_of, group_rows: int = GROUP_ROWS) -> State:
    """Create bookings from requests: intake, merged room lines, breakfast, nights, rooms, services.

    A request goes through with everything or leaves no trace, so the guards that do not depend on other
    requests are applied first and only the rest is admitted hotel by hotel in arrival order. A request that
    fails admission keeps its idempotency key for this batch: a retry belongs to the next batch.
    """
    opened = cut_lineage(booking_intake(t, req, as_of)["results"])
    stored = t["bookings"].select(
        F.col("id").alias("booking_id"), F.col("hotel_id").alias("b_hotel"), F.col("check_in").alias("b_in"), F.col("check_out").alias("b_out")
    )
    # a resumed booking keeps its stored hotel and stay
    asked = cut_lineage(
        opened.filter("accepted").select("request_id", "booking_id", "resumed").join(req, "request_id").join(stored, "booking_id", "left")
        .withColumns({"hotel_id": F.coalesce("b_hotel", "hotel_id"), "check_in": F.coalesce("b_in", "check_in"), "check_out": F.coalesce("b_out", "check_out")})
        .drop("b_hotel", "b_in", "b_out")
    )
    types = t["room_types"].select(F.col("id").alias("room_type_id"), F.col("hotel_id").alias("type_hotel"), "type_name", "base_price")
    merged = selection_merge(rooms).join(asked.select("request_id", "seq", "booking_id", "hotel_id", "check_in", "check_out"), "request_id")
    held = t["booking_details"].select("booking_id", "room_type_id", F.lit(True).alias("held")).distinct()
    merged = cut_lineage(merged.join(types, "room_type_id", "left").join(held, ["booking_id", "room_type_id"], "left"))
    bad_line = merged.groupBy("request_id").agg(
        F.when(F.min("quantity") <= 0, BAD_QUANTITY)
        .when(F.bool_or(~F.col("type_hotel").eqNullSafe(F.col("hotel_id"))), WRONG_TYPE)
        .when(F.bool_or("held"), DUPLICATE).alias("line_code")  # a resumed booking holds a room type once
    )
    sold = t["services"].select(F.col("id").alias("service_id"), F.lit(True).alias("sold"))
    bad_service = services.join(sold, "service_id", "left").groupBy("request_id").agg(
        F.when(F.bool_or(F.col("sold").isNull()), NOT_FOUND).when(F.min("quantity") <= 0, BAD_QUANTITY).alias("service_code")
    )
    judged = cut_lineage(
        opened.join(bad_line, "request_id", "left").join(bad_service, "request_id", "left")
        .withColumn("guard", F.coalesce("code", "line_code", "service_code")).select("seq", "request_id", "booking_id", "guard")
    )
    lines = merged.join(judged.filter("guard IS NULL").select("request_id"), "request_id", "left_semi").withColumnRenamed("booking_id", "ask_id")
    lines = lines.select("seq", "ask_id", "hotel_id", "room_type_id", "quantity", "check_in", "check_out")
    decided = decide_rooms(t, lines, t["room_type_inventory"], group_rows)
    codes = decided.filter("code IS NOT NULL").select(F.col("ask_id").alias("booking_id"), F.nullif("code", F.lit("OK")).alias("late"))
    judged = cut_lineage(judged.join(codes, "booking_id", "left").withColumn("code", F.coalesce("guard", "late")))
    won = cut_lineage(asked.join(accepted(judged).select("request_id"), "request_id", "left_semi"))
    ids = won.select("booking_id")
    now = timestamp(as_of)

    taken = merged.join(ids, "booking_id", "left_semi")
    new_details = taken.select(
        "booking_id", "room_type_id", F.col("base_price").alias("agreed_price"), "quantity", "is_breakfast_included"
    )
    new_details = cut_lineage(number_rows(new_details, max_id(t["booking_details"]), "booking_id", "room_type_id"))
    details = append_rows(t["booking_details"], _fit_columns(t["booking_details"], new_details))
    usage = services.join(won.select("request_id", "booking_id", "staff_id"), "request_id").withColumn("used_at", now)
    if "id" in t["service_usage"].columns:
        usage = number_rows(usage, max_id(t["service_usage"]), "booking_id", "service_id")
    usage = append_rows(t["service_usage"], _fit_columns(t["service_usage"], usage))

    # breakfast is charged per asked line, before lines of a type are merged
    eaters = rooms.filter("is_breakfast_included").join(won.select("request_id", "booking_id", "check_in", "check_out"), "request_id")
    meals = eaters.join(types.select("room_type_id", "type_name"), "room_type_id").select(
        "booking_id", "room_type_id", F.lit(0).alias("policy_id"), F.lit("Other").alias("surcharge_type"),
        (F.lit(BREAKFAST_PRICE) * F.col("quantity") * nights()).cast("decimal(18,2)").alias("amount"),
        F.concat(F.lit("Breakfast "), F.col("type_name")).alias("description"),
    )
    timed = time_surcharges(patched(t, bookings=won.withColumn("id", F.col("booking_id")), booking_details=details), ids)
    extra = meals.unionByName(timed.withColumnRenamed("detail_id", "room_type_id"))
    extra = number_rows(extra, max_id(t["booking_surcharges"]), "booking_id", "policy_id", "room_type_id", "amount").withColumn("created_at", now)
    old = t["booking_surcharges"]
    surcharges = append_rows(without_time_surcharges(old, ids), cut_lineage(_fit_columns(old, extra)))

    billed = patched(
        t, bookings=won.withColumn("id", F.col("booking_id")), booking_details=details, booking_surcharges=surcharges, service_usage=usage
    )
    totals = cut_lineage(booking_total(billed, ids).select(F.col("booking_id").alias("id"), F.col("total_amount").alias("due")))
    opened_rows = new_bookings(won.filter("NOT resumed"), as_of)
    bookings = update_from_join(
        append_rows(t["bookings"], _fit_columns(t["bookings"], opened_rows)), totals, ["id"],
        {"status": F.lit("Active"), "total_amount": F.col("due"), "updated_at": now},
    )
    placed = decided.filter("room_id IS NOT NULL").select(F.col("ask_id").alias("booking_id"), "room_type_id", "unit", "room_id")
    rows = new_assignments(t, placed.join(won.select("booking_id", "check_in", "check_out"), "booking_id"), as_of)
    return {
        "results": verdict(judged, "seq", "request_id", "booking_id"),
        "bookings": bookings,
        "booking_details": details,
        "booking_surcharges": surcharges,
        "service_usage": usage,
        "room_type_inventory": inventory_after(t["room_type_inventory"], taken),
        "room_assignments": append_rows(t["room_assignments"], _fit_columns(t["room_assignments"], rows)),
        "placed": placed,
        "totals": totals.select(F.col("id").alias("booking_id"), F.col("due").alias("total_amount")),
    }


def finalize_with_repack(t: Mapping, req: DataFrame, as_of, group_rows: int = GROUP_ROWS) -> State:
    """Finalize bookings, repack their hotels once, cancel the finalized bookings that got too few rooms.

    The repack runs once per batch over all touched hotels, not once per booking.
    """
    done = finalize_bookings(t, req, as_of)
    after = patched(t, bookings=cut_lineage(done["bookings"]), booking_surcharges=done["booking_surcharges"])
    ids = cut_lineage(done["results"].filter("accepted").select("booking_id"))
    hotels = after["bookings"].join(ids.withColumnRenamed("booking_id", "id"), "id", "left_semi").select("hotel_id")
    packed = defragment_rooms(after, hotels, as_of, group_rows)
    after = patched(after, room_assignments=cut_lineage(packed["room_assignments"]))
    own = {n: after[n].join(ids, "booking_id", "left_semi") for n in ("booking_details", "room_assignments")}
    short = cut_lineage(rooms_expected_vs_assigned(own).select("booking_id"))
    state = release_bookings(after, short.withColumn("reason", F.lit(NO_SPOT)), as_of)
    results = done["results"].join(short.withColumn("short", F.lit(True)), "booking_id", "left").withColumn(
        "code", F.when(F.col("accepted") & F.col("short"), NO_ROOM).otherwise(F.col("code"))
    )
    return {"results": verdict(results, "seq", "booking_id"), "booking_surcharges": done["booking_surcharges"], **state}
