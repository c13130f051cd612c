"""Front desk jobs: check-in, check-out, housekeeping."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from ..functions.calc import OPEN_STATES, live, timestamp
from ..operators.billing import booking_total
from ..operators.changes import append_rows, update_from_join
from ..session import cut_lineage
from .admission import new_assignments, overlapping
from .common import (
    BAD_CUT, BAD_STATE, NOT_DIRTY, NOT_FOUND, ROOM_BUSY, ROOM_TAKEN, State, accepted, first_wins, reach, state_code, verdict, with_booking, within_reach,
)

PAID_ABOVE_TOTAL = "PAID_ABOVE_TOTAL"


def _staff_of(df: DataFrame, key: str) -> DataFrame:
    """Who acted last per key; one row per key."""
    return df.groupBy(key).agg(F.max_by("staff_id", "seq").alias("staff_id"))


def check_in_batch(t: Mapping, req: DataFrame, as_of) -> State:
    """Hand out rooms (seq, booking_id, room_id, staff_id).

    Only Available rooms can be given out and each at most once per batch, so the first arrival that
    passes all other guards gets the room. A room the booking was not assigned to is assigned now,
    if no other stay holds it.
    """
    rooms = t["rooms"].select(F.col("id").alias("room_id"), F.col("status").alias("room_status"))
    stored = t["room_assignments"].filter(live()).select("booking_id", "room_id", "check_in", "check_out")
    assigned = stored.select("booking_id", "room_id").distinct().withColumn("assigned", F.lit(True))
    # narrow rows meet the large tables first, and the guarded requests are written once: all further steps read them
    asked = req.join(assigned, ["booking_id", "room_id"], "left").join(rooms, "room_id", "left")
    guarded = with_booking(asked, t, "status", "check_in", "check_out").withColumn(
        "guard", F.coalesce(state_code(OPEN_STATES), F.when(~F.col("room_status").eqNullSafe(F.lit("Available")), ROOM_BUSY))
    )
    guarded = cut_lineage(guarded.select("seq", "booking_id", "room_id", "staff_id", "b_check_in", "b_check_out", "assigned", "guard"))
    # a refused guard is the verdict; only the others meet stored stays and each other
    waiting = guarded.filter("guard IS NULL").drop("guard")
    to_assign = waiting.filter("assigned IS NULL").select(
        "seq", "booking_id", "room_id", F.col("b_check_in").alias("check_in"), F.col("b_check_out").alias("check_out")
    )
    taken = overlapping(to_assign, within_reach(stored, reach(to_assign))).withColumn("hit", F.lit(ROOM_TAKEN))
    waiting = cut_lineage(waiting.join(taken, "seq", "left"))
    given = waiting.filter("hit IS NULL").groupBy("room_id").agg(F.min("seq").alias("given_at"))
    late = F.when(F.col("seq") > F.col("given_at"), ROOM_BUSY)
    decided = waiting.join(given, "room_id", "left").withColumn("code", F.coalesce(late, "hit")).drop("hit", "given_at")
    judged = guarded.filter("guard IS NOT NULL").withColumnRenamed("guard", "code").unionByName(decided)
    won = accepted(judged)
    now = timestamp(as_of)
    added = won.filter("assigned IS NULL").select(
        "booking_id", "room_id", F.col("b_check_in").alias("check_in"), F.col("b_check_out").alias("check_out")
    )
    old = t["room_assignments"]
    rows = new_assignments(t, added, as_of)
    room_staff = _staff_of(won, "room_id").withColumnRenamed("room_id", "id")
    booking_staff = _staff_of(won, "booking_id").withColumnRenamed("booking_id", "id")
    changes = {"updated_by": F.col("staff_id"), "updated_at": now}
    return {
        "results": verdict(judged, "seq", "booking_id", "room_id"),
        "rooms": update_from_join(t["rooms"], room_staff, ["id"], {"status": F.lit("Occupied"), **changes}),
        "bookings": update_from_join(t["bookings"], booking_staff, ["id"], {"status": F.lit("Checked-in"), **changes}),
        "room_assignments": append_rows(old, rows.select(*[c for c in old.columns if c in rows.columns])),
    }


def check_out_batch(t: Mapping, req: DataFrame, as_of) -> State:
    """Close Checked-in bookings (seq, booking_id, staff_id): final total, rooms to clean, stays cut to now.

    A booking with an assignment that has not begun cannot be cut (ASSIGNMENT_PERIOD) and stays as it is.
    """
    now = timestamp(as_of)
    checked = with_booking(req, t, "status", "amount_paid").withColumn("guard", state_code(["Checked-in"]))
    ids = checked.filter("guard IS NULL").select("booking_id").distinct()
    mine = t["room_assignments"].filter(live()).join(ids, "booking_id", "left_semi")
    uncut = mine.filter((F.col("check_out") > now) & (F.col("check_in") >= now)).select("booking_id").distinct().withColumn("uncut", F.lit(True))
    totals = booking_total(t, ids).select("booking_id", F.col("total_amount").alias("due"))
    judged = (
        checked.join(uncut, "booking_id", "left").join(totals, "booking_id", "left")
        .withColumn("code", F.coalesce("guard", F.when(F.col("b_amount_paid") > F.col("due"), PAID_ABOVE_TOTAL), F.when(F.col("uncut"), BAD_CUT)))
    )
    judged = first_wins(judged, ["booking_id"], BAD_STATE)
    won = accepted(judged).select("seq", "booking_id", "staff_id", "due")
    closed = mine.join(won.select("booking_id", "staff_id", "seq"), "booking_id")
    room_staff = _staff_of(closed, "room_id").withColumnRenamed("room_id", "id")
    cut = closed.filter(F.col("check_out") > now).select("id")
    by = {"updated_by": F.col("staff_id"), "updated_at": now}
    done = won.select(F.col("booking_id").alias("id"), "staff_id", "due")
    return {
        "results": verdict(judged, "seq", "booking_id"),
        "bookings": update_from_join(t["bookings"], done, ["id"], {"status": F.lit("Completed"), "total_amount": F.col("due"), **by}),
        "rooms": update_from_join(t["rooms"], room_staff, ["id"], {"status": F.lit("Dirty"), **by}),
        "room_assignments": update_from_join(t["room_assignments"], cut, ["id"], {"check_out": now}),
    }


def housekeeping_batch(t: Mapping, req: DataFrame, as_of) -> State:
    """Dirty rooms become Available (seq, room_id, staff_id)."""
    rooms = t["rooms"].select(F.col("id").alias("room_id"), F.col("status").alias("room_status"), F.lit(True).alias("known"))
    code = F.when(F.col("known").isNull(), NOT_FOUND).when(~F.col("room_status").eqNullSafe(F.lit("Dirty")), NOT_DIRTY)
    judged = first_wins(req.join(rooms, "room_id", "left").withColumn("code", code), ["room_id"], NOT_DIRTY)
    done = accepted(judged).select(F.col("room_id").alias("id"), "staff_id")
    return {
        "results": verdict(judged, "seq", "room_id"),
        "rooms": update_from_join(
            t["rooms"], done, ["id"], {"status": F.lit("Available"), "updated_by": F.col("staff_id"), "updated_at": timestamp(as_of)}
        ),
    }
