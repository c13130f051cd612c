"""Order-dependent jobs: reserving nights, assigning rooms, repacking a hotel, moving bookings."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from ..functions.calc import BREAKFAST_PRICE, held_nights, live, timestamp
from ..functions.windows import seq_bucket
from ..operators.changes import append_rows, update_from_join
from ..session import cut_lineage, with_measured_joins
from .common import (
    BAD_QUANTITY, BLOCK_DAYS, DUPLICATE, NO_INVENTORY, NOT_FOUND, OVERBOOKED, ROOM_TAKEN, WRONG_TYPE,
    State, accepted, in_runs, max_id, number_rows, reach, runs, state_code, verdict, with_booking, with_run, within_reach,
)
from .ordered import ASK, BUSY, CELL, GROUP_ROWS, ROOM, Admit, AdmitNights, Claim, Place, as_rows, day_number, decide_in_order, micros

SEQ_ORDER = ["seq", "ask_id"]
ALWAYS_OK = "OK"
DAY_US = 86_400_000_000


def _span(**more) -> dict:
    return dict(
        first_day=day_number(F.to_date("check_in")), last_day=day_number(F.to_date("check_out")),
        start_us=micros("check_in"), end_us=micros("check_out"), **more,
    )


def _room_rows(t: Mapping, hotels_of_runs: DataFrame, group: list[str]) -> DataFrame:
    rooms = t["rooms"].select("hotel_id", "room_type_id", F.col("id").alias("room_id"), "room_number")
    joined = rooms.join(hotels_of_runs, group[:-1])
    return as_rows(joined, ROOM, group, **{c: F.col(c) for c in ("room_type_id", "room_id", "room_number")})


def _busy_rows(stays: DataFrame, run_days: DataFrame, group: list[str]) -> DataFrame:
    """Busy spans (room_id, check_in, check_out and the group's keys) per run; copies of a span count once."""
    spans = in_runs(stays.select(*group[:-1], "room_id", "check_in", "check_out"), run_days, group[:-1])
    return as_rows(spans, BUSY, group, room_id=F.col("room_id"), start_us=micros("check_in"), end_us=micros("check_out"))


def _live(t: Mapping) -> DataFrame:
    return t["room_assignments"].filter(live()).select("id", "booking_id", "room_id", "check_in", "check_out")


def _with_room(t: Mapping, stays: DataFrame) -> DataFrame:
    return stays.join(t["rooms"].select(F.col("id").alias("room_id"), "hotel_id", "room_type_id"), "room_id")


# ---------------------------------------------------------------- reserving nights


def night_demand(lines: DataFrame) -> DataFrame:
    return lines.select("seq", "ask_id", "hotel_id", "room_type_id", "quantity", F.explode(held_nights()).alias("date"))


def with_free(nights: DataFrame, inventory: DataFrame) -> DataFrame:
    """Nights with the free count of their cell, null where there is no inventory."""
    free = inventory.select("room_type_id", "date", (F.col("total_inventory") - F.col("total_reserved")).alias("free"))
    return nights.join(free, ["room_type_id", "date"], "left")


def impossible_asks(nights: DataFrame) -> DataFrame:
    """Asks that fail whatever the others do: a night without inventory, or fewer free rooms than asked.

    The code is the one of the first such (room type, night).
    """
    bad = nights.filter("free IS NULL OR free < quantity")
    code = F.when(F.col("free").isNull(), NO_INVENTORY).otherwise(OVERBOOKED)
    return bad.groupBy("ask_id").agg(F.min_by(code, F.struct("room_type_id", "date")).alias("fixed_code"))


def admit_nights(lines: DataFrame, inventory: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Decide every ask (ask_id, code) by inventory alone, in arrival order.

    ``lines``: seq, ask_id, hotel_id, room_type_id, quantity, check_in, check_out, one row per ask and type.
    Only asks that meet a contended night (total possible demand above the free count) depend on the
    order and go to the ordered step; all others are decided by joins and sums. The asked nights are
    joined with the inventory once and written, as everything below reads them.
    """
    nights = cut_lineage(with_free(night_demand(lines), inventory))
    never = impossible_asks(nights)
    wanted = nights.join(never, "ask_id", "left_anti")
    cells = wanted.groupBy("hotel_id", "room_type_id", "date").agg(F.sum("quantity").alias("demand"), F.first("free").alias("free"))
    tight = cut_lineage(cells.filter("demand > free").drop("demand"))
    ordered_asks = wanted.join(tight, ["room_type_id", "date"], "left_semi").select("ask_id").distinct()
    rows = lines.join(ordered_asks, "ask_id", "left_semi")
    group = ["hotel_id", "run"]
    run_days = cut_lineage(runs(rows, ["hotel_id"]))
    asks = as_rows(
        with_run(rows, run_days, ["hotel_id"]), ASK, group,
        **_span(**{c: F.col(c) for c in ("seq", "ask_id", "room_type_id", "quantity")}),
    )

    cells = tight.withColumnRenamed("date", "day").join(run_days, ["hotel_id", "day"])
    state = as_rows(cells, CELL, group, room_type_id=F.col("room_type_id"), first_day=day_number("day"), free=F.col("free"))
    decided = decide_in_order(asks, state, group, SEQ_ORDER, seq_bucket(), AdmitNights, group_rows)
    late = decided.select("ask_id", F.nullif("code", F.lit(ALWAYS_OK)).alias("late_code"))
    failed = never.withColumnRenamed("fixed_code", "code").unionByName(late.filter("late_code IS NOT NULL").withColumnRenamed("late_code", "code"))
    return lines.select("ask_id").distinct().join(failed, "ask_id", "left")


def inventory_after(inventory: DataFrame, lines: DataFrame, sign: int = 1) -> DataFrame:
    """Inventory with the held nights of ``lines`` added, or released (never below 0)."""
    change = (
        lines.select("room_type_id", F.explode(held_nights()).alias("date"), "quantity")
        .groupBy("room_type_id", "date").agg(F.sum("quantity").alias("_n"))
    )
    reserved = F.greatest(F.col("total_reserved") + F.lit(sign) * F.coalesce("_n", F.lit(0)), F.lit(0)).cast("int")
    return inventory.join(change, ["room_type_id", "date"], "left").withColumn("total_reserved", reserved).select(*inventory.columns)


def reserve_inventory(t: Mapping, req: DataFrame, as_of=None, group_rows: int = GROUP_ROWS, breakfast_in_price: bool = False) -> State:
    """Reserve nights for the room lines of Pending bookings, all lines of a booking or none.

    ``req``: seq, booking_id, room_type_id, quantity, is_breakfast_included. A booking holds a room type once: a type
    asked for in two lines, or stored already, is refused (DUPLICATE). Details take the base price; with
    ``breakfast_in_price`` those with breakfast take it on top.
    A booking arrives with its first line and asks for types of its own hotel. For asks that cannot succeed
    at all the code names the first impossible night; asks that lose to earlier ones get OVERBOOKING.
    """
    hotel_of = t["room_types"].select(F.col("id").alias("room_type_id"), F.col("hotel_id").alias("type_hotel"))
    heads = req.join(hotel_of, "room_type_id", "left").groupBy("booking_id").agg(
        F.min("seq").alias("seq"), (F.min("quantity") <= 0).alias("bad_quantity"),
        F.min("type_hotel").alias("low"), F.max("type_hotel").alias("high"), F.count_if(F.col("type_hotel").isNull()).alias("unknown"),
    )
    pair = ["booking_id", "room_type_id"]
    held = t["booking_details"].select(*pair).join(req.select(*pair), pair, "left_semi")
    twice = req.select(*pair).unionByName(held).groupBy(*pair).count().filter("count > 1").select("booking_id").distinct()
    heads = heads.join(twice.withColumn("twice", F.lit(True)), "booking_id", "left")
    own = (F.col("low") == F.col("b_hotel_id")) & (F.col("high") == F.col("b_hotel_id")) & (F.col("unknown") == 0)
    guarded = with_booking(heads, t, "status", "hotel_id", "check_in", "check_out").withColumn(
        "guard", F.coalesce(state_code(["Pending"]), F.when(F.col("bad_quantity"), BAD_QUANTITY), *([F.when(F.col("unknown") > 0, NOT_FOUND)] if breakfast_in_price else []),
            F.when(~F.coalesce(own, F.lit(False)), WRONG_TYPE), F.when(F.col("twice"), DUPLICATE))
    )
    stays = guarded.filter(F.col("guard").isNull()).select(
        "seq", "booking_id", F.col("b_hotel_id").alias("hotel_id"), F.col("b_check_in").alias("check_in"), F.col("b_check_out").alias("check_out")
    )
    lines = cut_lineage(
        req.select("booking_id", "room_type_id", "quantity").join(stays, "booking_id").withColumnRenamed("booking_id", "ask_id")
    )
    codes = admit_nights(lines, t["room_type_inventory"], group_rows).withColumnRenamed("ask_id", "booking_id")
    judged = guarded.join(codes, "booking_id", "left").withColumn("code", F.coalesce("guard", "code"))
    won = accepted(judged).select("booking_id")
    taken = lines.withColumnRenamed("ask_id", "booking_id").join(won, "booking_id", "left_semi")
    base = t["room_types"].select(F.col("id").alias("room_type_id"), "base_price")
    price = F.col("base_price")
    if breakfast_in_price:
        meal = F.when(F.col("is_breakfast_included"), F.lit(BREAKFAST_PRICE)).otherwise(F.lit(0))
        price = (price + meal).cast("decimal(18,2)")
    details = (
        req.join(won, "booking_id", "left_semi").join(base, "room_type_id")
        .select("booking_id", "room_type_id", price.alias("agreed_price"), "quantity", "is_breakfast_included")
    )
    details = number_rows(details, max_id(t["booking_details"]), "booking_id", "room_type_id")
    return {
        "results": verdict(judged, "seq", "booking_id"),
        "room_type_inventory": inventory_after(t["room_type_inventory"], taken),
        "booking_details": append_rows(t["booking_details"], details),
    }


def add_room_lines(t: Mapping, req: DataFrame, as_of=None, group_rows: int = GROUP_ROWS) -> State:
    """Add room lines to Pending bookings, breakfast in the price; an unknown room type is NOT_FOUND."""
    return reserve_inventory(t, req, as_of, group_rows, breakfast_in_price=True)


# ---------------------------------------------------------------- assigning rooms


def decide_rooms(t: Mapping, lines: DataFrame, cells: DataFrame | None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Admit asks hotel by hotel with nights (``cells``: inventory, or None) and physical rooms together.

    Returns one row per placed room and one per ask with its code.
    """
    group = ["hotel_id", "run"]
    lines = cut_lineage(lines)
    bounds = reach(lines)
    stored = within_reach(_live(t), bounds)
    run_days = cut_lineage(runs(lines, ["hotel_id"]))
    asks = as_rows(
        with_run(lines, run_days, ["hotel_id"]), ASK, group,
        **_span(**{c: F.col(c) for c in ("seq", "ask_id", "room_type_id", "quantity")}),
    )
    run_heads = run_days.select(*group).distinct()

    spans = _with_room(t, stored).select("hotel_id", "room_id", "check_in", "check_out")
    state = _room_rows(t, run_heads, group).unionByName(_busy_rows(spans, run_days, group))
    if cells is not None:
        # every asked night is listed, so one without inventory is seen as such
        asked = night_demand(lines).select("hotel_id", "room_type_id", "date").distinct()
        free = with_free(asked, cells).withColumn("free", F.coalesce("free", F.lit(-1))).withColumnRenamed("date", "day").join(run_days, ["hotel_id", "day"])
        state = state.unionByName(as_rows(free, CELL, group, room_type_id=F.col("room_type_id"), first_day=day_number("day"), free=F.col("free")))
    return decide_in_order(asks, state, group, SEQ_ORDER, seq_bucket(), Admit, group_rows)


def new_assignments(t: Mapping, placed: DataFrame, as_of) -> DataFrame:
    """Rows for room_assignments from (booking_id, room_id, check_in, check_out), with ids after the known ones."""
    rows = placed.select("booking_id", "room_id", "check_in", "check_out")
    rows = number_rows(rows, max_id(t["room_assignments"]), "booking_id", "room_id", "check_in")
    return rows.withColumn("is_cancelled", F.lit(False)).withColumn("assigned_at", timestamp(as_of))


def _fit_columns(target: DataFrame, rows: DataFrame) -> DataFrame:
    return rows.select(*[c for c in target.columns if c in rows.columns])


@with_measured_joins
def assign_rooms_first_fit(t: Mapping, req: DataFrame, as_of, group_rows: int = GROUP_ROWS) -> State:
    """Give each requested booking (seq, booking_id) its rooms: lowest free number first, all rooms or none."""
    first = req.groupBy("booking_id").agg(F.min("seq").alias("seq"))
    judged = cut_lineage(with_booking(first, t, "hotel_id", "check_in", "check_out").withColumn("guard", F.when(F.col("b_id").isNull(), NOT_FOUND)))
    stays = judged.filter(F.col("guard").isNull()).selectExpr(
        "seq", "booking_id", "b_hotel_id AS hotel_id", "b_check_in AS check_in", "b_check_out AS check_out"
    )
    lines = stays.join(t["booking_details"].select("booking_id", "room_type_id", "quantity"), "booking_id").withColumnRenamed("booking_id", "ask_id")
    decided = decide_rooms(t, lines, None, group_rows)
    codes = decided.filter("code IS NOT NULL").select(F.col("ask_id").alias("booking_id"), F.nullif("code", F.lit(ALWAYS_OK)).alias("late"))
    placed = decided.filter("room_id IS NOT NULL").select(F.col("ask_id").alias("booking_id"), "room_id")
    rows = new_assignments(t, placed.join(stays, "booking_id"), as_of)
    old = t["room_assignments"]
    results = cut_lineage(verdict(judged.join(codes, "booking_id", "left").withColumn("code", F.coalesce("guard", "late")), "seq", "booking_id"))
    return {"results": results, "room_assignments": append_rows(old, _fit_columns(old, rows)), "placed": placed}


# ---------------------------------------------------------------- repacking


def defragment_rooms(t: Mapping, hotel_ids: DataFrame, as_of, group_rows: int = GROUP_ROWS) -> State:
    """Drop the assignments of Active bookings in the given hotels and place them again, first-fit by check-in.

    Room types are independent, and so are runs of days within a type. Room state does not matter.
    The cancelled assignments stay as rows; ``unplaced`` lists units without a room.
    """
    hotels = hotel_ids.select("hotel_id").distinct()
    types = t["room_types"].join(hotels, "hotel_id", "left_semi").select(F.col("id").alias("room_type_id"), F.col("hotel_id").alias("type_hotel"))
    active = t["bookings"].filter("status = 'Active'").select(F.col("id").alias("booking_id"), "hotel_id", "check_in", "check_out")
    stays = (
        t["booking_details"].select("booking_id", "room_type_id", "quantity").join(types, "room_type_id")
        .join(active, "booking_id").filter("type_hotel = hotel_id")
    )
    group = ["key", "run"]
    keyed = lambda df: df.withColumn("key", F.col("room_type_id"))
    stays = cut_lineage(keyed(stays))
    in_scope = _with_room(t, _live(t)).join(types, "room_type_id")
    dropped = in_scope.join(active.select("booking_id"), "booking_id", "left_semi")
    near = _with_room(t, within_reach(_live(t), reach(stays))).join(types, "room_type_id")
    pinned = keyed(near.join(active.select("booking_id"), "booking_id", "left_anti"))
    run_days = cut_lineage(runs(stays, ["key"]))
    asks = as_rows(
        with_run(stays, run_days, ["key"]), ASK, group, ask_id=F.col("booking_id"), room_type_id=F.col("room_type_id"),
        quantity=F.col("quantity"), start_us=micros("check_in"), end_us=micros("check_out"),
    )
    rooms = t["rooms"].select(F.col("id").alias("room_id"), "room_type_id", "hotel_id", "room_number").join(types, "room_type_id")
    rooms = keyed(rooms.filter("type_hotel = hotel_id"))

    known = as_rows(
        rooms.join(run_days.select(*group).distinct(), "key"), ROOM, group,
        **{c: F.col(c) for c in ("room_type_id", "room_id", "room_number")},
    )
    state = known.unionByName(_busy_rows(pinned.select("key", "room_id", "check_in", "check_out"), run_days, group))
    decided = decide_in_order(asks, state, group, ["start_us", "ask_id"], F.floor(F.col("start_us") / DAY_US).cast("bigint"), Place, group_rows)
    spots = decided.select(F.col("ask_id").alias("booking_id"), "room_type_id", "unit", "room_id")
    placed = spots.filter("room_id IS NOT NULL").join(
        stays.select("booking_id", "room_type_id", "check_in", "check_out"), ["booking_id", "room_type_id"]
    )
    old = update_from_join(t["room_assignments"], dropped.select("id"), ["id"], {"is_cancelled": F.lit(True)})
    rows = new_assignments(t, placed, as_of)
    return {
        "room_assignments": append_rows(old, _fit_columns(old, rows)),
        "placed": placed.select("booking_id", "room_type_id", "unit", "room_id"),
        "unplaced": spots.filter("room_id IS NULL").select("booking_id", "room_type_id", "unit"),
    }


# ---------------------------------------------------------------- moving bookings


def pre_assign_rooms(t: Mapping, moves: DataFrame, as_of, group_rows: int = GROUP_ROWS) -> State:
    """Move Active bookings to named rooms (seq, booking_id, from_room_id, to_room_id).

    A move meets the live assignments before the batch (except the one it gives up) and the moves
    accepted earlier in the batch. A room given up in this batch is free for the next batch only.
    """
    kinds = t["rooms"].select(F.col("id").alias("to_room_id"), F.col("room_type_id").alias("to_type"))
    booked = t["booking_details"].select("booking_id", F.col("room_type_id").alias("to_type"), F.lit(True).alias("fits"))
    # narrow rows meet the large tables first, and the guarded moves are written once: all further steps read them
    asked = moves.join(kinds, "to_room_id", "left").join(booked, ["booking_id", "to_type"], "left")
    guarded = with_booking(asked, t, "status", "check_in", "check_out").withColumn(
        "guard", F.coalesce(state_code(["Active"]), F.when(F.col("fits").isNull(), WRONG_TYPE))
    )
    guarded = cut_lineage(guarded.select("seq", "booking_id", "from_room_id", "to_room_id", "b_check_in", "b_check_out", "guard"))
    # a refused guard is the verdict; only the others meet stored stays and each other
    waiting = guarded.filter("guard IS NULL").drop("guard")
    fine = waiting.select(
        "seq", "booking_id", F.col("from_room_id"), F.col("to_room_id").alias("room_id"),
        F.col("b_check_in").alias("check_in"), F.col("b_check_out").alias("check_out"),
    )
    blocked = cut_lineage(overlapping(fine, within_reach(_live(t), reach(fine))))
    open_moves = fine.join(blocked, "seq", "left_anti")
    group = ["key", "run"]
    open_moves = open_moves.withColumn("key", F.col("room_id"))
    run_days = cut_lineage(runs(open_moves, ["key"]))
    asks = as_rows(
        with_run(open_moves, run_days, ["key"]), ASK, group, seq=F.col("seq"), ask_id=F.col("seq"),
        room_id=F.col("room_id"), start_us=micros("check_in"), end_us=micros("check_out"),
    )

    # moves meet each other only: stored stays are settled above
    state = as_rows(open_moves.filter(F.lit(False)).join(run_days, "key"), BUSY, group)
    decided = decide_in_order(asks, state, group, SEQ_ORDER, seq_bucket(), Claim, group_rows)
    late = decided.select(F.col("ask_id").alias("seq"), F.nullif("code", F.lit(ALWAYS_OK)).alias("late"))
    decided = cut_lineage(
        waiting.join(blocked.withColumn("hit", F.lit(ROOM_TAKEN)), "seq", "left").join(late, "seq", "left")
        .withColumn("code", F.coalesce("hit", "late")).drop("hit", "late")
    )
    judged = guarded.filter("guard IS NOT NULL").withColumnRenamed("guard", "code").unionByName(decided)
    won = accepted(judged)
    given_up = won.filter("from_room_id IS NOT NULL").select("booking_id", F.col("from_room_id").alias("room_id")).distinct()
    old = t["room_assignments"]
    ids = old.filter(live()).join(given_up, ["booking_id", "room_id"], "left_semi").select("id")
    kept = update_from_join(old, ids, ["id"], {"is_cancelled": F.lit(True)})
    rows = new_assignments(
        t, won.select("booking_id", F.col("to_room_id").alias("room_id"), F.col("b_check_in").alias("check_in"), F.col("b_check_out").alias("check_out")), as_of
    )
    return {"results": verdict(judged, "seq", "booking_id", "to_room_id"), "room_assignments": append_rows(kept, _fit_columns(old, rows))}


def overlapping(asked: DataFrame, stored: DataFrame) -> DataFrame:
    """Distinct ``seq`` of asks (seq, booking_id, room_id, check_in, check_out[, from_room_id]) that meet a stored stay.

    Both sides meet on (room, block of days) and a pair counts on its first common block only. The stay an ask gives up does not count.
    """
    def blocks(check_in="check_in", check_out="check_out"):
        a, b = (F.floor(day_number(F.to_date(c)) / BLOCK_DAYS).cast("int") for c in (check_in, check_out))
        return F.when(F.to_date(check_in) <= F.to_date(check_out), F.sequence(a, b)).otherwise(F.array().cast("array<int>"))

    with_from = "from_room_id" in asked.columns
    a = stored.select(
        "room_id", *([F.col("booking_id").alias("s_booking")] if with_from else []), F.col("check_in").alias("s_in"), F.col("check_out").alias("s_out")
    )
    a = a.withColumn("block", F.explode(blocks("s_in", "s_out")))
    given = [F.col("from_room_id").alias("_from"), "booking_id"] if with_from else []
    q = asked.select("seq", "room_id", "check_in", "check_out", *given).withColumn("block", F.explode(blocks()))
    first = F.floor(F.greatest(day_number(F.to_date("s_in")), day_number(F.to_date("check_in"))) / BLOCK_DAYS)
    met = q.join(a, ["room_id", "block"]).filter(
        (F.col("s_in") < F.col("check_out")) & (F.col("check_in") < F.col("s_out")) & (F.col("block") == first)
    )
    if with_from:
        met = met.filter(~((F.col("s_booking") == F.col("booking_id")) & F.col("room_id").eqNullSafe(F.col("_from"))))
    return met.select("seq").distinct()
