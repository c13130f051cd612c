"""Inventory per room type and night: demand, occupancy, availability."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from ..functions.calc import HOLDING_STATES, as_date, held_nights, in_period, percent
from ..functions.windows import running, seq_bucket


def build_inventory(t: Mapping, start, end) -> DataFrame:
    """Fresh inventory: rooms per type for each date of the range, nothing reserved."""
    rooms = t["rooms"].groupBy("room_type_id").agg(F.count(F.lit(1)).alias("n"))
    a, b = F.lit(as_date(start)), F.lit(as_date(end))
    days = F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<date>"))
    types = t["room_types"].select(F.col("id").alias("room_type_id"))
    return types.join(rooms, "room_type_id", "left").select(
        "room_type_id",
        F.explode(days).alias("date"),
        F.coalesce("n", F.lit(0)).cast("int").alias("total_inventory"),
        F.lit(0).alias("total_reserved"),
    )


def nightly_demand(t: Mapping, states=HOLDING_STATES) -> DataFrame:
    """Rooms held per type and night. Stays become nights, so no range join is needed."""
    stays = t["bookings"].filter(F.col("status").isin(list(states))).select(
        F.col("id").alias("booking_id"), held_nights().alias("held")
    )
    lines = t["booking_details"].select("booking_id", "room_type_id", "quantity")
    nights_held = lines.join(stays, "booking_id").select("room_type_id", F.explode("held").alias("date"), "quantity")
    return nights_held.groupBy("room_type_id", "date").agg(F.sum("quantity").alias("reserved"))


def nightly_reserved(t: Mapping, states=HOLDING_STATES) -> DataFrame:
    """The reserved count every inventory row should carry."""
    days = t["room_type_inventory"].select("room_type_id", "date")
    return days.join(nightly_demand(t, states), ["room_type_id", "date"], "left").select(
        "room_type_id", "date", F.coalesce("reserved", F.lit(0)).cast("bigint").alias("reserved")
    )


def daily_occupancy(t: Mapping) -> DataFrame:
    types = t["room_types"].select(F.col("id").alias("room_type_id"), "hotel_id", "type_name")
    return t["room_type_inventory"].join(types, "room_type_id").select(
        "hotel_id",
        "room_type_id",
        "type_name",
        "date",
        "total_inventory",
        "total_reserved",
        percent("total_reserved", "total_inventory", 2).alias("occupancy_rate"),
    )


def occupancy_bucket(rate="occupancy_rate"):
    """Heat level of a rate: 0, 25, 50, 75 or 100."""
    r = F.col(rate)
    return F.when(r > 75, 100).when(r > 50, 75).when(r > 25, 50).when(r > 0, 25).otherwise(0)


def occupancy_levels(t: Mapping) -> DataFrame:
    return daily_occupancy(t).select("room_type_id", "date", occupancy_bucket().alias("level"))


def availability_min(t: Mapping, start, end) -> DataFrame:
    """Smallest free count per type over the dates [start, end) that have inventory, and how many there are."""
    d = F.col("date")
    rows = t["room_type_inventory"].filter((d >= F.lit(as_date(start))) & (d < F.lit(as_date(end))))
    return rows.groupBy("room_type_id").agg(
        F.min(F.col("total_inventory") - F.col("total_reserved")).alias("min_free"), F.count(F.lit(1)).alias("days")
    )


def rooms_available(t: Mapping, start, end, hotel_id=None) -> DataFrame:
    """Rooms bookable per type for every night of [start, end).

    Missing dates are found by counting, so neither a cross join with the dates nor a
    row per (type, night) is made: the inventory is reduced per type before any shuffle.
    """
    n = (as_date(end) - as_date(start)).days
    types = t["room_types"]
    if hotel_id is not None:
        types = types.filter(F.col("hotel_id") == hotel_id)
    if n <= 0:
        types = types.filter(F.lit(False))
    types = types.select(F.col("id").alias("room_type_id"), "hotel_id", "type_name", "base_price")
    missing = F.coalesce(F.col("days"), F.lit(0)) < n
    return types.join(availability_min(t, start, end), "room_type_id", "left").select(
        "room_type_id",
        "hotel_id",
        "type_name",
        F.when(missing, 0).otherwise(F.col("min_free")).cast("int").alias("min_available"),
        "base_price",
        missing.alias("has_missing_dates"),
    )


def latest_occupancy_100(t: Mapping, as_of, period="all", room_type_id=None, n: int = 100) -> DataFrame:
    """The newest n occupancy rows (top-k, no global sort). Type id 0 means no filter."""
    rows = t["room_type_inventory"].filter(in_period("date", period, as_of))
    if room_type_id:
        rows = rows.filter(F.col("room_type_id") == room_type_id)
    view = daily_occupancy({"room_type_inventory": rows, "room_types": t["room_types"]})
    return view.orderBy(F.desc("date"), "room_type_id").limit(n)


def heatmap_long(t: Mapping, as_of, period="all", room_type_id=None, n_dates: int = 30) -> DataFrame:
    """Heat map cells: every type name x the earliest dates among the newest 100 rows, 0 where empty.

    Works on at most 100 rows, kept in one array; equal names of several types show the highest id.
    """
    cell = F.struct("type_name", "date", "room_type_id", "occupancy_rate")
    one = latest_occupancy_100(t, as_of, period, room_type_id).agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    grid = one.select(
        "cells", F.explode(F.expr("ARRAY_DISTINCT(TRANSFORM(cells, c -> c.type_name))")).alias("type_name")
    ).select(
        "cells",
        "type_name",
        F.explode(F.expr(f"SLICE(ARRAY_SORT(ARRAY_DISTINCT(TRANSFORM(cells, c -> c.date))), 1, {n_dates})")).alias("date"),
    )
    grid = grid.select(
        F.col("type_name").alias("row_name"), F.col("date").alias("day"), "cells"
    ).withColumn("hits", F.expr("FILTER(cells, c -> c.type_name = row_name AND c.date = day)"))
    rate = F.when(F.size("hits") > 0, F.expr("ELEMENT_AT(hits, -1).occupancy_rate")).otherwise(F.lit(0))
    return grid.select(F.col("row_name").alias("type_name"), F.col("day").alias("date"), rate.cast("decimal(18,2)").alias("rate"))


def heatmap_matrix(t: Mapping, as_of, period="all", room_type_id=None, n_dates: int = 30) -> DataFrame:
    """The heat map with one column per date; the dates (at most n_dates) are read first."""
    cells = heatmap_long(t, as_of, period, room_type_id, n_dates)
    dates = [str(r.date) for r in cells.select("date").distinct().orderBy("date").collect()]
    return cells.withColumn("date", F.col("date").cast("string")).groupBy("type_name").pivot("date", dates).agg(F.max("rate"))


def demand_running(t: Mapping, lines: DataFrame, inventory: DataFrame) -> DataFrame:
    """Running demand against free rooms per (type, night) in arrival order.

    ``lines``: seq, request_id, room_type_id, quantity, check_in, check_out. A line fits
    while the running demand stays within the free count; that is exact for every
    type and night up to its first misfit.
    """
    wanted = lines.select("seq", "request_id", "room_type_id", "quantity", F.explode(held_nights()).alias("date"))
    free = inventory.select("room_type_id", "date", (F.col("total_inventory") - F.col("total_reserved")).alias("free"))
    run = running(
        wanted, ["room_type_id", "date"], seq_bucket(), ["seq"], {"demand": ("sum", "quantity", 0)}, inclusive=True
    )
    return run.join(free, ["room_type_id", "date"], "left").select(
        "seq", "request_id", "room_type_id", "date", "quantity",
        F.col("demand").cast("bigint").alias("demand"),
        F.col("free").cast("bigint").alias("free"),
        F.coalesce(F.col("demand") <= F.col("free"), F.lit(False)).alias("fits"),
    )
