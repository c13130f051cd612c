"""When rooms are free: the maximal free spans of each room, and an index of them by type and day."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.calc import live, timestamp
from ..functions.windows import running
from ..session import cut_lineage

# A room without an earlier or a later stay is free from or to these moments.
EVER, NEVER = "0001-01-01 00:00:00", "9999-12-31 00:00:00"
ROOM_STAYS = 1_000_000  # stays of one room that a task sorts; a room with more is worked out month by month
BLOCK_ROOMS = 256  # rooms that one index row lists at most, but for uneven hashing


def _crowded(stays: DataFrame, stored: DataFrame) -> bool:
    """Whether a room has more stays than one task should sort; a small table (its row count is in the files) settles it at once."""
    return stored.count() > ROOM_STAYS and stays.groupBy("room_id").count().agg(F.max("count")).first()[0] > ROOM_STAYS


def room_gaps(t: Mapping, since=None, until=None) -> DataFrame:
    """(room_id, free_from, free_to): the maximal spans in which no live assignment holds the room.

    A gap ends where the next stay starts and begins where all earlier ones have ended, so overlapping stays leave none;
    stays that follow each other at once leave an empty gap, which a stay without length still fits. ``since`` and ``until``
    leave out stays that end before or start after them; gaps are then right in between only. Rooms without any stay are not
    listed. Where one room has most of the stays, the running end is worked out month by month, so no task holds them all.
    """
    stays = t["room_assignments"].filter(live() & F.col("check_in").isNotNull() & F.col("check_out").isNotNull())
    if since is not None:
        stays = stays.filter((F.col("check_out") > F.lit(since)) & (F.col("check_in") < F.lit(until)))
    stays = stays.select("id", "room_id", "check_in", "check_out")
    order = ["check_in", "id"]
    if not _crowded(stays, t["room_assignments"]):
        w = Window.partitionBy("room_id").orderBy(*order)
        until_here = stays.withColumns({
            "busy_until": F.max("check_out").over(w.rowsBetween(Window.unboundedPreceding, -1)), "_next": F.lead("id").over(w),
        })
        before = F.when(F.col("busy_until").isNull() | (F.col("busy_until") <= F.col("check_in")), F.struct(
            F.coalesce("busy_until", timestamp(EVER)).alias("free_from"), F.col("check_in").alias("free_to")))
        after = F.when(F.col("_next").isNull(), F.struct(
            F.greatest("busy_until", "check_out").alias("free_from"), timestamp(NEVER).alias("free_to")))
        return until_here.select("room_id", F.explode(F.array_compact(F.array(before, after))).alias("g")).select("room_id", "g.*")
    run = running(stays, ["room_id"], F.trunc(F.to_date("check_in"), "month"), order, {"busy_until": ("max", "check_out", None)}, inclusive=False)
    before = run.filter("busy_until IS NULL OR busy_until <= check_in").select(
        "room_id", F.coalesce("busy_until", timestamp(EVER)).alias("free_from"), F.col("check_in").alias("free_to")
    )
    after = stays.groupBy("room_id").agg(F.max("check_out").alias("free_from")).withColumn("free_to", timestamp(NEVER))
    return before.unionByName(after)


def _blocks(t: Mapping) -> DataFrame:
    """Rooms with the block of their type that they belong to; blocks bound what one index row lists."""
    rooms = t["rooms"].select(F.col("id").alias("room_id"), "hotel_id", "room_type_id", "room_number")
    sizes = rooms.groupBy("hotel_id", "room_type_id").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROOMS).alias("_blocks"))
    return rooms.join(sizes, ["hotel_id", "room_type_id"]).withColumn("block", F.pmod(F.xxhash64("room_id"), "_blocks")).drop("_blocks")


def gap_index(t: Mapping, req: DataFrame) -> DataFrame:
    """(hotel_id, room_type_id, day, block, gaps) for every type and check-in day in ``req``.

    ``gaps`` holds (room_number, room_id, free_from, free_to) of the rooms that are free at some time of that day, ordered by number. Gaps are cut
    to the days asked for, which come as one short array per type, so free months are not spread over their days.
    """
    since, until = req.agg(F.min("check_in"), F.max(F.greatest("check_in", "check_out"))).first()
    rooms = _blocks(t)
    days = req.groupBy("hotel_id", "room_type_id").agg(F.collect_set(F.to_date("check_in")).alias("days"))
    placed = rooms.join(days, ["hotel_id", "room_type_id"])
    gaps = room_gaps(t, since, until)
    # rooms that no stay holds are free throughout
    held = placed.join(gaps, "room_id", "left").withColumns(
        {"free_from": F.coalesce("free_from", timestamp(EVER)), "free_to": F.coalesce("free_to", timestamp(NEVER))}
    )
    held = held.withColumns({"_first": F.to_date("free_from"), "_last": F.to_date("free_to")})
    met = F.filter("days", lambda d: (d >= F.col("_first")) & (d <= F.col("_last")))
    entry = F.struct("room_number", "room_id", "free_from", "free_to")
    return held.withColumn("day", F.explode(met)).groupBy("hotel_id", "room_type_id", "day", "block").agg(F.sort_array(F.collect_list(entry)).alias("gaps"))


def fitting_gaps(t: Mapping, req: DataFrame) -> DataFrame:
    """Requests with the gaps (ordered by room number) that hold their whole stay, one row per request and block of rooms."""
    asked = cut_lineage(req.select("request_id", "hotel_id", "room_type_id", "check_in", "check_out", F.to_date("check_in").alias("day")))
    met = asked.join(gap_index(t, asked), ["hotel_id", "room_type_id", "day"])
    fits = F.filter("gaps", lambda g: (g["free_from"] <= F.col("check_in")) & (g["free_to"] >= F.col("check_out")))
    return met.select("request_id", "room_type_id", fits.alias("gaps"))
