"""Pieces shared by the batch jobs.

A job takes the current tables and a table of requests with an arrival number ``seq``,
and returns a dict: ``results`` (request columns, accepted, code) plus the new state of
every table it changes. One batch is one writer: nothing is written in place.
"""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.calc import touched_days
from ..functions.windows import running
from ..session import cut_lineage

State = dict[str, DataFrame]

# Rejection codes.
NOT_FOUND = "NOT_FOUND"
BAD_STATE = "BOOKING_STATE_INVALID"
BAD_PERIOD = "INVALID_PERIOD"
DUPLICATE = "DUPLICATE"
BAD_QUANTITY = "INVALID_QUANTITY"
NO_INVENTORY = "MISSING_INVENTORY"
OVERBOOKED = "OVERBOOKING"
NO_ROOM = "ROOM_ASSIGN_FAILED"
WRONG_TYPE = "ROOM_TYPE_MISMATCH"
ROOM_TAKEN = "ROOM_OVERLAP"
ROOM_BUSY = "ROOM_NOT_AVAILABLE"
NOT_DIRTY = "HOUSEKEEPING_INVALID"
BAD_AMOUNT = "INVALID_AMOUNT"
TOO_MUCH = "OVERPAYMENT"
BAD_CUT = "ASSIGNMENT_PERIOD"

BLOCK_DAYS = 7  # spans of days meet in blocks of so many: most stays reach into one or two


def derived_key(*columns: str) -> Column:
    """A key worked out from a request's content: equal requests have equal keys, in any batch and on any machine.

    SHA-256 of each value's length and text, so neighbouring values cannot run into each other; a null differs from an empty text.
    """
    texts = [F.col(c).cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


REQUEST_CONTENT = ["hotel_id", "customer_id", "check_in", "check_out"]


def with_derived_keys(req: DataFrame, columns: list[str] = REQUEST_CONTENT) -> DataFrame:
    """Requests in which a missing idempotency key is derived from what is asked for, so a batch sent twice books once."""
    return req.withColumn("idempotency_key", F.coalesce("idempotency_key", derived_key(*columns)))


def patched(t: Mapping, **tables: DataFrame) -> Mapping:
    """The tables with some of them in a later state."""
    return ChainMap(tables, t)


def with_booking(req: DataFrame, t: Mapping, *columns: str) -> DataFrame:
    """Requests with columns of their booking; ``b_id`` is null for an unknown booking."""
    b = t["bookings"].select(F.col("id").alias("b_id"), *[F.col(c).alias(f"b_{c}") for c in columns])
    return req.join(b, F.col("booking_id") == F.col("b_id"), "left")


def state_code(allowed: list[str]) -> Column:
    return F.when(F.col("b_id").isNull(), NOT_FOUND).when(
        F.col("b_status").isNull() | ~F.col("b_status").isin(allowed), BAD_STATE
    )


def first_wins(df: DataFrame, keys: list[str], late_code: str) -> DataFrame:
    """Among rows without a code, keep the first arrival per key and give the others ``late_code``.

    The flag is joined on (keys, seq), which is unique, so a hot key cannot pile up.
    """
    winners = df.filter(F.col("code").isNull()).groupBy(*keys).agg(F.min("seq").alias("seq")).withColumn("_won", F.lit(True))
    return df.join(winners, [*keys, "seq"], "left").withColumn(
        "code", F.when(F.col("code").isNull() & F.col("_won").isNull(), late_code).otherwise(F.col("code"))
    ).drop("_won")


def verdict(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns, F.col("code").isNull().alias("accepted"), "code")


def accepted(df: DataFrame) -> DataFrame:
    return df.filter(F.col("code").isNull())


def max_id(df: DataFrame) -> Column:
    """The highest id as a scalar subquery, 0 for an empty table."""
    return df.agg(F.coalesce(F.max("id"), F.lit(0)).cast("bigint").alias("m")).scalar()


def number_rows(df: DataFrame, start: Column, by: str, *then: str) -> DataFrame:
    """Give ``id`` = start + 1, 2, ... in the order (by, then).

    Rows are dealt out by ranges of that order, whatever the gaps between its values, and written once; only the counts
    of the ranges meet in one task.
    """
    ranged = cut_lineage(df.repartitionByRange(by, *then).withColumns({"_one": F.lit(1), "_range": F.spark_partition_id()}))
    counted = running(ranged, [], F.col("_range"), [by, *then], {"_n": ("sum", "_one", 0)}, inclusive=True)
    return counted.withColumn("id", start + F.col("_n").cast("bigint")).drop("_one", "_n", "_range")


def runs(stays: DataFrame, keys: list[str]) -> DataFrame:
    """Cut each key's calendar into runs of days that stays connect: (keys, day, run).

    Stays of different runs never overlap, so a run is an exact unit of parallel work.
    The window only sees one row per (key, day), not the stays themselves.
    """
    days = stays.select(*keys, F.to_date("check_in").alias("_first"), F.explode(touched_days()).alias("day"))
    known = days.groupBy(*keys, "day").agg(F.max(F.col("day") > F.col("_first")).alias("linked"))
    order = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return known.select(*keys, "day", F.sum(F.when(F.col("linked"), 0).otherwise(1)).over(order).alias("run"))


def with_run(stays: DataFrame, run_days: DataFrame, keys: list[str]) -> DataFrame:
    return stays.withColumn("day", F.to_date("check_in")).join(run_days, [*keys, "day"]).drop("day")


def reach(asks: DataFrame):
    """First check-in and last check-out of written asks, as two values; none when there are no asks."""
    return asks.agg(F.min("check_in"), F.max("check_out")).first()


def within_reach(stays: DataFrame, bounds) -> DataFrame:
    """Stays that can meet any ask. The bounds are literals, so a scan of stored stays skips the rest of history."""
    if bounds[0] is None:
        return stays.filter(F.lit(False))
    return stays.filter((F.col("check_out") > F.lit(bounds[0])) & (F.col("check_in") < F.lit(bounds[1])))


def in_runs(stays: DataFrame, run_days: DataFrame, keys: list[str]) -> DataFrame:
    """Other stays of the same keys, once for each run they reach into.

    The days of a run follow each other without a gap, so a run is a span. Both sides meet in blocks of days, which are fewer
    rows than the days of all stays, and a pair counts on its first common block only.
    """
    block = lambda day: F.floor(F.unix_date(day) / BLOCK_DAYS).cast("int")
    spread = lambda df, a, z: df.withColumn("_block", F.explode(F.sequence(block(a), block(z))))
    spans = run_days.groupBy(*keys, "run").agg(F.min("day").alias("_run_first"), F.max("day").alias("_run_last"))
    days = stays.withColumns({"_first": F.to_date("check_in"), "_last": F.to_date("check_out")}).filter("_first <= _last")
    met = spread(days, "_first", "_last").join(spread(spans, "_run_first", "_run_last"), [*keys, "_block"]).filter(
        (F.col("_first") <= F.col("_run_last")) & (F.col("_run_first") <= F.col("_last"))
        & (F.col("_block") == F.greatest(block("_first"), block("_run_first")))
    )
    return met.drop("_first", "_last", "_run_first", "_run_last", "_block").distinct()
