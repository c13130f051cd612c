"""What a booking costs: rooms, time surcharges, breakfast, services."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from ..functions.calc import BREAKFAST_PRICE, MONEY, money, nights, second_of_day
from ..functions.sizing import broadcast_checked


def stay_nights(t: Mapping) -> DataFrame:
    return t["bookings"].select(F.col("id").alias("booking_id"), nights().alias("nights"))


def booking_balance(t: Mapping) -> DataFrame:
    b = t["bookings"]
    return b.select(F.col("id").alias("booking_id"), money(b.total_amount - b.amount_paid).alias("balance"))


def child_costs(t: Mapping, booking_ids: DataFrame | None = None) -> DataFrame:
    """Per booking: room price of one night, surcharges, services.

    The three child tables are stacked and summed in one aggregation: one shuffle
    with map-side combine instead of three, and no fan-out between the children.
    """
    zero = F.lit(0).cast(MONEY)

    def part(df: DataFrame, **value) -> DataFrame:
        cols = [value.get(c, zero).cast(MONEY).alias(c) for c in ("night_cost", "surcharge_cost", "service_cost")]
        return df.select("booking_id", *cols)

    def wanted(df: DataFrame) -> DataFrame:
        return df if booking_ids is None else df.join(booking_ids.select("booking_id"), "booking_id", "left_semi")

    prices = t["services"].select(F.col("id").alias("service_id"), "unit_price")
    usage = wanted(t["service_usage"]).join(prices, "service_id")
    rows = (
        part(wanted(t["booking_details"]), night_cost=F.col("agreed_price") * F.col("quantity"))
        .unionByName(part(wanted(t["booking_surcharges"]), surcharge_cost=F.col("amount")))
        .unionByName(part(usage, service_cost=F.col("quantity") * F.col("unit_price")))
    )
    return rows.groupBy("booking_id").agg(*[money(F.sum(c)).alias(c) for c in ("night_cost", "surcharge_cost", "service_cost")])


def booking_total(t: Mapping, booking_ids: DataFrame | None = None) -> DataFrame:
    """Total per booking from its current children; bookings without children total 0."""
    stays = t["bookings"].select(F.col("id").alias("booking_id"), nights().alias("nights"))
    if booking_ids is not None:
        stays = stays.join(booking_ids.select("booking_id"), "booking_id", "left_semi")
    zero = F.lit(0).cast(MONEY)
    costs = stays.join(child_costs(t, booking_ids), "booking_id", "left").select(
        "booking_id",
        money(F.coalesce(F.col("night_cost") * F.col("nights"), zero)).alias("room_cost"),
        F.coalesce("surcharge_cost", zero).alias("surcharge_cost"),
        F.coalesce("service_cost", zero).alias("service_cost"),
    )
    return costs.withColumn("total_amount", money(F.expr("room_cost + surcharge_cost + service_cost")))


def time_surcharges(t: Mapping, booking_ids: DataFrame | None = None) -> DataFrame:
    """One row per (detail, active policy whose window holds the arrival or departure time).

    Both window ends count. Policies with an open end or a window over midnight never
    match. Policies are spread over the hours they cover, so the match is an equi-join
    on (type, hour) with the exact test behind it, in either join strategy.
    """
    policies = (
        t["surcharge_policies"]
        .filter("is_active AND start_sec <= end_sec AND policy_type IN ('EarlyCheckIn', 'LateCheckOut')")
        .selectExpr(
            "id AS policy_id", "policy_type AS surcharge_type", "multiplier", "start_sec", "end_sec",
            "COALESCE(description, 'Auto time surcharge') AS description",
            "EXPLODE(SEQUENCE(CAST(FLOOR(start_sec / 3600) AS INT), CAST(FLOOR(end_sec / 3600) AS INT))) AS hour_of_day",
        )
    )
    stays = t["bookings"].select(F.col("id").alias("booking_id"), "check_in", "check_out")
    if booking_ids is not None:
        stays = stays.join(booking_ids.select("booking_id"), "booking_id", "left_semi")
    moments = stays.select(
        "booking_id",
        F.explode(
            F.array(
                F.struct(F.lit("EarlyCheckIn").alias("surcharge_type"), F.col("check_in").alias("at")),
                F.struct(F.lit("LateCheckOut").alias("surcharge_type"), F.col("check_out").alias("at")),
            )
        ).alias("m"),
    ).select("booking_id", "m.surcharge_type", F.hour("m.at").alias("hour_of_day"), second_of_day("m.at").alias("sec"))
    hits = moments.join(broadcast_checked(policies), ["surcharge_type", "hour_of_day"]).filter(
        F.col("sec").between(F.col("start_sec"), F.col("end_sec"))
    )
    details = t["booking_details"].select(F.col("id").alias("detail_id"), "booking_id", "agreed_price", "quantity")
    return details.join(hits, "booking_id").select(
        "booking_id",
        "detail_id",
        "policy_id",
        "surcharge_type",
        money(F.round(F.col("agreed_price") * F.col("multiplier") * F.col("quantity"), 2)).alias("amount"),
        "description",
    )


def breakfast_surcharges(lines: DataFrame, unit_price: int = BREAKFAST_PRICE) -> DataFrame:
    """Breakfast charge per requested line: price x rooms x nights, booked as type Other.

    ``lines`` carries request_id, room_type_id, quantity, is_breakfast_included, check_in, check_out.
    """
    amount = F.lit(unit_price).cast(MONEY) * F.col("quantity") * nights()
    return lines.filter(F.col("is_breakfast_included")).select(
        "request_id", "room_type_id", F.lit("Other").alias("surcharge_type"), money(amount).alias("amount")
    )


def selection_merge(lines: DataFrame) -> DataFrame:
    """Merge the lines of a request that name the same room type."""
    return lines.groupBy("request_id", "room_type_id").agg(
        F.sum("quantity").cast("int").alias("quantity"),
        F.coalesce(F.bool_or("is_breakfast_included"), F.lit(False)).alias("is_breakfast_included"),
    )


def price_snapshot(t: Mapping, details: DataFrame) -> DataFrame:
    """Take the room type's base price where a new detail has no price of its own."""
    base = t["room_types"].select(F.col("id").alias("room_type_id"), "base_price")
    unpriced = F.coalesce(F.col("agreed_price"), F.lit(0)) == 0
    return details.join(base, "room_type_id", "left").select(
        *[
            F.when(unpriced, F.col("base_price")).otherwise(F.col("agreed_price")).cast("decimal(10,2)").alias(c)
            if c == "agreed_price" else F.col(c)
            for c in details.columns
        ]
    )


def cost_split(t: Mapping) -> DataFrame:
    """Split the stored total; the room part is what remains, never below 0."""
    costs = child_costs(t)
    zero = F.lit(0).cast(MONEY)
    b = t["bookings"].select(F.col("id").alias("booking_id"), "total_amount")
    return b.join(costs, "booking_id", "left").select(
        "booking_id",
        money("total_amount").alias("total_amount"),
        money(F.greatest(F.expr("total_amount - COALESCE(surcharge_cost, 0) - COALESCE(service_cost, 0)"), zero)).alias("room_part"),
        F.coalesce("surcharge_cost", zero).alias("surcharge_part"),
        F.coalesce("service_cost", zero).alias("service_part"),
    )
