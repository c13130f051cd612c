"""Lookups, filters and form checks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from ..functions.calc import ADULT_AGE, EARLY_HOUR, PHONE_PATTERN, calendar_age, in_period


def service_search(t: Mapping, hotel_id=None, keyword: str = "") -> DataFrame:
    """Services by keyword, case-insensitive; % and _ in the keyword are wildcards.

    With a hotel the result is cut to it and ordered by category and name.
    """
    s = t["services"].select(
        F.col("id").alias("service_id"), F.col("hotel_id"), F.col("name").alias("service_name"), "unit_price", "category"
    )
    if keyword:
        s = s.filter(F.col("service_name").ilike(f"%{keyword}%"))
    if hotel_id is None:
        return s
    return s.filter(F.col("hotel_id") == hotel_id).orderBy("category", "service_name")


def customer_lookup(t: Mapping, req: DataFrame) -> DataFrame:
    """Find guests for a table of phone numbers; unknown numbers keep a row without guest."""
    guests = t["customers"].select(
        "phone_number", F.col("id").alias("customer_id"), "full_name", "identity_card", "email", "date_of_birth"
    )
    return req.join(guests, "phone_number", "left")


def period_filter(df: DataFrame, column: str, period: str, as_of) -> DataFrame:
    return df.filter(in_period(column, period, as_of))


def status_filter(df: DataFrame, keep: list | None = None, drop: list | None = None) -> DataFrame:
    if keep is not None:
        df = df.filter(F.col("status").isin(keep))
    if drop is not None:
        df = df.filter(~F.col("status").isin(drop))
    return df


def early_arrival_flag(t: Mapping) -> DataFrame:
    return t["bookings"].select(F.col("id").alias("booking_id"), (F.hour("check_in") < EARLY_HOUR).alias("early"))


def form_code(as_of):
    """First broken rule of a guest form, null when it is fine."""
    return (
        F.when(F.length(F.trim(F.coalesce("full_name", F.lit("")))) == 0, "INVALID_NAME")
        .when(~F.trim(F.coalesce("phone_number", F.lit(""))).rlike(PHONE_PATTERN), "INVALID_PHONE")
        .when(F.col("date_of_birth").isNull(), "DOB_REQUIRED")
        .when(calendar_age("date_of_birth", as_of) < ADULT_AGE, "UNDERAGE")
    )


def guest_form_check(df: DataFrame, as_of) -> DataFrame:
    return df.withColumn("code", form_code(as_of)).withColumn("accepted", F.col("code").isNull())


def room_type_match(t: Mapping, moves: DataFrame) -> DataFrame:
    """Moves (seq, booking_id, to_room_id) into a room whose type the booking does not hold; an unknown room has no type and never matches."""
    kinds = t["rooms"].select(F.col("id").alias("to_room_id"), "room_type_id")
    booked = t["booking_details"].select("booking_id", "room_type_id")
    return moves.select("seq", "booking_id", "to_room_id").join(kinds, "to_room_id", "left").join(booked, ["booking_id", "room_type_id"], "left_anti").select(
        "seq", "booking_id", "to_room_id", "room_type_id"
    )
