"""Declared schemas of the booking model. Nothing is inferred from files."""

from __future__ import annotations

from pyspark.sql import types as T

INT, LONG, STR = T.IntegerType(), T.LongType(), T.StringType()
BOOL, DATE, TS = T.BooleanType(), T.DateType(), T.TimestampNTZType()
PRICE, RATE = T.DecimalType(10, 2), T.DecimalType(5, 2)
MONEY = T.DecimalType(18, 2)  # sums of prices

# The allowed states of each enumerated column.
BOOKING_STATES = ["Pending", "Active", "Checked-in", "Completed", "Cancelled"]
ROOM_STATES = ["Available", "Occupied", "Dirty", "Maintenance"]
SURCHARGE_TYPES = ["EarlyCheckIn", "LateCheckOut", "Holiday", "Weekend", "Other"]
INVOICE_STATES = ["Draft", "Issued", "Paid", "Void"]


def _schema(*columns: tuple) -> T.StructType:
    """Columns as (name, type) or (name, type, True) when the value is required."""
    return T.StructType([T.StructField(c[0], c[1], len(c) < 3) for c in columns])


TABLES: dict[str, T.StructType] = {
    "hotels": _schema(
        ("id", LONG, True), ("name", STR, True), ("address", STR, True), ("hotline", STR), ("created_at", TS),
    ),
    "customers": _schema(
        ("id", LONG, True), ("full_name", STR, True), ("phone_number", STR, True), ("email", STR),
        ("identity_card", STR), ("date_of_birth", DATE, True), ("created_at", TS),
    ),
    "staff": _schema(
        ("id", LONG, True), ("hotel_id", LONG), ("name", STR, True), ("role", STR, True), ("username", STR),
        ("created_at", TS), ("updated_at", TS),
    ),
    # times of day are seconds since midnight
    "surcharge_policies": _schema(
        ("id", LONG, True), ("policy_type", STR, True), ("description", STR), ("multiplier", RATE, True),
        ("start_sec", INT), ("end_sec", INT), ("is_active", BOOL),
    ),
    "room_types": _schema(
        ("id", LONG, True), ("hotel_id", LONG, True), ("type_name", STR, True), ("base_price", PRICE, True),
        ("max_capacity", INT, True), ("created_at", TS), ("updated_at", TS), ("updated_by", LONG),
    ),
    "rooms": _schema(
        ("id", LONG, True), ("hotel_id", LONG, True), ("room_number", STR, True), ("room_type_id", LONG, True),
        ("status", STR), ("created_at", TS), ("updated_at", TS), ("updated_by", LONG),
    ),
    "room_type_inventory": _schema(
        ("room_type_id", LONG, True), ("date", DATE, True), ("total_inventory", INT, True), ("total_reserved", INT, True),
    ),
    "bookings": _schema(
        ("id", LONG, True), ("hotel_id", LONG, True), ("customer_id", LONG, True), ("status", STR),
        ("idempotency_key", STR), ("check_in", TS, True), ("check_out", TS, True), ("total_amount", MONEY),
        ("amount_paid", MONEY), ("created_at", TS), ("updated_at", TS), ("updated_by", LONG),
        ("cancelled_at", TS), ("cancel_reason", STR),
    ),
    "booking_details": _schema(
        ("id", LONG, True), ("booking_id", LONG, True), ("room_type_id", LONG, True), ("agreed_price", MONEY, True),
        ("quantity", INT, True), ("is_breakfast_included", BOOL),
    ),
    "booking_surcharges": _schema(
        ("id", LONG, True), ("booking_id", LONG, True), ("surcharge_type", STR, True), ("amount", MONEY, True),
        ("description", STR), ("created_at", TS),
    ),
    "room_assignments": _schema(
        ("id", LONG, True), ("booking_id", LONG, True), ("room_id", LONG, True), ("check_in", TS, True),
        ("check_out", TS, True), ("is_cancelled", BOOL), ("assigned_at", TS),
    ),
    "services": _schema(
        ("id", LONG, True), ("hotel_id", LONG, True), ("name", STR, True), ("unit_price", PRICE, True),
        ("category", STR), ("created_at", TS),
    ),
    "service_usage": _schema(
        ("id", LONG, True), ("booking_id", LONG, True), ("service_id", LONG, True), ("quantity", INT, True),
        ("used_at", TS), ("staff_id", LONG),
    ),
    "invoices": _schema(
        ("id", LONG, True), ("booking_id", LONG, True), ("issued_at", TS), ("issued_by", LONG),
        ("total_amount", MONEY, True), ("amount_paid", MONEY, True), ("balance", MONEY, True), ("status", STR),
    ),
}

REQUESTS: dict[str, T.StructType] = {
    "booking_requests": _schema(
        ("seq", LONG, True), ("request_id", STR, True), ("hotel_id", LONG), ("customer_id", LONG, True),
        ("check_in", TS, True), ("check_out", TS, True), ("idempotency_key", STR), ("staff_id", LONG),
    ),
    "booking_request_rooms": _schema(
        ("request_id", STR, True), ("room_type_id", LONG, True), ("quantity", INT, True), ("is_breakfast_included", BOOL),
    ),
    "booking_request_services": _schema(
        ("request_id", STR, True), ("service_id", LONG, True), ("quantity", INT, True),
    ),
    "customer_requests": _schema(
        ("seq", LONG, True), ("full_name", STR), ("phone_number", STR), ("email", STR),
        ("identity_card", STR), ("date_of_birth", DATE),
    ),
    "room_moves": _schema(
        ("seq", LONG, True), ("booking_id", LONG, True), ("from_room_id", LONG), ("to_room_id", LONG, True), ("staff_id", LONG),
    ),
    "check_ins": _schema(("seq", LONG, True), ("booking_id", LONG, True), ("room_id", LONG, True), ("staff_id", LONG)),
    "check_outs": _schema(("seq", LONG, True), ("booking_id", LONG, True), ("staff_id", LONG)),
    "housekeeping": _schema(("seq", LONG, True), ("room_id", LONG, True), ("staff_id", LONG)),
    "service_requests": _schema(
        ("seq", LONG, True), ("booking_id", LONG, True), ("service_id", LONG, True), ("quantity", INT, True), ("staff_id", LONG),
    ),
    "payments": _schema(
        ("seq", LONG, True), ("booking_id", LONG, True), ("amount", MONEY, True), ("payment_method", STR), ("staff_id", LONG),
    ),
}
