"""Integrity checks: the table constraints as reports of violating rows.

Every check returns (rule, table_name, key, detail). Row rules of a table are tested in
one scan; unique keys of a table in one aggregation.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.calc import ADULT_AGE, calendar_age
from ..sources.schemas import BOOKING_STATES, INVOICE_STATES, ROOM_STATES, SURCHARGE_TYPES, TABLES
from .billing import booking_total
from .calendar import first_overlap_per_room
from .occupancy import nightly_demand

# The constraints of the booking model. Conditions state what is wrong; an unknown is not a violation.
CHECKS = {
    "surcharge_policies": [("multiplier_not_negative", "multiplier < 0")],
    "room_types": [("base_price_not_negative", "base_price < 0"), ("capacity_positive", "max_capacity <= 0")],
    "room_type_inventory": [
        ("inventory_not_negative", "total_inventory < 0"),
        ("reserved_not_negative", "total_reserved < 0"),
        ("reserved_within_inventory", "total_reserved > total_inventory"),
    ],
    "bookings": [
        ("stay_not_empty", "check_out <= check_in"),
        ("total_not_negative", "total_amount < 0"),
        ("paid_not_negative", "amount_paid < 0"),
        ("paid_within_total", "amount_paid > total_amount"),
    ],
    "booking_details": [("agreed_price_not_negative", "agreed_price < 0"), ("quantity_positive", "quantity <= 0")],
    "booking_surcharges": [("amount_positive", "amount <= 0")],
    "room_assignments": [("stay_not_empty", "check_out <= check_in")],
    "services": [("unit_price_not_negative", "unit_price < 0")],
    "service_usage": [("quantity_positive", "quantity <= 0")],
    "invoices": [
        ("total_not_negative", "total_amount < 0"),
        ("paid_not_negative", "amount_paid < 0"),
        ("balance_matches", "balance <> total_amount - amount_paid"),
    ],
}
ENUMS = {
    ("bookings", "status"): BOOKING_STATES,
    ("rooms", "status"): ROOM_STATES,
    ("surcharge_policies", "policy_type"): SURCHARGE_TYPES,
    ("booking_surcharges", "surcharge_type"): SURCHARGE_TYPES,
    ("invoices", "status"): INVOICE_STATES,
}
MAX_LENGTHS = {
    "hotels": {"name": 100, "hotline": 20},
    "customers": {"full_name": 100, "phone_number": 20, "email": 100, "identity_card": 50},
    "staff": {"name": 100, "role": 50, "username": 50},
    "surcharge_policies": {"description": 255},
    "room_types": {"type_name": 50},
    "rooms": {"room_number": 10},
    "booking_surcharges": {"description": 255},
    "services": {"name": 100, "category": 50},
}
UNIQUE = {
    "customers": [["id"], ["phone_number"], ["email"], ["identity_card"]],
    "hotels": [["id"]],
    "staff": [["id"], ["username"]],
    "surcharge_policies": [["id"]],
    "room_types": [["id"], ["hotel_id", "type_name"]],
    "rooms": [["id"], ["hotel_id", "room_number"]],
    "room_type_inventory": [["room_type_id", "date"]],
    "bookings": [["id"], ["idempotency_key"]],
    "booking_details": [["id"], ["booking_id", "room_type_id"]],
    "booking_surcharges": [["id"]],
    "room_assignments": [["id"]],
    "services": [["id"], ["hotel_id", "name"]],
    "service_usage": [["id"]],
    "invoices": [["id"], ["booking_id"]],
}
FOREIGN = {
    "staff": {"hotel_id": "hotels"},
    "room_types": {"hotel_id": "hotels", "updated_by": "staff"},
    "rooms": {"hotel_id": "hotels", "room_type_id": "room_types", "updated_by": "staff"},
    "room_type_inventory": {"room_type_id": "room_types"},
    "bookings": {"hotel_id": "hotels", "customer_id": "customers", "updated_by": "staff"},
    "booking_details": {"booking_id": "bookings", "room_type_id": "room_types"},
    "booking_surcharges": {"booking_id": "bookings"},
    "room_assignments": {"booking_id": "bookings", "room_id": "rooms"},
    "services": {"hotel_id": "hotels"},
    "service_usage": {"booking_id": "bookings", "service_id": "services", "staff_id": "staff"},
    "invoices": {"booking_id": "bookings", "issued_by": "staff"},
}
# children that go with their booking, and references that block a delete
CASCADES = ["booking_details", "booking_surcharges", "room_assignments", "service_usage"]
RESTRICTS = {"room_types": [("rooms", "room_type_id"), ("booking_details", "room_type_id")], "rooms": [("room_assignments", "room_id")]}


def _text(df: DataFrame, cols: list[str]):
    return F.concat_ws("|", *[F.col(c).cast("string") for c in cols])


def _row_key(df: DataFrame, name: str):
    key = [c for c in ("id",) if c in df.columns] or (
        ["room_type_id", "date"] if name == "room_type_inventory" else ["booking_id", "service_id"]
    )
    return F.coalesce(_text(df, key), F.lit(""))


def _row_rules(t: Mapping, rules: dict[str, list[tuple]]) -> DataFrame:
    """Test (rule, violation condition, detail) lists, one scan per table.

    Rows without a violation are filtered out first: a scan skips stored blocks whose statistics rule one out, and only hits become lists.
    """
    parts = []
    for name, items in rules.items():
        if not items:
            continue
        df = t[name]
        hits = [
            F.when(cond, F.struct(F.lit(rule).alias("rule"), F.coalesce(detail.cast("string"), F.lit("")).alias("detail")))
            for rule, cond, detail in items
        ]
        wrong = df.filter(reduce(lambda a, b: a | b, [cond for _, cond, _ in items]))
        found = wrong.select(_row_key(df, name).alias("key"), F.explode(F.array_compact(F.array(*hits))).alias("v"))
        parts.append(found.select("v.rule", F.lit(name).alias("table_name"), "key", "v.detail"))
    return reduce(DataFrame.unionByName, parts)


def dq_checks(t: Mapping) -> DataFrame:
    rules = {}
    for name, items in CHECKS.items():
        rules[name] = [(rule, F.expr(cond), F.lit(cond)) for rule, cond in items]
    return _row_rules(t, rules)


def dq_not_null(t: Mapping) -> DataFrame:
    rules = {}
    for name, schema in TABLES.items():
        required = [f.name for f in schema if not f.nullable and f.name in t[name].columns]
        rules[name] = [("not_null", F.col(c).isNull(), F.lit(c)) for c in required]
    return _row_rules(t, rules)


def dq_enums(t: Mapping) -> DataFrame:
    rules: dict = {}
    for (name, column), allowed in ENUMS.items():
        rules.setdefault(name, []).append((f"{column}_allowed", ~F.col(column).isin(allowed), F.col(column)))
    return _row_rules(t, rules)


def dq_lengths(t: Mapping) -> DataFrame:
    rules = {
        name: [("max_length", F.length(c) > n, F.lit(c)) for c, n in limits.items() if c in t[name].columns]
        for name, limits in MAX_LENGTHS.items()
    }
    return _row_rules(t, rules)


def dq_adult(t: Mapping, as_of) -> DataFrame:
    young = calendar_age("date_of_birth", as_of) < ADULT_AGE
    return _row_rules(t, {"customers": [("adult", young, F.col("date_of_birth"))]})


def dq_missing_columns(t: Mapping) -> DataFrame:
    """Declared columns that a table lacks, whose rules can therefore not be tested: one row each, the table's name as key."""
    lost = [("missing_column", name, name, f.name) for name, schema in TABLES.items() for f in schema if f.name not in t[name].columns]
    return t["hotels"].sparkSession.createDataFrame(lost, "rule string, table_name string, key string, detail string")


def dq_unique(t: Mapping) -> DataFrame:
    """Keys stored more than once, with the count as detail. Keys with a null part never collide.

    Each key is counted by its columns as they are stored; only those found twice are written out as texts.
    """
    parts = []
    for name, keys in UNIQUE.items():
        df = t[name]
        for k in keys:
            if not all(c in df.columns for c in k):
                continue
            dup = df.select(*k).dropna().groupBy(*k).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
            parts.append(
                dup.select(
                    F.lit("unique_" + "_".join(k)).alias("rule"), F.lit(name).alias("table_name"), _text(df, k).alias("key"), F.col("_n").cast("string").alias("detail")
                )
            )
    return reduce(DataFrame.unionByName, parts)


def dq_foreign_keys(t: Mapping) -> DataFrame:
    """Rows whose reference names no stored parent; a null reference is fine."""
    parts = []
    for name, refs in FOREIGN.items():
        df = t[name]
        for column, parent in refs.items():
            if column not in df.columns:
                continue
            child = df.filter(F.col(column).isNotNull()).select(_row_key(df, name).alias("key"), F.col(column).alias("ref"))
            lost = child.join(t[parent].select(F.col("id").alias("ref")), "ref", "left_anti")
            parts.append(
                lost.select(
                    F.lit(f"fk_{column}").alias("rule"), F.lit(name).alias("table_name"), "key", F.col("ref").cast("string").alias("detail")
                )
            )
    return reduce(DataFrame.unionByName, parts)


def dq_no_overlap(t: Mapping) -> DataFrame:
    return first_overlap_per_room(t).select(
        F.lit("no_overlap").alias("rule"),
        F.lit("room_assignments").alias("table_name"),
        F.col("assignment_id").cast("string").alias("key"),
        F.concat(F.lit("room "), F.col("room_id").cast("string")).alias("detail"),
    )


def inventory_drift(t: Mapping) -> DataFrame:
    """Nights whose stored reserved count differs from the bookings, on either side."""
    stored = t["room_type_inventory"].select("room_type_id", "date", F.col("total_reserved").alias("stored"))
    both = stored.join(nightly_demand(t), ["room_type_id", "date"], "full")
    expected = F.coalesce("reserved", F.lit(0)).cast("bigint")
    return both.filter(F.col("stored").isNull() | (F.col("stored") != expected)).select(
        "room_type_id", "date", F.col("stored").cast("bigint").alias("stored"), expected.alias("expected")
    )


def dq_inventory_drift(t: Mapping) -> DataFrame:
    return inventory_drift(t).select(
        F.lit("inventory_drift").alias("rule"),
        F.lit("room_type_inventory").alias("table_name"),
        F.concat_ws("|", F.col("room_type_id").cast("string"), F.col("date").cast("string")).alias("key"),
        F.concat(
            F.coalesce(F.col("stored").cast("string"), F.lit("missing")), F.lit(" should be "), F.col("expected").cast("string")
        ).alias("detail"),
    )


def dq_total_drift(t: Mapping) -> DataFrame:
    due = booking_total(t).select(F.col("booking_id").alias("id"), F.col("total_amount").alias("due"))
    both = t["bookings"].select("id", "total_amount").join(due, "id").filter(~F.col("total_amount").eqNullSafe(F.col("due")))
    return both.select(
        F.lit("total_drift").alias("rule"),
        F.lit("bookings").alias("table_name"),
        F.col("id").cast("string").alias("key"),
        F.concat(F.coalesce(F.col("total_amount").cast("string"), F.lit("missing")), F.lit(" should be "), F.col("due").cast("string")).alias("detail"),
    )


def integrity_report(t: Mapping, as_of) -> DataFrame:
    """Violations per rule and table over all checks."""
    checks = [
        dq_missing_columns(t), dq_checks(t), dq_not_null(t), dq_enums(t), dq_lengths(t), dq_adult(t, as_of), dq_unique(t), dq_foreign_keys(t),
        dq_no_overlap(t), dq_inventory_drift(t), dq_total_drift(t),
    ]
    found = reduce(DataFrame.unionByName, checks)
    return found.groupBy("rule", "table_name").agg(F.count(F.lit(1)).alias("violations"))


def cascade_delete(t: Mapping, removed: DataFrame) -> dict[str, DataFrame]:
    """Bookings without the ``removed`` ones (booking_id) and the child rows that stay."""
    gone = removed.select("booking_id").distinct()
    state = {"bookings": t["bookings"].join(gone.withColumnRenamed("booking_id", "id"), "id", "left_anti")}
    for name in CASCADES:
        state[name] = t[name].join(gone, "booking_id", "left_anti")
    return state


def delete_blockers(t: Mapping, table: str, removed: DataFrame) -> DataFrame:
    """Rows that keep room types or rooms (``removed``: id) from being deleted, counted per id and child table."""
    ids = removed.select(F.col("id").alias("ref")).distinct()
    parts = [
        t[child].select(F.col(c).alias("ref")).join(ids, "ref", "left_semi").groupBy("ref").agg(F.count(F.lit(1)).alias("rows"))
        .select(F.col("ref").alias("id"), F.lit(child).alias("table_name"), "rows")
        for child, c in RESTRICTS[table]
    ]
    return reduce(DataFrame.unionByName, parts)
