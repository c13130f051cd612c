"""Booking tables derived from the driver's star-schema tables.

Every row comes from keys of the given tables by integer arithmetic, so both the
Spark side and the checking SQL (``oracle/ctes.py``) build the same tables, and all
of them grow with the data. See FIXTURES.md section 3 for the rules.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.billing import booking_total, time_surcharges
from ..operators.occupancy import nightly_demand
from ..session import cut_lineage
from .schemas import TABLES
from .tables import LazyTables, literal_relation

AS_OF = "2024-02-15 13:00:00"
SPINE = ("2023-12-20", "2024-05-20")

POLICIES = [
    (1, "EarlyCheckIn", "Early check-in", "0.50", 21600, 50400, True),
    (2, "LateCheckOut", "Late check-out", "0.30", 43200, 64800, True),
]


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=None)
def _row_count(app_id: str, sf_dir: str, name: str) -> int:
    return source(SparkSession.getActiveSession(), sf_dir, name).count()


def row_count(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Row count of a given table, read once per session from the Parquet footers."""
    return _row_count(spark.sparkContext.applicationId, sf_dir, name)


def _hotels(spark, d):
    return source(spark, d, "supplier").selectExpr(
        "s_suppkey AS id", "s_name AS name", "CAST(s_nationkey AS STRING) AS address", "CAST(NULL AS STRING) AS hotline"
    )


def _room_types(spark, d):
    kinds = source(spark, d, "supplier").selectExpr("s_suppkey AS hotel_id", "EXPLODE(ARRAY(0, 1, 2)) AS k")
    return kinds.selectExpr(
        "hotel_id * 3 + k AS id",
        "hotel_id",
        "ELEMENT_AT(ARRAY('Standard', 'Deluxe', 'Suite'), k + 1) AS type_name",
        "CAST(ELEMENT_AT(ARRAY(800000, 1200000, 2500000), k + 1) AS DECIMAL(10,2)) AS base_price",
        "ELEMENT_AT(ARRAY(2, 2, 4), k + 1) AS max_capacity",
    )


def _rooms(t):
    units = t["room_types"].selectExpr(
        "id AS room_type_id", "hotel_id", "EXPLODE(SEQUENCE(0, IF(type_name = 'Suite', 3, 4))) AS j"
    )
    return units.selectExpr(
        "room_type_id * 5 + j AS id",
        "hotel_id",
        "CAST((room_type_id % 3 + 1) * 100 + j + 1 AS STRING) AS room_number",
        "room_type_id",
        """CASE WHEN (room_type_id * 5 + j) % 20 = 0 THEN 'Maintenance' WHEN (room_type_id * 5 + j) % 20 = 1 THEN 'Dirty'
                WHEN (room_type_id * 5 + j) % 20 <= 3 THEN 'Occupied' ELSE 'Available' END AS status""",
    )


def _customers(spark, d):
    return source(spark, d, "customer").selectExpr(
        "c_custkey AS id",
        "c_name AS full_name",
        "CONCAT('09', LPAD(CAST(c_custkey AS STRING), 8, '0')) AS phone_number",
        "CONCAT('guest', CAST(c_custkey AS STRING), '@example.com') AS email",
        "IF(c_custkey % 3 = 0, NULL, CONCAT('ID', CAST(c_custkey AS STRING))) AS identity_card",
        "DATE_ADD(DATE '1950-01-01', CAST((c_custkey * 37) % 21000 AS INT)) AS date_of_birth",
    )


def booking_core(orders: DataFrame, hotels: int) -> DataFrame:
    """Bookings without money from order rows; works on a stream of orders too."""
    keys = orders.selectExpr(
        "o_orderkey AS id",
        "o_custkey AS customer_id",
        f"o_custkey % {hotels}L AS hotel_id",
        "CAST(FLOOR(o_orderkey / 5) % 10 AS INT) AS phase",
        "DATE_ADD(DATE '2024-01-01', CAST((o_orderkey * 7) % 120 AS INT)) AS ci_date",
        "CAST(o_orderkey % 5 AS INT) AS stay",
        "CAST(6 + o_orderkey % 13 AS INT) AS ci_hour",
        "CAST(IF(o_orderkey % 5 = 0, 20, 10 + o_orderkey % 9) AS INT) AS co_hour",
    )
    return keys.selectExpr(
        "id",
        "hotel_id",
        "customer_id",
        """CASE WHEN phase = 0 THEN 'Pending' WHEN phase = 1 THEN 'Cancelled' WHEN phase <= 4 THEN 'Active'
                WHEN phase <= 6 THEN 'Checked-in' ELSE 'Completed' END AS status""",
        "CONCAT('key-', CAST(id AS STRING)) AS idempotency_key",
        "CAST(ci_date AS TIMESTAMP_NTZ) + MAKE_DT_INTERVAL(0, ci_hour) AS check_in",
        "CAST(DATE_ADD(ci_date, stay) AS TIMESTAMP_NTZ) + MAKE_DT_INTERVAL(0, co_hour) AS check_out",
        "CAST(DATE_ADD(DATE '2023-12-01', CAST(id % 10 AS INT)) AS TIMESTAMP_NTZ) AS created_at",
        "CAST(DATE_ADD(DATE '2023-12-11', CAST(id % 10 AS INT)) AS TIMESTAMP_NTZ) AS updated_at",
    )


def _booking_details(spark, d, bookings):
    lines = (
        source(spark, d, "lineitem")
        .select("l_orderkey", (F.col("l_linenumber") % 3).alias("k"), "l_partkey")
        .groupBy("l_orderkey", "k")
        .agg(F.least(F.count(F.lit(1)), F.lit(2)).cast("int").alias("quantity"), F.max("l_partkey").alias("part"))
    )
    joined = lines.join(bookings.select(F.col("id").alias("l_orderkey"), "hotel_id"), "l_orderkey")
    return joined.selectExpr(
        "l_orderkey * 3 + k AS id",
        "l_orderkey AS booking_id",
        "hotel_id * 3 + k AS room_type_id",
        "CAST(ELEMENT_AT(ARRAY(800000, 1200000, 2500000), k + 1) AS DECIMAL(10,2)) AS agreed_price",
        "quantity",
        "part % 2 = 0 AS is_breakfast_included",
    )


def _booking_surcharges(t):
    billed = t["bookings_core"].filter("status <> 'Pending'").select(F.col("id").alias("booking_id"))
    rows = time_surcharges(t.replaced(bookings=t["bookings_core"]), billed)
    return rows.selectExpr(
        "detail_id * 2 + policy_id - 1 AS id", "booking_id", "surcharge_type", "amount", "description"
    )


def _bookings(t):
    core = t["bookings_core"]
    totals = booking_total(t.replaced(bookings=core)).select(F.col("booking_id").alias("id"), "total_amount")
    paid = F.expr("CAST(total_amount * CAST(id % 5 AS INT) * 0.25BD AS DECIMAL(18,2))")
    return core.join(totals, "id").withColumn("amount_paid", paid)


def _services(spark, d):
    hotels = row_count(spark, d, "supplier")
    return source(spark, d, "part").selectExpr(
        "p_partkey AS id",
        f"p_partkey % {hotels}L AS hotel_id",
        "CONCAT(p_name, ' ', CAST(p_partkey AS STRING)) AS name",
        "CAST(p_retailprice AS DECIMAL(10,2)) AS unit_price",
        "p_type AS category",
    )


def _service_usage(spark, d):
    return (
        source(spark, d, "lineitem")
        .selectExpr("l_orderkey AS booking_id", "l_partkey AS service_id", "CAST(l_quantity AS INT) % 3 + 1 AS quantity")
    )


def _inventory(t, states):
    types = t["room_types"].selectExpr("id AS room_type_id", "IF(type_name = 'Suite', 4, 5) AS total_inventory")
    days = types.selectExpr(
        "room_type_id", "total_inventory", f"EXPLODE(SEQUENCE(DATE '{SPINE[0]}', DATE '{SPINE[1]}')) AS date"
    ).filter(f"(room_type_id + DATEDIFF(date, DATE '{SPINE[0]}')) % 97 <> 0")
    demand = nightly_demand(t.replaced(bookings=t["bookings_core"]), states)
    return days.join(demand, ["room_type_id", "date"], "left").selectExpr(
        "room_type_id",
        "date",
        "total_inventory",
        "CAST(LEAST(COALESCE(reserved, 0), total_inventory) AS INT) AS total_reserved",
    )


def _room_assignments(t):
    stays = t["bookings_core"].selectExpr("id AS booking_id", "status", "check_in", "check_out")
    units = t["booking_details"].selectExpr(
        "id AS detail_id", "booking_id", "room_type_id", "EXPLODE(SEQUENCE(1, quantity)) AS u"
    )
    return units.join(stays, "booking_id").selectExpr(
        "detail_id * 2 + u - 1 AS id",
        "booking_id",
        "room_type_id * 5 + (booking_id + u) % IF(room_type_id % 3 = 2, 4, 5) AS room_id",
        "check_in",
        "check_out",
        "status = 'Cancelled' AS is_cancelled",
    )


def _invoices(t):
    return t["bookings"].filter("status = 'Completed' AND id % 3 <> 0").selectExpr(
        "id",
        "id AS booking_id",
        "CAST(total_amount AS DECIMAL(18,2)) AS total_amount",
        "amount_paid",
        "CAST(total_amount - amount_paid AS DECIMAL(18,2)) AS balance",
        "IF(amount_paid >= total_amount, 'Paid', 'Issued') AS status",
        "CAST(NULL AS TIMESTAMP_NTZ) AS issued_at",
        "CAST(NULL AS BIGINT) AS issued_by",
    )


def _payments(spark, d):
    """Every event pays for a booking; those with an even id crowd on a twentieth of the bookings."""
    orders = row_count(spark, d, "orders")
    return (
        source(spark, d, "events")
        .selectExpr(
            "event_id AS seq",
            f"event_id % IF(event_id % 2 = 0, {orders // 20}L, {orders}L) AS booking_id",
            "CAST(ROUND(value, 2) * 10000 AS DECIMAL(18,2)) AS amount",
            "'Card' AS payment_method",
            "CAST(1 AS BIGINT) AS staff_id",
        )
    )


def _booking_requests(t):
    """Pending bookings as new requests: shared keys, keys of known bookings and empty periods among them."""
    return t["bookings_core"].filter("status = 'Pending'").selectExpr(
        "id AS seq",
        "CONCAT('r', CAST(id AS STRING)) AS request_id",
        "hotel_id",
        "customer_id",
        "check_in",
        "IF(id % 13 = 0, check_in, check_out) AS check_out",
        """CASE WHEN id % 7 = 0 THEN CONCAT('key-', CAST(id + 5 AS STRING)) WHEN id % 11 = 0 THEN idempotency_key
                ELSE CONCAT('req-', CAST(CAST(FLOOR(id / 2) AS BIGINT) AS STRING)) END AS idempotency_key""",
        "CAST(1 AS BIGINT) AS staff_id",
    )


def _request_rooms(t):
    """Room lines of the requests; a double room is asked for in two lines."""
    asked = t["booking_requests"].select(F.col("seq").alias("booking_id"), "request_id")
    return t["booking_details"].join(asked, "booking_id").selectExpr(
        "request_id",
        "room_type_id",
        "1 AS quantity",
        "EXPLODE(IF(quantity = 2, ARRAY(is_breakfast_included, false), ARRAY(is_breakfast_included))) AS is_breakfast_included",
    )


def _request_services(t):
    asked = t["booking_requests"].select(F.col("seq").alias("booking_id"), "request_id")
    return t["service_usage"].join(asked, "booking_id").select("request_id", "service_id", "quantity")


def _room_moves(t):
    """Moves of every assigned booking to the neighbour room; each 7th aims at another room type."""
    live = t["room_assignments"].filter("NOT is_cancelled")
    return live.selectExpr(
        "id AS seq",
        "booking_id",
        "room_id AS from_room_id",
        """IF(id % 7 = 0, room_id + 5, room_id - room_id % 5
             + (room_id % 5 + 1) % IF(CAST(FLOOR(room_id / 5) AS BIGINT) % 3 = 2, 4, 5)) AS to_room_id""",
        "CAST(1 AS BIGINT) AS staff_id",
    )


def _check_ins(t):
    return t["room_assignments"].filter("NOT is_cancelled").selectExpr(
        "id AS seq", "booking_id", "IF(id % 7 = 0, room_id + 1, room_id) AS room_id", "CAST(1 AS BIGINT) AS staff_id"
    )


def _per_booking(t, states):
    return t["bookings_core"].filter(F.col("status").isin(states)).selectExpr(
        "id AS seq", "id AS booking_id", "CAST(1 AS BIGINT) AS staff_id"
    )


def _housekeeping(t):
    return t["rooms"].selectExpr("id AS seq", "IF(id % 7 = 0, id + 1, id) AS room_id", "CAST(1 AS BIGINT) AS staff_id")


def _customer_requests(t):
    """New guests, some of whom repeat a phone, e-mail or card of a known guest or of each other."""
    return t["customers"].selectExpr(
        "id AS seq",
        "IF(id % 19 = 0, '  ', full_name) AS full_name",
        """CASE WHEN id % 17 = 0 THEN '12345' WHEN id % 10 = 0 THEN phone_number
                ELSE CONCAT('08', LPAD(CAST(CAST(FLOOR(id / 2) AS BIGINT) AS STRING), 8, '0')) END AS phone_number""",
        "CASE WHEN id % 5 = 0 THEN NULL ELSE CONCAT('new', CAST(CAST(FLOOR(id / 3) AS BIGINT) AS STRING), '@example.com') END AS email",
        "CASE WHEN id % 4 = 0 THEN identity_card ELSE CONCAT('N', CAST(id AS STRING)) END AS identity_card",
        "IF(id % 23 = 0, NULL, date_of_birth) AS date_of_birth",
    )


# tables that take a join or an aggregation to derive
DERIVED = [
    "bookings", "booking_details", "booking_surcharges", "room_assignments", "room_type_inventory", "inventory_open",
    "booking_request_rooms", "booking_request_services",
]


def stored_tables(spark: SparkSession, sf_dir: str) -> LazyTables:
    """The derived tables, with those that take work written once on first use.

    For jobs and checks that read a table several times; a production snapshot is stored anyway.
    """
    return derived_tables(spark, sf_dir).wrapped(DERIVED, cut_lineage)


def derived_tables(spark: SparkSession, sf_dir: str) -> LazyTables:
    """All booking and request tables for one data folder, each built only when used.

    ``bookings_core`` is ``bookings`` without the money columns, for operators that
    do not read them: it spares the billing joins. ``inventory_open`` is the
    inventory before the Pending requests are admitted.
    """
    b = {
        "hotels": lambda t: _hotels(spark, sf_dir),
        "room_types": lambda t: _room_types(spark, sf_dir),
        "rooms": _rooms,
        "customers": lambda t: _customers(spark, sf_dir),
        "staff": lambda t: literal_relation(spark, [], TABLES["staff"]),
        "surcharge_policies": lambda t: literal_relation(
            spark, POLICIES, "id int, policy_type string, description string, multiplier string, start_sec int, end_sec int, is_active boolean"
        ).withColumn("multiplier", F.col("multiplier").cast("decimal(5,2)")),
        "bookings_core": lambda t: booking_core(source(spark, sf_dir, "orders"), row_count(spark, sf_dir, "supplier")),
        "bookings": _bookings,
        "booking_details": lambda t: _booking_details(spark, sf_dir, t["bookings_core"]),
        "booking_surcharges": _booking_surcharges,
        "services": lambda t: _services(spark, sf_dir),
        "service_usage": lambda t: _service_usage(spark, sf_dir),
        "room_type_inventory": lambda t: _inventory(t, ["Pending", "Active", "Checked-in"]),
        "inventory_open": lambda t: _inventory(t, ["Active", "Checked-in"]),
        "room_assignments": _room_assignments,
        "invoices": _invoices,
        "payments": lambda t: _payments(spark, sf_dir),
        "booking_requests": _booking_requests,
        "booking_request_rooms": _request_rooms,
        "booking_request_services": _request_services,
        "room_moves": _room_moves,
        "check_ins": _check_ins,
        "check_outs": lambda t: _per_booking(t, ["Checked-in", "Completed"]),
        "cancellations": lambda t: _per_booking(t, ["Active", "Completed", "Cancelled"]),
        "finalizations": lambda t: _per_booking(t, ["Pending", "Active"]),
        "invoice_requests": lambda t: _per_booking(t, ["Pending", "Checked-in", "Completed"]),
        "housekeeping": _housekeeping,
        "customer_requests": _customer_requests,
    }
    return LazyTables(b)
