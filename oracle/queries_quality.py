"""Checking SQL of the integrity checks, over tables with planted faults (``DIRTY``)."""

from __future__ import annotations

from .ctes import AS_OF, DAY, with_tables as q

# planted faults; the Spark side plants the same ones
DIRTY = {
    "d_bookings": """SELECT id, hotel_id, CASE WHEN id % 79 = 0 THEN -1 ELSE customer_id END AS customer_id,
        CASE WHEN id % 97 = 0 THEN 'Unknown' ELSE status END AS status,
        CASE WHEN id % 71 = 0 THEN 'dup-' || (id // 500) ELSE idempotency_key END AS idempotency_key, check_in,
        CASE WHEN id % 89 = 0 THEN check_in ELSE check_out END AS check_out,
        CASE WHEN id % 73 = 0 THEN total_amount + 5 ELSE total_amount END AS total_amount,
        CASE WHEN id % 83 = 0 THEN total_amount + 1 ELSE amount_paid END AS amount_paid FROM bookings""",
    "d_services": """SELECT id, CASE WHEN id % 60 = 0 THEN NULL ELSE hotel_id END AS hotel_id, name,
        CASE WHEN id % 50 = 0 THEN -1 ELSE unit_price END AS unit_price, CASE WHEN id % 70 = 0 THEN REPEAT('x', 51) ELSE category END AS category FROM services""",
    "d_invoices": "SELECT id, booking_id, total_amount, amount_paid, CASE WHEN id % 7 = 0 THEN balance + 1 ELSE balance END AS balance, status FROM invoices",
    "d_details": "SELECT id, booking_id, room_type_id, agreed_price, CASE WHEN id % 77 = 0 THEN 0 ELSE quantity END AS quantity FROM booking_details",
    "d_inventory": """SELECT room_type_id, date, total_inventory, CASE WHEN room_type_id % 40 = 0 THEN total_inventory + 1 ELSE total_reserved END AS total_reserved
        FROM room_type_inventory""",
    "d_customers": """SELECT id, CASE WHEN id % 31 = 0 THEN NULL ELSE full_name END AS full_name,
        CASE WHEN id % 37 = 0 THEN '09' || LPAD(CAST(id - 1 AS VARCHAR), 8, '0') ELSE phone_number END AS phone_number, email, identity_card, date_of_birth FROM customers""",
}


def d(body: str) -> str:
    return q(body, DIRTY)


def _rows(rule: str, table: str, key: str, detail: str, rel: str, cond: str) -> str:
    return f"SELECT '{rule}' AS rule, '{table}' AS table_name, {key} AS key, {detail} AS detail FROM {rel} WHERE {cond}"


def _check(rule: str, table: str, rel: str, cond: str, key: str = "CAST(id AS VARCHAR)") -> str:
    return _rows(rule, table, key, "'" + cond + "'", rel, cond)


INV = "room_type_id || '|' || date"
CHECKS = "\nUNION ALL ".join(
    [
        _check("reserved_within_inventory", "room_type_inventory", "d_inventory", "total_reserved > total_inventory", INV),
        _check("inventory_not_negative", "room_type_inventory", "d_inventory", "total_inventory < 0", INV),
        _check("stay_not_empty", "bookings", "d_bookings", "check_out <= check_in"),
        _check("paid_within_total", "bookings", "d_bookings", "amount_paid > total_amount"),
        _check("paid_not_negative", "bookings", "d_bookings", "amount_paid < 0"),
        _check("quantity_positive", "booking_details", "d_details", "quantity <= 0"),
        _check("amount_positive", "booking_surcharges", "booking_surcharges", "amount <= 0"),
        _check("stay_not_empty", "room_assignments", "room_assignments", "check_out <= check_in"),
        _check("unit_price_not_negative", "services", "d_services", "unit_price < 0"),
        _check("quantity_positive", "service_usage", "service_usage", "quantity <= 0", "booking_id || '|' || service_id"),
        _check("balance_matches", "invoices", "d_invoices", "balance <> total_amount - amount_paid"),
        _check("base_price_not_negative", "room_types", "room_types", "base_price < 0"),
        _check("capacity_positive", "room_types", "room_types", "max_capacity <= 0"),
    ]
)


def _uniq(rule: str, table: str, rel: str, cols: str) -> str:
    key = " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in cols.split(","))
    return f"SELECT 'unique_{rule}' AS rule, '{table}' AS table_name, {key} AS key, CAST(COUNT(*) AS VARCHAR) AS detail FROM {rel} GROUP BY {cols} HAVING COUNT(*) > 1 AND {key} IS NOT NULL"


UNIQUE = "\nUNION ALL ".join(
    [
        _uniq("id", "bookings", "d_bookings", "id"), _uniq("idempotency_key", "bookings", "d_bookings", "idempotency_key"),
        _uniq("id", "customers", "d_customers", "id"), _uniq("phone_number", "customers", "d_customers", "phone_number"),
        _uniq("email", "customers", "d_customers", "email"), _uniq("identity_card", "customers", "d_customers", "identity_card"),
        _uniq("id", "rooms", "rooms", "id"), _uniq("hotel_id_room_number", "rooms", "rooms", "hotel_id,room_number"),
        _uniq("hotel_id_type_name", "room_types", "room_types", "hotel_id,type_name"),
        _uniq("hotel_id_name", "services", "d_services", "hotel_id,name"),
        _uniq("booking_id_room_type_id", "booking_details", "d_details", "booking_id,room_type_id"),
        _uniq("id", "room_assignments", "room_assignments", "id"), _uniq("id", "booking_surcharges", "booking_surcharges", "id"),
        _uniq("room_type_id_date", "room_type_inventory", "d_inventory", "room_type_id,date"),
        _uniq("booking_id", "invoices", "d_invoices", "booking_id"),
    ]
)


def _fk(table: str, rel: str, col: str, parent: str, key: str = "CAST(id AS VARCHAR)") -> str:
    return _rows(f"fk_{col}", table, key, f"CAST({col} AS VARCHAR)", rel, f"{col} IS NOT NULL AND {col} NOT IN (SELECT id FROM {parent})")


FOREIGN = "\nUNION ALL ".join(
    [
        _fk("room_types", "room_types", "hotel_id", "hotels"), _fk("rooms", "rooms", "hotel_id", "hotels"),
        _fk("rooms", "rooms", "room_type_id", "room_types"), _fk("room_type_inventory", "d_inventory", "room_type_id", "room_types", INV),
        _fk("bookings", "d_bookings", "hotel_id", "hotels"), _fk("bookings", "d_bookings", "customer_id", "d_customers"),
        _fk("booking_details", "d_details", "booking_id", "d_bookings"), _fk("booking_details", "d_details", "room_type_id", "room_types"),
        _fk("booking_surcharges", "booking_surcharges", "booking_id", "d_bookings"),
        _fk("room_assignments", "room_assignments", "booking_id", "d_bookings"), _fk("room_assignments", "room_assignments", "room_id", "rooms"),
        _fk("services", "d_services", "hotel_id", "hotels"),
        _fk("service_usage", "service_usage", "booking_id", "d_bookings", "booking_id || '|' || service_id"),
        _fk("service_usage", "service_usage", "service_id", "d_services", "booking_id || '|' || service_id"),
        _fk("invoices", "d_invoices", "booking_id", "d_bookings"),
    ]
)

NOT_NULL = "\nUNION ALL ".join(
    _rows("not_null", t, "CAST(id AS VARCHAR)", f"'{c}'", rel, f"{c} IS NULL")
    for t, rel, cols in [
        ("customers", "d_customers", ["full_name", "phone_number", "date_of_birth"]),
        ("bookings", "d_bookings", ["hotel_id", "customer_id", "check_in", "check_out"]),
        ("services", "d_services", ["hotel_id", "name", "unit_price"]),
        ("rooms", "rooms", ["hotel_id", "room_number", "room_type_id"]),
    ]
    for c in cols
) + "\nUNION ALL SELECT 'not_null', 'hotels', CAST(s_suppkey AS VARCHAR), 'address' FROM supplier WHERE s_nationkey IS NULL"

ENUMS = "\nUNION ALL ".join(
    [
        _rows("status_allowed", "bookings", "CAST(id AS VARCHAR)", "status", "d_bookings", "status NOT IN ('Pending', 'Active', 'Checked-in', 'Completed', 'Cancelled')"),
        _rows("status_allowed", "rooms", "CAST(id AS VARCHAR)", "status", "rooms", "status NOT IN ('Available', 'Occupied', 'Dirty', 'Maintenance')"),
        _rows("status_allowed", "invoices", "CAST(id AS VARCHAR)", "status", "d_invoices", "status NOT IN ('Draft', 'Issued', 'Paid', 'Void')"),
    ]
)
LENGTHS = _rows("max_length", "services", "CAST(id AS VARCHAR)", "'category'", "d_services", "LENGTH(category) > 50")
ADULT = _rows(
    "adult", "customers", "CAST(id AS VARCHAR)", "CAST(date_of_birth AS VARCHAR)", "d_customers",
    f"date_diff('year', date_of_birth, {DAY}) - CAST(strftime(date_of_birth, '%m%d') > strftime({DAY}, '%m%d') AS INT) < 18",
)
OVERLAP = """SELECT 'no_overlap' AS rule, 'room_assignments' AS table_name, CAST(a.id AS VARCHAR) AS key, 'room ' || a.room_id AS detail
    FROM live_rooms a WHERE EXISTS (SELECT 1 FROM live_rooms b WHERE b.room_id = a.room_id AND b.check_out > a.check_in
    AND (b.check_in < a.check_in OR (b.check_in = a.check_in AND b.id < a.id)))"""
_DRIFT = """SELECT COALESCE(i.room_type_id, x.room_type_id) AS room_type_id, COALESCE(i.date, x.date) AS date,
    CAST(i.total_reserved AS BIGINT) AS stored, CAST(COALESCE(x.n, 0) AS BIGINT) AS expected
    FROM {inv} i FULL JOIN {demand} x ON x.room_type_id = i.room_type_id AND x.date = i.date
    WHERE i.total_reserved IS NULL OR i.total_reserved <> COALESCE(x.n, 0)"""
DIRTY["d_demand"] = """SELECT d.room_type_id, CAST(UNNEST(generate_series(CAST(b.check_in AS DATE), CAST(b.check_out AS DATE) - 1, INTERVAL 1 DAY)) AS DATE) AS date, d.quantity
    FROM d_details d JOIN d_bookings b ON b.id = d.booking_id WHERE b.status IN ('Pending', 'Active', 'Checked-in')"""
DIRTY["d_drift"] = _DRIFT.format(inv="d_inventory", demand="(SELECT room_type_id, date, SUM(quantity) AS n FROM d_demand GROUP BY ALL)")
DIRTY["d_due"] = """SELECT b.id, CAST(COALESCE(r.n, 0) * GREATEST(CAST(b.check_out AS DATE) - CAST(b.check_in AS DATE), 1) + t.surcharge_cost + COALESCE(v.n, 0) AS DECIMAL(18,2)) AS due
    FROM d_bookings b JOIN totals t ON t.booking_id = b.id
    LEFT JOIN (SELECT booking_id, SUM(agreed_price * quantity) AS n FROM d_details GROUP BY 1) r ON r.booking_id = b.id
    LEFT JOIN (SELECT booking_id, SUM(u.quantity * s.unit_price) AS n FROM service_usage u JOIN d_services s ON s.id = u.service_id GROUP BY 1) v ON v.booking_id = b.id"""
INV_DRIFT = """SELECT 'inventory_drift' AS rule, 'room_type_inventory' AS table_name, room_type_id || '|' || date AS key,
    COALESCE(CAST(stored AS VARCHAR), 'missing') || ' should be ' || expected AS detail FROM d_drift"""
TOTAL_DRIFT = """SELECT 'total_drift' AS rule, 'bookings' AS table_name, CAST(b.id AS VARCHAR) AS key,
    b.total_amount || ' should be ' || x.due AS detail FROM d_bookings b JOIN d_due x ON x.id = b.id WHERE b.total_amount <> x.due"""

_ALL = [CHECKS, NOT_NULL, ENUMS, LENGTHS, ADULT, UNIQUE, FOREIGN, OVERLAP, INV_DRIFT, TOTAL_DRIFT]

SQL: dict[str, str] = {
    "dq_checks": d(CHECKS),
    "dq_unique": d(UNIQUE),
    "dq_foreign_keys": d(FOREIGN),
    "dq_not_null": d(NOT_NULL),
    "dq_enums": d(ENUMS),
    "dq_lengths": d(LENGTHS),
    "dq_adult": d(ADULT),
    "dq_no_overlap": d(OVERLAP),
    "dq_inventory_drift": d(INV_DRIFT),
    "inventory_drift": q(_DRIFT.format(inv="room_type_inventory", demand="demand")),
    "dq_total_drift": d(TOTAL_DRIFT),
    "integrity_report": d("SELECT rule, table_name, COUNT(*) AS violations FROM (" + "\nUNION ALL ".join(_ALL) + """) GROUP BY ALL
        UNION ALL SELECT 'missing_column', * FROM (VALUES ('hotels', 1), ('customers', 1), ('room_types', 3), ('rooms', 3), ('bookings', 3),
            ('booking_surcharges', 1), ('room_assignments', 1), ('services', 1), ('service_usage', 3)) lost"""),
    "cascade_delete": q("""WITH gone AS (SELECT id FROM bookings_core WHERE id % 10 = 3)
        SELECT 'bookings' AS table_name, COUNT(*) AS rows FROM bookings_core WHERE id NOT IN (FROM gone)
        UNION ALL SELECT 'booking_details', COUNT(*) FROM booking_details WHERE booking_id NOT IN (FROM gone)
        UNION ALL SELECT 'booking_surcharges', COUNT(*) FROM booking_surcharges WHERE booking_id NOT IN (FROM gone)
        UNION ALL SELECT 'room_assignments', COUNT(*) FROM room_assignments WHERE booking_id NOT IN (FROM gone)
        UNION ALL SELECT 'service_usage', COUNT(*) FROM service_usage WHERE booking_id NOT IN (FROM gone)""".replace("WITH gone AS (SELECT id FROM bookings_core WHERE id % 10 = 3)\n", ""),
        {"gone": "SELECT id FROM bookings_core WHERE id % 10 = 3"}),
    "delete_blockers": q("""SELECT rt.id, 'rooms' AS table_name, COUNT(*) AS rows FROM room_types rt JOIN rooms r ON r.room_type_id = rt.id WHERE rt.type_name = 'Suite' GROUP BY 1
        UNION ALL SELECT rt.id, 'booking_details', COUNT(*) FROM room_types rt JOIN booking_details x ON x.room_type_id = rt.id WHERE rt.type_name = 'Suite' GROUP BY 1"""),
}
