"""Two small hand-checked data sets (FIXTURES.md section 2), at fixed dates."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from staylake.sources.schemas import TABLES
from staylake.sources.tables import LazyTables

DAY = dt.date(2026, 7, 10)
AS_OF = "2026-07-10 13:00:00"


def at(offset: int, clock: str) -> dt.datetime:
    h, m = map(int, clock.split(":"))
    return dt.datetime.combine(DAY + dt.timedelta(days=offset), dt.time(h, m))


def tables(spark, **rows) -> LazyTables:
    """Tables from lists of dicts; left-out columns are null."""

    def build(name):
        schema = TABLES[name]
        data = [tuple(_fit(f, r.get(f.name)) for f in schema) for r in rows.get(name, [])]
        return spark.createDataFrame(data, schema)

    return LazyTables({name: (lambda t, n=name: build(n)) for name in TABLES})


def _fit(field, value):
    if value is not None and field.dataType.typeName() == "decimal":
        return Decimal(str(value))
    return value


BOOKINGS = [
    # id, state, check-in, check-out, {type: quantity}, rooms, stated total
    (1, "Checked-in", (-1, "14:15"), (2, "12:00"), {1: 1}, [1], 2400000),
    (2, "Checked-in", (-2, "15:30"), (1, "11:00"), {2: 1}, [6], 3600000),
    (3, "Active", (1, "14:00"), (3, "12:00"), {1: 2}, [2, 3], 3200000),
    (4, "Active", (1, "14:30"), (2, "12:00"), {2: 2}, [7, 8], 2400000),
    (5, "Active", (2, "13:15"), (4, "12:45"), {1: 1, 2: 1}, [4, 9], 4000000),
    (6, "Active", (2, "14:00"), (5, "11:45"), {1: 1}, [1], 2400000),
    (7, "Active", (1, "13:00"), (3, "12:30"), {2: 1}, [6], 2400000),
    (8, "Active", (3, "14:15"), (6, "12:00"), {1: 2}, [2, 5], 4800000),
    (9, "Checked-in", (0, "12:00"), (2, "11:00"), {2: 1}, [10], 2400000),
    (10, "Active", (4, "14:30"), (7, "12:00"), {1: 1, 2: 1}, [3, 7], 6000000),
    (11, "Active", (5, "14:00"), (6, "12:00"), {1: 1}, [4], 800000),
    (12, "Active", (5, "15:00"), (8, "11:30"), {2: 2}, [8, 9], 7200000),
    (13, "Active", (6, "13:30"), (9, "12:00"), {1: 1}, [1], 2400000),
]
PRICES = {1: 800000, 2: 1200000, 3: 2500000}
DEMAND = {
    1: [0, 0, 0, 0, 1, 1, 3, 4, 4, 4, 4, 2, 1, 1, 0],
    2: [0, 0, 0, 1, 1, 2, 4, 2, 1, 1, 3, 3, 2, 0, 0],
}


def seed(spark, **more) -> LazyTables:
    numbers = [(1, n) for n in range(101, 106)] + [(2, n) for n in range(201, 206)] + [(3, n) for n in range(301, 305)]
    rooms = [
        {"id": i + 1, "hotel_id": 1, "room_number": str(n), "room_type_id": k, "status": "Occupied" if i + 1 in (1, 6, 10) else "Available"}
        for i, (k, n) in enumerate(numbers)
    ]
    bookings, details, stays = [], [], []
    for id_, state, ci, co, kinds, room_ids, total in BOOKINGS:
        bookings.append({
            "id": id_, "hotel_id": 1, "customer_id": 1 + id_ % 5, "status": state, "idempotency_key": f"k{id_}",
            "check_in": at(*ci), "check_out": at(*co), "total_amount": total, "amount_paid": 0,
        })
        for k, n in kinds.items():
            details.append({"id": len(details) + 1, "booking_id": id_, "room_type_id": k, "agreed_price": PRICES[k], "quantity": n, "is_breakfast_included": False})
        for r in room_ids:
            stays.append({"id": len(stays) + 1, "booking_id": id_, "room_id": r, "check_in": at(*ci), "check_out": at(*co), "is_cancelled": False})
    inventory = []
    for k, n in ((1, 5), (2, 5), (3, 4)):
        for off in range(-5, 26):
            held = DEMAND.get(k, [])
            inventory.append({
                "room_type_id": k, "date": DAY + dt.timedelta(days=off), "total_inventory": n,
                "total_reserved": held[off + 5] if off + 5 < len(held) else 0,
            })
    rows = {
        "hotels": [{"id": i, "name": f"Hotel {i}", "address": f"Street {i}"} for i in (1, 2, 3)],
        "customers": [
            {"id": i, "full_name": f"Guest {i}", "phone_number": f"090{i:07d}", "email": f"g{i}@example.com", "identity_card": f"ID{i}", "date_of_birth": dt.date(1985 + i, 5, 12)}
            for i in range(1, 6)
        ],
        "room_types": [
            {"id": 1, "hotel_id": 1, "type_name": "Standard", "base_price": 800000, "max_capacity": 2},
            {"id": 2, "hotel_id": 1, "type_name": "Deluxe", "base_price": 1200000, "max_capacity": 2},
            {"id": 3, "hotel_id": 1, "type_name": "Suite", "base_price": 2500000, "max_capacity": 4},
        ],
        "rooms": rooms, "bookings": bookings, "booking_details": details, "room_assignments": stays, "room_type_inventory": inventory,
    }
    return tables(spark, **{**rows, **more})


def two_stays(spark, **more) -> LazyTables:
    """One hotel, two overlapping stays of an early guest, three rooms, four inventory days."""

    def d(n):
        return dt.date(2026, 7, n)

    def ts(n, h, m=0):
        return dt.datetime(2026, 7, n, h, m)

    rows = {
        "hotels": [{"id": 1, "name": "Bay House", "address": "1 Quay"}],
        "customers": [{"id": 1, "full_name": "Early Guest", "phone_number": "0909000100", "date_of_birth": dt.date(1990, 1, 1)}],
        "surcharge_policies": [
            {"id": 1, "policy_type": "EarlyCheckIn", "description": "early", "multiplier": "0.50", "start_sec": 21600, "end_sec": 50400, "is_active": True},
            {"id": 2, "policy_type": "LateCheckOut", "description": "late", "multiplier": "0.30", "start_sec": 43200, "end_sec": 64800, "is_active": True},
        ],
        "room_types": [
            {"id": 1, "hotel_id": 1, "type_name": "Deluxe", "base_price": 120, "max_capacity": 2},
            {"id": 2, "hotel_id": 1, "type_name": "Suite", "base_price": 220, "max_capacity": 3},
        ],
        "rooms": [
            {"id": 1, "hotel_id": 1, "room_number": "D101", "room_type_id": 1, "status": "Available"},
            {"id": 2, "hotel_id": 1, "room_number": "D102", "room_type_id": 1, "status": "Available"},
            {"id": 3, "hotel_id": 1, "room_number": "S201", "room_type_id": 2, "status": "Available"},
        ],
        "room_type_inventory": [
            {"room_type_id": k, "date": d(n), "total_inventory": 2 if k == 1 else 1, "total_reserved": 0} for k in (1, 2) for n in range(10, 14)
        ],
        "services": [{"id": 1, "hotel_id": 1, "name": "Minibar", "unit_price": 25, "category": "F&B"}],
        "bookings": [
            {"id": 1, "hotel_id": 1, "customer_id": 1, "status": "Pending", "idempotency_key": "a", "check_in": ts(10, 7), "check_out": ts(12, 13), "total_amount": 0, "amount_paid": 0},
            {"id": 2, "hotel_id": 1, "customer_id": 1, "status": "Pending", "idempotency_key": "b", "check_in": ts(11, 8), "check_out": ts(13, 11), "total_amount": 0, "amount_paid": 0},
        ],
    }
    return tables(spark, **{**rows, **more})
