"""Order-dependent jobs against plain Python, on random data, whole and cut into small slices."""

import datetime as dt
import random
from decimal import Decimal as D

import golden
from pyspark.sql import functions as F
from staylake.plans import admission, bookings, money, pipeline
from staylake.sources.schemas import REQUESTS, MONEY, LONG
from pyspark.sql import types as T

BASE = dt.datetime(2026, 7, 10)


def crowded(spark, seed_no, n=60):
    """One hotel with far more requests than rooms: the hot group of every job."""
    rnd = random.Random(seed_no)
    stays, details, did = [], [], 0
    for i in range(1, n + 1):
        first = rnd.randrange(0, 20)
        a = BASE + dt.timedelta(days=first, hours=rnd.randrange(0, 23))
        b = a + dt.timedelta(days=rnd.randrange(0, 4), hours=1)
        stays.append({"id": i, "hotel_id": 1, "customer_id": 1, "status": "Pending", "idempotency_key": f"k{i}", "check_in": a, "check_out": b, "total_amount": 0, "amount_paid": 0})
        for k in rnd.sample([1, 2], rnd.choice([1, 1, 2])):
            did += 1
            details.append({"id": did, "booking_id": i, "room_type_id": k, "agreed_price": 100, "quantity": rnd.choice([1, 1, 2]), "is_breakfast_included": False})
    inventory = [
        {"room_type_id": k, "date": (BASE + dt.timedelta(days=d)).date(), "total_inventory": 2 if k == 1 else 1, "total_reserved": 0}
        for k in (1, 2) for d in range(24) if (k, d) != (1, 9)
    ]
    pinned = [{"id": 1, "booking_id": 900, "room_id": 1, "check_in": BASE + dt.timedelta(days=4), "check_out": BASE + dt.timedelta(days=6), "is_cancelled": False}]
    return stays, details, inventory, pinned


def admit(stays, details, inventory, rooms, busy):
    """Plain sequential admission in booking order."""
    free = {(r["room_type_id"], r["date"]): r["total_inventory"] - r["total_reserved"] for r in inventory}
    busy = list(busy)
    codes = {}
    for s in stays:
        code, take, spots = None, [], []
        for d in sorted((d for d in details if d["booking_id"] == s["id"]), key=lambda d: d["room_type_id"]):
            day = s["check_in"].date()
            while day < s["check_out"].date():
                cell = (d["room_type_id"], day)
                if cell not in free:
                    code = code or "MISSING_INVENTORY"
                elif free[cell] < d["quantity"]:
                    code = code or "OVERBOOKING"
                take.append((cell, d["quantity"]))
                day += dt.timedelta(days=1)
        if rooms and not code:
            for d in sorted((d for d in details if d["booking_id"] == s["id"]), key=lambda d: d["room_type_id"]):
                for _ in range(d["quantity"]):
                    spot = next((r for r, k in rooms if k == d["room_type_id"] and not any(x == r and a < s["check_out"] and s["check_in"] < b for x, a, b in busy + spots)), None)
                    if spot is None:
                        code = code or "ROOM_ASSIGN_FAILED"
                    else:
                        spots.append((spot, s["check_in"], s["check_out"]))
        if code is None:
            for cell, n in take:
                free[cell] -= n
            busy += spots
        codes[s["id"]] = code
    return codes


def test_reserve_matches_sequential(spark):
    for seed_no in (1,):
        stays, details, inventory, _ = crowded(spark, seed_no)
        t = golden.two_stays(spark, bookings=stays, room_type_inventory=inventory)
        req = spark.createDataFrame([(d["booking_id"], d["booking_id"], d["room_type_id"], d["quantity"], False) for d in details],
                                    "seq bigint, booking_id int, room_type_id int, quantity int, is_breakfast_included boolean")
        want = {k: v is None for k, v in admit(stays, details, inventory, [], []).items()}
        for rows in (1_000_000, 25):
            state = admission.reserve_inventory(t, req, group_rows=rows)
            assert {r.booking_id: r.accepted for r in state["results"].collect()} == want
            assert state["room_type_inventory"].filter("total_reserved > total_inventory").count() == 0
    assert len(set(want.values())) == 2


def test_create_matches_sequential(spark):
    stays, details, inventory, pinned = crowded(spark, 3)
    t = golden.two_stays(spark, bookings=[], room_type_inventory=inventory, room_assignments=pinned)
    req = spark.createDataFrame([(s["id"], f"r{s['id']}", 1, 1, s["check_in"], s["check_out"], s["idempotency_key"], 1) for s in stays], REQUESTS["booking_requests"])
    lines = spark.createDataFrame([(f"r{d['booking_id']}", d["room_type_id"], 1, False) for d in details for _ in range(d["quantity"])], REQUESTS["booking_request_rooms"])
    usage = spark.createDataFrame([("r1", 1, 2), ("r2", 77, 1)], REQUESTS["booking_request_services"])
    others = [s for s in stays if s["id"] != 2]  # request 2 asks for an unknown service
    want = admit(others, details, inventory, [(1, 1), (2, 1), (3, 2)], [(1, pinned[0]["check_in"], pinned[0]["check_out"])])
    want[2] = "NOT_FOUND"
    for rows in (1_000_000, 40):
        state = pipeline.create_bookings(t, req, lines, usage, golden.AS_OF, rows)
        got = {int(r.request_id[1:]): r.code for r in state["results"].collect()}
        assert got == want
    made = state["bookings"].count()
    assert made == sum(v is None for v in want.values()) == state["totals"].count()
    after = t.replaced(bookings=state["bookings"], room_assignments=state["room_assignments"])
    from staylake.operators.calendar import assignment_overlaps

    assert assignment_overlaps(after).count() == 0


def test_payments_match_sequential(spark):
    rnd = random.Random(5)
    pays = [(i, rnd.choice([1, 1, 1, 2, 3]), D(rnd.randrange(1, 4000)) / 100) for i in range(400)]
    rest = {1: D(900), 2: D("50.5"), 3: D(5000)}
    left, want = dict(rest), {}
    for seq, b, amount in pays:
        want[seq] = amount <= left[b]
        left[b] -= amount if want[seq] else 0
    schema = T.StructType([T.StructField("seq", LONG), T.StructField("booking_id", LONG), T.StructField("amount", MONEY), T.StructField("rest", MONEY)])
    due = spark.createDataFrame([(s, b, a, rest[b]) for s, b, a in pays], schema)
    for fold, width in ((1000, 1_000_000), (10, 40)):  # all in one fold; hot bookings in slices
        got = {r.seq: r.fits for r in money.settle_payments(due, fold, width).collect()}
        assert got == want


def test_guests_match_sequential(spark):
    rnd = random.Random(9)
    rows = []
    for i in range(120):
        rows.append((i, f"G {i}", f"09{rnd.randrange(40):08d}", rnd.choice([None, f"m{rnd.randrange(50)}"]), rnd.choice([None, f"c{rnd.randrange(60)}"]), dt.date(1990, 1, 1)))
    t = golden.seed(spark)
    want, held = {}, {(i, r[c]) for r in t["customers"].collect() for i, c in enumerate(("phone_number", "email", "identity_card"))}
    for seq, _, phone, mail, card, _ in rows:
        keys = [(i, v) for i, v in enumerate((phone, mail, card)) if v is not None]
        hit = next((i for i, v in keys if (i, v) in held), None)
        want[seq] = None if hit is None else ("DUPLICATE_PHONE", "DUPLICATE_EMAIL", "DUPLICATE_IDENTITY")[hit]
        if hit is None:
            held |= set(keys)
    state = bookings.customer_intake(t, spark.createDataFrame(rows, REQUESTS["customer_requests"]), golden.AS_OF)
    assert {r.seq: r.code for r in state["results"].collect()} == want


def test_row_order_does_not_matter(spark):
    stays, details, inventory, pinned = crowded(spark, 4)
    for s in stays:
        s["status"] = "Active"
    t = golden.two_stays(spark, bookings=stays, booking_details=details, room_assignments=pinned)
    hotel = spark.createDataFrame([(1,)], "hotel_id int")
    first = admission.defragment_rooms(t, hotel, golden.AS_OF)
    shuffled = golden.two_stays(spark, bookings=stays[::-1], booking_details=details[::-1], room_assignments=pinned)
    second = admission.defragment_rooms(shuffled, hotel, golden.AS_OF, 20)
    spots = lambda s: sorted(map(tuple, s["placed"].collect()))
    assert spots(first) == spots(second)
    asked = sum(d["quantity"] for d in details)
    assert first["placed"].count() + first["unplaced"].count() == asked
