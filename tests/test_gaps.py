"""Free spans of rooms against plain Python, with few and many rooms to a block and a crowded room."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from staylake.operators import calendar, gaps

DAY0 = dt.datetime(2026, 7, 1)
STAYS = "id bigint, booking_id bigint, room_id bigint, check_in timestamp_ntz, check_out timestamp_ntz, is_cancelled boolean"
ASKS = "request_id string, hotel_id bigint, room_type_id bigint, check_in timestamp_ntz, check_out timestamp_ntz"


def hotel(spark, n_rooms, stays):
    rooms = [(i, 1 + i % 2, 1 + i % 2, f"{(i * 7) % n_rooms:03d}") for i in range(1, n_rooms + 1)]
    return {
        "rooms": spark.createDataFrame(rooms, "id bigint, hotel_id bigint, room_type_id bigint, room_number string"),
        "room_assignments": spark.createDataFrame(stays, STAYS),
    }, rooms


def moment(rnd, days=30):
    return DAY0 + dt.timedelta(days=rnd.randrange(days), hours=rnd.randrange(24))


@pytest.mark.parametrize("stays_a_task, rooms_a_block", [(1_000_000, 256), (5, 3)])
def test_free_rooms_match_plain(spark, monkeypatch, stays_a_task, rooms_a_block):
    monkeypatch.setattr(gaps, "ROOM_STAYS", stays_a_task)
    monkeypatch.setattr(gaps, "BLOCK_ROOMS", rooms_a_block)
    rnd = random.Random(stays_a_task)
    stays = []
    for i in range(160):  # overlapping stays, stays that follow at once, stays without length, cancelled ones, one room with most
        a = moment(rnd)
        b = a + dt.timedelta(hours=rnd.choice([0, 5, 20, 30, 100]))
        stays.append((i, i, 1 if i % 3 == 0 else rnd.randrange(1, 17), a, b, rnd.random() < 0.1))
        if rnd.random() < 0.3:
            stays.append((1000 + i, i, stays[-1][2], b, b + dt.timedelta(hours=9), None))
    t, rooms = hotel(spark, 20, stays)
    asks = []
    for i in range(200):
        a = moment(rnd, 34) - dt.timedelta(days=2)
        k = 1 + i % 2
        asks.append((f"r{i}", k if i % 17 else 9, k, a, a + dt.timedelta(hours=rnd.choice([0, 3, 24, 70]))))
    want = {}
    for r, h, k, a, b in asks:
        free = [(n, i) for i, rh, rk, n in rooms if rh == h and rk == k and not any(s[2] == i and not s[5] and s[3] < b and a < s[4] for s in stays)]
        want[r] = sorted(free)
    req = spark.createDataFrame(asks, ASKS)
    got = {}
    for x in calendar.free_rooms(t, req).collect():
        got.setdefault(x.request_id, []).append((x.room_number, x.room_id))
    assert {r: sorted(v) for r, v in got.items()} == {r: v for r, v in want.items() if v}
    first = {x.request_id: (x.room_number, x.room_id) for x in calendar.first_free_room(t, req).collect()}
    assert first == {r: v[0] for r, v in want.items() if v}


def test_equal_requests_meet_one_index_row(spark):
    """10,000 equal requests for a type of 500 rooms: the index has two rows, and no step lists requests times rooms."""
    stays = [(i, i, i, DAY0, DAY0 + dt.timedelta(days=3), False) for i in range(1, 900)]
    t, _ = hotel(spark, 1000, stays)
    req = spark.range(10_000).select(
        F.concat(F.lit("r"), "id").alias("request_id"), F.lit(1).cast("bigint").alias("hotel_id"), F.lit(1).cast("bigint").alias("room_type_id"),
        F.lit(DAY0 + dt.timedelta(days=1)).cast("timestamp_ntz").alias("check_in"), F.lit(DAY0 + dt.timedelta(days=2)).cast("timestamp_ntz").alias("check_out"),
    )
    index = gaps.gap_index(t, req).collect()
    assert len(index) == 2 and sum(len(r.gaps) for r in index) == 51
    assert gaps.fitting_gaps(t, req).count() == 20_000
    began = time.time()
    best = calendar.first_free_room(t, req).groupBy("room_id").count().collect()
    assert [r["count"] for r in best] == [10_000] and time.time() - began < 60


def test_no_stays_and_no_requests(spark):
    t, rooms = hotel(spark, 4, [])
    req = spark.createDataFrame([("a", 1, 1, DAY0, DAY0 + dt.timedelta(days=1))], ASKS)
    assert calendar.free_rooms(t, req).count() == 2
    assert calendar.first_free_room(t, req.limit(0)).collect() == []
