"""Bounds of what large tables cost: sizes of partitions, and how often a job works its requests out."""

import datetime as dt

import golden
import pytest
from pyspark.sql import functions as F

from staylake import session
from staylake.plans import admission, common, ordered, pipeline
from staylake.plans.admission import overlapping, pre_assign_rooms
from staylake.plans.rooms import check_in_batch
from staylake.session import SETTINGS, measured_joins

AT = dt.datetime(2024, 1, 1)


def stay(first, last):
    return AT + dt.timedelta(hours=first), AT + dt.timedelta(hours=last)


@pytest.fixture
def tables(spark):
    make = spark.createDataFrame
    return {
        "rooms": make([(i, 1, 10, str(i), "Available") for i in (1, 2, 3)], "id long, hotel_id long, room_type_id long, room_number string, status string"),
        "bookings": make([(b, 1, "Active", *stay(0, 300)) for b in (1, 2)], "id long, hotel_id long, status string, check_in timestamp_ntz, check_out timestamp_ntz"),
        "booking_details": make([(b, b, 10, 1) for b in (1, 2)], "id long, booking_id long, room_type_id long, quantity int"),
        "room_assignments": make(
            [(1, 1, 1, *stay(0, 300), False), (2, 2, 2, *stay(0, 300), False)],
            "id long, booking_id long, room_id long, check_in timestamp_ntz, check_out timestamp_ntz, is_cancelled boolean",
        ),
    }


def joins(df):
    return df._jdf.queryExecution().analyzed().toString().count("Join ")


def test_partitions_stay_small():
    assert SETTINGS["spark.sql.adaptive.advisoryPartitionSizeInBytes"] == "8m"


def test_check_in_verdicts_read_written_rows(spark, tables):
    req = spark.createDataFrame([(1, 1, 1, 7), (2, 2, 1, 7), (3, 2, 3, 7), (4, 9, 3, 7)], "seq long, booking_id long, room_id long, staff_id long")
    got = check_in_batch(tables, req, "2024-01-02")["results"]
    assert joins(got) <= 1
    assert {r["seq"]: r["code"] for r in got.collect()} == {1: None, 2: "ROOM_NOT_AVAILABLE", 3: None, 4: "NOT_FOUND"}


def test_move_verdicts_read_written_rows(spark, tables):
    moves = spark.createDataFrame([(1, 1, 1, 3), (2, 2, 2, 3), (3, 2, 2, 1), (4, 9, 2, 1)], "seq long, booking_id long, from_room_id long, to_room_id long")
    got = pre_assign_rooms(tables, moves, "2024-01-02")["results"]
    assert joins(got) == 0
    assert {r["seq"]: r["code"] for r in got.collect()} == {1: None, 2: "ROOM_OVERLAP", 3: "ROOM_OVERLAP", 4: "NOT_FOUND"}


def test_overlaps_in_blocks_are_those_of_all_pairs(spark):
    spans = [stay(a, a + n) for a in range(-40, 500, 7) for n in (0, 5, 30, 200, 400, -3, -60)]
    stored = [(1 + i % 2, i, *s) for i, s in enumerate(spans) if i % 3 == 0]
    asked = [(i, i, 1 + i % 2, *s, 1 + i % 2 if i % 6 == 0 else None) for i, s in enumerate(spans)]
    day = lambda x: x.date()
    want = {
        seq for seq, b, room, a, z, given in asked for r, sb, sa, sz in stored
        if r == room and sa < z and a < sz and day(a) <= day(z) and day(sa) <= day(sz) and not (sb == b and given == room)
    }
    got = overlapping(
        spark.createDataFrame(asked, "seq long, booking_id long, room_id long, check_in timestamp_ntz, check_out timestamp_ntz, from_room_id long"),
        spark.createDataFrame(stored, "room_id long, booking_id long, check_in timestamp_ntz, check_out timestamp_ntz"),
    )
    assert {r["seq"] for r in got.collect()} == want


LIMIT = "spark.sql.autoBroadcastJoinThreshold"


def test_no_join_is_broadcast_by_the_size_of_a_file(spark, tmp_path):
    """A small file of hotels becomes many rooms: only their rows, once measured, may say that they are broadcast."""
    spark.range(2000).write.parquet(f"{tmp_path}/hotels")
    rooms = spark.read.parquet(f"{tmp_path}/hotels").select("id", F.explode(F.sequence(F.lit(1), F.lit(300))).alias("room"))
    plan = lambda: spark.range(5000).join(rooms, "id").groupBy("id").count()._jdf.queryExecution().executedPlan().toString()
    before = spark.conf.get(LIMIT)
    assert "BroadcastHashJoin" in plan()
    with measured_joins(spark):
        assert "BroadcastHashJoin" not in plan() and "SortMergeJoin" in plan()
    assert spark.conf.get(LIMIT) == before
    with pytest.raises(ValueError), measured_joins(spark):
        raise ValueError
    assert spark.conf.get(LIMIT) == before and "BroadcastHashJoin" in plan()


def test_jobs_that_assign_rooms_write_under_measured_joins(spark, monkeypatch):
    limits = []
    for module in (admission, common, ordered, pipeline):
        monkeypatch.setattr(module, "cut_lineage", lambda df, *by: limits.append(spark.conf.get(LIMIT)) or session.cut_lineage(df, *by))
    t = golden.two_stays(spark)
    before = spark.conf.get(LIMIT)
    got = admission.assign_rooms_first_fit(t, spark.createDataFrame([(1, 1), (2, 9)], "seq bigint, booking_id bigint"), golden.AS_OF)["results"]
    assert joins(got) == 0 and {r["seq"]: r["code"] for r in got.collect()}[2] == "NOT_FOUND"
    assert limits and set(limits) == {"-1"} and spark.conf.get(LIMIT) == before
    del limits[:]
    req = spark.createDataFrame(
        [(1, "r1", 1, 1, *stay(14, 36), "k", 1)],
        "seq bigint, request_id string, hotel_id bigint, customer_id bigint, check_in timestamp_ntz, check_out timestamp_ntz, idempotency_key string, staff_id bigint",
    )
    rooms = spark.createDataFrame([("r1", 1, 1, False)], "request_id string, room_type_id bigint, quantity int, is_breakfast_included boolean")
    none = spark.createDataFrame([], "request_id string, service_id bigint, quantity int")
    got = pipeline.create_bookings(t, req, rooms, none, golden.AS_OF)["results"]
    assert joins(got) == 0 and got.count() == 1
    assert limits and set(limits) == {"-1"} and spark.conf.get(LIMIT) == before


def test_stays_meet_runs_in_blocks_of_days(spark):
    """As many stays per run as when every day of a stay meets every day of a run, and fewer rows to join."""
    asks = [(1 + i % 2, *stay(a, a + n)) for i, (a, n) in enumerate([(0, 30), (40, 20), (200, 400), (650, 10), (300, 50), (-90, 2), (1000, 900), (10, -20)])]
    spans = [(1 + i % 3, i, *stay(a, a + n)) for i, (a, n) in enumerate((a, n) for a in range(-200, 2200, 37) for n in (0, 7, 60, 700, -5, -50))]
    spans = spans + spans[:9] + [(1, 9999, None, stay(1, 2)[1])]
    run_days = common.runs(spark.createDataFrame(asks, "key long, check_in timestamp_ntz, check_out timestamp_ntz"), ["key"])
    days = {}
    for r in run_days.collect():
        days.setdefault((r["key"], r["run"]), set()).add(r["day"])
    want = set()
    for key, room, a, z in spans:
        for (k, run), held in days.items():
            if k == key and a and any(a.date() <= d <= z.date() for d in held):
                want.add((key, room, a, z, run))
    found = common.in_runs(spark.createDataFrame(spans, "key long, room_id long, check_in timestamp_ntz, check_out timestamp_ntz"), run_days, ["key"])
    got = [tuple(r) for r in found.select("key", "room_id", "check_in", "check_out", "run").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(days) > 4
