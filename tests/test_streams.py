"""Streams over several batches, with late events, a restart and compaction, against the batch results."""

import datetime as dt
from decimal import Decimal as D

import golden

from staylake.operators.billing import booking_total
from staylake.streaming import jobs

EVENT = "op string, room_type_id bigint, quantity int, check_in timestamp_ntz, check_out timestamp_ntz, at timestamp_ntz"
DAY0 = dt.datetime(2026, 1, 1, 15)


def event(op, kind, first, nights, at, n=1):
    return op, kind, n, DAY0 + dt.timedelta(days=first), DAY0 + dt.timedelta(days=first + nights), DAY0 + dt.timedelta(days=at)


def batch_counts(events):
    counts: dict = {}
    for op, kind, n, a, b, _ in events:
        day = a.date()
        while day < b.date():
            counts[kind, day] = counts.get((kind, day), 0) + (n if op == "reserve" else -n)
            day += dt.timedelta(days=1)
    return counts


def occupancy(spark, feed, out, checkpoint):
    """Run what has arrived; gives the rows left in state after the last batch."""
    events = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(feed)
    query = jobs.stream_occupancy(events, out, checkpoint, horizon=30, grace=3)
    query.awaitTermination()
    return query.lastProgress["stateOperators"][0] if query.lastProgress else None


def test_occupancy_batches_restart_and_expiry(spark, tmp_path):
    feed, out, checkpoint = (f"{tmp_path}/{n}" for n in ("feed", "out", "checkpoint"))
    write = lambda rows: spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(feed)
    first = [event("reserve", 1, 0, 3, -5), event("reserve", 1, 2, 2, -4, 2), event("reserve", 2, 1, 1, -4)]
    second = [event("release", 1, 2, 2, -2, 2), event("reserve", 2, 3, 2, 0)]
    write(first)
    occupancy(spark, feed, out, checkpoint)
    write(second)
    occupancy(spark, feed, out, checkpoint)  # a restart from the checkpoint
    read = lambda: {(r.room_type_id, r.date): r.reserved for r in jobs.read_occupancy(spark, out).collect()}
    assert read() == batch_counts(first + second)
    # a late event within the grace still counts
    late = [event("release", 2, 1, 1, 2)]
    write(late)
    occupancy(spark, feed, out, checkpoint)
    assert read() == batch_counts(first + second + late)
    # two months on the old nights leave the state, and an event for one of them is dropped; one too far ahead is not taken
    later = [event("reserve", 1, 75, 2, 60), event("reserve", 1, 200, 1, 60)]
    write(later)
    occupancy(spark, feed, out, checkpoint)
    write([event("reserve", 1, 80, 1, 61)])
    occupancy(spark, feed, out, checkpoint)
    write([event("reserve", 1, 0, 1, 61), event("reserve", 1, 81, 1, 61)])
    state = occupancy(spark, feed, out, checkpoint)
    want = batch_counts(first + second + late + later[:1] + [event("reserve", 1, 80, 1, 61), event("reserve", 1, 81, 1, 61)])
    assert read() == want
    assert state["numRowsTotal"] == 4 and state["numRowsTotal"] < len(want)
    # compaction changes nothing, and the stream goes on after it
    schema = (jobs.OCCUPANCY_SCHEMA, ["room_type_id", "date"], ["reserved"])
    assert jobs.compact(spark, out, *schema) >= 4 and read() == want
    write([event("release", 1, 81, 1, 62)])
    occupancy(spark, feed, out, checkpoint)
    assert read() == want | {(1, (DAY0 + dt.timedelta(days=81)).date()): 0}
    assert jobs.compact(spark, out, *schema, keep="reserved <> 0") >= 1
    assert read() == {k: n for k, n in want.items() if n and k[1] != (DAY0 + dt.timedelta(days=81)).date()}


def test_totals_from_changes(spark, tmp_path):
    """Three batches with a restart: the totals of ``booking_total``, without reading a table again."""
    feed, out, checkpoint = (f"{tmp_path}/{n}" for n in ("feed", "out", "checkpoint"))
    drinks = [{"id": i, "booking_id": 1 + i % 3, "service_id": 1, "quantity": i} for i in range(1, 7)]
    bar = [{"id": 1, "hotel_id": 1, "name": "Bar", "unit_price": 25, "category": "F&B"}]
    t = golden.seed(spark, service_usage=drinks, services=bar)
    F = jobs.F
    prices = t["services"].select(F.col("id").alias("service_id"), "unit_price")
    parts = {
        jobs.NIGHTS: t["bookings"].select(F.col("id").alias("booking_id"), jobs.F.expr("greatest(datediff(to_date(check_out), to_date(check_in)), 1)").alias("amount")),
        jobs.ROOM: t["booking_details"].selectExpr("booking_id", "agreed_price * quantity AS amount"),
        jobs.SURCHARGE: t["booking_surcharges"].select("booking_id", "amount"),
        jobs.SERVICE: t["service_usage"].join(prices, "service_id").selectExpr("booking_id", "quantity * unit_price AS amount"),
    }

    def send(df):
        df.withColumn("booking_id", F.col("booking_id").cast("bigint")).coalesce(1).write.mode("append").parquet(feed)

    def run():
        schema = "booking_id bigint, part string, change decimal(18,2)"
        jobs.stream_totals(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(feed), out, checkpoint).awaitTermination()

    send(jobs.child_changes(None, parts[jobs.SERVICE], jobs.SERVICE))  # children before their booking
    send(jobs.child_changes(None, parts[jobs.NIGHTS], jobs.NIGHTS))
    run()
    for part in (jobs.ROOM, jobs.SURCHARGE):
        send(jobs.child_changes(None, parts[part], part))
    run()
    read = lambda: {r.booking_id: r.total_amount for r in jobs.read_totals(spark, out).collect()}
    assert read() == {r.booking_id: r.total_amount for r in booking_total(t).collect()}
    # a row moves to another booking and doubles: taken from the one, given to the other
    moved = parts[jobs.SERVICE].orderBy("booking_id").limit(1).collect()[0]
    target = next(b for b in sorted(read()) if b != moved.booking_id)
    before = read()
    old = spark.createDataFrame([(moved.booking_id, moved.amount)], "booking_id bigint, amount decimal(18,2)")
    new = spark.createDataFrame([(target, moved.amount * 2)], "booking_id bigint, amount decimal(18,2)")
    send(jobs.child_changes(old, new, jobs.SERVICE))
    run()
    after = read()
    assert after[moved.booking_id] == before[moved.booking_id] - moved.amount and after[target] == before[target] + 2 * moved.amount
    assert {b: x for b, x in after.items() if b not in (moved.booking_id, target)} == {b: x for b, x in before.items() if b not in (moved.booking_id, target)}
    assert all(isinstance(x, D) for x in after.values())


CHANGES = "booking_id bigint, part string, change decimal(18,2)"


def test_totals_are_exact_and_their_state_is_small(spark, tmp_path):
    """Three batches over the same bookings: large, negative and missing amounts count to the cent, state is whole numbers in one version."""
    feed, out, checkpoint = (f"{tmp_path}/{n}" for n in ("feed", "out", "checkpoint"))
    odd = [
        (-1, jobs.ROOM, D("9007199254740993.01")), (-1, jobs.NIGHTS, D("1.00")), (-1, jobs.SERVICE, D("-0.02")), (-1, jobs.SURCHARGE, None),
        (-2, jobs.ROOM, D("100.10")), (-2, jobs.NIGHTS, D("3.99")), (-2, "unknown", D("7.00")),
        (-3, jobs.ROOM, D("-50.05")), (-3, jobs.NIGHTS, D("-2.50")), (-4, jobs.ROOM, None), (None, jobs.SERVICE, D("0.07")),
    ]
    n = 20_000
    for batch in range(3):
        rows = [(i, part, D(i * 7 + batch) / 100) for i in range(n) for part in ((jobs.ROOM, jobs.SERVICE, jobs.NIGHTS)[batch],)]
        df = spark.createDataFrame(rows + (odd if batch == 1 else []), CHANGES)
        df.coalesce(1).write.mode("append").parquet(feed)
    changes = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(feed)
    before = spark.conf.get(jobs.KEPT_VERSIONS, None)
    query = jobs.stream_totals(changes, out, checkpoint)
    query.awaitTermination()
    assert spark.conf.get(jobs.KEPT_VERSIONS, None) == before
    state = [p for p in query.recentProgress if p["stateOperators"]][-1]["stateOperators"][0]
    assert state["numRowsTotal"] == n + 5 and state["memoryUsedBytes"] < 300 * n
    got = {r.booking_id: r.total_amount for r in jobs.read_totals(spark, out).collect()}
    assert {b: got[b] for b in (-1, -2, -3, -4, None)} == {-1: D("9007199254740992.99"), -2: D("300.30"), -3: D("100.10"), -4: None, None: D("0.07")}
    assert all(got[i] == D(i * 7) / 100 * ((i * 7 + 2) // 100) + D(i * 7 + 1) / 100 for i in range(n))
