"""Streaming forms of the results that are kept up to date on change.

Sources are folders of Parquet files, every query runs with the availableNow trigger, and each
writes per batch into its own folder, so a repeated batch after a failure replaces its own output. What a result needs of the past is
Spark's streaming state; no batch reads whole tables. ``compact`` folds written batches into one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.calc import held_nights


def _start(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str) -> StreamingQuery:
    return (
        df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    )


def _per_batch(out_dir: str) -> Callable[[DataFrame, int], None]:
    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")

    return write


def _batches(spark: SparkSession, out_dir: str) -> list[int]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out_dir)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n[len("batch="):]) for n in names if n.startswith("batch=") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out_dir}/{n}/_SUCCESS")))


def latest(spark: SparkSession, out_dir: str, schema: str, keys: list[str], values: list[str]) -> DataFrame:
    """The newest row per key over all written batches. An aggregate, so old versions collapse before the shuffle."""
    paths = [f"{out_dir}/batch={n}" for n in _batches(spark, out_dir)]
    if not paths:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(f"{schema}, batch bigint").option("basePath", out_dir).parquet(*paths)
    # value by value, not as one struct: numbers are kept in a hash table, structs would be sorted
    return rows.groupBy(*keys).agg(*[F.max_by(v, "batch").alias(v) for v in values])


def compact(spark: SparkSession, out_dir: str, schema: str, keys: list[str], values: list[str], keep=None) -> int:
    """Fold all written batches into the newest one; ``keep`` (a condition) may leave out keys that nobody reads any more.

    Not while the stream runs. The folded rows are written beside the batches first and take the newest one's place; older batches
    are deleted last. If that is cut short, older batches only repeat what the newest one holds. Returns the number of folders deleted.
    """
    done = _batches(spark, out_dir)
    if len(done) < 2:
        return 0
    rows = latest(spark, out_dir, schema, keys, values)
    folded = f"{out_dir}/folded"
    (rows if keep is None else rows.filter(keep)).write.mode("overwrite").parquet(folded)
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = Path(out_dir).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    spark.read.schema(schema).parquet(folded).write.mode("overwrite").parquet(f"{out_dir}/batch={done[-1]}")
    for old in [*(f"batch={n}" for n in done[:-1]), "folded"]:
        fs.delete(Path(f"{out_dir}/{old}"), True)
    return len(done) - 1


KEPT_VERSIONS = "spark.sql.streaming.maxBatchesToRetainInMemory"
TOTALS_SCHEMA = "booking_id bigint, total_amount decimal(18,2)"
OCCUPANCY_SCHEMA = "room_type_id bigint, date date, reserved bigint"

# What a change to a booking's total can be about. Rooms count once for each night.
ROOM, SURCHARGE, SERVICE, NIGHTS = "room", "surcharge", "service", "nights"


def child_changes(old: DataFrame | None, new: DataFrame | None, part: str) -> DataFrame:
    """Changes (booking_id, part, change) from child rows before and after (booking_id, amount): what goes is negative.

    A row that moves to another booking is a loss for the one and a gain for the other.
    """
    sides = [(df, sign) for df, sign in ((old, -1), (new, 1)) if df is not None]
    out = [df.select("booking_id", F.lit(part).alias("part"), (F.col("amount") * sign).cast("decimal(18,2)").alias("change")) for df, sign in sides]
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def stream_totals(changes: DataFrame, out_dir: str, checkpoint: str) -> StreamingQuery:
    """Totals of bookings kept up to date by signed changes of their children (booking_id, part, change).

    State is four sums per booking: price of one night, surcharges, services, nights, each a whole number of hundredths: as decimals they would be
    three times as long and summed as objects. A batch touches the bookings it names and nothing else; in which order changes
    arrive does not matter. State stays as long as bookings can change, which has no end here; executors hold its newest version only.
    """
    hundredths = (F.col("change").cast("decimal(18,2)") * 100).cast("bigint")

    def sum_of(part: str):
        return F.sum(F.when(F.col("part") == part, hundredths).otherwise(F.lit(0).cast("bigint")))

    sums = changes.groupBy("booking_id").agg(*[sum_of(p).alias(p) for p in (ROOM, SURCHARGE, SERVICE, NIGHTS)])
    whole = lambda p: F.col(p).cast("decimal(19,0)")
    nights = F.expr(f"{NIGHTS} DIV 100").cast("int")
    total = ((whole(ROOM) * nights + whole(SURCHARGE) + whole(SERVICE)) * F.expr("0.01BD")).cast("decimal(18,2)")
    spark = changes.sparkSession
    before = spark.conf.get(KEPT_VERSIONS, None)
    spark.conf.set(KEPT_VERSIONS, "1")
    try:
        return _start(sums.select("booking_id", total.alias("total_amount")), _per_batch(out_dir), checkpoint, "update")
    finally:
        if before is None:
            spark.conf.unset(KEPT_VERSIONS)
        else:
            spark.conf.set(KEPT_VERSIONS, before)


def read_totals(spark: SparkSession, out_dir: str) -> DataFrame:
    return latest(spark, out_dir, TOTALS_SCHEMA, ["booking_id"], ["total_amount"])


def stream_intake_dedup(requests: DataFrame, out_dir: str, checkpoint: str, delay: str = "7 days") -> StreamingQuery:
    """Let the first request per idempotency key through (arrived_at is the event time).

    Keys are remembered for ``delay`` of event time, unlike the table, which remembers them for good.
    """
    fresh = requests.withWatermark("arrived_at", delay).dropDuplicatesWithinWatermark(["idempotency_key"])
    return (
        fresh.writeStream.format("parquet").outputMode("append").option("path", out_dir)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


HORIZON_DAYS = 400  # nights further ahead of their event than this are not taken: nobody books that early
GRACE_DAYS = 7  # so many days after a night its count can still change


def stream_occupancy(events: DataFrame, out_dir: str, checkpoint: str, horizon: int = HORIZON_DAYS, grace: int = GRACE_DAYS) -> StreamingQuery:
    """Reserved rooms per type and night from a stream of reserve and release events.

    ``events``: op ('reserve' or 'release'), room_type_id, quantity, check_in, check_out, at (when it happened). State is one
    count per (type, night); each batch writes the nights it changed. The watermark runs on the night, ``horizon`` + ``grace`` days behind
    the furthest one seen, and no event reaches further ahead than ``horizon``: so a night leaves the state more than ``grace`` days after it,
    never before, and an event for a night that has left is dropped.
    """
    sign = F.when(F.col("op") == "release", -1).otherwise(1)
    nights = events.select("room_type_id", "at", F.explode(held_nights()).alias("date"), (F.col("quantity") * sign).alias("change"))
    near = nights.filter(F.datediff("date", F.to_date("at")) <= horizon).withColumn("night", F.col("date").cast("timestamp"))
    counts = near.withWatermark("night", f"{horizon + grace} days").groupBy("room_type_id", "night").agg(F.sum("change").cast("bigint").alias("reserved"))
    return _start(counts.select("room_type_id", F.to_date("night").alias("date"), "reserved"), _per_batch(out_dir), checkpoint, "update")


def read_occupancy(spark: SparkSession, out_dir: str) -> DataFrame:
    return latest(spark, out_dir, OCCUPANCY_SCHEMA, ["room_type_id", "date"], ["reserved"])
