"""Shards that match the mixture of sources: proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import discard, fresh, stored

SHARDS = 40
SEED = "interleave-1"
ROW_BYTES = 16  # what a row weighs besides its text
LEAST_BUCKETS = 1024
BUCKET_ROWS = 32_768  # rows of a bucket that one task sorts; beyond LEAST_BUCKETS * BUCKET_ROWS rows there are more buckets
_UNIT = float(1 << 52)


def _digest(seed: str, *what: Column) -> Column:
    """52 seeded bits: the first 13 hex digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *what)), 1, 13), 16, 10).cast("bigint")


def _running(counts: DataFrame, order: str, *group: str) -> DataFrame:
    """Rows of the buckets before each bucket; ``counts`` holds one row per bucket."""
    w = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))


def interleave(
    docs: DataFrame, shards: int = SHARDS, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", keep: tuple[str, ...] = ()
) -> DataFrame:
    """Deal every row to one of ``shards`` shards so that each shard holds each source in its share of the whole.

    Returns doc_id, source, size, text_crc32, law, shard, slot, grown_shard, then the columns in ``keep``, one row per input row.

    Rows of a source are put in a seeded order and ranked 1..n; a row's fractional rank is (rank - u) / n, where u in [0, 1)
    is the source's own seeded offset, so that sources of a few rows do not all fall on the same shards. All rows are
    sorted by fractional rank (ties: source, rank) and the order is cut at equal row counts: the law is ``rows``, counts
    differ by one at most. Any stretch of the order holds each source in proportion, up to a row for each source it meets.
    ``grown_shard`` is null: another number of shards cuts the order elsewhere. Equal texts are dealt like any other rows.

    Neither order needs one task: a source's order is cut into buckets of the seeded hash, the whole order into buckets of
    the fractional rank (both even by construction, also for a source with most of the rows); bucket counts give the
    places before each bucket, and only a bucket is sorted as a whole. Steps read written tables.

    Null counts as no text, and a null source is a source of its own. Rows that repeat an id are ordered by their texts;
    rows alike in id, source and text are interchangeable. With fewer rows than shards some shards stay empty; an empty
    table gives an empty result. Other columns are not looked at, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"), (F.octet_length(text) + ROW_BYTES).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("_tie"), F.struct(*keep).alias("_keep") if keep else F.lit(0).alias("_keep"),
    )
    shuffled = stored(row.withColumn("_h", _digest(seed, F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))))
    rows = shuffled.count()
    buckets = max(LEAST_BUCKETS, rows // BUCKET_ROWS)

    bucket = F.floor(F.col("_h") / F.lit(_UNIT) * buckets).alias("_b")
    in_source = shuffled.select("*", bucket, F.coalesce("source", F.lit("")).alias("_s"), F.col("source").isNull().alias("_none"))
    counts = in_source.groupBy("_none", "_s", "_b").agg(F.count(F.lit(1)).alias("_n"))
    places = stored(
        _running(counts, "_b", "_none", "_s")
        .withColumn("_of", F.sum("_n").over(Window.partitionBy("_none", "_s")))
        .withColumn("_u", _digest(seed + ":source", F.when(F.col("_none"), F.lit("-")).otherwise(F.concat(F.lit("="), "_s"))) / F.lit(_UNIT))
        .drop("_n")
    )
    order = Window.partitionBy("_none", "_s", "_b").orderBy("_h", F.col("doc_id").asc_nulls_first(), "_tie")
    rank = (F.col("_before") + F.col("_i")).alias("_rank")
    share = ((F.col("_before") + F.col("_i") - F.col("_u")) / F.col("_of")).alias("_share")
    ranked = stored(
        in_source.withColumn("_i", F.row_number().over(order)).join(places, ["_none", "_s", "_b"])
        .select("doc_id", "source", "size", "text_crc32", "_keep", rank, share)
    )
    discard(shuffled, places)

    cut = ranked.withColumn("_g", F.least(F.floor(F.col("_share") * buckets), F.lit(buckets - 1)))
    starts = stored(_running(cut.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")), "_g").drop("_n"))
    order = Window.partitionBy("_g").orderBy("_share", F.col("source").asc_nulls_first(), "_rank")
    at = cut.withColumn("_i", F.row_number().over(order)).join(starts, "_g").withColumn("_at", F.col("_before") + F.col("_i") - 1)
    shard = F.expr(f"_at * {shards} div {rows or 1}")
    first = F.expr(f"({rows} * cast(shard as bigint) + {shards - 1}) div {shards}")
    return at.withColumn("shard", shard.cast("int")).select(
        "doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("_at") - first).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), *[F.col(f"_keep.{c}").alias(c) for c in keep],
    )


def write_shards(placed: DataFrame, path: str, file_rows: int = 100_000) -> None:
    """Write ``interleave(..., keep=...)`` as one folder per shard; each file holds ``file_rows`` consecutive slots in order.

    A shard of any size is written by as many tasks as it has files. The columns of ``placed`` are written as they are.
    """
    part = fresh(placed, "part")
    chunk = placed.withColumn(part, F.floor(F.col("slot") / file_rows).cast("int"))
    chunk.repartition("shard", part).sortWithinPartitions("shard", part, "slot").write.partitionBy("shard", part).parquet(path)
