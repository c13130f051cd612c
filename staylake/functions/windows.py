"""Running aggregates that keep working when one key holds a large part of the rows.

A plain window puts all rows of a key into one task. Here the order is cut into
buckets: each bucket is summed on its own (with map-side combine), a small window
runs over the bucket sums of a key, and the fine window only spans one bucket.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

SEQ_BUCKET = 1_000_000  # arrival numbers are unique, so a bucket holds at most this many rows


def seq_bucket(seq="seq", width: int = SEQ_BUCKET) -> Column:
    return F.floor(F.col(seq) / F.lit(width)).cast("bigint")


def running(df: DataFrame, keys: list[str], bucket: Column, order: list, aggs: dict[str, tuple], inclusive: bool) -> DataFrame:
    """Add running aggregates in ``order`` within ``keys``.

    ``aggs`` maps a new column to (function, value column, value before the first row),
    where the function is ``"sum"`` or ``"max"``. ``bucket`` must not decrease along
    ``order``. With ``inclusive`` the current row counts too.
    """
    fns = {"sum": F.sum, "max": F.max}
    rows = df.withColumn("_bucket", bucket)
    coarse = rows.groupBy(*keys, "_bucket").agg(*[fns[f](v).alias(f"_b_{n}") for n, (f, v, _) in aggs.items()])
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = coarse.select(
        *keys, "_bucket", *[fns[f](f"_b_{n}").over(earlier).alias(f"_o_{n}") for n, (f, _, _) in aggs.items()]
    )
    upto = Window.currentRow if inclusive else -1
    within = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, upto)
    # keys may be null, and buckets are where the order value is: such rows meet their own offsets
    named = offsets.select(*[F.col(c).alias(f"_k_{c}") for c in [*keys, "_bucket"]], *[f"_o_{n}" for n in aggs])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in [*keys, "_bucket"]])
    out = rows.join(named, same)
    for name, (f, value, start) in aggs.items():
        here = fns[f](value).over(within)
        if f == "sum":
            total = F.coalesce(F.col(f"_o_{name}"), F.lit(start)) + F.coalesce(here, F.lit(start))
        else:
            total = F.coalesce(F.greatest(F.col(f"_o_{name}"), here), start) if start is not None else F.greatest(F.col(f"_o_{name}"), here)
        out = out.withColumn(name, total)
    return out.drop("_bucket", *[f"_k_{c}" for c in [*keys, "_bucket"]], *[f"_o_{n}" for n in aggs])


def first_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The (keys, order) pairs of each key's first arrival; an aggregate, so copies collapse before the shuffle."""
    return df.groupBy(*keys).agg(F.min(order).alias(order))


def flag_first(df: DataFrame, keys: list[str], order: str, flag: str = "is_first") -> DataFrame:
    """Mark the first arrival of every key.

    The join back is on (keys, order), which is unique, so a hot key spreads over all
    tasks. Rows with a null key are each their own first.
    """
    first = first_by(df, keys, order).withColumn(flag, F.lit(True))
    has_null = F.lit(False)
    for k in keys:
        has_null = has_null | F.col(k).isNull()
    return df.join(first, [*keys, order], "left").withColumn(flag, F.coalesce(F.col(flag), has_null))
