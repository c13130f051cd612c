"""Size-checked broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def broadcast_checked(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """Hint a broadcast only when ``df`` is counted to be small; otherwise leave the join to Spark.

    Used for tables that are configuration (a handful of pricing policies), where the
    check reads at most ``max_rows + 1`` rows. Dimension tables get no hint at all:
    Spark decides by their size.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
