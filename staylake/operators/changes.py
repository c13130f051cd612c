"""Table changes as new states: append, upsert, update, delete. Inputs are never overwritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def append_rows(df: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Rows of both; columns the new rows lack become null."""
    return df.unionByName(new_rows, allowMissingColumns=True)


def upsert_by_key(target: DataFrame, src: DataFrame, keys: list[str], set_cols: list[str], guard: str | None = None) -> DataFrame:
    """Insert rows of ``src`` with new keys; for known keys take ``set_cols`` from it where ``guard``
    (a SQL condition on the stored row) holds."""
    allowed = F.lit(True) if guard is None else F.coalesce(F.expr(guard), F.lit(False))
    t = target.select(*keys, *[F.col(c).alias(f"t_{c}") for c in target.columns if c not in keys], allowed.alias("_allowed"))
    s = src.select(*keys, *[F.col(c).alias(f"s_{c}") for c in src.columns if c not in keys], F.lit(True).alias("_new"))
    both = t.join(s, keys, "full")
    insert = F.col("_allowed").isNull()
    update = F.col("_new").isNotNull() & F.coalesce(F.col("_allowed"), F.lit(False))
    out = []
    for c in target.columns:
        if c in keys:
            out.append(F.col(c))
        else:
            new = F.col(f"s_{c}") if c in src.columns else F.lit(None)
            take = insert | (update if c in set_cols else F.lit(False))
            out.append(F.when(take, new).otherwise(F.col(f"t_{c}")).cast(target.schema[c].dataType).alias(c))
    return both.select(*out)


def insert_if_absent(target: DataFrame, src: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of ``src`` that an insert-or-ignore would add: the first of each key not yet stored.

    The first row is taken by an aggregate over the whole row, so copies of a key
    collapse before the shuffle.
    """
    rest = [c for c in src.columns if c not in (*keys, order)]
    first = src.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in [order, *rest]]), F.col(order)).alias("_r"))
    fresh = first.join(target.select(*keys), keys, "left_anti")
    return fresh.select(*[F.col(c) if c in keys else F.col(f"_r.{c}") for c in src.columns])


def update_from_join(target: DataFrame, flags: DataFrame, keys: list[str], assignments: dict[str, Column]) -> DataFrame:
    """Set columns on the rows whose keys are in ``flags`` (one row per key).

    Assignment expressions may use target columns and the extra columns of ``flags``.
    """
    joined = target.join(flags.withColumn("_hit", F.lit(True)), keys, "left")
    hit = F.col("_hit").isNotNull()
    return joined.select(
        *[
            F.when(hit, assignments[c]).otherwise(F.col(c)).cast(target.schema[c].dataType).alias(c) if c in assignments else F.col(c)
            for c in target.columns
        ]
    )


def updated_rows(target: DataFrame, flags: DataFrame, keys: list[str], assignments: dict[str, Column]) -> DataFrame:
    """Only the rows that ``update_from_join`` would change, as they are afterwards: what a versioned table needs to write."""
    joined = target.join(flags, keys)
    return joined.select(*[assignments[c].cast(target.schema[c].dataType).alias(c) if c in assignments else F.col(c) for c in target.columns])


def delete_where(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which the predicate is not true."""
    return df.filter(~F.coalesce(predicate, F.lit(False)))
