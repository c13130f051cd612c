"""Readers and writers for snapshots of the booking tables."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .schemas import TABLES


class LazyTables(Mapping):
    """A name -> DataFrame mapping whose entries are built on first use."""

    def __init__(self, builders: dict):
        self._builders, self._built = dict(builders), {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name](self)
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)

    def replaced(self, **tables: DataFrame) -> "LazyTables":
        """The same tables with some of them exchanged (a later state)."""
        merged = {name: (lambda t, n=name: self[n]) for name in self._builders}
        merged.update({name: (lambda t, d=df: d) for name, df in tables.items()})
        return LazyTables(merged)


    def wrapped(self, names: list[str], change) -> "LazyTables":
        """Fresh tables in which the named ones go through ``change`` when first built."""
        return LazyTables(
            {n: (lambda t, b=b: change(b(t))) if n in names else b for n, b in self._builders.items()}
        )


def scan_tables(spark: SparkSession, path: str) -> LazyTables:
    """Read a snapshot folder ``path/<table>`` with the declared schemas."""
    return LazyTables(
        {name: (lambda t, n=name, s=schema: spark.read.schema(s).parquet(f"{path}/{n}")) for name, schema in TABLES.items()}
    )


def literal_relation(spark: SparkSession, rows: list, schema: T.StructType) -> DataFrame:
    """A small literal table, the VALUES list of SQL."""
    return spark.createDataFrame(rows, schema)


def date_spine(spark: SparkSession, start, end_inclusive) -> DataFrame:
    """One row per calendar date of the closed range; no rows when the range is empty."""
    a, b = F.lit(str(start)).cast("date"), F.lit(str(end_inclusive)).cast("date")
    days = F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<date>"))
    return spark.range(1).select(F.explode(days).alias("date"))


def conformed(df: DataFrame, name: str) -> DataFrame:
    """The columns of a table in their declared order and types; columns it lacks stay out, others too."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[name] if f.name in df.columns])


def write_snapshot(tables: Mapping, names: list[str], path: str) -> None:
    """Write tables as a new snapshot, with the declared types, so that it can be read back. The path must be new, so no input is overwritten."""
    for name in names:
        conformed(tables[name], name).write.mode("errorifexists").parquet(f"{path}/{name}")


def append_to_snapshot(df: DataFrame, path: str, name: str) -> None:
    """Append rows to one table of a snapshot folder."""
    conformed(df, name).write.mode("append").parquet(f"{path}/{name}")
