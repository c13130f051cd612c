"""Versions of the booking tables: a change rewrites the partitions it touches, and one small file makes the new version current.

Tables are folders of partitions (a month, or a range of booking ids) that are never written twice. A version is a manifest that names the
folder of every partition. A change reads and writes the touched partitions only, into new folders; then its manifest appears under the next number
by a rename, which does not replace a file. So a reader keeps the version it opened, a failed change leaves the last version as it was,
and of two changes to the same version one is refused.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import cut_lineage
from .schemas import TABLES
from .tables import LazyTables, conformed

RANGE_IDS = 1_000_000  # booking ids of one partition of the tables that have no date

_MONTH = "date_format({c}, 'yyyy-MM')"
_RANGE = f"cast(floor({{c}} / {RANGE_IDS}) as bigint)"
# how tables are cut; tables not named here are one partition
CUT = {
    "bookings": _MONTH.format(c="check_in"), "room_assignments": _MONTH.format(c="check_in"), "room_type_inventory": _MONTH.format(c="date"),
    **{n: _RANGE.format(c="booking_id") for n in ("booking_details", "booking_surcharges", "service_usage", "invoices")},
}


class StaleVersion(RuntimeError):
    """Someone else has committed since the version that a change started from."""


def _part(name: str):
    return F.coalesce(F.expr(CUT.get(name, "'all'")).cast("string"), F.lit("none")).alias("part")


class _Files:
    """The few file operations that a version needs, on any store that Spark writes to."""

    def __init__(self, spark: SparkSession):
        self.fs, self.conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
        self.gateway = spark.sparkContext._gateway

    def at(self, path: str):
        p = self.fs.Path(path)
        return p, p.getFileSystem(self.conf)

    def names(self, path: str) -> list[str]:
        p, fs = self.at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: str) -> str:
        p, fs = self.at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def publish(self, path: str, text: str) -> bool:
        """Write a file that appears whole or not at all; False if the name is taken."""
        p, fs = self.at(path)
        draft = self.fs.Path(f"{path}.{uuid.uuid4().hex}.draft")
        stream = fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if fs.exists(p):
            fs.delete(draft, False)
            return False
        none = self.gateway.new_array(getattr(self.fs, "Options$Rename"), 0)
        self.fs.FileContext.getFileContext(p.toUri(), self.conf).rename(draft, p, none)
        return True

    def remove(self, path: str) -> None:
        p, fs = self.at(path)
        fs.delete(p, True)


def _manifest(path: str, version: int) -> str:
    return f"{path}/versions/{version:012d}.json"


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of all versions, oldest first."""
    return [int(n[:-5]) for n in _Files(spark).names(f"{path}/versions") if n.endswith(".json")]


def _load(spark: SparkSession, path: str, version: int | None) -> tuple[int, dict]:
    if version is None:
        version = versions(spark, path)[-1]
    return version, json.loads(_Files(spark).read(_manifest(path, version)))


def _table(spark: SparkSession, path: str, name: str, parts: dict[str, str], only: list[str] | None = None) -> DataFrame:
    folders = [f"{path}/{folder}" for part, folder in sorted(parts.items()) if only is None or part in only]
    if not folders:
        return spark.createDataFrame([], TABLES[name])
    return spark.read.schema(TABLES[name]).parquet(*folders)


def read_version(spark: SparkSession, path: str, version: int | None = None) -> LazyTables:
    """All tables of a version (the newest if none is named); later changes do not touch what is read."""
    _, tables = _load(spark, path, version)
    return LazyTables({n: (lambda t, n=n, parts=parts: _table(spark, path, n, parts)) for n, parts in tables.items()})


def _write(spark: SparkSession, rows: DataFrame, path: str, name: str) -> dict[str, str]:
    """Write rows into a new folder, a sub-folder per partition; rows of one partition may come from any number of tasks."""
    folder = f"{name}/{uuid.uuid4().hex}"
    conformed(rows, name).withColumn("part", _part(name)).write.partitionBy("part").parquet(f"{path}/{folder}")
    made = [n for n in _Files(spark).names(f"{path}/{folder}") if n.startswith("part=")]
    return {n[len("part="):]: f"{folder}/{n}" for n in made}


def _publish(spark: SparkSession, path: str, version: int, tables: dict) -> int:
    if not _Files(spark).publish(_manifest(path, version), json.dumps(tables, sort_keys=True)):
        raise StaleVersion(f"version {version} of {path} exists already")
    return version


def create_versions(spark: SparkSession, path: str, tables: Mapping, names: list[str]) -> int:
    """Write tables as version 0 of a new folder."""
    return _publish(spark, path, 0, {n: _write(spark, tables[n], path, n) for n in names})


def commit(spark: SparkSession, path: str, base: int, changed: Mapping[str, DataFrame], keys: Mapping[str, list[str]], deleted: Mapping[str, DataFrame] | None = None) -> int:
    """Make the version after ``base`` from rows that are new or have changed, and from keys of deleted rows; returns its number.

    ``keys`` names each table's key columns; a row replaces the stored one of its key. Touched are the partitions that
    changed rows belong to and those where their keys are stored, as a new date can move a row. Names of touched partitions come to the
    driver: months and id ranges, not rows.
    """
    deleted = deleted or {}
    _, tables = _load(spark, path, base)
    after = dict(tables)
    for name in sorted({*changed, *deleted}):
        key, parts = keys[name], tables[name]
        old = _table(spark, path, name, parts)
        rows = cut_lineage(conformed(changed[name], name)) if name in changed else old.limit(0)
        gone = rows.select(*key)
        if name in deleted:
            gone = gone.unionByName(deleted[name].select(*key))
        gone = cut_lineage(gone.distinct())
        held = old.select(*key, _part(name)).join(gone, key, "left_semi").select("part")
        touched = [r["part"] for r in held.unionByName(rows.select(_part(name))).distinct().collect()]
        kept = _table(spark, path, name, parts, touched).join(gone, key, "left_anti")
        made = _write(spark, kept.unionByName(rows, allowMissingColumns=True), path, name) if touched else {}
        after[name] = {p: f for p, f in parts.items() if p not in touched} | made
    return _publish(spark, path, base + 1, after)


def drop_unused(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete manifests but the newest ``keep``, then the folders that none of these names; not while a change is under way."""
    files, known = _Files(spark), versions(spark, path)
    for v in known[:-keep]:
        files.remove(_manifest(path, v))
    used = {f for v in known[-keep:] for parts in _load(spark, path, v)[1].values() for f in parts.values()}
    gone = []
    for name in {n for v in known[-keep:] for n in _load(spark, path, v)[1]}:
        for run in files.names(f"{path}/{name}"):
            for part in files.names(f"{path}/{name}/{run}"):
                if part.startswith("part=") and f"{name}/{run}/{part}" not in used:
                    files.remove(f"{path}/{name}/{run}/{part}")
                    gone.append(f"{name}/{run}/{part}")
    return gone
