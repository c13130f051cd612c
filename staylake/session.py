"""Session settings the library is written for, and the checkpoint folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

# Correctness needs UTC (date_trunc on a zone-less timestamp passes through the
# session zone). The rest lets Spark re-plan at run time: small sides turn into
# broadcasts once their real size is known, hot keys of a sort-merge join are split.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Partitions are put together up to this size only. Rows take 17 to 52 times (as measured) their shuffled size when a task sorts or
    # groups them, so the 64 MB that Spark allows by itself would be gigabytes in one task.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # A union of inputs hashed on one key may skip the shuffle above it; when a join below is re-planned
    # at run time the inputs no longer line up and the query fails ("Can't zip RDDs"). Always shuffle instead.
    "spark.sql.unionOutputPartitioning": "false",
}


# Before a query runs, Spark takes a file's compressed bytes for a table's size, and no more than that for what is exploded from it: the rooms
# of a 1.7 MB table of hotels were broadcast as 245 MB and several times that in the driver. Sizes measured in a shuffle are those of the rows.
MEASURED = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "8m"}


@contextmanager
def measured_joins(spark: SparkSession) -> Iterator[None]:
    """Tables written inside broadcast a side of a join only when it has been shuffled and measured, so what the driver gathers does not grow with the tables."""
    before = {key: spark.conf.get(key, None) for key in MEASURED}
    for key, value in MEASURED.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def with_measured_joins(job: Callable) -> Callable:
    """For a job (tables, requests, ...): the tables it writes are written under ``measured_joins``."""

    @wraps(job)
    def run(t, req: DataFrame, *args, **kwargs):
        with measured_joins(req.sparkSession):
            return job(t, req, *args, **kwargs)

    return run


def local_session(name: str = "staylake", cores: str = "8", shuffle: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("STAYLAKE_DRIVER_MEMORY", "8g"))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application: they need not share the driver's folders."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    home = os.path.dirname(os.path.abspath(__file__))
    # Executors fetch the file from the driver when they first run a task, so it stays until the driver ends.
    folder = tempfile.mkdtemp(prefix="staylake-ship-")
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(os.path.realpath(folder), "staylake.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, _, names in os.walk(home):
            for name in sorted(names):
                if name.endswith(".py"):
                    file = os.path.join(at, name)
                    z.write(file, os.path.relpath(file, os.path.dirname(home)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder: the session's own setting, or a temp folder in local mode."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if configured is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            configured = tempfile.mkdtemp(prefix="staylake-")
        sc.setCheckpointDir(configured)
    return configured or sc.getCheckpointDir()


_FOLDERS: dict[str, str] = {}  # application id -> the folder of its own below the shared one


def run_folder(spark: SparkSession) -> str:
    """This application's own folder below the shared one; the JVM deletes it when the application ends."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = f"{shared_dir(spark)}/staylake-{uuid.uuid4().hex}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_FOLDERS[app])
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)  # only a folder that is there can be marked
        files.deleteOnExit(path)
    return _FOLDERS[app]


def cut_lineage(df: DataFrame, *by: str) -> DataFrame:
    """Write ``df`` once to the run's folder below the shared checkpoint folder and go on from the written table, in folders ``by`` the named columns.

    Decisions that depend on order are written this way before several outputs are built on
    them: they are made once, and a lost executor only reads them again.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/cut/{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
