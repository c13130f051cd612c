"""What the operators share: reading tables, written intermediate tables, column clean-up."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import shared_dir

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_FOLDERS: dict[str, str] = {}  # application id -> the folder that this driver writes its tables to


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_folder(spark: SparkSession) -> str:
    """This application's own folder below the shared one; it goes when the application ends."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"
        _FOLDERS[app] = path
        jvm = spark.sparkContext._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(hadoop)  # only a folder that is there can be marked
        files.deleteOnExit(hadoop)
        atexit.register(_FOLDERS.pop, app, None)
    return _FOLDERS[app]


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the run folder and go on from the written table.

    Lost executors read it again instead of repeating the work, and joins on it start
    from plain exchanges, so hot keys can be split at run time.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{uuid.uuid4().hex}"
    # shuffle files go as soon as the table is written; else they stay until the driver happens to collect its garbage
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote and that no later step reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with null texts as empty ones; all other columns are left behind, so their names cannot clash."""
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; 0 for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % n, F.lit(0))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name
