"""Line de-duplication by overlapping windows of consecutive lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored

WINDOW = 3


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Remove lines of every later occurrence of ``window`` consecutive lines.

    Lines are separated by ``\\n``. The first occurrence is the one with the smallest (doc_id, line number); all
    later ones, also in the same document, are removed, and covered positions are merged. Windows are judged on the
    input. Returns doc_id, n_lines, n_removed, kept_text, one row per input row.

    Windows are known by two independent 64-bit hashes. First occurrences are a minimum with map-side combine; they
    meet the windows again in a join on written tables, which Spark splits on a hot window.

    A null text counts as empty; an empty text has one empty line. Texts with fewer lines than the window stay as
    they are. Rows that repeat a doc_id count as one document for first occurrences, and each loses the lines that any
    of them loses. A null doc_id sorts before all others; such rows are left whole. An empty table gives an empty
    result. Other columns are not looked at.
    """
    own = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1).alias("_lines"))
    starts = F.expr(f"if(size(_lines) >= {window}, sequence(0, size(_lines) - {window}), array())")
    windows = own.select("doc_id", "_lines", F.explode(starts).alias("pos")).select(
        "doc_id", "pos", F.slice("_lines", F.col("pos") + 1, window).alias("_w")
    ).select("doc_id", "pos", F.xxhash64("_w").alias("h1"), F.xxhash64(F.lit("second"), "_w").alias("h2"))
    place = F.struct("doc_id", "pos")
    first = stored(
        windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1", "h2", "first")
    )
    later = windows.join(first, ["h1", "h2"]).filter(place > F.col("first")).select("doc_id", "pos")
    covered = later.groupBy("doc_id").agg(F.collect_set("pos").alias("_at"))
    kept = F.when(F.col("_at").isNull(), F.col("_lines")).otherwise(F.expr(
        f"transform(array_except(sequence(0, size(_lines) - 1), flatten(transform(_at, p -> sequence(p, p + {window - 1})))), i -> _lines[i])"
    ))
    return own.join(covered, "doc_id", "left").select("doc_id", "_lines", kept.alias("_kept")).select(
        "doc_id", F.size("_lines").cast("bigint").alias("n_lines"), (F.size("_lines") - F.size("_kept")).cast("bigint").alias("n_removed"),
        F.array_join("_kept", "\n").alias("kept_text"),
    )
