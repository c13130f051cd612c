"""Exact de-duplication by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored

PREFIX_CHARS = 256


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: dict | None = None, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """Group equal texts; of each group the row with the largest id stays.

    Returns one row per input row: doc_id, keep_id, group_size, kept, and the ``carry`` expressions.

    Rows whose length no other row has are settled from the length alone; rows that share a length are told
    apart by a hash of their first ``prefix_chars`` characters; only rows that still share both are hashed whole
    (SHA-256). Groups are aggregated before they are shuffled and come back by a join on written tables, which
    Spark splits when one group is hot; no task holds a group.

    A null text counts as empty. Rows that repeat an id together with its text are equal rows: all of them carry
    the kept id and are all kept. A null id never wins over another one; a group of null ids only is kept whole.
    An empty table gives an empty result. Other columns of the table are not looked at.
    """
    carry = carry or {}
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), *[e.alias(f"_c_{n}") for n, e in carry.items()], text.alias("_text"),
        F.octet_length(text).alias("_len"), F.xxhash64(F.substring(text, 1, prefix_chars)).alias("_head"),
    )
    narrow = stored(own.drop("_text"))
    lengths = stored(narrow.groupBy("_len").count().filter("count > 1").select("_len"))
    heads = stored(
        narrow.join(lengths, "_len", "left_semi").groupBy("_len", "_head").count().filter("count > 1").select("_len", "_head")
    )
    hashed = stored(own.join(heads, ["_len", "_head"], "left_semi").withColumn("_full", F.sha2("_text", 256)).drop("_text"))
    key = ["_len", "_head", "_full"]
    groups = stored(hashed.groupBy(*key).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1"))
    alone = narrow.join(heads, ["_len", "_head"], "left_anti")
    extra = [F.col(f"_c_{n}").alias(n) for n in carry]
    one = F.lit(1).cast("bigint")
    return alone.select("doc_id", F.col("doc_id").alias("keep_id"), one.alias("group_size"), F.lit(True).alias("kept"), *extra).unionByName(
        hashed.join(groups, key, "left").select(
            "doc_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("group_size", one).alias("group_size"),
            (F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), *extra,
        )
    )
