"""A corpus pipeline over ``documents``: language, exact copies, near copies, benchmark leaks, packing.

Rows that share a doc_id are one document and stay or go together; rows without a doc_id are never dropped by a stage
that decides by doc_id (exact and near copies).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from staylake.llm import decontaminate, exact_dedup, language_id, near_dedup, packing
from staylake.llm.common import fresh, stored, table
from staylake.session import ship_package


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """Documents but those in ``dropped``; its ids are written first, so that Spark knows their size when it picks the join."""
    return docs.join(stored(dropped.select("doc_id").filter("doc_id is not null").distinct()), "doc_id", "left_anti").select(*docs.columns)


def detect_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language: one that any learned language parses; no letters, no language.

    All documents stay where no language was learned.
    """
    sample = language_id.learned(docs)
    if not sample:
        return docs
    names = fresh(docs, "lang_pred"), fresh(docs, "lang_score")
    found = language_id.language_id(docs, sample, pred_col=names[0], score_col=names[1])
    return found.filter(F.col(names[0]) != language_id.UNKNOWN).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return _without(docs, exact_dedup.exact_dedup(docs).filter("not kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: shingles of five words, similarity 0.8."""
    return _without(docs, near_dedup.near_dedup(docs, size=5).filter("not kept"))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    leaks = fresh(docs, "leaks")
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), leaks_col=leaks)
    return found.filter(F.size(leaks) == 0).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of at most 4096 tokens."""
    tokens = packing.tokenize(docs)
    return packing.pack(tokens.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [
    ("language id", detect_language),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]
# Tokenizers, trained language models and MinHash have no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads what the one before wrote."""
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
