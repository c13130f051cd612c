"""Registered queries of the operators: whole tables in, digest columns out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate, exact_dedup, language_id, license_scan, line_dedup, lm_score, merkle, near_dedup, packing, periodic, pii, sharding, substring_dedup
from .common import ascii_lower, table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents")).drop("findings")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), "longest_repeat"
    )


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = packing.tokenize(table(spark, sf_dir, "documents"))
    return packing.pack(tokens.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    found = decontaminate.decontaminate(docs.select("doc_id", "text"), benchmark)
    ids = F.array_distinct(F.transform(F.array_sort("leaks"), lambda x: x["item_id"]))
    return found.select(
        "doc_id", (F.size("leaks") > 0).alias("contaminated"), F.size(ids).cast("bigint").alias("n_items"),
        F.array_join(ids.cast("array<string>"), ",").alias("item_ids"), F.array_min(F.transform("leaks", lambda x: x["distance"])).alias("least_distance"),
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = {"text_sha256": F.sha2(F.coalesce("text", F.lit("")), 256)}
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), carry=digest)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find_pii(docs, pii.fit(docs)).withColumn("base_sha256", F.sha2("base", 256)).drop("base", "redacted")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.language_id(docs.select("doc_id", "text"), language_id.learned(docs))
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_score(table(spark, sf_dir, "documents"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.find_runs(table(spark, sf_dir, "documents"), source=periodic.planted))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "source", "lang", "n_chars"]
    given = F.when(merkle.tampered(), merkle.leaf_hash(*map(F.col, columns), ascii_lower(F.col("text"))))
    manifest = merkle.build(table(spark, sf_dir, "documents"), [*columns, "text"], "lang", "doc_id", carry={"given": given})
    given, path = F.coalesce("given", "leaf"), F.col("path")
    return merkle.proofs(manifest).withColumn("folded_root", merkle.fold(given, path)).select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_hash(path).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_near_dedup": op3_near_dedup,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_decontaminate": op5_decontaminate,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_pii": op8_pii,
    "op9_language_id": op9_language_id,
    "op10_lm_score": op10_lm_score,
    "op11_sharding": op11_sharding,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_merkle_manifest": op13_merkle_manifest,
}
