"""A Merkle manifest of a dataset: a digest per row, tree roots per group and over all, and a proof for every row.

Hash(x, ...) is the lowercase hex SHA-256 of its inputs laid end to end, digests as hex text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import stored

FAN = 8
LEVELS = 3  # only every third level is kept
RANGE_ROWS = 1_000_000  # rows that one task sorts when leaves are numbered

PATH = "array<struct<before: string, after: string>>"


def leaf_hash(*values: Column) -> Column:
    """Hash of a row: each value as ``-`` if null, else its UTF-8 byte count, ``:`` and itself (integers in decimal)."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` leads to along a proof's siblings, level by level."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


def proof_hash(path: Column) -> Column:
    """Hash of a proof's siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


@dataclass
class Manifest:
    """``leaves``: leaves, a row per aligned subtree; ``kept``: nodes of every third level above, a row per aligned subtree of the
    next three; ``subroots``: a row per tree with its subroot, ``upper``, the path from there, and the root."""

    leaves: DataFrame
    kept: list[DataFrame]
    subroots: DataFrame


def _width() -> int:
    return FAN**LEVELS


def _parents(nodes: str) -> str:
    """SQL: the hashes of every ``FAN`` consecutive entries of an array of digests."""
    return f"transform(sequence(0, (size({nodes}) - 1) div {FAN}), j -> sha2(array_join(slice({nodes}, j * {FAN} + 1, {FAN}), ''), 256))"


def _interior(rows: DataFrame) -> DataFrame:
    """Interior nodes of each aligned subtree, made again from its stored lowest nodes: columns l0, l1, ... and ``up``, the
    number of levels that the subtree has (its tree's node count settles it: a tree of several subtrees uses all)."""
    up = F.lit(LEVELS)
    for k in range(LEVELS - 1, -1, -1):
        up = F.when(F.col("n") <= FAN**k, F.lit(k)).otherwise(up)
    rows = rows.withColumn("up", up)
    for k in range(1, LEVELS + 1):
        rows = rows.withColumn(f"l{k}", F.expr(f"if(up >= {k}, {_parents(f'l{k - 1}')}, array())"))
    return rows


def _top(rows: DataFrame) -> DataFrame:
    """The highest node of each subtree."""
    top = F.col("l0")
    for k in range(1, LEVELS + 1):
        top = F.when(F.col("up") >= k, F.col(f"l{k}")).otherwise(top)
    return _interior(rows).withColumn("node", F.element_at(top, 1))


def _steps(i: str) -> str:
    """SQL: siblings of entry ``i`` of a subtree from its lowest level up, in the levels it has."""
    levels = []
    for k in range(LEVELS):
        own = f"({i} div {FAN**k})"
        first = f"({own} - {own} % {FAN})"
        before = f"array_join(slice(l{k}, {first} + 1, {own} % {FAN}), '')"
        after = f"array_join(slice(l{k}, {own} + 2, {FAN} - 1 - {own} % {FAN}), '')"
        levels.append(f"if(up > {k}, array(struct({before} as before, {after} as after)), cast(array() as {PATH}))")
    return f"concat({', '.join(levels)})"


def _numbered(leaves: DataFrame, tree: str, key: str) -> DataFrame:
    """Leaves with their number from 0 within their tree, in the order of key, then digest.

    Rows are split into sorted ranges and numbered within each; the counts of the ranges give the rest. A tree with most of the
    rows spans many ranges, so no task holds it.
    """
    leaves = stored(leaves)
    ranges = max(64, leaves.count() // RANGE_ROWS)
    order = [F.col(tree).asc_nulls_first(), F.col(key).asc_nulls_first(), F.col("leaf")]
    ranged = leaves.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    # the upper bits of the number are the range, the lower 33 the place in it
    placed = stored(ranged.withColumn("_m", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_m", 33)).withColumn("_nth", F.col("_m") % (1 << 33))
    counts = placed.groupBy(F.col(tree).alias("_t"), F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_c"), F.min("_nth").alias("_first"))
    earlier = Window.partitionBy("_t").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        "_t", "_p", "_first", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"), F.sum("_c").over(Window.partitionBy("_t")).alias("n")
    )
    same = F.col("_part").eqNullSafe(F.col("_p")) & F.col(tree).eqNullSafe(F.col("_t"))
    return placed.join(stored(counts), same).withColumn("i", F.col("_before") + F.col("_nth") - F.col("_first")).drop("_m", "_part", "_nth", "_t", "_p", "_first", "_before")


def _subtrees(nodes: DataFrame, entry: list[str]) -> DataFrame:
    """Nodes (tree, n, i, entry...) as one row per aligned subtree, entries in order; no row has more than FAN ** LEVELS."""
    wide = _width()
    rows = nodes.groupBy("tree", "n", F.expr(f"i div {wide}").alias("sub")).agg(F.array_sort(F.collect_list(F.struct("i", *entry))).alias("entries"))
    return rows.withColumn("l0", F.transform("entries", lambda e: e["leaf"] if "leaf" in entry else e["node"]))


def _climb(level: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """From subtrees of leaves to one node per tree; every ``LEVELS``-th level is written, what lies between is not kept."""
    kept, wide = [], _width()
    while True:
        tops = stored(_top(level).select("tree", "n", "sub", "node"))
        if tops.filter(F.col("n") > wide).isEmpty():
            return kept, tops.select("tree", "node")
        # trees that have one node left stay as they are: a subtree of one entry without levels
        nodes = tops.select("tree", F.expr(f"(n + {wide - 1}) div {wide}").alias("n"), F.col("sub").alias("i"), "node")
        level = stored(_subtrees(nodes, ["node"]))
        kept.append(level)


def build(docs: DataFrame, columns: list[str], tree_col: str, key_col: str, carry: dict[str, Column] | None = None) -> Manifest:
    """A tree per value of ``tree_col`` over its rows in the order of ``key_col``, and a tree over their roots.

    A row's leaf is the Hash of ``columns``. While a tree has several nodes, every 8 consecutive ones (the last run: fewer, even one)
    become their Hash; a lone leaf is its tree's subroot. Subroots in the order of ``tree_col`` (null first, bytewise) give the root in
    the same way. ``carry`` holds expressions over ``docs`` that each leaf keeps beside it.

    Whole rows are read once, for their digests; digests are numbered by sorted ranges and gathered 512 at a time, which is an aligned
    subtree of three levels. Only its top is written, and these tops are gathered 512 at a time in turn. ``proofs`` makes the missing levels
    again. All tables are in the run's folder below the shared one.

    Nulls are values of their own, in any column. Rows alike in everything are leaves side by side. An empty table has no trees and no root.
    """
    carry = carry or {}
    rows = docs.select(
        F.col(tree_col).cast("string").alias("tree"), F.col(key_col).cast("bigint").alias("key"), leaf_hash(*[F.col(c) for c in columns]).alias("leaf"),
        *[c.alias(n) for n, c in carry.items()],
    )
    numbered = _numbered(rows, "tree", "key")
    leaves = stored(_subtrees(numbered.select("tree", "n", "i", "key", "leaf", *carry), ["key", "leaf", *carry]))
    kept, subroots = _climb(leaves)
    over = _numbered(subroots.select(F.col("tree").alias("key"), F.lit("").alias("tree"), F.col("node").alias("leaf")), "tree", "key")
    top = stored(_subtrees(over.select("tree", "n", "i", "key", "leaf"), ["key", "leaf"]))
    above, root = _climb(top)
    # one row per tree: where it leads to the root
    climbed = _descend([top, *above], root.select("tree", F.array().cast(PATH).alias("upper"), F.col("node").alias("root")))
    subroots = climbed.select(F.col("entry.key").alias("tree"), F.col("entry.leaf").alias("subroot"), F.col("path").alias("upper"), "root")
    return Manifest(leaves, kept, stored(subroots))


def write_manifest(manifest: Manifest, path: str) -> None:
    """Keep a manifest's tables under ``path``, which must not exist."""
    manifest.leaves.write.parquet(f"{path}/leaves")
    manifest.subroots.write.parquet(f"{path}/subroots")
    for k, df in enumerate(manifest.kept):
        df.withColumn("step", F.lit(k)).write.partitionBy("step").mode("append").parquet(f"{path}/kept")


def read_manifest(spark: SparkSession, path: str) -> Manifest:
    leaves, subroots = spark.read.parquet(f"{path}/leaves"), spark.read.parquet(f"{path}/subroots")
    try:
        above = spark.read.parquet(f"{path}/kept")
    except AnalysisException:  # no tree is higher than one step
        return Manifest(leaves, [], subroots)
    steps = sorted(r["step"] for r in above.select("step").distinct().collect())
    return Manifest(leaves, [above.filter(F.col("step") == k).drop("step") for k in steps], subroots)


def _descend(levels: list[DataFrame], start: DataFrame | None = None) -> DataFrame:
    """(tree, entry, path) for every lowest entry of ``levels``; ``start`` (tree, upper, more) goes on top: its paths follow, the rest is kept.

    From the highest kept level down: each subtree's missing nodes are made again from the nodes below, its entries take their siblings
    and the path of the subtree itself, and the rest is dropped. A subtree meets its path one to one, so no key is hot.
    """
    more = [c for c in start.columns if c not in ("tree", "upper")] if start is not None else []
    paths = start
    for depth in range(len(levels) - 1, -1, -1):
        rows = _interior(levels[depth])
        if depth < len(levels) - 1:
            rows = rows.join(paths, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("sub") == F.col("_s")))
        elif start is not None:
            rows = rows.join(start.withColumnsRenamed({"tree": "_t", "upper": "rest"}), F.col("tree").eqNullSafe(F.col("_t")))
        else:
            rows = rows.withColumn("rest", F.array().cast(PATH))
        each = F.expr(f"transform(entries, (e, i) -> struct(e as entry, concat({_steps('i')}, rest) as path))")
        found = rows.select("tree", *more, F.explode(each).alias("x")).select("tree", *more, "x.entry", "x.path")
        if depth:
            paths = stored(found.select(F.col("tree").alias("_t"), F.col("entry.i").alias("_s"), *more, F.col("path").alias("rest")))
    return found


def proofs(manifest: Manifest, only: DataFrame | None = None) -> DataFrame:
    """One row per leaf: tree, subroot, root, i (its number in its tree), key, leaf, what was carried, and path.

    ``path`` holds, from the leaf to the root, the digests before and after the own node among the nodes of its run; levels
    that a tree does not have are no entries. ``only`` names the wanted rows by a column ``key``; subtrees of leaves without any of them are
    not looked at.
    """
    leaves = manifest.leaves
    if only is not None:
        only = only.select("key").distinct()
        held = leaves.select(F.col("tree").alias("_t"), F.col("sub").alias("_s"), F.explode("entries.key").alias("key")).join(only, "key", "left_semi")
        leaves = leaves.join(held, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("sub") == F.col("_s")), "left_semi")
    paths = _descend([leaves, *manifest.kept], manifest.subroots).select("tree", "subroot", "root", "entry.*", "path")
    return paths if only is None else paths.join(only, "key", "left_semi").select(*paths.columns)


def verify(leaf: Column, path: Column, root: Column) -> Column:
    """Whether a row's digest leads to ``root`` along its path."""
    return fold(leaf, path) == root


def tampered(key: str = "doc_id") -> Column:
    """Whether a row is among the third (by crc32 of its key) whose text is tampered with; a null key is not."""
    return F.coalesce(F.crc32(F.col(key).cast("bigint").cast("string").cast("binary")) % 3 == 0, F.lit(False))
