"""Connected components of a graph that is a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the smallest node that it is connected to.

    Hooking and pointer jumping: every node points to a smaller or equal one. In each round a node, and the node that it points to, are
    hooked to the smallest grandparent among the neighbours, and every pointer jumps to its grandparent. Depth halves from round to round, so a
    chain takes a number of rounds that grows with the logarithm of its length; each writes one table. Hooks are minima
    with map-side combine, and only (node, pointer) pairs are joined, so no component is gathered.
    """
    both = cut_lineage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    alone = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    least = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    up = cut_lineage(alone.join(least, "node", "left").select("node", F.least("node", "m").alias("up")))
    while True:
        above = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
        tops = up.join(above, "up")
        near = both.join(tops.select(F.col("node").alias("b"), "top"), "b").groupBy(F.col("a").alias("node")).agg(F.min("top").alias("m"))
        seen = tops.join(near, "node", "left").withColumn("m", F.least("top", "m"))
        hooks = F.array(F.struct(F.col("node"), F.col("m").alias("to")), F.struct(F.col("up").alias("node"), F.col("m").alias("to")))
        after = seen.select(F.explode(hooks).alias("h")).groupBy("h.node").agg(F.min("h.to").alias("next"))
        moved = cut_lineage(after.join(up, "node"))
        up = moved.select("node", F.col("next").alias("up"))
        if moved.filter("next <> up").isEmpty():
            return up.withColumnRenamed("up", "root")
