"""Connected components of a graph of any size, by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of edges (a, b).

    Each round every node hooks to its smallest neighbour or itself, and edges
    are redrawn between what they hooked to; it ends when no edge is left. With
    ids that are hashes each round drops a good part of the nodes, so rounds are
    few. Every round is a written table; nothing is collected.
    """
    spark = edges.sparkSession
    left = materialise(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    maps: list[DataFrame] = []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("to")), "hooks")
        pa = hook.select(F.col("node").alias("a"), F.col("to").alias("ta"))
        pb = hook.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        drawn = left.join(pa, "a").join(pb, "b").filter("ta <> tb")
        after = materialise(drawn.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
        drop_path(spark, left.scratch)
        left = after
        maps.append(hook)
    if not maps:
        out = left.select(F.col("a").alias("node"), F.col("b").alias("component"))
        out.scratch = left.scratch
        return out
    out = maps[0].withColumnRenamed("to", "component")
    for m in maps[1:]:
        step = m.select(F.col("node").alias("component"), "to")
        out = out.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    out = materialise(out, "components")
    for m in (*maps, left):
        drop_path(spark, m.scratch)
    return out
