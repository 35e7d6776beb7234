"""Connected components by alternating large and small stars; edges never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._state import drop_path, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, label) for every node of ``edges``: the smallest node of its component.

    Each round joins every node's edges with the smallest node it sees, so rows
    stay as many as edges at most, and the rounds grow with the logarithm of the nodes.
    """
    now = materialize(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    for _ in range(max_rounds):
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(low, "u")
        small = linked.select("u", F.col("m").alias("v")).union(linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        before, now = now, materialize(small, "edges")
        same = before.count() == now.count() and before.join(now, ["u", "v"], "left_anti").isEmpty()  # edges are distinct
        drop_path(before._tessera_path)
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
