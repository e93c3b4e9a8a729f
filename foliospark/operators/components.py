"""Connected components on an edge table, by alternating star contractions.

Every round joins and aggregates by node with map-side combination, so a hub costs one aggregate row per
task; joins on a hub are splittable by adaptive execution. Each round's edges are written to the shared
folder, so lineage stays short and lost executors cost one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.scratch import discard, stage


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"] or 0


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """large: larger neighbours of u move to u's least neighbour; small: smaller neighbours and u itself do."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("_m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("_m").alias("v")).union(least.select("u", F.col("_m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): root is the least node of node's component, for every node of an edge between two nodes.

    edges has columns u, v of one ordered type. Rows with a null or with u = v bind nothing and their nodes
    appear only if another edge has them. An empty edge table gives an empty result. Nodes without an edge
    are their own roots and are left to the caller.
    """
    kind = edges.schema["u"].dataType
    now = stage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = _mark(now)
    for _ in range(most_rounds):
        if mark[0] == 0:
            break
        after = stage(_star(_star(now, large=True), large=False), "edges")
        discard(now)
        now, old, mark = after, mark, _mark(after)
        if mark == old:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots).select(F.col("node").cast(kind), F.col("root").cast(kind))
