"""Connected components of a graph of links, by contraction in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mishear.llm._cluster import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of each vertex of ``edges`` (u, v); root is the least id of its component.

    In each round every vertex takes the least of itself and its neighbours, in
    the order of their hashes, as parent, parents are shortened once, and edges
    are drawn again between parents. In a random order a third of a path's
    vertices are least among their neighbours, so rounds are logarithmic in the
    vertices; they end when no edge joins two different ones. All groupings
    have partial sums. Joins on vertices with very many edges or children are
    inner and left joins with a unique other side, which adaptive execution
    splits where a partition is skewed, as nothing is grouped in the same stage. Edges and parents are checkpointed, so a
    lost executor costs one round at most.
    """
    ids = None
    live = checkpointed(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    ordered = lambda c: F.struct(F.xxhash64(c).alias("hash"), F.col(c).alias("id"))
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(ordered("v")).alias("n"))
        parent = checkpointed(least.select(F.col("u").alias("id"), F.least(ordered("u"), "n")["id"].alias("root")))
        above = parent.select(F.col("id").alias("root"), F.col("root").alias("above"))
        parent = parent.join(above, "root").select("id", F.col("above").alias("root"))
        if ids is None:
            ids = parent = checkpointed(parent)
        else:
            parent = checkpointed(parent)
            step = parent.select(F.col("id").alias("root"), F.col("root").alias("to"))
            ids = checkpointed(ids.join(step, "root", "left").select("id", F.coalesce("to", "root").alias("root")))
        left, right = (parent.select(F.col("id").alias(x), F.col("root").alias(f"{x}_root")) for x in "uv")
        drawn = live.join(left, "u").join(right, "v").where("u_root <> v_root")
        live = checkpointed(drawn.select(F.least("u_root", "v_root").alias("u"), F.greatest("u_root", "v_root").alias("v")).distinct())
    if ids is None:
        return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).limit(0)
    names = checkpointed(ids.groupBy("root").agg(F.min("id").alias("least")))
    return ids.join(names, "root").select("id", F.col("least").alias("root"))
