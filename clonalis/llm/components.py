"""Connected components of an edge table by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import Scratch, join_hot


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(F.col("u").alias("_node")).agg(F.min("v").alias("_least"), F.count("*").alias("_degree"))


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 100) -> DataFrame:
    """(node, component) of every node of the undirected edges; component is the smallest node.

    Large-star links each node's larger neighbours to the smallest of its neighbours and itself;
    small-star links its smaller neighbours and itself to the smallest of them. Alternated until
    nothing changes, every tree is a star around its smallest node. The least neighbour of a node is
    an aggregate with map-side partials; its edges are joined with that one row, which is broadcast for
    the few nodes that have a large share of all edges, so that no task gathers a hub. Each round is written to the shared
    folder. Self-loops and rows with a null end are ignored.
    """
    scratch = Scratch(edges.sparkSession, "components")
    a, b = F.col(u), F.col(v)
    now = scratch.save(edges.filter(a != b).select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).distinct())
    state = _fingerprint(now)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.save(_least(both).select("_node", F.least("_node", "_least").alias("_least"), "_degree"), "least", 2 * state[0])
        upward = both.filter(F.col("v") > F.col("u"))
        large = scratch.save(join_hot(upward, "u", least, "_node", "_degree", 2 * state[0]).select(F.col("v").alias("u"), F.col("_least").alias("v")).distinct(), "large", state[0])
        nearest = scratch.save(_least(large), "nearest", state[0])
        small = join_hot(large, "u", nearest, "_node", "_degree", state[0])
        small = small.filter(F.col("v") != F.col("_least")).select(F.col("v").alias("u"), F.col("_least").alias("v"))
        small = small.unionByName(nearest.select(F.col("_node").alias("u"), F.col("_least").alias("v"))).distinct()
        after = scratch.save(small, "small", state[0])
        scratch.drop(now, large, least, nearest)
        now, before, state = after, state, _fingerprint(after)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
