"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..materialize import discard, materialize

#: Edges that the last task contracts; tasks side by side take a fourth of it at a time.
LOT = 2_000_000


def _roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node of the part of each of n nodes: greater roots are hung on smaller ones, and every path is cut to
    its root, until no edge is left between two roots."""
    up = np.arange(n)
    while len(u):
        np.minimum.at(up, np.maximum(u, v), np.minimum(u, v))
        while (above := up[up]).tobytes() != up.tobytes():
            up = above
        u, v = up[u], up[v]
        apart = u != v
        u, v = u[apart], v[apart]
    return up


def _contract(lot: int, names: tuple[str, str] = ("u", "v"), roots: bool = False):
    """Replaces each lot of a task's edges by stars with the same parts, a row (node, smallest of its part) a node;
    roots: also for the smallest ones themselves."""

    def star(some: list[pa.RecordBatch]) -> pa.RecordBatch:
        coded = pa.chunked_array([b.column(k) for k in (0, 1) for b in some]).combine_chunks().dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        u, v = np.split(rank[coded.indices.to_numpy()], 2)
        up = _roots(len(rank), u, v)
        rows = np.arange(len(rank)) if roots else np.flatnonzero(up != np.arange(len(rank)))
        return pa.RecordBatch.from_arrays([coded.dictionary.take(order.take(pa.array(at))) for at in (rows, up[rows])], names=list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= lot:
                yield star(held)
                held, n = [], 0
        if held:
            yield star(held)

    return run


def connected_components(edges: DataFrame, limit: int | None = None) -> DataFrame:
    """(node, component) of the nodes of undirected edges (u, v); component is the smallest node.

    Tasks contract their own edges in lots, none if limit (LOT) is 0. What is left of them is contracted once more by
    one task as soon as it is limit edges at most, which is the result; until then, rounds of joins link each node's
    neighbours to the least of them, and tasks contract again. No edge goes to the driver. Self-loops are ignored.
    """
    limit = LOT if limit is None else limit
    kind = edges.schema["u"].dataType.simpleString()
    contracted = lambda links: materialize(links.mapInArrow(_contract(max(1, limit // 4)), f"u {kind}, v {kind}") if limit else links)
    now = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = contracted(now if limit else now.distinct())
    while True:
        if limit and now.count() <= limit:
            return materialize(now.coalesce(1).mapInArrow(_contract(limit, ("node", "component"), True), f"node {kind}, component {kind}"))
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
        if not now.join(least, (F.col("v") == F.col("n")) & (F.col("m") < F.col("v")), "left_semi").unionByName(now.join(least, (F.col("u") == F.col("n")) & (F.col("m") < F.col("v")), "left_semi")).limit(1).count():
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        moved = both.join(least, F.col("u") == F.col("n")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        moved = moved.unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).filter("a <> b")
        after = contracted(moved.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
        discard(now)
        now = after
