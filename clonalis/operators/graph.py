"""The graph of cells: nodes of equal cloneID sets, edges by Jaccard similarity, and its pruning."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequences as sq
from ..materialize import materialize
from .components import connected_components


class CellGraph(NamedTuple):
    """nodes (node_id, n, clone_ids), members (cell_id, node_id) and edges (u, v), u < v, once each.

    A node stands for all cells with the same set of cloneIDs; its id is their smallest cell id. The
    members stay a table, so a node of very many cells is one row here and many small ones there.
    """

    nodes: DataFrame
    members: DataFrame
    edges: DataFrame


def make_nodes(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    sets = cells.groupBy("cell_id").agg(F.array_sort(F.collect_set("clone_id")).alias("clone_ids"))
    nodes = sets.groupBy("clone_ids").agg(F.min("cell_id").alias("node_id"), F.count("*").alias("n"))
    members = sets.join(nodes.select(F.col("clone_ids").alias("_ids"), "node_id"), F.col("clone_ids") == F.col("_ids")).select("cell_id", "node_id")
    return nodes.select("node_id", "n", "clone_ids"), members


def jaccard_edges(nodes: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(u, v, jaccard), u < v, of nodes whose sets are more similar than the threshold.

    Only the rarest cloneIDs of a set, as many as two sets above the threshold must share one of, are
    joined on: a cloneID held by very many nodes is rarely one of them.
    """
    if threshold < 0:
        raise ValueError("a Jaccard threshold is not negative")
    items = nodes.select("node_id", "clone_ids", F.explode("clone_ids").alias("item"))
    often = items.groupBy("item").agg(F.count("*").alias("often"))
    ranked = items.join(often, "item").groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("often", "item"))).alias("by"))
    size = F.size("by")
    prefix = F.greatest(F.lit(1), size - F.ceil(F.lit(float(threshold)) * size - F.lit(1e-9)).cast("int") + 1)
    keyed = ranked.select("node_id", F.array_sort("by.item").alias("ids"), F.explode(F.slice("by", F.lit(1), prefix)["item"]).alias("item"))
    a, b = keyed.alias("a"), keyed.alias("b")
    similarity = sq.jaccard(F.col("a.ids"), F.col("b.ids"))
    on = (F.col("a.item") == F.col("b.item")) & (F.col("a.node_id") < F.col("b.node_id"))
    sizes = F.least(F.size("a.ids"), F.size("b.ids")) > F.greatest(F.size("a.ids"), F.size("b.ids")) * F.lit(float(threshold))
    return a.join(b, on & sizes & (similarity > F.lit(float(threshold)))).select(F.col("a.node_id").alias("u"), F.col("b.node_id").alias("v"), similarity.alias("jaccard")).distinct()


def make_graph(cells: DataFrame, threshold: float = 0.7) -> CellGraph:
    nodes, members = make_nodes(cells)
    return CellGraph(nodes, members, jaccard_edges(nodes, threshold).select("u", "v"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("u").alias("node_id")).agg(F.count("*").alias("degree"))


def _with_degrees(edges: DataFrame) -> DataFrame:
    d = degrees(edges)
    t = edges.select("u", "v").join(d.select(F.col("node_id").alias("u"), F.col("degree").alias("du")), "u")
    return t.join(d.select(F.col("node_id").alias("v"), F.col("degree").alias("dv")), "v").select("u", "v", "du", "dv")


def triangles(edges: DataFrame) -> DataFrame:
    """(u, v, w): for each edge u < v, the neighbours w of both. Each edge looks from its end of lower
    degree, which bounds the rows by the power 1.5 of the edges whatever the hubs are."""
    t = _with_degrees(edges).select("u", "v", F.when(F.col("du") <= F.col("dv"), F.col("u")).otherwise(F.col("v")).alias("near"), F.when(F.col("du") <= F.col("dv"), F.col("v")).otherwise(F.col("u")).alias("far"))
    sym = both_ways(edges)
    open_ = t.join(sym.select(F.col("u").alias("near"), F.col("v").alias("w")), "near").filter("w <> far")
    return open_.join(sym.select(F.col("u").alias("far"), F.col("v").alias("w")), ["far", "w"], "left_semi").select("u", "v", "w")


def bridges(edges: DataFrame) -> DataFrame:
    """Edges without a common neighbour of their ends, one of which has other neighbours."""
    closed = triangles(edges).select("u", "v").distinct()
    return _with_degrees(edges).filter("du > 1 or dv > 1").join(closed, ["u", "v"], "left_anti").select("u", "v")


def local_cut_vertices(edges: DataFrame) -> DataFrame:
    """node_id of nodes whose neighbours, without the node, fall apart. Each node's neighbours are nodes
    of one graph for all centres, linked where a triangle links them, so no centre is a task of its own."""
    sym, t = both_ways(edges), triangles(edges)
    name = lambda center, node: F.concat(F.col(center), F.lit("\t"), F.col(node))
    links = t.select(name("w", "u").alias("u"), name("w", "v").alias("v")).distinct()
    placed = connected_components(links)
    around = sym.select(F.col("u").alias("node_id"), name("u", "v").alias("_name"))
    parts = around.join(placed, F.col("_name") == F.col("node"), "left").select("node_id", F.coalesce("component", "_name").alias("part"))
    return parts.groupBy("node_id").agg(F.count_distinct("part").alias("n")).filter("n > 1").select("node_id")


def doublets(graph: CellGraph) -> DataFrame:
    return local_cut_vertices(graph.edges).join(graph.nodes.filter("n = 1").select("node_id"), "node_id", "left_semi")


def remove_edges(graph: CellGraph, gone: DataFrame) -> CellGraph:
    return graph._replace(edges=graph.edges.join(gone.select("u", "v"), ["u", "v"], "left_anti"))


def remove_nodes(graph: CellGraph, gone: DataFrame) -> CellGraph:
    ids = gone.select("node_id")
    edges = graph.edges.join(ids.withColumnRenamed("node_id", "u"), "u", "left_anti").join(ids.withColumnRenamed("node_id", "v"), "v", "left_anti").select("u", "v")
    return CellGraph(graph.nodes.join(ids, "node_id", "left_anti"), graph.members.join(ids, "node_id", "left_anti").select("cell_id", "node_id"), edges)


def induced_subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("node_id")
    return edges.join(ids.withColumnRenamed("node_id", "u"), "u", "left_semi").join(ids.withColumnRenamed("node_id", "v"), "v", "left_semi").select("u", "v")


def count_edges(edges: DataFrame) -> DataFrame:
    """(n_edges): edges, each once whichever way it is given; self-loops don't count."""
    return edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct().agg(F.count("*").alias("n_edges"))


def components(graph: CellGraph) -> DataFrame:
    """(node_id, component); a node without edges is one of its own."""
    found = connected_components(graph.edges)
    return graph.nodes.select("node_id").join(found, F.col("node_id") == F.col("node"), "left").select("node_id", F.coalesce("component", "node_id").alias("component"))


def component_density(graph: CellGraph, placed: DataFrame | None = None) -> DataFrame:
    """(component, n_cells, n_edges, possible_edges, complete) with each node counted as a clique of its cells."""
    placed = components(graph) if placed is None else placed
    sized = placed.join(graph.nodes.select("node_id", "n"), "node_id")
    inside = sized.groupBy("component").agg(F.sum("n").alias("n_cells"), F.sum(F.expr("n * (n - 1) div 2")).alias("own"))
    ends = sized.select(F.col("node_id").alias("u"), F.col("n").alias("nu"), "component")
    across = graph.edges.join(ends, "u").join(sized.select(F.col("node_id").alias("v"), F.col("n").alias("nv")), "v")
    across = across.groupBy("component").agg(F.sum(F.col("nu") * F.col("nv")).alias("across"))
    t = inside.join(across, "component", "left").select("component", "n_cells", (F.col("own") + F.coalesce("across", F.lit(0))).alias("n_edges"), F.expr("n_cells * (n_cells - 1) div 2").alias("possible_edges"))
    return t.select("*", (F.col("n_edges") == F.col("possible_edges")).alias("complete"))


def prune(graph: CellGraph, keep_doublets: bool = False, settle=materialize) -> tuple[CellGraph, dict[str, DataFrame]]:
    """Removes bridges and, unless they are kept, doublets, bridges again and doublets again, each found
    on the graph as it then is. settle: fixes a result before it is looked at again; without that, plans would grow with each step. Returns what
    was removed too."""
    gone: dict[str, DataFrame] = {}
    graph = graph._replace(edges=settle(graph.edges))
    gone["bridges_1"] = settle(bridges(graph.edges))
    graph = remove_edges(graph, gone["bridges_1"])
    if not keep_doublets:
        for k in (1, 2):
            if k == 2:
                gone["bridges_2"] = settle(bridges(graph.edges))
                graph = remove_edges(graph, gone["bridges_2"])
            graph = graph._replace(edges=settle(graph.edges))
            gone[f"doublets_{k}"] = settle(doublets(graph))
            graph = remove_nodes(graph, gone[f"doublets_{k}"])
            graph = graph._replace(edges=settle(graph.edges))
    return graph, gone
