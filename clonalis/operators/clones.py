"""Clones: the components of the pruned graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..materialize import materialize
from .graph import CellGraph, components


def clone_table(graph: CellGraph, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """clones (clone_nr, cell_id) and details (clone_nr, clone_id, n_cells, clone_ids_per_cell).

    A clone is named by the cloneID of greatest summed count, ties to the greatest, and numbered in the
    order of that name and the smallest cell id. Only the table of clones, not of cells, is put in one order.
    """
    placed = materialize(graph.members.join(components(graph), "node_id").select("cell_id", "component"))
    held = cells.join(placed, "cell_id")
    sums = held.groupBy("component", "clone_id").agg(F.sum("count").alias("total"), F.count("*").alias("pairs"))
    named = sums.groupBy("component").agg(F.max(F.struct("total", "clone_id"))["clone_id"].alias("clone_id"), F.sum("pairs").alias("pairs"))
    sizes = placed.groupBy("component").agg(F.count("*").alias("n_cells"), F.min("cell_id").alias("first_cell"))
    t = named.join(sizes, "component").select("*", F.row_number().over(Window.orderBy("clone_id", "first_cell")).cast("long").alias("clone_nr"))
    details = t.select("clone_nr", "clone_id", "n_cells", (F.col("pairs") / F.col("n_cells")).alias("clone_ids_per_cell"))
    return placed.join(t.select("component", "clone_nr"), "component").select("clone_nr", "cell_id"), details


def sizes(graph: CellGraph) -> DataFrame:
    """(component, n_cells) of the clones, from the cells of each node: without their names and members."""
    return components(graph).join(graph.nodes.select("node_id", "n"), "node_id").groupBy("component").agg(F.sum("n").alias("n_cells"))


def clone_size_histogram(details: DataFrame) -> DataFrame:
    return details.groupBy(F.col("n_cells").alias("size")).agg(F.count("*").alias("n_clones"))
