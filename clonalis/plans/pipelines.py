"""The protocols from reads to clones, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..materialize import materialize
from ..operators import cells as cl
from ..operators import clones as cn
from ..operators import graph as gr
from ..operators import molecules as ml
from ..operators import quality as qc


def _count_full(metrics: list, stage: str, df: DataFrame) -> None:
    row = ml.full_id_stats(df).first()
    metrics += [(stage, k, row[k]) for k in ("total", "n_full", "n_distinct_full")]


def _count_single(metrics: list, molecules: DataFrame) -> None:
    metrics.append(("molecules", "single_read_clone_ids", molecules.filter("read_count = 1").select("clone_id").distinct().count()))


def _finish(found: dict, metrics: list, threshold: float, keep_doublets: bool, bridges_only: bool) -> dict:
    cells = found["cells_filtered"]
    metrics += [("cells", "n", found["cells"].select("cell_id").distinct().count()), ("cells_filtered", "n", cells.select("cell_id").distinct().count())]
    graph = gr.make_graph(cells, threshold)
    graph = gr.CellGraph(materialize(graph.nodes), materialize(graph.members), materialize(graph.edges))
    pruned, gone = gr.prune(graph, keep_doublets or bridges_only)
    metrics += [(name, "removed", t.count()) for name, t in gone.items()]
    clones, details = cn.clone_table(pruned, cells)
    found |= {"graph": graph, "graph_corrected": pruned, "clones": materialize(clones), "clone_details": materialize(details)}
    if not (keep_doublets or bridges_only):
        found["doublets"] = [gone["doublets_1"], gone["doublets_2"]]
    sizes = cn.clone_size_histogram(found["clone_details"]).orderBy("size").collect()
    n = sum(r["n_clones"] for r in sizes)
    metrics += [("clones", "n", n)] + [("clone_size", r["size"], r["n_clones"]) for r in sizes]
    metrics.append(("clones", "mean_size", sum(r["size"] * r["n_clones"] for r in sizes) / n if n else None))
    return found | {"metrics": metrics}


def run_10x(
    reads: DataFrame, *, min_length: int = 20, max_hamming: int = 5, jaccard_threshold: float = 0.7, per_cell: bool = False, visium: bool = False,
    keep_single_reads: bool = False, keep_cross_contamination: bool = False, keep_doublets: bool = False, excluded: DataFrame | None = None,
) -> dict:
    """Droplet reads to clones: consensus, low complexity, correction, exclusion, cell filters, graph, pruning."""
    metrics: list = []
    reads = materialize(reads)
    _count_full(metrics, "reads", reads)
    molecules = materialize(ml.compute_molecules(reads))
    _count_full(metrics, "molecules", molecules)
    plain = materialize(ml.drop_low_complexity(molecules))
    metrics.append(("molecules", "after_complexity", plain.count()))
    corrected = materialize(ml.correct_per_cell(plain, max_hamming, min_length) if per_cell else ml.correct(plain, max_hamming, min_length))
    _count_full(metrics, "molecules_corrected", corrected)
    kept = corrected
    if excluded is not None:
        kept = materialize(ml.exclude(corrected, excluded))
        _count_full(metrics, "molecules_kept", kept)
    cells = materialize(cl.compute_cells(kept, min_length))
    if not visium:
        _count_single(metrics, kept)
    filtered = cl.filter_visium(cells, kept) if visium else cl.filter_cells(cells, kept, not keep_single_reads, not keep_cross_contamination)
    found = {"reads": reads, "molecules": molecules, "molecules_corrected": corrected, "cells": cells, "cells_filtered": materialize(filtered)}
    return _finish(found, metrics, jaccard_threshold, keep_doublets, False)


def run_smartseq3(reads: DataFrame, *, min_length: int = 20, max_hamming: int = 5, jaccard_threshold: float = 0.7, keep_single_reads: bool = False) -> dict:
    """Full-length reads with UMIs: as for droplets, without the complexity filter and without doublets."""
    metrics: list = []
    reads = materialize(reads)
    _count_full(metrics, "reads", reads)
    molecules = materialize(ml.compute_molecules(reads))
    _count_full(metrics, "molecules", molecules)
    corrected = materialize(ml.correct(molecules, max_hamming, min_length))
    cells = materialize(cl.compute_cells(corrected, min_length))
    _count_single(metrics, corrected)
    filtered = materialize(cl.filter_cells(cells, corrected, not keep_single_reads))
    found = {"reads": reads, "molecules": molecules, "molecules_corrected": corrected, "cells": cells, "cells_filtered": filtered}
    return _finish(found, metrics, jaccard_threshold, True, True)


def run_smartseq2(reads: DataFrame, *, min_length: int = 20, max_hamming: int = 5, jaccard_threshold: float = 0.7, readcount_threshold: int = 2) -> dict:
    """Reads without UMIs: each is a molecule, and a cell's cloneIDs need a number of them."""
    metrics: list = []
    reads = materialize(reads.select("cell_id", F.lit(None).cast("string").alias("umi"), "clone_id"))
    _count_full(metrics, "reads", reads)
    corrected = materialize(ml.correct(reads.withColumn("read_count", F.lit(1).cast("long")), max_hamming, min_length))
    cells = materialize(cl.compute_cells(corrected, min_length))
    found = {"reads": reads, "molecules": reads, "molecules_corrected": corrected, "cells": cells, "cells_filtered": materialize(cl.filter_smartseq2(cells, readcount_threshold))}
    return _finish(found, metrics, jaccard_threshold, True, True)


def quality_tables(reads: DataFrame, molecules: DataFrame, corrected: DataFrame, cells: DataFrame, filtered: DataFrame, clones: DataFrame) -> dict[str, DataFrame]:
    """The tables behind the quality report: histograms of (value, n), and the pairs' similarities."""
    out = {"reads_per_molecule": qc.histogram(qc.reads_per_molecule(reads), "n_reads")}
    for name, t in (("molecules", molecules), ("corrected", corrected), ("cells", cells), ("filtered", filtered)):
        out[f"nucleotides_per_molecule_{name}"] = qc.nucleotides_per_molecule(t)
        out[f"molecules_per_cell_{name}"] = qc.histogram(qc.molecules_per(t, "cell_id"), "n_molecules")
        out[f"molecules_per_clone_id_{name}"] = qc.histogram(qc.molecules_per(t, "clone_id"), "n_molecules")
        out[f"clone_ids_per_cell_{name}"] = qc.histogram(qc.unique_clone_ids_per_cell(t), "n_clone_ids")
    out["clone_ids_per_clone"] = qc.histogram(qc.unique_clone_ids_per_clone(clones, filtered), "n_clone_ids")
    out["clone_sizes"] = qc.histogram(qc.clone_sizes(clones), "n_cells")
    out["full_length_share"] = qc.full_length_share(corrected)
    return out
