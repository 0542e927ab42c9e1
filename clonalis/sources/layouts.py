"""Folders that alignments come in."""

from __future__ import annotations

from pathlib import Path
from typing import NamedTuple


class LayoutError(Exception):
    """A folder is not laid out as expected."""


class CellRanger(NamedTuple):
    """Output folder of the aligner for droplets: its BAM file, its list of cells, and its name."""

    bam: str
    barcodes: str
    sample_dir: str


def find_cellranger(path: str, genome: str | None = None) -> CellRanger:
    """The older layout has a folder for each genome, of which there must be one if none is named."""
    outs = Path(path) / "outs"
    old, new = outs / "filtered_gene_bc_matrices", outs / "filtered_feature_bc_matrix"
    if old.exists():
        folders = [old / genome] if genome is not None else sorted(p for p in old.iterdir() if p.is_dir())
        if len(folders) != 1:
            raise LayoutError(f"exactly one genome folder is expected in {old}, found {len(folders)}")
        barcodes = folders[0] / "barcodes.tsv"
    elif new.exists():
        barcodes = new / "barcodes.tsv.gz"
    else:
        raise LayoutError(f"{outs} has no folder of filtered matrices")
    return CellRanger(str(outs / "possorted_genome_bam.bam"), str(barcodes), str(path))


def find_bams(path: str, cell_id_tag: str) -> list[str]:
    """The BAM files of a folder in the order of their names, or the path itself."""
    p = Path(path)
    if cell_id_tag == "CB" or not p.is_dir():
        return [str(p)]
    return [str(b) for b in sorted(p.glob("*.bam"))] or [str(p)]
