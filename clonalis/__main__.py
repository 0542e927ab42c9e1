"""Command line: python -m clonalis run10x | smartseq2 | smartseq3 | qc."""

from __future__ import annotations

import argparse
import logging
import shutil
import sys
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__
from .functions.alignments import detect_span, overlapping, read_alignments
from .materialize import materialize
from .plans import pipelines
from .sources import alignment_files, dataset, layouts, lists, sinks


class CommandError(Exception):
    """The command line or its inputs don't fit."""


def parser() -> argparse.ArgumentParser:
    # fixed values: the names of commands and options are an interface
    top = argparse.ArgumentParser(prog="clonalis", description=__doc__)
    top.add_argument("--version", action="version", version=f"clonalis {__version__}")
    top.add_argument("--debug", action="store_true", help="tell of Spark's work, and show errors in full")
    commands = top.add_subparsers(dest="command", required=True)
    for name, text in (("run10x", "droplet reads"), ("smartseq3", "full-length reads with UMIs"), ("smartseq2", "full-length reads without UMIs")):
        p = commands.add_parser(name, help=f"{text} to clones")
        p.add_argument("path", nargs="+", help="folder of a sample, or a BAM or SAM file")
        p.add_argument("--genome-name")
        p.add_argument("--chromosome", "--chr")
        p.add_argument("--start", "-s", type=int, help="first position, 1-based")
        p.add_argument("--end", "-e", type=int, help="last position, 1-based")
        p.add_argument("--amplicon", "-a", nargs="+", default=[])
        p.add_argument("--samples", type=lambda s: s.split(","))
        p.add_argument("--prefix", action="store_true")
        p.add_argument("--min-length", type=int, default=20)
        p.add_argument("--max-hamming", type=int, default=5)
        p.add_argument("--jaccard-threshold", type=float, default=0.7)
        p.add_argument("--filter-cellids", "-f")
        p.add_argument("--filter-cloneids")
        p.add_argument("--output", "-o", default="clonalis_run")
        p.add_argument("--delete", action="store_true")
        p.add_argument("--plot", action="store_true", help="write the graph in the language of Graphviz")
        p.add_argument("--highlight")
        if name != "smartseq2":
            p.add_argument("--keep-single-reads", action="store_true")
            p.add_argument("--umi-matrix", action="store_true")
        if name == "run10x":
            for flag in ("--keep-cross-contamination", "--keep-doublets", "--visium", "--per-cell"):
                p.add_argument(flag, action="store_true")
            p.add_argument("--loom", "-l", action="store_true", help="write cell attributes as Parquet")
        if name == "smartseq2":
            p.add_argument("--readcount-threshold", type=int, default=2)
            p.add_argument("--read-matrix", action="store_true")
    p = commands.add_parser("qc", help="tables of a quality report from the folder of a run")
    p.add_argument("path")
    p.add_argument("--plot-jaccard-matrix", action="store_true")
    p.add_argument("--plot-hamming-distance", action="store_true")
    return top


def load_sample(spark: SparkSession, path: str, a: argparse.Namespace, tag: str, require_umis: bool, kept: Path | None = None) -> tuple[DataFrame, list[str]]:
    """Reads of one input, and the lines of the log about it; a span that is not given is looked for.

    The alignments that the reads come from are written to kept, a BAM file, if the input is BAM.
    """
    allowed = None
    if tag == "CB" and Path(path).is_dir():
        found = layouts.find_cellranger(path, a.genome_name)
        files, allowed = [found.bam], lists.read_barcodes(spark, found.barcodes)
    else:
        files = layouts.find_bams(path, tag)
    if (a.start is None) != (a.end is None):
        raise CommandError("--start and --end go together")
    notes, parts, header = [], [], None
    for k, name in enumerate(files):
        chromosome, length, span = a.chromosome, 1 << 31, None
        if a.start is not None:
            span = (a.start - 1, a.end)
        if name.endswith(".sam"):
            if chromosome is None:
                raise CommandError("a SAM file needs --chromosome")
            rows, carry = alignment_files.read_sam(spark, name), ()
        else:
            header = alignment_files.header_of(spark, name)
            chromosome = chromosome or header[1][-1][0]
            length = dict(header[1]).get(chromosome, length)
            region = (max(0, span[0] - 10), span[1] + 10) if span else ()
            rows, carry = alignment_files.read_bam(spark, name, chromosome, *region, keep_records=True), ("ref", "pos", "flag", "place", "record")
        if span is None:
            rows = materialize(rows)
            span = detect_span(rows, chromosome, length)
            if span[1] - span[0] < 10:
                raise CommandError("the span found is too short")
        near = materialize(overlapping(rows, chromosome, *span))
        reads, counters = read_alignments(near, chromosome, *span, allowed=allowed, require_umis=require_umis, cell_id_tag=tag, carry=carry)
        reads, counts = materialize(reads.withColumn("_file", F.lit(k))), counters.first()
        parts.append(reads)
        # fixed values: the wording of the lines
        notes.append(f"Reading cloneIDs from {chromosome}:{span[0] + 1}-{span[1]} in {name}")
        words = f"Found {reads.count()} reads with usable cloneIDs" + (" and UMIs" if require_umis else "")
        notes.append(f"{words}. Skipped {counts['no_cell_id']} without cell id" + (f", {counts['no_umi']} without UMI." if require_umis else ""))
    out = reduce(DataFrame.unionByName, [p.select("cell_id", "umi", "clone_id") for p in parts])
    stored = [p for p in parts if "record" in p.columns]
    if kept is not None and stored:
        alignment_files.write_bam(str(kept), reduce(DataFrame.unionByName, stored), *header, ["_file"])
    return out, notes


def load(spark: SparkSession, a: argparse.Namespace, tag: str, require_umis: bool) -> tuple[DataFrame, list[str]]:
    """Reads of all inputs, and the lines of the log. Filtered alignments go to BAM files in the output folder."""
    if a.amplicon and len(a.amplicon) != len(a.path):
        raise CommandError("as many --amplicon inputs as samples are needed")
    names = [""]
    if len(a.path) > 1:
        names = a.samples or [Path(p).name for p in a.path]
        if len(names) != len(a.path) or len(set(names)) != len(names):
            raise CommandError("each sample needs a name of its own")
    samples, notes, base = [], [], Path(a.output)
    base.mkdir(parents=True, exist_ok=True)
    for k, path in enumerate(a.path):
        first = f"{names[k]}_" if names[k] else ""
        reads, lines = load_sample(spark, path, a, tag, require_umis, base / f"{first}entries.bam")
        notes += lines
        if a.amplicon:
            more, lines = load_sample(spark, a.amplicon[k], a, tag, require_umis, base / f"{first}amplicon_entries.bam")
            reads, notes = reads.unionByName(more), notes + lines
        samples.append(reads)
    reads = dataset.merge_samples(samples, names, a.prefix) if len(samples) > 1 else samples[0]
    if a.filter_cellids:
        reads = dataset.keep_cells(reads, lists.read_allowed_cells(spark, a.filter_cellids))
    reads = materialize(reads)
    if reads.isEmpty():
        raise CommandError("no reads are left")
    return reads, notes


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    out = Path(a.output)
    if out.exists():
        if not a.delete:
            raise CommandError(f"{out} exists; --delete replaces it")
        shutil.rmtree(out)
    tag, require_umis = ("CB" if a.command == "run10x" else "BC"), a.command != "smartseq2"
    reads, notes = load(spark, a, tag, require_umis)
    own = {"min_length": a.min_length, "max_hamming": a.max_hamming, "jaccard_threshold": a.jaccard_threshold}
    matrix = None
    if a.command == "run10x":
        excluded = lists.read_excluded_clone_ids(spark, a.filter_cloneids) if a.filter_cloneids else None
        found = pipelines.run_10x(
            reads, **own, per_cell=a.per_cell, visium=a.visium, keep_single_reads=a.keep_single_reads, keep_cross_contamination=a.keep_cross_contamination,
            keep_doublets=a.keep_doublets, excluded=excluded,
        )
        matrix = "umi_count_matrix.csv" if a.umi_matrix else None
    elif a.command == "smartseq3":
        found = pipelines.run_smartseq3(reads, **own, keep_single_reads=a.keep_single_reads)
        matrix = "umi_count_matrix.csv" if a.umi_matrix else None
    else:
        found = pipelines.run_smartseq2(reads, **own, readcount_threshold=a.readcount_threshold)
        matrix = "read_count_matrix.csv" if a.read_matrix else None
    highlight = lists.read_highlights(spark, a.highlight) if a.highlight else None
    sinks.write_outputs(a.output, found, require_umis, matrix, highlight, with_original=a.command == "run10x", notes=notes)
    if a.plot:
        sinks.write_dot(str(out / "graph.gv"), found["graph"], highlight)
        sinks.write_dot(str(out / "graph_corrected.gv"), found["graph_corrected"], highlight)
    if a.command == "run10x" and a.loom:
        barcodes = lists.read_barcodes(spark, layouts.find_cellranger(a.path[0], a.genome_name).barcodes)
        sinks.barcode_attributes(found["cells_filtered"], barcodes).write.parquet(str(out / "cell_attributes.parquet"))


def quality(spark: SparkSession, a: argparse.Namespace) -> None:
    base = Path(a.path)
    at = lambda name: str(base / name)
    with_umis = (base / "molecules.txt").exists()
    reads = lists.read_reads(spark, at("reads.txt"), with_umis)
    molecules = lists.read_molecules(spark, at("molecules.txt")) if with_umis else reads
    corrected = lists.read_table(spark, at("molecules_corrected.txt"), "cell_id string, umi string, original_clone_id string, clone_id string, read_count bigint") if with_umis else lists.read_reads(spark, at("molecules_corrected.txt"), False)
    cells, filtered = lists.read_cells(spark, at("cells.txt")), lists.read_cells(spark, at("cells_filtered.txt"))
    tables = pipelines.quality_tables(reads, molecules, corrected, cells, filtered, lists.read_clones(spark, at("clones.txt")))
    if a.plot_hamming_distance:
        tables["hamming_distance"] = pipelines.qc.hamming_histogram(corrected)
    if a.plot_jaccard_matrix:
        tables["jaccard"] = pipelines.qc.jaccard_matrix(filtered)
        order = pipelines.qc.matrix_order(tables["jaccard"])
        tables["jaccard_order"] = spark.createDataFrame(list(enumerate(order)), "place long, cell_id string")
    for name, table in tables.items():
        table.coalesce(1).write.mode("overwrite").csv(at(f"quality/{name}"), header=True)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if a.debug else logging.INFO, format="%(levelname)s: %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = SparkSession.builder.appName("clonalis").getOrCreate()
    spark.sparkContext.setLogLevel("INFO" if a.debug else "WARN")
    try:
        (quality if a.command == "qc" else run)(spark, a)
    except (CommandError, layouts.LayoutError) as e:
        if a.debug:
            raise
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
