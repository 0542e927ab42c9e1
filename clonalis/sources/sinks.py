"""Text outputs. Each is one file in a fixed order, streamed row by row through the driver; tables of any
size are better written as Parquet. Column headers and the comment lines of components.txt are fixed values:
other programs read these files."""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequences as sq
from ..operators import graph as gr
from ..operators.cells import top_clone_ids


def write_lines(path: str, lines: Iterable[str]) -> None:
    with open(path, "w") as out:
        for line in lines:
            out.write(line + "\n")


def _tsv(path: str, header: list[str], df: DataFrame) -> None:
    rows = ("\t".join("" if v is None else str(v) for v in r) for r in df.toLocalIterator())
    write_lines(path, _chain("\t".join(header), rows))


def _chain(first: str, rest: Iterable[str]) -> Iterable[str]:
    yield first
    yield from rest


def write_reads(path: str, reads: DataFrame, require_umis: bool = True) -> None:
    if require_umis:
        _tsv(path, ["#cell_id", "umi", "clone_id"], reads.select("cell_id", "umi", "clone_id").orderBy("umi", "cell_id", "clone_id"))
    else:
        _tsv(path, ["#cell_id", "clone_id"], reads.select("cell_id", "clone_id").orderBy("clone_id", "cell_id"))


def write_molecules(path: str, molecules: DataFrame, require_umis: bool = True) -> None:
    """In the order of cell, cloneID before correction, and UMI; without UMIs a read is a molecule and has no read count."""
    before = "original_clone_id" if "original_clone_id" in molecules.columns else "clone_id"
    if require_umis:
        _tsv(path, ["#cell_id", "umi", "clone_id", "read_count"], molecules.orderBy("cell_id", before, "umi").select("cell_id", "umi", "clone_id", "read_count"))
    else:
        _tsv(path, ["#cell_id", "clone_id"], molecules.orderBy("cell_id", before).select("cell_id", "clone_id"))


def write_corrected_molecules(path: str, molecules: DataFrame) -> None:
    columns = ["cell_id", "umi", "original_clone_id", "clone_id", "read_count"]
    _tsv(path, ["#" + columns[0], *columns[1:]], molecules.orderBy("cell_id", "original_clone_id", "umi").select(*columns))


def write_cells(path: str, cells: DataFrame) -> None:
    """A line a cell, its cloneIDs by falling count, then in their order in the cell."""
    pairs = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("c"), "ord", "clone_id")))
    lines = cells.groupBy("cell_id").agg(pairs.alias("p")).orderBy("cell_id").select(
        F.concat_ws("\t", "cell_id", F.lit(":"), F.array_join(F.transform("p", lambda x: F.concat(x["clone_id"], F.lit("\t"), -x["c"])), "\t"))
    )
    write_lines(path, _chain("\t".join(["#cell_id", ":", "clone_id1", "count1", "clone_id2", "count2", "..."]), (r[0] for r in lines.toLocalIterator())))


def write_count_matrix(path: str, cells: DataFrame) -> None:
    """CloneIDs by cells, as a sparse row each that is filled up here: no wide table is made."""
    names = [r[0] for r in cells.select("cell_id").distinct().orderBy("cell_id").collect()]
    rows = cells.groupBy("clone_id").agg(F.map_from_entries(F.collect_list(F.struct("cell_id", "count"))).alias("m")).orderBy("clone_id")
    write_lines(path, _chain("," + ",".join(names), (",".join([r["clone_id"], *(str(r["m"].get(n, 0)) for n in names)]) for r in rows.toLocalIterator())))


def write_clones(path: str, clones: DataFrame) -> None:
    _tsv(path, ["clone_nr", "cell_id"], clones.select("clone_nr", "cell_id").orderBy("clone_nr", "cell_id"))


def write_clone_details(path: str, details: DataFrame) -> None:
    shown = F.expr("format_number(clone_ids_per_cell, '0.00')")
    _tsv(path, ["clone_nr", "clone_id", "n_cells", "clone_ids_per_cell"], details.orderBy("clone_nr").select("clone_nr", "clone_id", "n_cells", shown))


def write_components(path: str, graph: gr.CellGraph, cells: DataFrame, highlight: DataFrame | None = None) -> None:
    """The components that are no cliques, with their cells and cloneIDs, + where a cell is highlighted."""
    placed = gr.components(graph)
    density = gr.component_density(graph, placed)
    n_complete = density.filter("complete").count()
    ids = cells.groupBy("cell_id").agg(F.array_sort(F.collect_set("clone_id")).alias("ids"))
    marks = highlight.select("cell_id", F.lit("+").alias("mark")).distinct() if highlight is not None else None
    rows = graph.members.join(placed, "node_id").join(density.filter("not complete"), "component").join(ids, "cell_id")
    rows = rows.withColumn("mark", F.lit("")) if marks is None else rows.join(marks, "cell_id", "left").fillna("", ["mark"])

    def lines() -> Iterable[str]:
        yield "# Clone graph components (only incomplete/density<1)"
        last = None
        for r in rows.orderBy("component", "cell_id").toLocalIterator():
            if r["component"] != last:
                last = r["component"]
                yield f"## {r['n_cells']} nodes, {r['n_edges']} edges, density {r['n_edges'] / r['possible_edges']:.3f}"
            yield "\t".join([r["cell_id"], r["mark"], *r["ids"]])
        yield f"# {n_complete} complete components"

    write_lines(path, lines())


def write_doublets(path: str, rounds: list[DataFrame]) -> None:
    write_lines(path, (r["node_id"] for d in rounds for r in d.orderBy("node_id").toLocalIterator()))


def drawing_tables(graph: gr.CellGraph) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, n, component, weight) and edges (u, v, bridge, weight) of components of three nodes or more.

    The weight of a node is the logarithm of its cells, that of an edge the logarithm of the pairs of cells
    that it stands for, both as a share of the greatest in the graph."""
    placed = gr.components(graph)
    drawn = placed.groupBy("component").agg(F.count("*").alias("_size")).filter("_size >= 3").select("component")
    nodes = placed.join(drawn, "component", "left_semi").join(graph.nodes.select("node_id", "n"), "node_id").select("node_id", "n", "component", F.log(F.col("n")).alias("raw"))
    size = nodes.select("node_id", "n")
    ends = graph.edges.join(size.withColumnsRenamed({"node_id": "u", "n": "nu"}), "u").join(size.withColumnsRenamed({"node_id": "v", "n": "nv"}), "v")
    edges = ends.join(gr.bridges(graph.edges).withColumn("bridge", F.lit(True)), ["u", "v"], "left").select("u", "v", F.coalesce("bridge", F.lit(False)).alias("bridge"), F.log(F.col("nu") * F.col("nv")).alias("raw"))

    def scaled(t: DataFrame) -> DataFrame:
        most = t.agg(F.max("raw")).first()[0] or 1.0
        return t.withColumn("weight", F.round(F.col("raw") / F.lit(float(most)), 3)).drop("raw")

    return scaled(nodes), scaled(edges)


def write_dot(path: str, graph: gr.CellGraph, highlight: DataFrame | None = None, doublets: DataFrame | None = None) -> None:
    """The graph in the language of Graphviz, a cluster a component; it is drawn by other programs. Shapes tell what
    a node is: a double octagon a doublet, a hexagon one with highlighted cells, a circle any other."""
    nodes, edges = drawing_tables(graph)
    if highlight is not None:
        marked = graph.members.join(highlight.select("cell_id").distinct(), "cell_id", "left_semi").groupBy("node_id").agg(F.count("*").alias("marked"))
        nodes = nodes.join(marked, "node_id", "left")
    else:
        nodes = nodes.withColumn("marked", F.lit(None).cast("long"))
    nodes = nodes.join(doublets.select("node_id").distinct().withColumn("double", F.lit(True)), "node_id", "left") if doublets is not None else nodes.withColumn("double", F.lit(None).cast("boolean"))
    shape = F.when(F.col("double"), "doubleoctagon").when(F.col("marked") > 0, "hexagon").otherwise("circle")

    def lines() -> Iterable[str]:
        yield "graph g {"
        open_ = None
        for r in nodes.select("*", shape.alias("shape")).orderBy("component", "node_id").toLocalIterator():
            if r["component"] != open_:
                if open_ is not None:
                    yield "}"
                open_ = r["component"]
                yield f'subgraph "cluster {open_}" {{'
            cells = f"{r['n']} cells" + (f", {r['marked']} marked" if r["marked"] else "")
            yield f'"{r["node_id"]}" [shape={r["shape"]} penwidth={1 + 4 * r["weight"]:.2f} tooltip="{cells}"]'
        if open_ is not None:
            yield "}"
        for r in edges.orderBy("u", "v").toLocalIterator():
            yield f'"{r["u"]}" -- "{r["v"]}" [penwidth={1 + 4 * r["weight"]:.2f} style={"dotted" if r["bridge"] else "solid"}]'
        yield "}"

    write_lines(path, lines())


def barcode_attributes(cells: DataFrame, barcodes: DataFrame, n: int = 6) -> DataFrame:
    """A row a listed cell with its n most frequent cloneIDs and counts as columns, - and 0 where it has fewer."""
    top = top_clone_ids(cells, n)
    ranks = list(range(1, n + 1))
    wide = top.groupBy("cell_id").pivot("rank", ranks).agg(F.first("clone_id").alias("id"), F.first("count").alias("n"))
    t = barcodes.select(F.regexp_replace("cell_id", "-1$", "").alias("cell_id")).distinct().join(wide, "cell_id", "left")
    out = [F.col("cell_id")]
    for k in ranks:
        out += [F.coalesce(F.col(f"{k}_id"), F.lit("-")).alias(f"cloneid_{k}"), F.coalesce(F.col(f"{k}_n"), F.lit(0)).alias(f"cloneid_count_{k}")]
    return t.select(*out)


def log_lines(metrics: list[tuple], notes: Iterable[str] = (), matrix: str | None = None, with_mean: bool = True) -> Iterable[str]:
    """The lines of log.txt: notes, then a run's counts by stage. Other programs read them, so their wording is fixed."""
    m = {(stage, name): value for stage, name, value in metrics}
    yield from notes
    # fixed values: the wording of the lines
    yield f"Read {m['reads', 'total']} reads containing (parts of) the cloneID ({m['reads', 'n_full']} full cloneIDs, {m['reads', 'n_distinct_full']} unique)"
    if ("molecules", "total") in m:
        yield f"Detected {m['molecules', 'total']} molecules ({m['molecules', 'n_full']} full cloneIDs, {m['molecules', 'n_distinct_full']} unique)"
    worded = (
        (("molecules", "after_complexity"), "{} remain after low-complexity filtering"),
        (("molecules_corrected", "n_distinct_full"), "After cloneID correction, {} unique cloneIDs remain"),
        (("molecules_kept", "n_distinct_full"), "After filtering cloneIDs, {} unique cloneIDs remain"),
        (("cells", "n"), "Detected {} cells"),
        (("molecules", "single_read_clone_ids"), "Found {} single-read cloneIDs"),
        (("cells_filtered", "n"), "{} filtered cells remain"),
        (None, f"Writing {matrix.split('_')[0].replace('umi', 'UMI')} matrix" if matrix else None),
        (("bridges_1", "removed"), "Removing {} bridges from the graph"),
        (("doublets_1", "removed"), "Removing {} doublets from the graph (first round)"),
        (("bridges_2", "removed"), "Removing {} bridges from the graph (second round)"),
        (("doublets_2", "removed"), "Removing {} doublets from the graph (second round)"),
        (("clones", "n"), "Detected {} clones"),
    )
    for key, words in worded:
        if words and (key is None or key in m):
            yield words.format(m.get(key))
    yield "Clone size histogram"
    yield " size count"
    for (stage, size), n in m.items():
        if stage == "clone_size":
            yield f"{size:5d} {n:5d}"
    if with_mean and m.get(("clones", "mean_size")) is not None:
        yield f"Average clone size: {m['clones', 'mean_size']:.2f}"


def write_outputs(
    folder: str, found: dict, require_umis: bool = True, matrix: str | None = None, highlight: DataFrame | None = None, with_original: bool = True, notes: Iterable[str] = (),
) -> None:
    """The files of a run from the tables that a pipeline returns; notes come first in log.txt."""
    base = Path(folder)
    base.mkdir(parents=True, exist_ok=True)
    at = lambda name: str(base / name)
    write_reads(at("reads.txt"), found["reads"], require_umis)
    if require_umis:
        write_molecules(at("molecules.txt"), found["molecules"])
    (write_corrected_molecules if with_original else lambda p, m: write_molecules(p, m, require_umis))(at("molecules_corrected.txt"), found["molecules_corrected"])
    write_cells(at("cells.txt"), found["cells"])
    write_cells(at("cells_filtered.txt"), found["cells_filtered"])
    if matrix:
        write_count_matrix(at(matrix), found["cells_filtered"])
    write_components(at("components.txt"), found["graph"], found["cells_filtered"], highlight)
    write_components(at("components_corrected.txt"), found["graph_corrected"], found["cells_filtered"], highlight)
    if "doublets" in found:
        write_doublets(at("doublets.txt"), found["doublets"])
    write_clones(at("clones.txt"), found["clones"])
    write_clone_details(at("clone_details.txt"), found["clone_details"])
    write_lines(at("log.txt"), log_lines(found["metrics"], notes, matrix, with_original))
