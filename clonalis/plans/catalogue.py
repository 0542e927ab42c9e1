"""Queries over the driver's tables, each with the SQL that states what it must return."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import alignments as al
from ..functions import sequences as sq
from ..materialize import materialize
from ..operators import cells as cl
from ..operators import clones as cn
from ..operators import graph as gr
from ..operators import molecules as ml
from ..operators import quality as qc
from ..sources import dataset
from . import oracles as o
from .derived import derived_alignments, derived_reads

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Thresholds of the graph queries: the default, and one at which doublets appear.
DEFAULT, LOOSE = 0.7, 0.3


def _query(ctes: list[tuple[str, str]], final: str, name: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = f
        ORACLE_SQL[key] = o.sql(ctes, final)
        return f

    return register


def _molecules(spark, sf):
    return ml.compute_molecules(derived_reads(spark, sf))


def _plain(spark, sf):
    return ml.drop_low_complexity(_molecules(spark, sf))


def _corrected(spark, sf):
    return materialize(ml.correct(materialize(_plain(spark, sf))))


def _cells(spark, sf):
    return cl.compute_cells(_corrected(spark, sf))


def _filtered(spark, sf):
    corrected = _corrected(spark, sf)
    return cl.filter_cells(cl.compute_cells(corrected), corrected)


def _graph(spark, sf, threshold):
    cells = materialize(_filtered(spark, sf))
    nodes, members = gr.make_nodes(cells)
    nodes = materialize(nodes)
    return gr.CellGraph(nodes, members, materialize(gr.jaccard_edges(nodes, threshold).select("u", "v"))), cells


def _pruned(spark, sf, threshold):
    graph, cells = _graph(spark, sf, threshold)
    graph, gone = gr.prune(graph)
    return graph, gone, cells


# alignments


@_query(o.ALIGNMENTS, "SELECT replace(cb, '-1', '') AS cell_id, ub AS umi, clone_id FROM cloned JOIN near USING (id)")
def alignments_usable(spark, sf):
    return al.read_alignments(derived_alignments(spark, sf), "chrX", 100, 130)[0]


@_query(o.ALIGNMENTS, "SELECT count_if(cb IS NULL) AS no_cell_id, count_if(ub IS NULL OR ub = '') AS no_umi FROM near")
def alignments_counters(spark, sf):
    return al.read_alignments(derived_alignments(spark, sf), "chrX", 100, 130)[1]


# reads and molecules


@_query(o.CTES, "SELECT cell_id, umi, clone_id FROM reads")
def reads_derived(spark, sf):
    return derived_reads(spark, sf)


@_query(o.CTES, "SELECT cell_id, umi, clone_id FROM reads WHERE regexp_matches(clone_id, '[^0-]') AND umi <> ''")
def reads_usable(spark, sf):
    return dataset.usable_reads(derived_reads(spark, sf))


@_query(o.CTES, "SELECT count(*) AS total, count(CASE WHEN NOT regexp_matches(clone_id, '[-0]') THEN 1 END) AS n_full, count(DISTINCT CASE WHEN NOT regexp_matches(clone_id, '[-0]') THEN clone_id END) AS n_distinct_full FROM reads")
def full_id_stats(spark, sf):
    return ml.full_id_stats(derived_reads(spark, sf))


@_query(o.CTES, "SELECT cell_id, umi, clone_id FROM reads WHERE cell_id IN (SELECT 'CELL' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') FROM customer WHERE c_nationkey < 5)")
def allowed_cells_semi(spark, sf):
    allowed = spark.read.parquet(f"{sf}/customer.parquet").filter("c_nationkey < 5").select(F.concat(F.lit("CELL"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("cell_id"))
    return dataset.keep_cells(derived_reads(spark, sf), allowed)


@_query(o.CTES, "SELECT cell_id || '_a' AS cell_id, umi, clone_id FROM reads WHERE umi < 'G' UNION ALL SELECT cell_id || '_b', umi, clone_id FROM reads WHERE umi >= 'G'")
def merge_samples_suffix(spark, sf):
    reads = derived_reads(spark, sf)
    return dataset.merge_samples([reads.filter("umi < 'G'"), reads.filter("umi >= 'G'")], ["a", "b"])


@_query(o.CTES, "SELECT 'a_' || cell_id AS cell_id, umi, clone_id FROM reads WHERE umi < 'G' UNION ALL SELECT 'b_' || cell_id, umi, clone_id FROM reads WHERE umi >= 'G'")
def merge_samples_prefix(spark, sf):
    reads = derived_reads(spark, sf)
    return dataset.merge_samples([reads.filter("umi < 'G'"), reads.filter("umi >= 'G'")], ["a", "b"], prefix=True)


@_query(o.MOLECULES, "SELECT cell_id, umi, clone_id, read_count FROM molecules")
def molecules_consensus(spark, sf):
    return _molecules(spark, sf)


@_query(o.CTES, "SELECT cell_id, umi, count(*) AS n_reads FROM reads GROUP BY ALL")
def reads_per_molecule(spark, sf):
    return qc.reads_per_molecule(derived_reads(spark, sf))


@_query(o.CTES, f"SELECT clone_id, round({o._ENTROPY.format(c='clone_id')}, 9) AS entropy, {o._ENTROPY.format(c='clone_id')} < 1.0 AS low FROM (SELECT DISTINCT clone_id FROM reads UNION SELECT DISTINCT repeat(substr(clone_id, 1, 2), 15) FROM reads)")
def low_complexity(spark, sf):
    ids = derived_reads(spark, sf).select("clone_id")
    ids = ids.unionByName(ids.select(F.repeat(F.substring("clone_id", 1, 2), 15).alias("clone_id"))).distinct()
    return ids.select("clone_id", F.round(sq.entropy(F.col("clone_id")), 9).alias("entropy"), sq.is_low_complexity(F.col("clone_id")).alias("low"))


# corrections and exclusion


@_query(o.CORRECTION, "SELECT DISTINCT a.kmer, CAST(count(*) AS BIGINT) AS n_ids FROM words a GROUP BY ALL")
def kmer_index(spark, sf):
    ids = _plain(spark, sf).select("clone_id").distinct().filter(sq.known_length(F.col("clone_id")) >= 20)
    words = ids.select(F.explode(F.array_distinct(sq.kmers(F.col("clone_id"), 7))).alias("kmer"))
    return words.groupBy("kmer").agg(F.count("*").alias("n_ids"))


@_query(o.CORRECTION, "SELECT u, v FROM pairs")
def similar_pairs(spark, sf):
    return ml.similar_pairs(_plain(spark, sf), 20, 5)


@_query(o.CORRECTION, "SELECT clone_id, representative FROM cmap")
def correction_map_global(spark, sf):
    return ml.correction_map(materialize(_plain(spark, sf)))


@_query(o.CORRECTION, "SELECT cell_id, umi, original_clone_id, clone_id, read_count FROM corrected")
def molecules_corrected(spark, sf):
    return ml.correct(materialize(_plain(spark, sf))).select("cell_id", "umi", "original_clone_id", "clone_id", "read_count")


@_query(o.PER_CELL, "SELECT cell_id, clone_id, representative FROM own_map")
def correction_per_cell(spark, sf):
    return ml.correction_map_per_cell(materialize(_plain(spark, sf)))


@_query(o.EXCLUSION, "SELECT clone_id FROM gone")
def excluded_clone_ids(spark, sf):
    corrected = _corrected(spark, sf).select("clone_id").distinct()
    full = corrected.filter(F.col("clone_id").like("A%") & sq.is_full(F.col("clone_id")))
    partial_ = corrected.filter(F.col("clone_id").like("CG%")).select(F.concat(F.substring("clone_id", 1, 14), F.lit("-" * 16)).alias("clone_id"))
    kept = ml.exclude(corrected, full.unionByName(partial_))
    return corrected.join(kept, "clone_id", "left_anti")


# cells and filters


@_query(o.CELLS, "SELECT cell_id, clone_id, count FROM cells")
def cells_counts(spark, sf):
    return _cells(spark, sf).select("cell_id", "clone_id", "count")


@_query(o.CELLS, "SELECT cell_id, clone_id, count, ord FROM cells")
def cells_ordered(spark, sf):
    return _cells(spark, sf)


def _filter_10x(spark, sf, single, contamination):
    corrected = _corrected(spark, sf)
    return cl.filter_cells(cl.compute_cells(corrected), corrected, single, contamination)


for _single, _contamination, _name in ((True, True, "filter_10x"), (False, True, "filter_10x_keep_single_reads"), (True, False, "filter_10x_keep_contamination"), (False, False, "filter_10x_keep_both")):
    _rule = " OR ".join([*["total > 1"] * _contamination, *["weak"] * _single]) or "false"
    _query(o.CELLS, f"SELECT cell_id, clone_id, count, ord FROM judged WHERE NOT (count <= 1 AND ({_rule}))", _name)(partial(_filter_10x, single=_single, contamination=_contamination))


@_query(o.CELLS, "SELECT cell_id, clone_id, count, ord FROM judged WHERE NOT (count <= 1 AND (total > 1 OR weak))")
def filter_smartseq3(spark, sf):
    corrected = _corrected(spark, sf)
    return cl.filter_cells(cl.compute_cells(corrected), corrected, discard_single_reads=True)


@_query(o.CELLS, "SELECT cell_id, clone_id, count, ord FROM cells c WHERE NOT (count <= 1 AND EXISTS (SELECT 1 FROM corrected m WHERE m.cell_id = c.cell_id AND m.clone_id = c.clone_id AND m.read_count = 1))")
def filter_visium(spark, sf):
    corrected = _corrected(spark, sf)
    return cl.filter_visium(cl.compute_cells(corrected), corrected)


@_query(o.CELLS, "SELECT cell_id, clone_id, count, ord FROM cells WHERE count >= 2")
def filter_smartseq2(spark, sf):
    return cl.filter_smartseq2(_cells(spark, sf))


@_query(o.CELLS, "SELECT clone_id, cell_id, count FROM filtered")
def umi_matrix_long(spark, sf):
    return _filtered(spark, sf).select("clone_id", "cell_id", "count")


def umi_matrix_all_cells(spark, sf):
    """The matrix over all filtered cells; without SQL, since its columns are the cells of the input."""
    return cl.count_matrix(materialize(_filtered(spark, sf)))


QUERIES["umi_matrix_all_cells"] = umi_matrix_all_cells


@_query(o.CELLS, "SELECT cell_id, row_number() OVER (PARTITION BY cell_id ORDER BY count DESC, ord DESC) AS rank, clone_id, count FROM filtered QUALIFY rank <= 6")
def top6_per_cell(spark, sf):
    return cl.top_clone_ids(_filtered(spark, sf))


# graph and clones


@_query(o.graph(DEFAULT), "SELECT node_id, n, clone_ids FROM nodes")
def precluster_nodes(spark, sf):
    return gr.make_nodes(_filtered(spark, sf))[0]


def _edges(spark, sf, threshold):
    return gr.jaccard_edges(materialize(gr.make_nodes(_filtered(spark, sf))[0]), threshold)


def _components(spark, sf, threshold):
    return gr.components(_graph(spark, sf, threshold)[0])


def _density(spark, sf, threshold):
    return gr.component_density(_graph(spark, sf, threshold)[0])


def _bridges(spark, sf, threshold):
    return gr.bridges(_graph(spark, sf, threshold)[0].edges)


def _after_bridges(spark, sf, threshold):
    graph, _ = _graph(spark, sf, threshold)
    return gr.components(gr.remove_edges(graph, gr.bridges(graph.edges)))


def _clones(spark, sf, threshold):
    graph, _, cells = _pruned(spark, sf, threshold)
    return cn.clone_table(graph, cells)[0]


def _details(spark, sf, threshold):
    graph, _, cells = _pruned(spark, sf, threshold)
    return cn.clone_table(graph, cells)[1]


def _sizes(spark, sf, threshold):
    return cn.clone_size_histogram(cn.sizes(_pruned(spark, sf, threshold)[0]))


_GRAPH_QUERIES = {
    "jaccard_edges": (_edges, "SELECT u, v, jaccard FROM jac WHERE jaccard > CAST({t} AS DOUBLE)"),
    "components": (_components, "SELECT node AS node_id, component FROM comp0"),
    "component_density": (_density, o.density(0)),
    "bridges": (_bridges, "SELECT u, v FROM b0"),
    "components_after_bridges": (_after_bridges, "SELECT node AS node_id, component FROM comp1"),
    "clones": (_clones, "SELECT clone_nr, cell_id FROM clones"),
    "clone_details": (_details, "SELECT clone_nr, clone_id, n_cells, clone_ids_per_cell FROM details"),
    "clone_size_histogram": (_sizes, "SELECT n_cells AS size, count(*) AS n_clones FROM details GROUP BY ALL"),
}
for _name, (_f, _sql) in _GRAPH_QUERIES.items():
    for _t, _suffix in ((DEFAULT, ""), (LOOSE, "_loose")):
        _query(o.graph(_t), _sql.format(t=_t) if "{t}" in _sql else _sql, _name + _suffix)(partial(_f, threshold=_t))


@_query(o.graph(LOOSE), "SELECT node_id FROM cut1")
def cut_vertices(spark, sf):
    graph, _ = _graph(spark, sf, LOOSE)
    return gr.local_cut_vertices(materialize(gr.remove_edges(graph, gr.bridges(graph.edges)).edges))


@_query(o.graph(LOOSE), "SELECT 1 AS round, node_id AS cell_id FROM d1 UNION ALL SELECT 2, node_id FROM d3")
def doublets(spark, sf):
    gone = _pruned(spark, sf, LOOSE)[1]
    return gone["doublets_1"].select(F.lit(1).alias("round"), F.col("node_id").alias("cell_id")).unionByName(gone["doublets_2"].select(F.lit(2).alias("round"), F.col("node_id").alias("cell_id")))


_VALUES = "(VALUES ('K','L'),('L','M'),('M','K'),('M','N'),('N','P'),('P','Q'),('Q','N'),('R','S'),('T','S')) t(u, v)"


@_query([("e9", f"SELECT least(u, v) AS u, greatest(u, v) AS v FROM {_VALUES}"), ("sym9", "SELECT u, v FROM e9 UNION ALL SELECT v, u FROM e9"), ("near9", "SELECT u || chr(9) || v AS id FROM sym9"),
         ("ring9", "SELECT DISTINCT a.u || chr(9) || e.u AS u, a.u || chr(9) || e.v AS v FROM e9 e JOIN sym9 a ON a.v = e.u JOIN sym9 b ON b.v = e.v AND a.u = b.u"), *o.reach("part9", "near9", "ring9")],
        "SELECT string_split(node, chr(9))[1] AS node_id FROM part9 GROUP BY ALL HAVING count(DISTINCT component) > 1")
def cut_vertices_values_graph(spark, sf):
    edges = spark.sql(f"select least(u, v) u, greatest(u, v) v from {_VALUES}")
    return gr.local_cut_vertices(edges)


# quality report


@_query(o.MOLECULES, "SELECT length(translate(clone_id, '-0', '')) AS n_nucleotides, count(*) AS n_molecules FROM molecules GROUP BY ALL")
def nucleotides_per_molecule(spark, sf):
    return qc.nucleotides_per_molecule(_molecules(spark, sf))


@_query(o.CELLS, "SELECT length(translate(clone_id, '-0', '')) AS n_nucleotides, CAST(sum(count) AS BIGINT) AS n_molecules FROM cells GROUP BY ALL")
def nucleotides_per_molecule_in_cells(spark, sf):
    return qc.nucleotides_per_molecule(_cells(spark, sf))


@_query(o.MOLECULES, "SELECT cell_id, count(umi) AS n_molecules FROM molecules GROUP BY ALL")
def molecules_per_cell(spark, sf):
    return qc.molecules_per(_molecules(spark, sf), "cell_id")


@_query(o.CELLS, "SELECT clone_id, CAST(sum(count) AS BIGINT) AS n_molecules FROM cells GROUP BY ALL")
def molecules_per_clone_id(spark, sf):
    return qc.molecules_per(_cells(spark, sf), "clone_id")


@_query(o.MOLECULES, "SELECT cell_id, count(DISTINCT clone_id) AS n_clone_ids FROM molecules GROUP BY ALL")
def unique_ids_per_cell(spark, sf):
    return qc.unique_clone_ids_per_cell(_molecules(spark, sf))


@_query(o.graph(DEFAULT), "SELECT clone_nr, count(DISTINCT clone_id) AS n_clone_ids FROM clones JOIN filtered USING (cell_id) GROUP BY ALL")
def unique_ids_per_clone(spark, sf):
    graph, _, cells = _pruned(spark, sf, DEFAULT)
    return qc.unique_clone_ids_per_clone(cn.clone_table(graph, cells)[0], cells)


@_query(o.graph(DEFAULT), "SELECT clone_nr, count(*) AS n_cells FROM clones GROUP BY ALL")
def clone_sizes(spark, sf):
    graph, _, cells = _pruned(spark, sf, DEFAULT)
    return qc.clone_sizes(cn.clone_table(graph, cells)[0])


@_query(o.CTES, "SELECT n_reads AS value, count(*) AS n FROM (SELECT count(*) AS n_reads FROM reads GROUP BY cell_id, umi) GROUP BY ALL")
def reads_per_molecule_histogram(spark, sf):
    return qc.histogram(qc.reads_per_molecule(derived_reads(spark, sf)), "n_reads")


@_query(o.CTES, "SELECT count(x) AS n, avg(x) AS mean, quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.5) AS q50, quantile_cont(x, 0.75) AS q75, count(CASE WHEN x = 1 THEN 1 END) AS n_equal_one FROM (SELECT count(*) AS x FROM reads GROUP BY cell_id, umi)")
def qc_quantiles(spark, sf):
    return qc.summary(qc.reads_per_molecule(derived_reads(spark, sf)), "n_reads")


@_query(o.CELLS, "SELECT a.cell_id AS cell_a, b.cell_id AS cell_b, count(*) / CAST(any_value(a.n) + any_value(b.n) - count(*) AS DOUBLE) AS jaccard FROM (SELECT *, count(*) OVER (PARTITION BY cell_id) AS n FROM filtered) a JOIN (SELECT *, count(*) OVER (PARTITION BY cell_id) AS n FROM filtered) b ON a.clone_id = b.clone_id AND a.cell_id < b.cell_id GROUP BY ALL")
def jaccard_pairs(spark, sf):
    return qc.jaccard_pairs(materialize(_filtered(spark, sf)))


_SPARSE = "SELECT a.cell_id AS cell_a, b.cell_id AS cell_b, count(*) / CAST(any_value(a.n) + any_value(b.n) - count(*) AS DOUBLE) AS jaccard FROM held2 a JOIN held2 b ON a.clone_id = b.clone_id GROUP BY ALL"


@_query([*o.CELLS, ("held2", "SELECT *, count(*) OVER (PARTITION BY cell_id) AS n FROM filtered")], _SPARSE)
def jaccard_matrix(spark, sf):
    return qc.jaccard_matrix(materialize(_filtered(spark, sf)))


_CUT = [
    ("o0", "SELECT u, v, u AS s, v AS t, regexp_matches(u, '[-0]') OR regexp_matches(v, '[-0]') AS cut FROM pairs"),
    ("o1", "SELECT u, v, cut, CASE WHEN cut THEN ltrim(s, '-0') ELSE s END AS s, t FROM o0"),
    ("o2", "SELECT u, v, cut, s, CASE WHEN cut THEN ltrim(CASE WHEN length(s) = 0 THEN t ELSE right(t, length(s)) END, '-0') ELSE t END AS t FROM o1"),
    ("o3", "SELECT u, v, cut, CASE WHEN cut THEN rtrim(CASE WHEN length(t) = 0 THEN s ELSE right(s, length(t)) END, '-0') ELSE s END AS s, t FROM o2"),
    ("o4", "SELECT u, v, cut, s, CASE WHEN cut THEN rtrim(left(t, length(s)), '-0') ELSE t END AS t FROM o3"),
    ("o5", "SELECT u, v, CASE WHEN cut THEN left(s, length(t)) ELSE s END AS s, t FROM o4"),
]


@_query([*o.CORRECTION, *_CUT], "SELECT u, v, s, t, CAST(hamming(s, t) AS BIGINT) AS distance FROM o5")
def overlap_distance(spark, sf):
    return qc.trimmed_overlap(materialize(ml.similar_pairs(materialize(_plain(spark, sf)), 20, 5)))


_DRAWN = "SELECT translate(substr(md5('7-' || CAST(i AS VARCHAR) || '-0'), 1, 30), '0123456789abcdef', 'ACGTACGTACGTACGT') AS id FROM range(2000) r(i)"


@_query([("drawn", _DRAWN)], "SELECT CAST(hamming(a.id, b.id) AS BIGINT) AS distance, count(*) AS n_pairs FROM drawn a JOIN drawn b ON a.id < b.id GROUP BY ALL")
def simulated_hamming_histogram(spark, sf):
    return qc.hamming_histogram(materialize(qc.simulated_ids(spark, 2000, 30, 7)))


@_query(o.MOLECULES, "SELECT avg(CAST(length(translate(clone_id, '-0', '')) = 30 AS INT)) AS share FROM molecules")
def full_length_share(spark, sf):
    return qc.full_length_share(_molecules(spark, sf))


@_query(o.graph(LOOSE), "SELECT u, v FROM e0 WHERE u IN (SELECT node_id FROM nodes WHERE n = 1) AND v IN (SELECT node_id FROM nodes WHERE n = 1)")
def induced_subgraph(spark, sf):
    graph, _ = _graph(spark, sf, LOOSE)
    return gr.induced_subgraph(graph.edges, graph.nodes.filter("n = 1"))


@_query(o.graph(LOOSE), "SELECT count(*) AS n_edges FROM e0")
def count_edges(spark, sf):
    return gr.count_edges(gr.both_ways(_graph(spark, sf, LOOSE)[0].edges))


@_query(o.graph(LOOSE), "SELECT node AS node_id, d AS degree FROM deg0")
def degrees(spark, sf):
    return gr.degrees(_graph(spark, sf, LOOSE)[0].edges)


@_query(o.graph(DEFAULT), "SELECT clone_nr, clone_id, n_cells, printf('%.2f', clone_ids_per_cell) AS shown FROM details")
def clone_details_text(spark, sf):
    return _details(spark, sf, DEFAULT).select("clone_nr", "clone_id", "n_cells", F.expr("format_number(clone_ids_per_cell, '0.00')").alias("shown"))


@_query(o.CORRECTION, "SELECT CAST(hamming(a.clone_id, b.clone_id) AS BIGINT) AS distance, count(*) AS n_pairs FROM (SELECT DISTINCT clone_id FROM corrected WHERE NOT regexp_matches(clone_id, '[-0]')) a JOIN (SELECT DISTINCT clone_id FROM corrected WHERE NOT regexp_matches(clone_id, '[-0]')) b ON a.clone_id < b.clone_id GROUP BY ALL")
def hamming_histogram(spark, sf):
    return qc.hamming_histogram(materialize(_corrected(spark, sf).select("clone_id").distinct()))


@_query([], "SELECT doc_id, kmer, count(*) AS n FROM (SELECT doc_id, substr(text, CAST(i AS BIGINT), 7) AS kmer FROM documents, unnest(range(1, length(text) - 5)) r(i)) WHERE length(kmer) = 7 GROUP BY ALL")
def text_kmers_all(spark, sf):
    """All k-mers of the documents with their counts."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return docs.select("doc_id", F.explode(sq.kmers(F.col("text"), 7)).alias("kmer")).groupBy("doc_id", "kmer").agg(F.count("*").alias("n"))
