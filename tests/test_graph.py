import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from clonalis.operators import cells as cl
from clonalis.operators import clones as cn
from clonalis.operators import components as cc
from clonalis.operators import graph as gr
from clonalis.operators import molecules as ml
from clonalis.operators import quality as qc
from clonalis.operators.components import connected_components
from clonalis.plans import catalogue

#: Two triangles held together by an edge, and a path.
EDGES = [("K", "L"), ("L", "M"), ("K", "M"), ("M", "N"), ("N", "P"), ("P", "Q"), ("N", "Q"), ("R", "S"), ("S", "T")]


def edge_frame(spark, edges):
    return spark.createDataFrame([tuple(sorted(e)) for e in edges], "u string, v string")


def plain_components(nodes, edges):
    left, out = set(nodes), {}
    near = {n: set() for n in nodes}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    while left:
        todo = [min(left)]
        name = todo[0]
        while todo:
            n = todo.pop()
            if n in left:
                left.remove(n)
                out[n] = name
                todo += near[n]
    return out


def plain_bridges(nodes, edges):
    near = {n: {b for a, b in edges if a == n} | {a for a, b in edges if b == n} for n in nodes}
    return {tuple(sorted(e)) for e in edges if not near[e[0]] & near[e[1]] and (len(near[e[0]]) > 1 or len(near[e[1]]) > 1)}


def plain_cuts(nodes, edges):
    near = {n: {b for a, b in edges if a == n} | {a for a, b in edges if b == n} for n in nodes}
    out = set()
    for n in nodes:
        own = [e for e in edges if e[0] in near[n] and e[1] in near[n]]
        if len(near[n]) > 1 and len(set(plain_components(near[n], own).values())) > 1:
            out.add(n)
    return out


def test_small_graph(spark):
    e = edge_frame(spark, EDGES)
    assert {tuple(r) for r in gr.bridges(e).collect()} == {("M", "N"), ("R", "S"), ("S", "T")}
    assert sorted(r[0] for r in gr.local_cut_vertices(e).collect()) == ["M", "N", "S"]
    assert gr.count_edges(e.unionByName(edge_frame(spark, [("S", "T")]))).first()[0] == 9
    assert {tuple(r) for r in gr.induced_subgraph(e, spark.createDataFrame([("K",), ("L",), ("M",), ("N",), ("R",)], "node_id string")).collect()} == {("K", "L"), ("K", "M"), ("L", "M"), ("M", "N")}


@pytest.mark.parametrize("seed,n,p", [(1, 25, 0.12), (2, 18, 0.3)])
def test_against_plain_versions(spark, seed, n, p):
    rng = np.random.default_rng(seed)
    nodes = [f"n{i:02d}" for i in range(n)]
    edges = [e for e in itertools.combinations(nodes, 2) if rng.random() < p]
    e = edge_frame(spark, edges)
    assert {tuple(r) for r in gr.bridges(e).collect()} == plain_bridges(nodes, edges)
    assert {r[0] for r in gr.local_cut_vertices(e).collect()} == plain_cuts(nodes, edges)
    touched = {x for e_ in edges for x in e_}
    want = {k: v for k, v in plain_components(nodes, edges).items() if k in touched}
    assert {r.node: r.component for r in connected_components(e).collect()} == want
    assert {r.node: r.component for r in connected_components(e, limit=0).collect()} == want


def test_components_of_dealt_edges_need_no_rounds(spark, monkeypatch):
    rng, written, write = np.random.default_rng(4), [], cc.materialize
    monkeypatch.setattr(cc, "materialize", lambda df: written.append(write(df)) or written[-1])
    at = rng.permutation(300).tolist()
    edges = [(f"n{a:03d}", f"n{b:03d}") for a, b in zip(at[:-1], at[1:], strict=True) if a % 29]
    e = spark.createDataFrame([edges[k] for k in rng.permutation(len(edges))] + [("x", "x"), ("x", None)], "u string, v string").repartition(4)
    want = plain_components({x for p in edges for x in p}, edges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert {r.node: r.component for r in connected_components(e).collect()} == want
        assert len(written) <= 2
        got = connected_components(e, limit=40).collect()
        assert {r.node: r.component for r in got} == want and len(got) == len(want)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    longs = spark.createDataFrame([(12, 5), (5, 100), (7, 8)], "u long, v long").repartition(3)
    assert {r.node: r.component for r in connected_components(longs).collect()} == {12: 5, 5: 5, 100: 5, 7: 7, 8: 7}


def cell_frame(spark, sets):
    rows = [(c, i, n, k + 1) for c, own in sets.items() for k, (i, n) in enumerate(own.items())]
    return spark.createDataFrame(rows, "cell_id string, clone_id string, count long, ord long")


@pytest.mark.parametrize("threshold", [0.0, 0.3, 0.5, 0.7])
def test_nodes_and_edges(spark, threshold):
    rng = np.random.default_rng(7)
    sets = {f"c{i:03d}": {f"id{k}": int(rng.integers(1, 5)) for k in rng.choice(8, rng.integers(1, 6), replace=False)} for i in range(60)}
    nodes, members = gr.make_nodes(cell_frame(spark, sets))
    groups = {}
    for c, own in sets.items():
        groups.setdefault(frozenset(own), []).append(c)
    assert {(r.node_id, r.n, frozenset(r.clone_ids)) for r in nodes.collect()} == {(min(c), len(c), s) for s, c in groups.items()}
    assert {tuple(r) for r in members.collect()} == {(c, min(own)) for own in groups.values() for c in own}
    want = {tuple(sorted((min(groups[a]), min(groups[b])))) for a, b in itertools.combinations(groups, 2) if len(a & b) / len(a | b) > threshold}
    got = gr.jaccard_edges(nodes, threshold).collect()
    assert {(r.u, r.v) for r in got} == want and len(got) == len(want)
    with pytest.raises(ValueError):
        gr.jaccard_edges(nodes, -0.1)


def test_pruning_clones_and_density(spark):
    ring = {"a1": {"x": 3, "y": 1}, "a2": {"x": 2, "y": 2, "z": 1}, "a3": {"x": 1, "y": 1, "z": 1, "w": 1}, "d": {"x": 1, "y": 1, "p": 1, "q": 1}, "b1": {"p": 2, "q": 2}, "b2": {"p": 1, "q": 1, "r": 1}, "e": {"k": 9}, "f": {"k": 1}}
    cells = cell_frame(spark, ring)
    graph = gr.make_graph(cells, 0.3)
    pruned, gone = gr.prune(graph)
    nodes = [r.node_id for r in graph.nodes.collect()]
    edges = [tuple(r) for r in graph.edges.collect()]
    assert {tuple(r) for r in gone["bridges_1"].collect()} == plain_bridges(nodes, edges)
    doublets = {r[0] for k in (1, 2) for r in gone[f"doublets_{k}"].collect()}
    assert "d" in doublets
    clones, details = cn.clone_table(pruned, cells)
    found = {}
    for r in clones.collect():
        found.setdefault(r.clone_nr, set()).add(r.cell_id)
    assert {"e", "f"} in found.values() and not any({"a1", "b1"} <= s for s in found.values())
    rows = sorted(details.collect(), key=lambda r: r.clone_nr)
    assert [r.clone_id for r in rows] == sorted(r.clone_id for r in rows)
    assert next(r for r in rows if r.clone_id == "k").clone_ids_per_cell == 1.0
    assert {r.size: r.n_clones for r in cn.clone_size_histogram(details).collect()}[2] >= 1
    assert sorted(r.n_cells for r in cn.sizes(pruned).collect()) == sorted(r.n_cells for r in rows)
    density = {r.component: r for r in gr.component_density(graph).collect()}
    assert density["e"].n_cells == 2 and density["e"].n_edges == 1 and density["e"].complete
    assert not density["a1"].complete


def test_filters(spark):
    cells = spark.createDataFrame([("a", "x", 5, 1), ("b", "x", 1, 1), ("c", "y", 1, 1), ("d", "z", 1, 1), ("e", "w", 2, 1)], "cell_id string, clone_id string, count long, ord long")
    mols = spark.createDataFrame([("q", "u", "y", 1), ("d", "u", "z", 3), ("b", "u", "x", 1)], "cell_id string, umi string, clone_id string, read_count long")
    left = lambda d: sorted(r.cell_id for r in d.collect())
    assert left(cl.filter_cells(cells, mols)) == ["a", "d", "e"]
    assert left(cl.filter_cells(cells, mols, discard_single_reads=False)) == ["a", "c", "d", "e"]
    assert left(cl.filter_cells(cells, mols, discard_cross_contamination=False)) == ["a", "d", "e"]
    assert left(cl.filter_cells(cells, mols, False, False)) == ["a", "b", "c", "d", "e"]
    assert left(cl.filter_visium(cells, mols)) == ["a", "c", "d", "e"]
    assert left(cl.filter_smartseq2(cells)) == ["a", "e"]


def test_quality_tables(spark):
    mols = spark.createDataFrame([("a", "1", "ACGT"), ("a", "2", "ACGA"), ("b", None, "AC--"), ("b", "3", "TTTT")], "cell_id string, umi string, clone_id string")
    assert {r.cell_id: r.n_molecules for r in qc.molecules_per(mols, "cell_id").collect()} == {"a": 2, "b": 1}
    assert {r.n_nucleotides: r.n_molecules for r in qc.nucleotides_per_molecule(mols).collect()} == {4: 3, 2: 1}
    assert {r.distance: r.n_pairs for r in qc.hamming_histogram(mols).collect()} == {1: 1, 3: 1, 4: 1}
    row = qc.summary(spark.createDataFrame([(1,), (2,), (4,), (8,)], "x long"), "x").first()
    assert tuple(row) == (4, 3.75, 1.75, 3.0, 5.0, 1)
    cells = cell_frame(spark, {"a": {"x": 1, "y": 1}, "b": {"x": 1}, "c": {"z": 1}})
    assert {(r.cell_a, r.cell_b): r.jaccard for r in qc.jaccard_pairs(cells).collect()} == {("a", "b"): 0.5}
    assert cl.top_clone_ids(cells, 1).filter(F.col("cell_id") == "a").first().clone_id == "y"


def test_matrix_query_holds_all_filtered_cells(spark):
    sf = "/root/testdata/sf0.001"
    found = catalogue.QUERIES["umi_matrix_all_cells"](spark, sf)
    want = {(r.clone_id, r.cell_id): r["count"] for r in catalogue.QUERIES["umi_matrix_long"](spark, sf).collect()}
    cells = sorted({c for _, c in want})
    assert len(cells) > 3 and found.columns == ["clone_id", *cells]
    rows = {r[0]: list(r)[1:] for r in found.collect()}
    assert rows == {i: [want.get((i, c), 0) for c in cells] for i in {i for i, _ in want}}


def test_matrix_is_filled_up_after_the_shuffles(spark, monkeypatch):
    monkeypatch.setattr(cl, "_BATCH_VALUES", 1000, raising=False)
    monkeypatch.setattr(cl, "_TASK_VALUES", 4000, raising=False)
    held = [(f"c{k:03}", f"i{k * m % 31:02}", k % 5 + m) for k in range(300) for m in (1, 2)] + [("c300", "i00", None), ("c301", None, 7)]
    cells = spark.createDataFrame(held, "cell_id string, clone_id string, count long")
    found = cl.count_matrix(cells)
    assert "pivotfirst" not in found._jdf.queryExecution().executedPlan().toString().lower()
    want = {}
    for cell, i, n in held:
        want[i, cell] = want.get((i, cell), 0) + (n or 0)
    names = sorted({h[0] for h in held})
    assert found.columns == ["clone_id", *names] and {t for _, t in found.dtypes[1:]} == {"bigint"}
    rows = found.collect()
    assert len(rows) == 32 and {r[0]: list(r)[1:] for r in rows} == {i: [want.get((i, c), 0) for c in names] for i in {h[1] for h in held}}
    none = cl.count_matrix(cells.limit(0))
    assert none.columns == ["clone_id"] and none.collect() == []


def test_matrix_and_its_order(spark):
    sets = {f"c{i}": {x: 1 for x in own} for i, own in enumerate(["ab", "ab", "bc", "cd", "z", "a"])}
    matrix = qc.jaccard_matrix(cell_frame(spark, sets))
    got = {(r.cell_a, r.cell_b): r.jaccard for r in matrix.collect()}
    for a, b in itertools.product(sets, repeat=2):
        want = len(sets[a].keys() & sets[b].keys()) / len(sets[a].keys() | sets[b].keys())
        assert got.get((a, b), 0) == want and ((a, b) in got) == (want > 0)
    order = qc.matrix_order(matrix)
    assert sorted(order) == sorted(sets)
    place = {c: k for k, c in enumerate(order)}
    assert max(abs(place[a] - place[b]) for a, b in got) <= 3
    v = spark.sql("select array(true, false) a, array(true, true) b, array(false, false) z")
    half, none = v.select(qc.vector_jaccard(F.col("a"), F.col("b")), qc.vector_jaccard(F.col("z"), F.col("z"))).first()
    assert half == 0.5 and none != none


def test_simulated_ids(spark):
    got = [r[0] for r in qc.simulated_ids(spark, 60, 3, 5).collect()]
    assert len(got) == len(set(got)) == 60 and all(len(x) == 3 and set(x) <= set("ACGT") for x in got)
    assert sorted(got) == sorted(r[0] for r in qc.simulated_ids(spark, 60, 3, 5).collect())
    with pytest.raises(ValueError):
        qc.simulated_ids(spark, 65, 3)


def plain_trim(s, t):
    if set("-0") & set(s + t):
        s = s.lstrip("-0")
        t = (t[len(t) - len(s) :] if 0 < len(s) <= len(t) else t).lstrip("-0")
        s = (s[len(s) - len(t) :] if 0 < len(t) <= len(s) else s).rstrip("-0")
        t = t[: len(s)].rstrip("-0")
        s = s[: len(t)]
    return s, t


def test_trimmed_overlap(spark):
    rng = np.random.default_rng(3)
    rows = [tuple("".join(rng.choice(list("ACGT--00"), 8)) for _ in range(2)) for _ in range(200)] + [("ACGT----", "--------"), ("ACGTACGT", "ACGAACGT")]
    wanted = [(u, v, *plain_trim(u, v)) for u, v in rows]
    same = [w for w in wanted if len(w[2]) == len(w[3])]
    got = qc.trimmed_overlap(spark.createDataFrame([w[:2] for w in same], "u string, v string")).collect()
    assert sorted((r.u, r.v, r.s, r.t, r.distance) for r in got) == sorted((*w, sum(a != b for a, b in zip(w[2], w[3], strict=True))) for w in same) and len(same) > 150


@pytest.mark.parametrize("width,letters", [(6, "ACGT"), (6, "ACGTN"), (40, "ACGT"), (6, "ACGTx")])
def test_histogram_of_all_pairs_against_brute_force(spark, width, letters):
    rng = np.random.default_rng(width)
    ids = sorted({"".join(x) for x in rng.choice(list(letters), (71, width))})
    want = {}
    for a, b in itertools.combinations(ids, 2):
        d = sum(x != y for x, y in zip(a, b, strict=True))
        want[d] = want.get(d, 0) + 1
    got = qc.hamming_histogram(spark.createDataFrame([(i,) for i in [*ids, ids[0], "A" * (width - 1) + "-"]], "clone_id string")).collect()
    assert {r.distance: r.n_pairs for r in got} == want and len(got) == len(want)


def test_histogram_of_unequal_lengths(spark):
    with pytest.raises(Exception, match="unequal"):
        qc.hamming_histogram(spark.createDataFrame([("ACG",), ("ACGT",)], "clone_id string")).collect()


def test_correction_counts_the_molecules_once(spark):
    mols = spark.createDataFrame([("a", str(i), "ACGTACGTTGCAACGTTGCATTAGGCATCA"[:29] + "AAC"[i], 1) for i in range(3)], "cell_id string, umi string, clone_id string, read_count long")
    found = ml.correction_map(mols)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "LocalRelation" not in plan
    assert [tuple(r) for r in found.collect()] == [("ACGTACGTTGCAACGTTGCATTAGGCATCC", "ACGTACGTTGCAACGTTGCATTAGGCATCA")]


def test_places_of_cells_are_found_once(spark):
    cells = spark.createDataFrame([("a", "x", 2, 1), ("b", "x", 2, 1), ("c", "y", 1, 1)], "cell_id string, clone_id string, count long, ord long")
    clones, details = cn.clone_table(gr.make_graph(cells), cells)
    assert "collect_set" not in clones._jdf.queryExecution().optimizedPlan().toString() + details._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, clones.collect())) == [(1, "a"), (1, "b"), (2, "c")]
