"""What the catalogue's queries must return, as SQL built from common table expressions."""

from __future__ import annotations

from .derived import ALIGNMENT_CTES, CTES

_SPAN = "range(1, 31) r(i)"
_KNOWN = "length(translate({c}, '-0', ''))"
_BOTH = "substr({a}, i, 1) NOT IN ('-', '0') AND substr({b}, i, 1) NOT IN ('-', '0')"
_OVERLAP = "len(list_filter(range(1, 31), lambda i: " + _BOTH + "))"
_DIFFER = "len(list_filter(range(1, 31), lambda i: " + _BOTH + " AND substr({a}, i, 1) <> substr({b}, i, 1)))"
_ENTROPY = (
    "-list_sum(list_transform(list_sort(list_distinct(string_split({c}, ''))), lambda x: "
    "((length({c}) - length(replace({c}, x, ''))) / length({c})::DOUBLE) * log2((length({c}) - length(replace({c}, x, ''))) / length({c})::DOUBLE)))"
)


def similar(a: str, b: str, overlap: int = 20, most: int = 5) -> str:
    return f"({_OVERLAP.format(a=a, b=b)} >= {overlap} AND {_DIFFER.format(a=a, b=b)} <= {most})"


def reach(name: str, nodes: str, edges: str) -> list[tuple[str, str]]:
    """Components: name(node, component) of the nodes (column id) and edges (u, v)."""
    return [
        (f"{name}_sym", f"SELECT u, v FROM {edges} UNION SELECT v, u FROM {edges}"),
        (f"{name}_walk(node, here)", f"SELECT id, id FROM {nodes} UNION SELECT w.node, s.v FROM {name}_walk w JOIN {name}_sym s ON w.here = s.u"),
        (name, f"SELECT node, min(here) AS component FROM {name}_walk GROUP BY node"),
    ]


MOLECULES = [
    *CTES,
    ("dist", "SELECT cell_id, umi, clone_id, count(*) AS n FROM reads GROUP BY ALL"),
    ("grp", "SELECT cell_id, umi, CAST(sum(n) AS BIGINT) AS read_count, count(*) AS k, min(clone_id) AS one FROM dist GROUP BY ALL"),
    ("posn", f"SELECT cell_id, umi, i, substr(clone_id, i, 1) AS ch, sum(n) AS c FROM dist JOIN grp USING (cell_id, umi), {_SPAN} WHERE k > 1 GROUP BY ALL"),
    ("best", "SELECT cell_id, umi, i, ch FROM posn QUALIFY row_number() OVER (PARTITION BY cell_id, umi, i ORDER BY CASE WHEN ch IN ('-', '0') THEN c ELSE 10 * c END DESC, strpos('ACGT-0', ch)) = 1"),
    ("cons", "SELECT cell_id, umi, string_agg(ch, '' ORDER BY i) AS clone_id FROM best GROUP BY ALL"),
    ("molecules", "SELECT grp.cell_id, grp.umi, coalesce(cons.clone_id, grp.one) AS clone_id, read_count FROM grp LEFT JOIN cons USING (cell_id, umi)"),
]
CORRECTION = [
    *MOLECULES,
    ("complex_ids", "SELECT DISTINCT clone_id FROM molecules WHERE " + _ENTROPY.format(c="clone_id") + " >= 1.0"),
    ("mols", "SELECT m.* FROM molecules m JOIN complex_ids USING (clone_id)"),
    ("ids", "SELECT clone_id, count(*) AS n FROM mols GROUP BY ALL"),
    ("long_ids", "SELECT clone_id AS id FROM ids WHERE " + _KNOWN.format(c="clone_id") + " >= 20"),
    ("words", "SELECT DISTINCT id, substr(id, i, 7) AS kmer FROM long_ids, range(1, 25) r(i)"),
    ("cands", "SELECT DISTINCT a.id AS u, b.id AS v FROM words a JOIN words b ON a.kmer = b.kmer AND a.id < b.id"),
    ("pairs", "SELECT u, v FROM cands WHERE " + similar("u", "v")),
    *reach("clusters", "long_ids", "pairs"),
    ("reps", "SELECT component, arg_max(clone_id, (n, clone_id)) AS representative FROM clusters JOIN ids ON node = clone_id GROUP BY ALL"),
    ("cmap", "SELECT node AS clone_id, representative FROM clusters JOIN reps USING (component) WHERE node <> representative"),
    ("corrected", "SELECT m.cell_id, m.umi, m.clone_id AS original_clone_id, coalesce(representative, m.clone_id) AS clone_id, read_count FROM mols m LEFT JOIN cmap USING (clone_id)"),
]
PER_CELL = [
    *CORRECTION,
    ("own_ids", "SELECT DISTINCT cell_id, clone_id FROM mols"),
    ("own_nodes", "SELECT (cell_id || chr(9) || clone_id) AS id FROM own_ids"),
    ("own_pairs", "SELECT a.cell_id || chr(9) || a.clone_id AS u, b.cell_id || chr(9) || b.clone_id AS v FROM own_ids a JOIN own_ids b ON a.cell_id = b.cell_id AND a.clone_id < b.clone_id WHERE " + similar("a.clone_id", "b.clone_id")),
    *reach("own_cc", "own_nodes", "own_pairs"),
    ("own_in", "SELECT component, string_split(node, chr(9))[1] AS cell_id, string_split(node, chr(9))[2] AS clone_id FROM own_cc"),
    ("own_reps", "SELECT component, arg_max(clone_id, (" + _KNOWN.format(c="clone_id") + ", n, clone_id)) AS representative FROM own_in JOIN ids USING (clone_id) GROUP BY ALL"),
    ("own_map", "SELECT cell_id, clone_id, representative FROM own_in JOIN own_reps USING (component) WHERE clone_id <> representative"),
]
EXCLUSION = [
    *CORRECTION,
    ("entries", "SELECT DISTINCT clone_id AS entry FROM corrected WHERE clone_id LIKE 'A%' AND NOT regexp_matches(clone_id, '[-0]') UNION SELECT DISTINCT substr(clone_id, 1, 14) || repeat('-', 16) FROM corrected WHERE clone_id LIKE 'CG%'"),
    (
        "gone",
        "SELECT DISTINCT c.clone_id FROM (SELECT DISTINCT clone_id FROM corrected) c JOIN entries e ON c.clone_id = e.entry "
        "OR ((regexp_matches(e.entry, '[-0]') OR regexp_matches(c.clone_id, '[-0]')) AND " + _DIFFER.format(a="c.clone_id", b="e.entry") + " = 0)",
    ),
]
CELLS = [
    *CORRECTION,
    ("counted", "SELECT cell_id, clone_id, count(*) AS count, min((original_clone_id, umi)) AS first FROM corrected WHERE " + _KNOWN.format(c="clone_id") + " >= 20 GROUP BY ALL"),
    ("cells", "SELECT cell_id, clone_id, count, row_number() OVER (PARTITION BY cell_id ORDER BY length(clone_id) - length(translate(clone_id, '-', '')), count DESC, first, clone_id) AS ord FROM counted"),
    ("overall", "SELECT clone_id, sum(count) AS total FROM cells GROUP BY ALL"),
    ("single", "SELECT DISTINCT clone_id AS single FROM corrected WHERE read_count = 1"),
    ("judged", "SELECT cells.*, total, single IS NOT NULL AS weak FROM cells JOIN overall USING (clone_id) LEFT JOIN single ON clone_id = single"),
    ("filtered", "SELECT cell_id, clone_id, count, ord FROM judged WHERE NOT (count <= 1 AND (total > 1 OR weak))"),
]


def graph(threshold: float) -> list[tuple[str, str]]:
    """Nodes, members, edges e0; after bridges e1; doublets d1; e2; bridges b2; e3; doublets d2; e4."""
    def bridge(k: int) -> list[tuple[str, str]]:
        return [
            (f"s{k}", f"SELECT u, v FROM e{k} UNION ALL SELECT v, u FROM e{k}"),
            (f"deg{k}", f"SELECT u AS node, count(*) AS d FROM s{k} GROUP BY ALL"),
            (f"tri{k}", f"SELECT e.u, e.v, a.v AS w FROM e{k} e JOIN s{k} a ON a.u = e.u JOIN s{k} b ON b.u = e.v AND b.v = a.v"),
        ]

    def bridges(k: int) -> tuple[str, str]:
        return (f"b{k}", f"SELECT e.u, e.v FROM e{k} e JOIN deg{k} x ON x.node = e.u JOIN deg{k} y ON y.node = e.v WHERE (x.d > 1 OR y.d > 1) AND NOT EXISTS (SELECT 1 FROM tri{k} t WHERE t.u = e.u AND t.v = e.v)")

    def cut(k: int) -> list[tuple[str, str]]:
        return [
            (f"near{k}", f"SELECT u || chr(9) || v AS id FROM s{k}"),
            (f"ring{k}", f"SELECT DISTINCT w || chr(9) || u AS u, w || chr(9) || v AS v FROM tri{k}"),
            *reach(f"part{k}", f"near{k}", f"ring{k}"),
            (f"cut{k}", f"SELECT string_split(node, chr(9))[1] AS node_id FROM part{k} GROUP BY ALL HAVING count(DISTINCT component) > 1"),
            (f"d{k}", f"SELECT node_id FROM cut{k} JOIN nodes USING (node_id) WHERE n = 1"),
        ]

    return [
        *CELLS,
        ("sets", "SELECT cell_id, list_sort(list(DISTINCT clone_id)) AS clone_ids FROM filtered GROUP BY ALL"),
        ("nodes", "SELECT min(cell_id) AS node_id, count(*) AS n, clone_ids FROM sets GROUP BY clone_ids"),
        ("members", "SELECT cell_id, node_id FROM sets JOIN nodes USING (clone_ids)"),
        ("held", "SELECT node_id, unnest(clone_ids) AS item, len(clone_ids) AS size FROM nodes"),
        ("meet", "SELECT a.node_id AS u, b.node_id AS v, count(*) AS common, any_value(a.size) AS na, any_value(b.size) AS nb FROM held a JOIN held b ON a.item = b.item AND a.node_id < b.node_id GROUP BY ALL"),
        ("jac", "SELECT u, v, common / CAST(na + nb - common AS DOUBLE) AS jaccard FROM meet"),
        ("e0", f"SELECT u, v FROM jac WHERE jaccard > CAST({threshold} AS DOUBLE)"),
        *bridge(0), bridges(0),
        ("e1", "SELECT u, v FROM e0 EXCEPT SELECT u, v FROM b0"),
        *bridge(1), *cut(1),
        ("e2", "SELECT u, v FROM e1 WHERE u NOT IN (SELECT node_id FROM d1) AND v NOT IN (SELECT node_id FROM d1)"),
        *bridge(2), bridges(2),
        ("e3", "SELECT u, v FROM e2 EXCEPT SELECT u, v FROM b2"),
        *bridge(3), *cut(3),
        ("e4", "SELECT u, v FROM e3 WHERE u NOT IN (SELECT node_id FROM d3) AND v NOT IN (SELECT node_id FROM d3)"),
        ("nodes4", "SELECT * FROM nodes WHERE node_id NOT IN (SELECT node_id FROM d1 UNION SELECT node_id FROM d3)"),
        ("ids0", "SELECT node_id AS id FROM nodes"),
        ("ids4", "SELECT node_id AS id FROM nodes4"),
        *reach("comp0", "ids0", "e0"),
        *reach("comp1", "ids0", "e1"),
        *reach("comp4", "ids4", "e4"),
        ("placed", "SELECT cell_id, component FROM members JOIN comp4 ON node = node_id"),
        ("sums", "SELECT component, clone_id, sum(count) AS total, count(*) AS pairs FROM filtered JOIN placed USING (cell_id) GROUP BY ALL"),
        ("named", "SELECT component, arg_max(clone_id, (total, clone_id)) AS clone_id, CAST(sum(pairs) AS BIGINT) AS pairs FROM sums GROUP BY ALL"),
        ("sized", "SELECT component, count(*) AS n_cells, min(cell_id) AS first_cell FROM placed GROUP BY ALL"),
        ("numbered", "SELECT *, row_number() OVER (ORDER BY clone_id, first_cell) AS clone_nr FROM named JOIN sized USING (component)"),
        ("clones", "SELECT clone_nr, cell_id FROM placed JOIN numbered USING (component)"),
        ("details", "SELECT clone_nr, clone_id, n_cells, pairs / CAST(n_cells AS DOUBLE) AS clone_ids_per_cell FROM numbered"),
    ]


def density(k: int) -> str:
    return (
        f"SELECT component, CAST(any_value(n_cells) AS BIGINT) AS n_cells, CAST(any_value(own) + coalesce(sum(a.n * b.n), 0) AS BIGINT) AS n_edges, CAST(any_value(possible) AS BIGINT) AS possible_edges, "
        f"any_value(own) + coalesce(sum(a.n * b.n), 0) = any_value(possible) AS complete FROM (SELECT component, sum(n) AS n_cells, sum(n * (n - 1) // 2) AS own, (sum(n) * (sum(n) - 1)) // 2 AS possible "
        f"FROM comp{k} JOIN nodes ON node = node_id GROUP BY ALL) c LEFT JOIN (SELECT component, u, v FROM e{k} JOIN comp{k} ON node = u) e USING (component) LEFT JOIN nodes a ON a.node_id = e.u LEFT JOIN nodes b ON b.node_id = e.v GROUP BY component"
    )


def sql(ctes: list[tuple[str, str]], final: str) -> str:
    if not ctes:
        return final
    return "WITH RECURSIVE " + ",\n".join(f"{name} AS ({text})" for name, text in ctes) + "\n" + final


_AT = "a + b + c + d + (r - pos - b - d - e)"
#: Alignments near the span of positions 100 to 129, and the base of each over each position.
ALIGNMENTS = [
    *ALIGNMENT_CTES,
    ("near", "SELECT *, row_number() OVER () AS id, length(seq) AS n FROM alignments WHERE rname = 'chrX' AND pos < 140 AND pos + b + d + e + f > 90"),
    (
        "over_span",
        "SELECT id, r, CASE WHEN r < pos - a THEN '-' WHEN r < pos + b THEN substr(seq, CAST(a + r - pos + 1 AS BIGINT), 1) WHEN r < pos + b + d THEN substr(seq, CAST(a + c + r - pos + 1 AS BIGINT), 1) "
        f"WHEN r < pos + b + d + e THEN '0' WHEN r < pos + b + d + e + f + g THEN substr(seq, CAST({_AT} + 1 AS BIGINT), 1) ELSE '-' END AS ch FROM near, range(100, 130) t(r) WHERE cb IS NOT NULL AND ub <> ''",
    ),
    ("cloned", "SELECT id, string_agg(ch, '' ORDER BY r) AS clone_id FROM over_span GROUP BY id HAVING count_if(ch NOT IN ('-', '0')) > 0"),
]
