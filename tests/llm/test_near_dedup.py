import re

import numpy as np
import pytest

from clonalis.llm import near_dedup as nd
from clonalis.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def union_find(pairs, nodes):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def brute(docs, percent=85):
    sets = {i: shingles(t) for i, t in docs}
    ids = sorted(sets)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    found = union_find(pairs, ids)
    return sorted((i, len(sets[i]), found[i], found[i] == i) for i in ids)


def corpus(seed, families, copies, changed):
    rng = np.random.default_rng(seed)
    word = lambda: "w%d" % rng.integers(0, 400)
    docs, i = [], 0
    for _ in range(families):
        base = [word() for _ in range(rng.integers(1, 160))]
        for _ in range(rng.integers(1, copies)):
            own = list(base)
            for _ in range(rng.integers(0, changed)):
                own[rng.integers(len(own))] = word()
            text = " ".join(own)
            docs.append((i, text.upper() if i % 7 == 0 else text.replace(" ", "\n", 2)))
            i += 1
    return docs


@pytest.mark.parametrize("seed,families,copies,changed,block", [(1, 40, 8, 4, 256), (2, 4, 60, 5, 16)])
def test_against_brute_force(spark, monkeypatch, seed, families, copies, changed, block):
    monkeypatch.setattr(nd, "BLOCK", block)
    docs = corpus(seed, families, copies, changed) + [(9000, None), (9001, ""), (9002, " \n"), (9003, "Five"), (9004, "five"), (9005, "one two three four")]
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, component_id int, id string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(d).collect())
    assert got == brute(docs)
    assert len({r[2] for r in got}) < len(got)
    kept = nd.drop_near_duplicates(d)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == [r[0] for r in got if r[3]]


def test_repeated_rows_nulls_and_empty_table(spark):
    d = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or -1), r.component_id, r.kept) for r in nd.near_duplicates(d).collect())
    assert [g for g in got if g[0] > 0] == [(1, 1, True), (1, 1, True), (2, 1, False)]
    assert [g[2] for g in got if g[0] < 0] == [True, True]
    assert nd.near_duplicates(d.limit(0)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [(2000, i) for i in range(2001, 2200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    assert got == union_find([e for e in edges if e[0] != e[1]], nodes)


def test_exact_sizes_in_slices():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 300, 200).astype(np.uint64)) for _ in range(9)]
    want = [[100 * len(set(a) & set(b)) >= 40 * len(set(a) | set(b)) for b in sets] for a in sets]
    assert nd._alike_sets(np.arange(9), [s.tobytes() for s in sets], 40).tolist() == want


def test_one_group_of_many_near_copies(spark):
    """5 000 variants of a text, of which few are near the smallest id's, and a chain that leads away from it."""
    base = [f"w{i}" for i in range(80)]
    texts = [" ".join([f"v{k}", *base, f"z{k}"]) for k in range(5000)]
    step = [" ".join(f"w{i}" for i in range(k, 80 + k)) for k in range(60)]  # each near the next only
    far = [" ".join(f"u{k}-{i}" for i in range(40)) for k in range(50)]
    docs = spark.createDataFrame(list(enumerate([*step, *texts, *far])), "doc_id long, text string")
    rows = {r.doc_id: r.component_id for r in nd.near_duplicates(docs).collect()}
    assert [rows[i] for i in range(5060)] == [0] * 5060 and all(rows[i] == i for i in range(5060, 5110))


def test_clashing_names_and_shared_ids(spark):
    long = " ".join(f"a{i}" for i in range(50))
    docs = spark.createDataFrame([(1, long, 0, 1), (2, long, 0, 2), (2, "other text", 0, 3), (3, long + " more", 0, 4), (None, long, 0, 5)], "doc_id long, text string, _gone int, kept int")
    got = nd.drop_near_duplicates(docs)
    assert got.columns == docs.columns and sorted(r.kept for r in got.collect()) == [1, 2, 3, 5]
