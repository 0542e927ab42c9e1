import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from clonalis.functions import sequences as sq
from clonalis.operators import molecules as ml
from clonalis.plans import catalogue


def plain_similar(s, t, overlap, most):
    known = [(a, b) for a, b in zip(s, t, strict=True) if a not in "-0" and b not in "-0"]
    return len(known) >= overlap and sum(a != b for a, b in known) <= most


PAIRS = [
    ("ACGTACGT", "ACGTACGT"), ("ACGTACGT", "ACGTACGA"), ("ACGTACGT", "ACGTACAA"), ("ACGTAC--", "--GTACGT"), ("ACGTA---", "--GTACGT"), ("A0GTACGT", "ACGTAC0T"),
    ("--------", "ACGTACGT"), ("ACNTACGT", "ACNTACGT"), ("ACNTACGT", "ACGTACGT"), ("acgtacgt", "acgtacga"), ("ACGTACGTR", "ACGTACGTY"), ("00000000", "--------"), ("", ""),
    ("ACGT" * 20, "ACGT" * 19 + "ACGA"),
]


def test_similarity(spark):
    rows = [(s, t) for s, t in PAIRS] + [(t, s) for s, t in PAIRS] + [(s.replace("-", "0"), t) for s, t in PAIRS]
    for overlap, most in ((5, 1), (0, 0), (20, 5)):
        d = spark.createDataFrame(rows, "s string, t string").select("s", "t", sq.is_similar(F.col("s"), F.col("t"), overlap, most).alias("x"))
        for r in d.collect():
            assert r.x == plain_similar(r.s, r.t, overlap, most), (r, overlap, most)


def test_unequal_lengths_are_an_error(spark):
    d = spark.createDataFrame([("ACG", "ACGT")], "s string, t string")
    with pytest.raises(Exception, match="unequal"):
        d.select(sq.is_similar(F.col("s"), F.col("t"), 1, 1)).collect()


def test_scalars(spark):
    texts = ["AAAAAA", "ACACAC", "ACGTAC", "A--C00", "NNacgt", "AAAAAC", "A", "ACGTACGTAC"]
    d = spark.createDataFrame([(t,) for t in texts], "c string")
    c = F.col("c")
    rows = d.select("c", sq.is_full(c).alias("full"), sq.trimmed(c).alias("trim"), sq.known_length(c).alias("n"), sq.entropy(c).alias("e"), sq.is_low_complexity(c).alias("low"), sq.kmers(c, 7).alias("k")).collect()
    for r in rows:
        t = r.c
        shares = [t.count(x) / len(t) for x in set(t)]
        e = -sum(p * math.log2(p) for p in shares)
        assert r.full == (not set(t) & set("-0")) and r.trim == t.replace("-", "").replace("0", "") and r.n == len(r.trim)
        assert abs(r.e - e) < 1e-12 and r.low == (e < 1.0 - 1e-12)
        assert r.k == [t[i : i + 7] for i in range(len(t) - 6)]
    assert not next(r for r in rows if r.c == "ACACAC").low


def consensus(seqs):
    if len(seqs) == 1:
        return seqs[0]
    out = ""
    for column in zip(*seqs, strict=True):
        import numpy as np

        weights = []
        for s in "ACGT-0":
            w = np.float16(0)
            for _ in range(column.count(s)):
                w = np.float16(w + np.float16(1 if s in "ACGT" else 0.1))
            weights.append(w)
        out += "ACGT-0"[int(np.argmax(weights))]
    return out


GROUPS = {
    "one": ["ACGTN-0"], "same": ["ACGNN-0"] * 3, "major": ["ACGTA", "ACGTA", "TCGTA"], "tie": ["ACGTA", "TCGTT"], "gaps": ["A----", "-----", "--0--"], "order": ["GATTA", "CATTA"],
    "n": ["NNA", "NNC"], "gap49": ["A"] * 5 + ["-"] * 49, "gap50": ["A"] * 5 + ["-"] * 50, "gap10": ["A"] + ["-"] * 10, "gap11": ["A"] + ["-"] * 11, "both": ["-"] * 30 + ["0"] * 40 + ["C"] * 3,
    "many": ["C"] * 300 + ["-"] * 3000,
}


def test_consensus(spark):
    rows = [("cell", name, s) for name, seqs in GROUPS.items() for s in seqs]
    got = {r.umi: (r.clone_id, r.read_count) for r in ml.compute_molecules(spark.createDataFrame(rows, "cell_id string, umi string, clone_id string")).collect()}
    for name, seqs in GROUPS.items():
        want = seqs[0] if len(set(seqs)) == 1 and "N" not in seqs[0] else consensus(seqs)
        assert got[name] == (want, len(seqs)), name


def test_gap_weights(spark):
    import numpy as np

    sums = [np.float16(0)]
    for _ in range(2500):
        sums.append(np.float16(sums[-1] + np.float16(0.1)))
    rows = spark.range(2501).select("id", ml.gap_weight(F.col("id")).alias("w")).collect()
    assert all(r.w == float(sums[r.id]) for r in rows)


def test_consensus_of_unequal_lengths(spark):
    d = spark.createDataFrame([("c", "u", "ACG"), ("c", "u", "ACGT")], "cell_id string, umi string, clone_id string")
    with pytest.raises(Exception, match="unequal"):
        ml.compute_molecules(d).collect()


def test_clusters_and_corrections(spark):
    base = "ACGTTGCAATCGGATCCTAGACTTGACGTA"
    near = [base, "T" + base[1:], base[:-1] + "C", base[:14] + "-" * 16, base[:20] + "-" * 10, "-" * 10 + base[10:]]
    other = "TTTTTGGGGGCCCCCAAAAATTTTTGGGGG"
    mols = [("c1", f"u{i}", s, 2) for i, s in enumerate(near)] + [("c2", "x", base, 2), ("c2", "y", other, 1)]
    d = spark.createDataFrame(mols, "cell_id string, umi string, clone_id string, read_count long")
    got = {(r.cell_id, r.umi): r.clone_id for r in ml.correct(d).collect()}
    assert {u: c for (cell, u), c in got.items() if cell == "c1"} == {f"u{i}": base if i != 3 else near[3] for i in range(6)}
    assert got["c2", "y"] == other
    per = {(r.cell_id, r.umi): r.clone_id for r in ml.correct_per_cell(d).collect()}
    assert per["c1", "u1"] == base and per["c1", "u4"] == base and per["c1", "u3"] == near[3] and per["c2", "y"] == other


def test_exclusion(spark):
    mols = [("c", str(i), s, 1) for i, s in enumerate(["ACGT", "ACGA", "AC--", "A0GT", "TTTT", "----"])]
    d = spark.createDataFrame(mols, "cell_id string, umi string, clone_id string, read_count long")

    def left(entries):
        e = spark.createDataFrame([(x,) for x in entries], "clone_id string")
        return sorted(r.clone_id for r in ml.exclude(d, e).collect())

    assert left(["ACGT"]) == ["ACGA", "TTTT"]
    assert left(["T---"]) == sorted(["ACGT", "ACGA", "AC--", "A0GT"])
    assert left([]) == sorted(m[2] for m in mols)


def test_all_kmers_against_brute_force(spark, tmp_path):
    docs = [(1, "abcabcabcabc"), (2, "short"), (3, ""), (4, None), (5, "é abcdefg abcdefg"), (6, "1234567")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for i, text in docs:
        for k in range(len(text or "") - 6):
            want[i, text[k : k + 7]] = want.get((i, text[k : k + 7]), 0) + 1
    got = catalogue.QUERIES["text_kmers_all"](spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.kmer): r.n for r in got} == want and len(got) == len(want) and 1 in want.values()


def test_molecules_that_go_on_in_the_next_batch(spark):
    rng = np.random.default_rng(5)
    rows = [("c1", "u1", "".join(rng.choice(list("ACGT-0N"), 12))) for _ in range(40)] + [("c1", "u2", "ACGT")] * 3 + [("c1", None, "NCGé"), ("c1", None, "NCGT"), ("c2", "u1", None), (None, "u1", "ACGT")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = {(r.cell_id, r.umi): (r.clone_id, r.read_count) for r in ml.compute_molecules(spark.createDataFrame(rows, "cell_id string, umi string, clone_id string")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {("c1", "u1"): (consensus([r[2] for r in rows[:40]]), 40), ("c1", "u2"): ("ACGT", 3), ("c1", None): ("ACGT", 2), ("c2", "u1"): (None, 1), (None, "u1"): ("ACGT", 1)}


def test_similar_pairs_of_many_masks_against_brute_force(spark):
    rng = np.random.default_rng(9)
    ids = set()
    for _ in range(40):
        base = rng.choice(list("ACGT"), 30)
        for _ in range(8):
            own = base.copy()
            own[rng.choice(30, rng.integers(0, 7), replace=False)] = rng.choice(list("ACGTN"))
            cut = int(rng.integers(0, 11))
            if cut % 3 == 1:
                own[:cut] = "-"
            elif cut % 3 == 2:
                own[30 - cut :] = "-"
            own[2] = "0" if rng.random() < 0.2 else own[2]
            ids.add("".join(own))
    ids.add("Z" + "ACGTTGCAATCGGATCCTAGACTTGACGT")
    ids.add("ACGTTGCAATCGGATCCTAGACTTGACGTA")
    words = {i: {i[x : x + 7] for x in range(24)} for i in ids}
    known = lambda a, b: [(x, y) for x, y in zip(a, b) if x not in "-0" and y not in "-0"]
    want = {(a, b) for a in ids for b in ids if a < b and words[a] & words[b] and len(known(a, b)) >= 20 and sum(x != y for x, y in known(a, b)) <= 5}
    rows = ml.similar_pairs(spark.createDataFrame([(i,) for i in sorted(ids)], "clone_id string"), 20, 5).collect()
    assert {(r.u, r.v) for r in rows} == want and len(rows) == len(want) and len(want) > 300


def test_similar_pairs_compare_few_ids(spark):
    """IDs without links are found to have none by few comparisons: a k-mer join meets 200 times as many pairs."""
    rng = np.random.default_rng(3)
    ids = spark.createDataFrame([("".join(x),) for x in rng.choice(list("ACGT"), (300, 30))], "clone_id string")
    plan = ml.similar_pairs(ids, 20, 5)._jdf.queryExecution().toString()
    assert "kmer" not in plan and ml.similar_pairs(ids, 20, 5).count() == 0


def test_molecules_are_shuffled_once(spark):
    reads = spark.createDataFrame([("c", "u", "ACGT")] * 3, "cell_id string, umi string, clone_id string")
    plan = ml.compute_molecules(reads)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "HashAggregate" not in plan
