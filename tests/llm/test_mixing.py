import re

import pytest

from clonalis.llm import mixing

SF = "/root/testdata/sf0.01"


def fill(sizes, weights, share, cap):
    """Round by round: deal out, clamp, deal the excess out again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in capped)
        open_ = [s for s in names if s not in capped]
        target = {s: cap * sizes[s] for s in capped} | {s: rest * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if target[s] > cap * sizes[s] + 1e-9}
        if not over:
            return target
        capped |= over


CASES = [
    {"a": 100, "b": 100, "c": 100, "d": 1000}, {"a": 5}, {"a": 10, None: 7, "é": 3, "Z": 90}, {str(i): i * i + 1 for i in range(40)}, {"a": 0, "b": 10}, {"a": 0},
]


@pytest.mark.parametrize("sizes", CASES)
def test_water_filling(spark, sizes):
    s = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.water_fill(s, (3, 1, 2), 1.5, 2.0).collect()}
    want = fill(sizes, (3, 1, 2), 1.5, 2.0)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_taken_near_targets_and_reruns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mix_sources(docs).collect()
    by = {}
    for r in rows:
        assert r.taken in (0, r.size, 2 * r.size)
        by.setdefault(r.source, []).append(r)
    for own in by.values():
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own) / 2 + 1
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))


def test_edge_cases(spark):
    d = spark.createDataFrame(
        [(1, None, "a", 1), (2, "", None, 1), (2, "", None, 1), (None, "x y z", "a", 1), (4, "w " * 90000, "b", 2), (4, "w " * 90000, "b", 2), (5, " \t", "c", 3)],
        "doc_id long, text string, source string, target int",
    )
    rows = mixing.mix_sources(d).collect()
    assert len(rows) == 7 and {r.doc_id: r.size for r in rows} == {1: 0, 2: 0, None: 3, 4: 90000, 5: 0}
    assert mixing.mix_sources(d.limit(0)).count() == 0
    assert mixing.mixed_documents(d).columns == d.columns


def test_no_python_on_the_main_path(spark):
    plan = mixing.mix_sources(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
