import tracemalloc
import zlib

import numpy as np
import pytest

from clonalis.llm import quality as q

SF = "/root/testdata/sf0.01"


def auc(score, label):
    pos, neg = score[label == 1], score[label == 0]
    return np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r.doc_id: r for r in q.score_quality(docs, labels).collect()}
    assert len(rows) == docs.count()
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    pairs = [(rows[r.doc_id].score, r.quality) for r in labels.collect() if r.doc_id in rows and rows[r.doc_id].held_out]
    score, label = (np.array(x) for x in zip(*pairs, strict=True))
    assert auc(score, label) > 0.97
    assert np.mean((score >= 0.5)[label == 1]) > 0.97
    kept = {r.doc_id for r in q.keep_good(docs, labels).collect()}
    assert kept == {i for i, r in rows.items() if r.predicted}


def test_held_out_labels_do_not_matter(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    seen = labels.filter(~q.held_out(labels["doc_id"]))
    one, two = q.train(docs, labels), q.train(docs, seen)
    assert all(np.array_equal(a, b) for a, b in zip(one, two, strict=True))


def test_driver_holds_few_labelled_rows_at_once(spark):
    docs = spark.range(9000).selectExpr("id AS doc_id", "repeat(concat('word', id % 37, ' and more. '), int(1 + id % 5)) AS text")
    labels = spark.range(9000).selectExpr("id AS doc_id", "int(id % 2) AS quality")
    q.train(docs.limit(10), labels)
    tracemalloc.start()
    q.train(docs, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48e6


def test_lots_give_the_moments_of_the_whole():
    x = np.random.default_rng(3).normal(5, 2, (2500, 7))
    mean, deviation = q.moments(lambda: (x[i : i + 999] for i in range(0, len(x), 999)), 7)
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(deviation, x.std(axis=0))
    assert not np.any(q.moments(lambda: iter(()), 7))


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 0.1), (2, "", 0.2), (2, "", 0.2), (None, "x y", 0.3), (4, "Long text. " * 5000, 0.4), (5, " \n", 0.5)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = q.score_quality(docs, none).collect()
    assert len(rows) == 6 and all(abs(r.score - 0.5) < 1e-9 for r in rows)
    assert q.keep_good(docs, none).columns == docs.columns
    some = spark.createDataFrame([(1, 1, 0), (4, 0, None), (2, None, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    rows = q.score_quality(docs, some).collect()
    assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert q.score_quality(docs.limit(0), some).count() == 0


def test_features_do_not_depend_on_neighbours():
    texts = [b"One two two.\nThree FOUR!!", b"", b" ", "é日本 x".encode(), b"a | b | c", b"Same Same Same"]
    together = q.features(texts)
    assert together.shape == (6, q.N_FEATURES) and not together[1].any()
    for i, t in enumerate(texts):
        assert np.allclose(q.features([t])[0], together[i])


@pytest.mark.parametrize("share", [0.6, 0.9])
def test_risk_on_two_clouds(share):
    rng = np.random.default_rng(1)
    positive, negative = rng.normal(1.5, 1, (2000, 4)), rng.normal(-1.5, 1, (2000, 4))
    n = int(3000 * share)
    unlabelled = np.concatenate([rng.normal(1.5, 1, (n, 4)), rng.normal(-1.5, 1, (3000 - n, 4))])
    model = q.fit(positive, unlabelled, share)
    assert np.mean(model.score(positive) >= 0.5) > 0.95 and np.mean(model.score(negative) >= 0.5) < 0.1
