import collections

import numpy as np
import pyarrow.parquet as pq
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from clonalis.llm import mixing, quality  # noqa: E402

from .test_decontaminate import brute as brute_leaks  # noqa: E402
from .test_near_dedup import brute as brute_copies  # noqa: E402
from .test_token_store import expected  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_run_against_plain_version(spark):
    rows = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = [r for r in rows if model.score(quality.features([r["text"].encode()]).astype(np.float64))[0] >= 0.5]
    assert 0 < len(good) < len(rows)
    kept = {r[0] for r in brute_copies([(r["doc_id"], r["text"]) for r in good]) if r[3]}
    single = [r for r in good if r["doc_id"] in kept]
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    leaks = {r[0] for r in brute_leaks([(r["doc_id"], r["text"]) for r in single], items) if r[5]}
    clean = [r for r in single if r["doc_id"] not in leaks]
    assert len(good) > len(single) > len(clean)
    taken = {r.doc_id: r.repeats for r in mixing.mix_sources(spark.createDataFrame(clean, docs.schema)).collect()}
    want = expected([(r["doc_id"], r["text"]) for r in clean for _ in range(taken[r["doc_id"]])])
    got = [tuple(r) for r in corpus_pipeline.run(spark, SF).orderBy("start").collect()]
    assert got == [w[:4] for w in want]
    assert set(collections.Counter(g[0] for g in got).values()) <= {1, 2}


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).schema == docs.schema, name
