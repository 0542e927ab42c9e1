"""Rows that share ids, clashing column names, nulls and empty tables in stages and readers."""

import pytest
from pyspark.sql import functions as F

from clonalis.llm import decontaminate, matroska, mixing, near_dedup, quality, token_store, warc_zip

EXTRA = ["_mix_n", "_mix_id", "_mix_i", "_gone", "_row", "_key", "_src", "_bucket", "_last", "source_size", "repeats", "kept", "score", "predicted", "shard", "ids", "n_words"]


def documents(spark):
    text = "one two three four five six seven eight nine ten eleven"
    rows = [(1, text, "a"), (1, "x y", "a"), (2, None, "b"), (None, "p q r", None), (None, "p q", "b"), (3, "", "a")] + [(10 + i, f"word{i} is here " * (i % 7 + 1), "ab"[i % 2]) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return d.select("*", *[F.lit(k).alias(c) for k, c in enumerate(EXTRA)])


def stages(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(10, 70)], "doc_id long, quality int, toxic int")
    tests = spark.createDataFrame([(1, "two three four five six seven eight nine ten eleven")], "item_id long, text string")
    return {
        "quality": lambda d: quality.keep_good(d, labels),
        "near": near_dedup.drop_near_duplicates,
        "leaks": lambda d: decontaminate.remove_contaminated(d, tests),
        "mix": mixing.mixed_documents,
    }


@pytest.mark.parametrize("name", ["quality", "near", "leaks", "mix"])
def test_stages_keep_clashing_columns(spark, name):
    d, stage = documents(spark), stages(spark)[name]
    got = stage(d)
    assert got.schema.names == d.schema.names and {tuple(r) for r in got.collect()} <= {tuple(r) for r in d.collect()}
    assert stage(d.limit(0)).count() == 0


def test_rows_that_share_an_id_have_repeats_of_their_own(spark):
    d = documents(spark)
    want = sorted((r.doc_id or 0, r.size, r.repeats) for r in mixing.mix_sources(d).collect() if r.repeats)
    mixed = mixing.mixed_documents(d).groupBy("doc_id", "text").count().collect()
    assert sorted((r.doc_id or 0, len((r.text or "").split()), r["count"]) for r in mixed) == want


def test_token_files_of_clashing_columns(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    d = documents(spark)
    root, manifest = token_store.write_token_files(d, tokenizer_path=public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    assert token_store.read_token_files(root, manifest).count() == d.count()


def test_digests_of_null_media(spark):
    d = spark.createDataFrame([(1, 0, None), (2, 3, bytearray(matroska.write(matroska.pad(b"abc"))))], "doc_id long, n_bytes long, media binary")
    null, some = matroska.digests(d).orderBy("doc_id").collect()
    assert null.payload_sha256 is None and null.feature is None and some.payload_bytes == 192


def test_revisits_have_their_response_s_html(spark):
    long = "<p>" + "same é " * 40
    pages = spark.createDataFrame([(i, f"http://x/{i}", long if i % 3 else f"<p>own {i} " * 30) for i in range(40)] + [(99, None, None)], "page_id long, url string, html string")
    _, archives = warc_zip.write_archives(pages)
    got = {r.page_id: (r.record_type, r.html) for r in warc_zip.read_archives(archives, keep_html=True).collect()}
    assert {i: h for i, (_, h) in got.items()} == {r.page_id: r.html or "" for r in pages.collect()}
    assert sum(t == "revisit" for t, _ in got.values()) == 25
