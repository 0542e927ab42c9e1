"""A training corpus from raw documents: five stages, each over all that the one before kept.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which
is written as Parquet and read again as the next one's docs. All but the last return documents'
columns. Ids are integers and unique; null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clonalis.llm import decontaminate, mixing, near_dedup, quality, queries, token_store
from clonalis.llm.runtime import Scratch

#: Pieces that a worker keeps while it tokenizes; fewer than by default, since executors serve all stages.
CACHE_ENTRIES = 120_000


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each near-duplicate component; links are at similarity 0.85 or
    more, as in op7's contract, so pairs at 0.80 to 0.85 are both kept unless other links join them."""
    return near_dedup.drop_near_duplicates(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents in which a benchmark window occurs."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix of sources takes it."""
    return mixing.mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: doc_id, start, n_tokens and ids_crc32 of each copy."""
    root, manifest = token_store.write_token_files(
        docs, tokenizer_path=queries.tokenizer_path("byte_bpe_50k.json"), end_id=2, cache_entries=CACHE_ENTRIES
    )
    return token_store.read_token_files(root, manifest)


STAGES = [
    ("quality_classifier", keep_quality),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_benchmark_leaks),
    ("mix_sources", mix),
    ("token_output", write_tokens),
]

#: The classifier and the tokenizer can't be written in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs, name)
            scratch.drop(before)
    return docs
