"""Reads of one or several samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable_reads(reads: DataFrame, require_umis: bool = True) -> DataFrame:
    """Reads with a base inside the span and, if required, a UMI; an empty UMI is none."""
    umi = F.when(F.col("umi") != "", F.col("umi"))
    kept = reads.select("cell_id", umi.alias("umi"), "clone_id").filter(F.col("clone_id").rlike("[^0-]"))
    return kept.filter("umi is not null") if require_umis else kept


def keep_cells(reads: DataFrame, allowed: DataFrame) -> DataFrame:
    """Reads of the cells in a table with cell_id."""
    return reads.join(allowed.select("cell_id").distinct(), "cell_id", "left_semi").select(*reads.columns)


def merge_samples(samples: Sequence[DataFrame], names: Sequence[str], prefix: bool = False) -> DataFrame:
    """All reads, with the sample's name after (or before) the cell id."""
    if len(names) != len(set(names)) or len(names) != len(samples):
        raise ValueError("each sample needs a name of its own")
    out = None
    for reads, name in zip(samples, names, strict=True):
        parts = [F.lit(name), F.col("cell_id")] if prefix else [F.col("cell_id"), F.lit(name)]
        named = reads.withColumn("cell_id", F.concat_ws("_", *parts))
        out = named if out is None else out.unionByName(named)
    return out
