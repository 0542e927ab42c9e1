"""CloneIDs from alignments: projection of a read onto a reference span by its CIGAR string."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

_OPERATIONS = re.compile(r"(\d+)([MIDNSHP=X])")
#: Operations that move along the read, and along the reference.
ON_READ, ON_REFERENCE = frozenset("MIS=X"), frozenset("MDN=X")


@lru_cache(maxsize=1 << 16)
def operations(cigar: str) -> list[tuple[int, str]]:
    return [(int(n), op) for n, op in _OPERATIONS.findall(cigar or "")]


def reference_length(cigar: str) -> int:
    return sum(n for n, op in operations(cigar) if op in ON_REFERENCE)


def right_clip(cigar: str) -> int:
    """Soft-clipped bases at the end of the read."""
    found = [(n, op) for n, op in operations(cigar) if op != "H"]
    return found[-1][0] if len(found) > 1 and found[-1][1] == "S" else 0


def project(pos: int, cigar: str, seq: str, start: int, end: int) -> str | None:
    """The read's bases over reference positions start to end (0-based, half-open).

    Soft-clipped ends continue the alignment without gaps; inserted bases are left out; deleted or
    skipped positions are 0 and others that the read does not reach are -. None without any base. pos is
    the 0-based first aligned position.
    """
    ops = operations(cigar)
    aligned = [k for k, (_, op) in enumerate(ops) if op in "M=X"]
    if not aligned or seq in (None, "", "*"):
        return None
    out, bases, at_read, at_reference = ["-"] * (end - start), 0, 0, pos
    leading = sum(n for n, op in ops[: aligned[0]] if op == "S")
    for k, (n, op) in enumerate(ops):
        if op in "M=X" or op == "S":
            first = at_reference if op != "S" or k > aligned[0] else pos - leading
            low, high = max(first, start), min(first + n, end)
            if low < high:
                out[low - start : high - start] = seq[at_read + low - first : at_read + high - first]
                bases += high - low
            at_read += n
            if op != "S":
                at_reference += n
        elif op in "DN":
            low, high = max(at_reference, start), min(at_reference + n, end)
            if low < high:
                out[low - start : high - start] = "0" * (high - low)
            at_reference += n
        elif op == "I":
            at_read += n
    return "".join(out) if bases else None


def _spanned(cigar: Column) -> Column:
    """Reference positions that a CIGAR string spans."""
    return F.aggregate(F.regexp_extract_all(cigar, F.lit(r"(\d+)[MDN=X]"), 1), F.lit(0).cast("long"), lambda acc, n: acc + n.cast("long"))


def overlapping(alignments: DataFrame, chromosome: str, start: int, end: int, margin: int = 10) -> DataFrame:
    """Alignments with a reference base within the span and margin, as a region query gives them."""
    low, high = max(0, start - margin), end + margin
    near = alignments.filter((F.col("rname") == chromosome) & (F.col("pos") < high) & F.col("pos").isNotNull())
    return near.filter(F.col("pos") + F.greatest(_spanned(F.col("cigar")), F.lit(1)) > low)


def extract_clone_ids(alignments: DataFrame, start: int, end: int) -> DataFrame:
    """Adds clone_id, null where the read has no base in the span or a null in pos, cigar or seq.

    Whole Arrow batches go to Python: the same walk as an expression, whose lambda functions aren't generated
    code, took 94 s in place of 25 for the 447 000 reads derived at sf0.1, in one task and with the session's start.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = (batch.column(n).to_pylist() for n in ("pos", "cigar", "seq"))
            found = [None if p is None or c is None else project(p, c, s, start, end) for p, c, s in zip(*given, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, "clone_id"])

    return alignments.mapInArrow(rows, StructType([*alignments.schema.fields, StructField("clone_id", StringType())]))


def read_alignments(
    alignments: DataFrame, chromosome: str, start: int, end: int, *, allowed: DataFrame | None = None, require_umis: bool = True, cell_id_tag: str = "CB", carry: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame]:
    """(reads, counters): usable reads of a span, and how many alignments there had no cell id or no UMI.

    The allow-list is tested on the cell id as it is in the tag; with the tag CB ids end in -1, which is
    cut off, and others are an error. An empty UMI is none. Alignment flags are not looked at. Reads keep the columns of carry, too.
    """
    near = overlapping(alignments, chromosome, start, end)
    cell, umi = F.col("tags").getItem(cell_id_tag), F.col("tags").getItem("UB")
    t = near.select("pos", "cigar", "seq", cell.alias("_cell"), umi.alias("_umi"), *(c for c in carry if c not in ("pos", "cigar", "seq")))
    if allowed is not None:
        t = t.join(allowed.select(F.col("cell_id").alias("_cell"), F.lit(True).alias("_listed")).distinct(), "_cell", "left")
        t = t.withColumn("_listed", F.coalesce("_listed", F.lit(False)))
    else:
        t = t.withColumn("_listed", F.lit(True))
    tagged = F.col("_cell").isNotNull() & (F.col("_umi").isNotNull() | F.lit(not require_umis))
    counters = t.agg(
        F.count_if(F.col("_cell").isNull() | (tagged & ~F.col("_listed"))).alias("no_cell_id"),
        F.count_if(F.col("_umi").isNull() | (F.col("_umi") == "")).alias("no_umi"),
    )
    kept = t.filter(tagged & F.col("_listed"))
    name = F.col("_cell")
    if cell_id_tag == "CB":
        name = F.when(name.endswith("-1"), F.expr("substring(_cell, 1, length(_cell) - 2)")).otherwise(F.raise_error(F.concat(F.lit("a cell id does not end in -1: "), name)))
    reads = extract_clone_ids(kept, start, end).filter("clone_id is not null").select(name.alias("cell_id"), F.when(F.col("_umi") != "", F.col("_umi")).alias("umi"), "clone_id", *carry)
    return (reads.filter("umi is not null") if require_umis else reads), counters


def detect_span(alignments: DataFrame, chromosome: str, length: int, *, candidates: int = 5, least: int = 5, share: float = 0.95) -> tuple[int, int]:
    """(start, end) of the cloneID on a reference, from where reads are clipped at their right ends.

    The most frequent ends of reads with five clipped bases or more are tried in turn; from each on, the
    first position at which one base has more than the share of all ends the span. Duplicates,
    secondary and failed alignments do not count for the shares. Ties go to the smaller position.
    """
    own = alignments.filter((F.col("rname") == chromosome) & F.col("pos").isNotNull())

    def bases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            places, chars = [], []
            for p, c, s in zip(batch["pos"], batch["cigar"], batch["seq"], strict=True):
                at_read, at = 0, int(p)
                for n, op in operations(c):
                    if op in "M=X":
                        own = s[at_read : at_read + n]
                        places.append(np.arange(at, at + len(own)))
                        chars.append(own)
                    at_read += n if op in ON_READ else 0
                    at += n if op in ON_REFERENCE else 0
            if places:
                codes = np.frombuffer("".join(chars).encode("latin-1", "replace"), dtype="uint8")
                keys, n = np.unique(np.concatenate(places) << 8 | codes, return_counts=True)
                yield pd.DataFrame({"place": keys >> 8, "base": keys & 255, "n": n})

    clip = F.regexp_extract("cigar", r"[MIDNP=XS](\d+)S(?:\d+H)?$", 1).try_cast("int")
    ends = own.filter(clip >= 5).select((F.col("pos") + _spanned(F.col("cigar"))).alias("end"))
    first = ends.groupBy("end").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "end").limit(candidates).collect()
    pileup = own.filter((F.col("flag").bitwiseAND(0x704)) == 0).select("pos", "cigar", "seq").mapInPandas(bases, "place bigint, base bigint, n bigint")
    counts = pileup.groupBy("place", "base").agg(F.sum("n").alias("n")).groupBy("place").agg((F.max("n") / F.sum("n")).alias("top")).filter(F.col("top") > share)
    for row in first:
        if row["end"] >= length:
            continue
        found = counts.filter(F.col("place") >= row["end"]).agg(F.min("place")).first()[0]
        if found is not None and found - row["end"] >= least:
            return row["end"], found
    raise ValueError(f"could not detect the span of the cloneID on {chromosome}")
