"""SAM text and BAM files as a table of alignments, without other libraries.

Tables have rname, pos (0-based first aligned position), cigar, seq, flag and tags, a map of the text tags.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bam import BASES as _BASES  # noqa: F401
from .bam import CIGAR as _CIGAR  # noqa: F401
from .bam import header_of, read_bam, write_bam  # noqa: F401


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of SAM text files; header lines are left out. Columns are split where they are read."""
    fields = F.split(F.col("value"), "\t")
    own = spark.read.text(path).filter(~F.col("value").startswith("@") & (F.length("value") > 0)).select(fields.alias("f"))
    tags = F.filter(F.slice("f", F.lit(12), F.greatest(F.size("f") - 11, F.lit(0))), lambda t: F.substring(t, 4, 2) == "Z:")
    return own.select(
        F.get("f", F.lit(2)).alias("rname"), (F.get("f", F.lit(3)).cast("long") - 1).alias("pos"), F.get("f", F.lit(5)).alias("cigar"), F.get("f", F.lit(9)).alias("seq"), F.get("f", F.lit(1)).cast("int").alias("flag"),
        F.map_from_entries(F.transform(tags, lambda t: F.struct(F.substring(t, 1, 2), t.substr(F.lit(6), F.length(t))))).alias("tags"),
    )


def bam_references(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """(name, length) of the references of the first of the files."""
    return header_of(spark, path)[1]
