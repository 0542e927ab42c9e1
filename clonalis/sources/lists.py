"""Small text inputs: cell lists, exclusion lists, and the tables that a run has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_barcodes(spark: SparkSession, path: str) -> DataFrame:
    """cell_id, one a line, plain or gz."""
    return spark.read.text(path).select(F.col("value").alias("cell_id")).filter("cell_id <> ''").distinct()


def read_allowed_cells(spark: SparkSession, path: str) -> DataFrame:
    """cell_id from the second column of a table without header; ids that end in -1 are an error."""
    rows = spark.read.csv(path, sep="\t", schema="row_index string, cell_id string").select("cell_id").filter("cell_id is not null").distinct()
    bad = F.raise_error(F.concat(F.lit("cell ids in the list must not end in -1: "), F.col("cell_id")))
    return rows.select(F.when(F.col("cell_id").endswith("-1"), bad).otherwise(F.col("cell_id")).alias("cell_id"))


def read_excluded_clone_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.split("value", "\t")[0].alias("clone_id")).filter("clone_id <> ''")


def read_highlights(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("cell_id")).filter("cell_id <> ''")


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A tab-separated table with a header, whose first cell may start with #."""
    return spark.read.csv(path, sep="\t", header=True, schema=schema, enforceSchema=True)


def read_reads(spark: SparkSession, path: str, require_umis: bool = True) -> DataFrame:
    t = read_table(spark, path, "cell_id string, umi string, clone_id string" if require_umis else "cell_id string, clone_id string")
    return t if require_umis else t.select("cell_id", F.lit(None).cast("string").alias("umi"), "clone_id")


def read_molecules(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, "cell_id string, umi string, clone_id string, read_count bigint")


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """(cell_id, clone_id, count, ord) of lines of a cell id, a colon, and pairs of cloneID and count."""
    f = F.split("value", "\t")
    own = spark.read.text(path).filter(~F.col("value").startswith("#")).select(f[0].alias("cell_id"), F.slice(f, F.lit(3), F.greatest(F.size(f) - 2, F.lit(0))).alias("p"))
    pairs = F.transform(F.sequence(F.lit(0), F.expr("size(p) div 2") - 1), lambda i: F.struct(F.get("p", 2 * i).alias("clone_id"), F.get("p", 2 * i + 1).cast("long").alias("count")))
    t = own.filter("size(p) >= 2").select("cell_id", F.posexplode(pairs).alias("ord", "c"))
    return t.select("cell_id", "c.clone_id", "c.count", (F.col("ord") + 1).cast("long").alias("ord"))


def read_count_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(cell_id, clone_id, count) of the cells of a matrix that are not 0."""
    t = spark.read.csv(path, header=True, inferSchema=False)
    key = t.columns[0]
    long = t.withColumnRenamed(key, "clone_id").unpivot("clone_id", [c for c in t.columns[1:]], "cell_id", "count")
    return long.select("cell_id", "clone_id", F.col("count").cast("long").alias("count")).filter("count > 0")


def read_clones(spark: SparkSession, path: str) -> DataFrame:
    """(clone_nr, cell_id); an older header of the first column is read too."""
    return read_table(spark, path, "clone_nr bigint, cell_id string")
