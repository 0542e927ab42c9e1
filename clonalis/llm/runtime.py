"""Shared storage for intermediate results: Spark tables and plain files that survive lost executors."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of all rows that a join deals out by a key, the share of one key beyond which its rows are not shuffled.
HOT_SHARE, HOT_LEAST = 500, 200
#: Rows of a narrow table that go to one file.
ROWS_A_FILE = 50_000


def fresh(label: str, *tables: DataFrame) -> str:
    """A column name that none of the tables has, whatever its case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while label.lower() in taken:
        label += "_"
    return label


def join_hot(rows: DataFrame, key: str, table: DataFrame, table_key: str, weight: str, total: int) -> DataFrame:
    """Inner join of rows with a table of one row a key, whose column weight says how many rows have it.

    Keys with over a 500th of all rows (total) are at most 500; their rows of the table are broadcast, so
    that no task gathers a hot key, and the other keys are joined by a shuffle."""
    bar = max(HOT_LEAST, total // HOT_SHARE)
    hot, others = table.filter(F.col(weight) > bar), table.filter(F.col(weight) <= bar)
    hot = F.broadcast(hot)
    on = lambda t: rows[key] == t[table_key]
    return rows.join(hot, on(hot)).unionByName(rows.join(hot, on(hot), "left_anti").join(others, on(others)))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset (tests on one machine), an own one is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


class Scratch:
    """Tables written to the shared folder to cut lineage; ``drop`` removes those no longer needed."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.n = spark, new_path(spark, label), 0

    def save(self, df: DataFrame, name: str = "t", rows: int | None = None) -> DataFrame:
        """rows: about how many there are at most, where that is known; they go to a file for each ROWS_A_FILE."""
        self.n += 1
        path = f"{self.root}/{name}-{self.n}"
        if rows is not None:
            df = df.coalesce(max(1, -(-rows // ROWS_A_FILE)))
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            if path := getattr(table, "_scratch_path", None):
                remove(self.spark, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's filesystem and path for a URI or a plain path; usable in tasks."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" in uri:
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), os.path.abspath(uri)


def write_atomically(uri: str, parts) -> int:
    """Write byte strings to uri through a temporary name, so that a retried or a second attempt of a
    task leaves one whole file. Returns the number of bytes."""
    files, path = filesystem(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    temporary, size = f"{path}.{uuid.uuid4().hex}.tmp", 0
    try:
        with files.open_output_stream(temporary) as out:
            for part in parts:
                out.write(part)
                size += len(part)
        files.move(temporary, path)
    except BaseException:
        with contextlib.suppress(Exception):
            files.delete_file(temporary)
        raise
    return size


def release() -> None:
    """Gives memory that earlier tasks of a reused Python worker have freed back to the system."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(run: Callable) -> Callable:
    """A function for mapInArrow that leaves a reused worker small: what it freed goes back before and after."""

    def wrapped(batches: Iterator) -> Iterator:
        release()
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped
