"""Counts of cloneIDs in cells, and the filters of the protocols."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import sequences as sq

#: Values of the count matrix that a task, or a batch, fills up.
_TASK_VALUES, _BATCH_VALUES = 1 << 25, 1 << 22


def compute_cells(molecules: DataFrame, min_length: int = 20) -> DataFrame:
    """(cell_id, clone_id, count, ord) over cloneIDs of min_length known positions; ord is the place in
    the cell: fewer uncovered positions first, then greater counts, then the earlier molecule, in the
    order of the cloneIDs before correction."""
    before = F.coalesce(*[F.col(c) for c in ("original_clone_id", "clone_id") if c in molecules.columns])
    umi = F.col("umi") if "umi" in molecules.columns else F.lit(None).cast("string")
    counts = molecules.filter(sq.known_length(F.col("clone_id")) >= min_length).groupBy("cell_id", "clone_id").agg(F.count("*").alias("count"), F.min(F.struct(before.alias("o"), umi.alias("u"))).alias("_first"))
    place = Window.partitionBy("cell_id").orderBy(sq.n_dashes(F.col("clone_id")), F.desc("count"), "_first", "clone_id")
    return counts.select("cell_id", "clone_id", "count", F.row_number().over(place).cast("long").alias("ord"))


def filter_cells(cells: DataFrame, molecules: DataFrame, discard_single_reads: bool = True, discard_cross_contamination: bool = True) -> DataFrame:
    """Drops a cloneID seen once in a cell if it is seen in others too (contamination), or else if some
    molecule of it, of any cell, has a single read. Cells without cloneIDs vanish."""
    total = F.sum("count").over(Window.partitionBy("clone_id"))
    single = molecules.filter("read_count = 1").select(F.col("clone_id").alias("_single")).distinct()
    t = cells.select("*", total.alias("_total")).join(single, F.col("clone_id") == F.col("_single"), "left")
    once = F.col("count") <= 1
    contaminated = once & (F.col("_total") > 1) & F.lit(discard_cross_contamination)
    weak = once & F.col("_single").isNotNull() & F.lit(discard_single_reads)
    return t.filter(~contaminated & ~weak).select(*cells.columns)


def filter_visium(cells: DataFrame, molecules: DataFrame) -> DataFrame:
    """Drops a cloneID seen once in a cell whose molecule there has a single read."""
    single = molecules.filter("read_count = 1").select("cell_id", "clone_id").distinct()
    weak = cells.filter("count <= 1").select("cell_id", "clone_id").join(single, ["cell_id", "clone_id"], "left_semi")
    return cells.join(weak, ["cell_id", "clone_id"], "left_anti").select(*cells.columns)


def filter_smartseq2(cells: DataFrame, threshold: int = 2) -> DataFrame:
    return cells.filter(F.col("count") >= threshold)


def count_matrix(cells: DataFrame) -> DataFrame:
    """clone_id by cell_id, 0 where there is none. One column a cell: for sinks. Rows are shuffled as lists of
    their cells; only the last step fills them up, some rows at once."""
    names = [r[0] for r in cells.select("cell_id").distinct().orderBy("cell_id").collect()]
    n_rows = cells.select("clone_id").distinct().count()
    counts = cells.groupBy("clone_id", "cell_id").agg(F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("count"))
    rows = counts.groupBy("clone_id").agg(F.collect_list(F.struct("cell_id", "count")).alias("c")).select("clone_id", "c.cell_id", "c.count")
    labels = ["null" if n is None else n for n in names]
    schema = T.StructType([T.StructField("clone_id", T.StringType()), *(T.StructField(n, T.LongType(), False) for n in labels)])
    n_tasks = max(cells.sparkSession.sparkContext.defaultParallelism, -(-n_rows * len(names) // _TASK_VALUES))
    return rows.repartition(n_tasks).mapInArrow(partial(_filled, names, labels), schema)


def _filled(names: list, labels: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A column a name of each row's counts, at most _BATCH_VALUES values (or one row) at once."""
    places = pa.array(names, pa.string())
    schema = pa.schema([pa.field("clone_id", pa.string()), *(pa.field(n, pa.int64(), False) for n in labels)])
    lot = max(1, _BATCH_VALUES // max(1, len(names)))
    for batch in batches:
        for start in range(0, batch.num_rows, lot):
            ids, cell, count = batch.slice(start, lot).columns
            n = len(ids)
            block = np.zeros((len(names), n), dtype=np.int64)
            place = pc.index_in(pc.list_flatten(cell).cast(pa.string()), value_set=places)
            block[place.to_numpy(), pc.list_parent_indices(cell).to_numpy()] = pc.list_flatten(count).to_numpy()
            values = pa.array(block.reshape(-1))
            yield pa.RecordBatch.from_arrays([ids.cast(pa.string()), *(values.slice(i * n, n) for i in range(len(names)))], schema=schema)


def top_clone_ids(cells: DataFrame, n: int = 6) -> DataFrame:
    """(cell_id, rank, clone_id, count) of the n most frequent cloneIDs of a cell; ties in reverse order of ord."""
    place = Window.partitionBy("cell_id").orderBy(F.desc("count"), F.desc("ord"))
    return cells.select("cell_id", F.row_number().over(place).cast("long").alias("rank"), "clone_id", "count").filter(F.col("rank") <= n)
