"""Tables of the quality report."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import sequences as sq
from ..materialize import materialize
from .molecules import deal, in_pairs


def reads_per_molecule(reads: DataFrame) -> DataFrame:
    return reads.groupBy("cell_id", "umi").agg(F.count("*").alias("n_reads"))


def nucleotides_per_molecule(molecules: DataFrame) -> DataFrame:
    """(n_nucleotides, n_molecules): known positions; a table of cells weighs by its counts."""
    weight = F.sum("count") if "count" in molecules.columns else F.count("*")
    return molecules.groupBy(sq.known_length(F.col("clone_id")).alias("n_nucleotides")).agg(weight.alias("n_molecules"))


def molecules_per(df: DataFrame, key: str) -> DataFrame:
    """(key, n_molecules) by cell_id or clone_id, of molecules (with a UMI) or of cells (by count)."""
    total = F.sum("count") if "count" in df.columns else F.count("umi")
    return df.groupBy(key).agg(total.alias("n_molecules"))


def unique_clone_ids_per_cell(df: DataFrame) -> DataFrame:
    return df.groupBy("cell_id").agg(F.count_distinct("clone_id").alias("n_clone_ids"))


def unique_clone_ids_per_clone(clones: DataFrame, cells: DataFrame) -> DataFrame:
    return clones.join(cells.select("cell_id", "clone_id"), "cell_id").groupBy("clone_nr").agg(F.count_distinct("clone_id").alias("n_clone_ids"))


def clone_sizes(clones: DataFrame) -> DataFrame:
    return clones.groupBy("clone_nr").agg(F.count("*").alias("n_cells"))


def histogram(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))


def summary(df: DataFrame, value: str) -> DataFrame:
    """(n, mean, q25, q50, q75, n_equal_one) with linear interpolation between neighbours."""
    q: Column = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    t = df.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), q.alias("q"), F.count(F.when(F.col(value) == 1, 1)).alias("n_equal_one"))
    return t.select("n", "mean", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "n_equal_one")


def full_length_share(molecules: DataFrame, width: int = 30) -> DataFrame:
    """(share) of molecules all of whose width positions are known."""
    return molecules.agg(F.avg((sq.known_length(F.col("clone_id")) == width).cast("int")).alias("share"))


def jaccard_pairs(cells: DataFrame) -> DataFrame:
    """(cell_a, cell_b, jaccard) of cells a < b that share a cloneID. All other pairs have 0: a matrix of
    them all would grow with the square of the cells."""
    size = cells.groupBy("cell_id").agg(F.count("*").alias("n"))
    a, b = cells.select("cell_id", "clone_id").alias("a"), cells.select("cell_id", "clone_id").alias("b")
    common = a.join(b, (F.col("a.clone_id") == F.col("b.clone_id")) & (F.col("a.cell_id") < F.col("b.cell_id"))).groupBy(F.col("a.cell_id").alias("cell_a"), F.col("b.cell_id").alias("cell_b")).agg(F.count("*").alias("common"))
    t = common.join(size.select(F.col("cell_id").alias("cell_a"), F.col("n").alias("na")), "cell_a").join(size.select(F.col("cell_id").alias("cell_b"), F.col("n").alias("nb")), "cell_b")
    return t.select("cell_a", "cell_b", (F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("jaccard"))


def jaccard_matrix(cells: DataFrame) -> DataFrame:
    """(cell_a, cell_b, jaccard): the symmetric matrix of all cells in sparse form. The diagonal is 1, both halves
    are there, and a pair that is absent is 0: cells here hold a cloneID each, so that no pair is 0/0 (NaN)."""
    pairs = jaccard_pairs(cells)
    turned = pairs.select(F.col("cell_b").alias("cell_a"), F.col("cell_a").alias("cell_b"), "jaccard")
    own = cells.select(F.col("cell_id").alias("cell_a")).distinct().select("cell_a", F.col("cell_a").alias("cell_b"), F.lit(1.0).alias("jaccard"))
    return pairs.unionByName(turned).unionByName(own)


def vector_jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of booleans of equal length; without any true the quotient 0/0 is NaN."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    either = F.size(F.filter(pairs, lambda p: p["a"] | p["b"]))
    return F.when(either == 0, F.lit(float("nan"))).otherwise(F.size(F.filter(pairs, lambda p: p["a"] & p["b"])) / either)


def matrix_order(matrix: DataFrame) -> list[str]:
    """Cells of a sparse matrix in an order that brings its entries near the diagonal, for drawings: each part is
    walked from a cell of least degree, neighbours by degree and name, and the whole order is turned round. A
    drawing has all cells side by side, so the pairs are streamed to the driver."""
    near: dict[str, set[str]] = {}
    for r in matrix.filter("jaccard > 0").toLocalIterator():
        near.setdefault(r["cell_a"], set()).add(r["cell_b"])
        near.setdefault(r["cell_b"], set()).add(r["cell_a"])
    by_degree = lambda names: sorted(names, key=lambda n: (len(near[n]), n))
    out, seen = [], set()
    for start in by_degree(near):
        if start in seen:
            continue
        seen.add(start)
        walk = [start]
        for cell in walk:
            fresh = by_degree(near[cell] - seen)
            seen.update(fresh)
            walk += fresh
        out += walk
    return out[::-1]


def trimmed_overlap(pairs: DataFrame) -> DataFrame:
    """Adds s, t and distance to pairs (u, v): the parts of two IDs that overlap, and their Hamming distance.

    Where either ID has an unknown position, unknown ends are cut in turn: u's left end, v to u's length from
    the right, v's left end, u to v's length from the right, and the same for the right ends. Unknown positions
    that are left count as characters."""
    gaps = F.lit("-0")
    last = lambda x, n: F.when(n == 0, x).otherwise(F.right(x, n))
    t = pairs.select("*", F.col("u").alias("s"), F.col("v").alias("t"), (~sq.is_full(F.col("u")) | ~sq.is_full(F.col("v"))).alias("_cut"))
    steps = [
        ("s", F.ltrim("s", gaps)), ("t", last(F.col("t"), F.length("s"))), ("t", F.ltrim("t", gaps)), ("s", last(F.col("s"), F.length("t"))),
        ("s", F.rtrim("s", gaps)), ("t", F.left("t", F.length("s"))), ("t", F.rtrim("t", gaps)), ("s", F.left("s", F.length("t"))),
    ]
    for name, value in steps:
        t = t.withColumn(name, F.when(F.col("_cut"), value).otherwise(F.col(name)))
    return t.withColumn("distance", sq.hamming(F.col("s"), F.col("t"))).drop("_cut")


def simulated_ids(spark: SparkSession, n: int, width: int = 30, seed: int = 1) -> DataFrame:
    """(clone_id): n distinct random IDs. The i-th draw comes from md5 digests of seed and i; draws are repeated
    with a longer range until n are distinct, and the first n by draw are taken."""
    if n > 4**width:
        raise ValueError("there are not so many IDs of this width")
    digits = F.concat(*[F.md5(F.concat(F.lit(f"{seed}-"), F.col("id").cast("string"), F.lit(f"-{k}"))) for k in range(-(-width // 32))])
    draws = n
    while True:
        t = spark.range(draws).select("id", F.translate(F.substring(digits, 1, width), "0123456789abcdef", "ACGT" * 4).alias("clone_id"))
        first = t.groupBy("clone_id").agg(F.min("id").alias("id"))
        if first.count() >= n:
            return first.select("clone_id", F.row_number().over(Window.orderBy("id")).alias("k")).filter(F.col("k") <= n).select("clone_id") if draws > n else first.select("clone_id")
        draws *= 2


def _counted(s: list[np.ndarray], t: list[np.ndarray]) -> np.ndarray:
    """How many pairs of rows of s and t differ in 0, 1, ... places; a plane of bits each, at most 62 of them in use."""
    pairs, odd = np.zeros(1 << 14, np.int64), np.zeros(64, np.int64)
    step = max(1, (1 << 17) // len(t[0]))
    for x in range(0, len(s[0]), step):
        differ = reduce(np.bitwise_or, [a[x : x + step, None] ^ b for a, b in zip(s, t, strict=True)])
        places = np.bitwise_count(differ).ravel()
        two = len(places) // 2 * 2
        pairs += np.bincount(places[:two].view(np.uint16), minlength=len(pairs))  # two distances at once
        odd[places[two:]] += 1
    pairs = pairs.reshape(64, 256)
    return odd + pairs.sum(axis=1) + pairs.sum(axis=0)[:64]


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(distance, n) of the pairs between two lots of packed IDs, or within one where i = j."""
    for batch in batches:
        total = np.zeros(64, np.int64)
        for row in range(batch.num_rows):
            lots = [batch.column(k)[row].values for k in (2, 3)]
            known = np.concatenate([lot.field("known").to_numpy() for lot in lots])
            if (known != known[0]).any():
                raise ValueError("sequences of unequal lengths")
            kind = np.uint32 if int(known[0]) < 1 << 32 else np.int64
            planes = [[lot.field(x).to_numpy().astype(kind) for lot in lots] for x in "abn"]
            planes = [p for p in planes if p[0].any() or p[1].any()] or planes[:1]
            found = _counted([p[0] for p in planes], [p[1] for p in planes])
            if batch.column(0)[row] == batch.column(1)[row]:
                found[0] -= len(lots[0])
                found //= 2
            total += found
        places = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(total[places])], names=["distance", "n"])


def hamming_histogram(molecules: DataFrame) -> DataFrame:
    """(distance, n_pairs) over all pairs of distinct full cloneIDs. It is a table of all pairs by its
    definition: the distinct IDs are packed into bits and dealt into lots, each pair of lots is a row, whose
    pairs are counted in bulk, and only counts leave it. IDs that don't fit into bits are compared by position."""
    ids = materialize(molecules.select(F.col("clone_id").alias("id")).filter(sq.is_full(F.col("id"))).distinct().select("id", sq.packed(F.col("id")).alias("p")))
    dealt, blocks = deal(ids.filter("p is not null"), per_block=16384, least=8)
    tasks = max(8, blocks * (blocks + 1) // 4)
    lots = dealt.groupBy("block").agg(F.collect_list("p").alias("lot"))
    a, b = (side.select("i", "j", "lot").repartition(tasks, "i", "j").alias(name) for side, name in zip(in_pairs(lots, blocks), "ab", strict=True))
    rows = a.join(b, (F.col("a.i") == F.col("b.i")) & (F.col("a.j") == F.col("b.j"))).select("a.i", "a.j", F.col("a.lot").alias("s"), F.col("b.lot").alias("t"))
    counts = rows.mapInArrow(_distances, "distance long, n long")
    if not ids.filter("p is null").isEmpty():
        dealt, blocks = deal(ids, per_block=4096, least=32)
        a, b = in_pairs(dealt, blocks)
        unit = (F.col("a.i") == F.col("b.i")) & (F.col("a.j") == F.col("b.j")) & ((F.col("a.i") < F.col("a.j")) | (F.col("a.id") < F.col("b.id")))
        for x, y in (("a.p is null", "true"), ("a.p is not null", "b.p is null")):
            by_place = a.filter(x).alias("a").join(b.filter(y).alias("b").hint("shuffle_hash"), unit).select(sq.hamming(F.col("a.id"), F.col("b.id")).alias("distance"))
            counts = counts.unionByName(by_place.groupBy("distance").agg(F.count("*").alias("n")))
    return counts.groupBy("distance").agg(F.sum("n").alias("n_pairs"))
