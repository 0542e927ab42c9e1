"""From reads to molecules: consensus, low complexity, corrections, exclusion."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequences as sq
from ..materialize import materialize
from ..schemas import MOLECULES
from .components import connected_components

BASES, GAPS = "ACGT", "-0"
MOST_BASES = 2048  # half-precision sums of ones stop here
MOST_MASKS = 6  # sets of known positions whose IDs are joined by parts


@lru_cache(maxsize=1)
def gap_segments() -> list[tuple[int, float, float]]:
    """(first n, weight there, step): weight of n gaps, 0.1 each, added in half precision. The sums are
    linear between powers of two and stop growing at last."""
    sums, tenth = [np.float16(0)], np.float16(0.1)
    while (more := np.float16(sums[-1] + tenth)) != sums[-1]:
        sums.append(more)
    values = np.array(sums, dtype=np.float64)
    steps = np.append(np.diff(values), 0.0)
    first = [0, *(np.flatnonzero(np.diff(steps)) + 1).tolist()]
    return [(n, float(values[n]), float(steps[n])) for n in first]


def gap_weight(n: Column) -> Column:
    segments = gap_segments()
    out = F.lit(0.0)
    for start, value, step in segments:
        out = F.when(n >= start, F.lit(value) + (n - start) * F.lit(step)).otherwise(out)
    return out


def _weights(counts: np.ndarray) -> np.ndarray:
    """Weights of counts whose first axis is A C G T - 0."""
    gaps = np.array([w for start, w, _ in _gap_table()])
    return np.concatenate([np.minimum(counts[:4], MOST_BASES).astype(np.float64), gaps[np.minimum(counts[4:], len(gaps) - 1)]])


@lru_cache(maxsize=1)
def _gap_table() -> list[tuple[int, float, float]]:
    """(n, weight, step) of each n up to the one from which the weight stays."""
    segments = gap_segments()
    return [(n, w + (n - start) * step, step) for (start, w, step), end in zip(segments, [s[0] for s in segments[1:]] + [segments[-1][0] + 1], strict=True) for n in range(start, end)]


def _characters(ids: pa.Array, width: int) -> np.ndarray:
    """A row of codes an ID; all have the same number of characters."""
    offsets = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
    data = np.frombuffer(ids.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    if len(data) != len(ids) * width:
        data = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    return data.reshape(len(ids), width)


def _counts(chars: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(symbol, molecule, position): reads of each molecule, whose rows begin at starts, with A C G T - 0 there."""
    return np.stack([np.add.reduceat(chars == ord(x), starts, axis=0, dtype=np.int64) for x in BASES + GAPS])


def _texts(counts: np.ndarray) -> pa.Array:
    """The symbols of greatest weight; ties go to the first, and other characters weigh nothing."""
    symbols = np.frombuffer((BASES + GAPS).encode(), np.uint8)[_weights(counts).argmax(axis=0)]
    offsets = np.arange(len(symbols) + 1, dtype=np.int32) * symbols.shape[1]
    return pa.StringArray.from_buffers(len(symbols), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(symbols)))


def _one_width(least: np.ndarray, most: np.ndarray) -> None:
    if (least != most).any():
        raise ValueError("reads of a molecule have unequal lengths")


def _settled(ids: pa.Array, sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Molecules of a single read, or of equal reads of known symbols: the consensus is that read."""
    other = np.append(False, _differs(ids))
    other[starts] = False
    out = ~np.logical_or.reduceat(other, starts)
    many = np.flatnonzero(out & (sizes > 1))
    out[many] = pc.match_substring_regex(ids.take(pa.array(starts[many])), f"^[{BASES}{GAPS[::-1]}]*$").to_numpy(zero_copy_only=False)
    return out


def _votes(ids: pa.Array, starts: np.ndarray) -> pa.Array:
    """Consensus of the molecules whose reads begin at starts."""
    sizes = np.diff(np.append(starts, len(ids)))
    widths = pc.utf8_length(ids).to_numpy(zero_copy_only=False)
    least = np.minimum.reduceat(widths, starts)
    _one_width(least, np.maximum.reduceat(widths, starts))
    settled = _settled(ids, sizes, starts)
    parts, places = [ids.take(pa.array(starts[settled]))], [np.flatnonzero(settled)]
    for width in np.unique(least[~settled]):
        own = ~settled & (least == width)
        rows = np.repeat(own, sizes)
        begin = np.cumsum(sizes[own]) - sizes[own]
        some = ids.filter(pa.array(rows))
        for lot in np.array_split(np.arange(len(begin)), max(1, rows.sum() * max(1, int(width)) // 2_000_000)):
            if len(lot):
                a, b = begin[lot[0]], begin[lot[-1]] + sizes[own][lot[-1]]
                chars = _characters(some[a:b], int(width))
                parts.append(_texts(_counts(chars, begin[lot] - a)) if width else some.take(pa.array(begin[lot])))
                places.append(np.flatnonzero(own)[lot])
    return pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate(places))))


def _differs(a: pa.Array) -> np.ndarray:
    """Where a value is another one than that before it."""
    known, full = pc.is_valid(a).to_numpy(zero_copy_only=False), a.fill_null("")
    return pc.not_equal(full[1:], full[:-1]).to_numpy(zero_copy_only=False) | (known[1:] != known[:-1])


class _Open:
    """A molecule whose rows may go on in the next batch: counts by symbol and position, never its reads."""

    def __init__(self, key: tuple):
        self.key, self.width, self.total, self.one, self.counts = key, None, 0, None, None

    def add(self, ids: pa.Array) -> None:
        """Reads without a cloneID are counted, but don't vote."""
        self.total += len(ids)
        ids = ids.drop_null()
        if not len(ids):
            return
        if self.width is None:
            self.one = ids[0].as_py()
            self.width = len(self.one)
            self.counts = np.zeros((len(BASES + GAPS), 1, self.width), np.int64)
        widths = pc.utf8_length(ids).to_numpy(zero_copy_only=False)
        _one_width(widths, np.full(len(widths), self.width))
        if self.width:
            step = max(1, 2_000_000 // self.width)
            for a in range(0, len(ids), step):
                self.counts += _counts(_characters(ids[a : a + step], self.width), np.array([0]))

    def row(self) -> pa.RecordBatch:
        text = self.one if self.total == 1 or not self.width else _texts(self.counts)[0].as_py()
        return _molecule_batch(*(pa.array([x], pa.string()) for x in (*self.key, text)), pa.array([self.total], pa.int64()))


def _molecule_batch(*columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), names=["cell_id", "umi", "clone_id", "read_count"])


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Molecules of reads (cell_id, umi, clone_id), those of a cell and UMI next to each other."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cell, umi, ids = (batch.column(k) for k in range(3))
        starts = np.flatnonzero(np.append(True, _differs(cell) | _differs(umi)))
        ends = np.append(starts[1:], batch.num_rows)
        key = lambda row: (cell[row].as_py(), umi[row].as_py())  # noqa: E731, B023
        if held and held.key == key(0):
            held.add(ids[: ends[0]])
            starts, ends = starts[1:], ends[1:]
        if not len(starts):
            continue
        if held:
            yield held.row()
        last = int(starts[-1])
        if ids.null_count:
            for a, b in zip(starts[:-1].tolist(), ends[:-1].tolist(), strict=True):
                one = _Open(key(a))
                one.add(ids[a:b])
                yield one.row()
            starts = starts[-1:]
        held = _Open(key(last))
        held.add(ids[last:])
        if len(starts) > 1:
            first, own = int(starts[0]), pa.array(starts[:-1])
            yield _molecule_batch(cell.take(own), umi.take(own), _votes(ids[first:last], starts[:-1] - first), pa.array(np.diff(starts)))
    if held:
        yield held.row()


def compute_molecules(reads: DataFrame) -> DataFrame:
    """(cell_id, umi, clone_id, read_count): the consensus of the reads of each cell and UMI.

    The reads are shuffled once, stand in the order of their molecules and are voted on a batch at a time; a
    molecule that goes on in the next batch is held as counts by position, so none is ever gathered. Equal reads
    are not counted before the shuffle: most are of different tasks, and the tables of counts went to disk. A
    single read is kept as it is.
    """
    near = reads.select("cell_id", "umi", "clone_id").repartition("cell_id", "umi")
    near = near.sortWithinPartitions(F.xxhash64("cell_id", "umi"), "cell_id", "umi")  # cell ids begin alike: by hash, few rows are compared in full
    return near.mapInArrow(_vote, MOLECULES)


def drop_low_complexity(molecules: DataFrame) -> DataFrame:
    return molecules.filter(~sq.is_low_complexity(F.col("clone_id")))


def similar_pairs(ids: DataFrame, min_overlap: int, max_hamming: int, k: int = 7) -> DataFrame:
    """(u, v), u < v: pairs of the distinct cloneIDs that are similar and, for k >= 5, share a k-mer.

    IDs with fewer known positions than min_overlap are similar to none and leave first. Of the others, those
    of the MOST_MASKS most frequent sets of known positions are joined by parts of the positions known in both
    (_pairs_by_parts), whose matches grow far less than those of a k-mer; the rest are joined with all by k-mers.
    The similarity is part of the join, on bits, so that what leaves it are links, not candidates.
    """
    known = ids.select("clone_id").distinct().filter(sq.known_length(F.col("clone_id")) >= min_overlap)
    known = known.select(F.col("clone_id").alias("id"), sq.packed(F.col("clone_id")).alias("p"))
    if k < 5:
        return pairs_in_blocks(known, lambda a, b: sq.is_similar(F.col("a.id"), F.col("b.id"), min_overlap, max_hamming, a, b)).distinct()
    known = materialize(known.withColumn("number", F.monotonically_increasing_id()))
    kinds = known.groupBy("p.known", F.length("id").alias("width")).agg(F.count("*").alias("n"))
    packed = kinds.filter("known is not null").orderBy(F.desc("n"), "known", "width").limit(MOST_MASKS).collect()
    widths, n_packed, n = kinds.agg(F.count_distinct("width"), F.sum(F.when(F.col("known").isNotNull(), F.col("n"))), F.sum("n")).first()
    usual = packed if widths == 1 and min_overlap >= 2 * (max_hamming + 2) else []  # IDs of several widths are an error of the k-mer join
    found = [_pairs_by_parts(known, [r["known"] for r in usual], min_overlap, max_hamming, k)] if usual else []
    rare = F.col("p").isNotNull() & (~F.col("p.known").isin([r["known"] for r in usual]) if usual else F.lit(True))
    words = known.select("id", "p", rare.alias("rare"), F.explode(F.array_distinct(sq.kmers(F.col("id"), k))).alias("kmer"))
    on = F.col("a.kmer") == F.col("b.kmer")
    link = (F.least("a.id", "b.id").alias("u"), F.greatest("a.id", "b.id").alias("v"))
    if (n_packed or 0) > sum(r["n"] for r in usual):
        a, b = words.filter("rare").alias("a"), words.filter("p is not null").alias("b")
        once = ~F.col("b.rare") | (F.col("a.id") < F.col("b.id"))
        found.append(a.join(b, on & once & sq.is_similar_packed(F.col("a.id"), F.col("b.id"), min_overlap, max_hamming, F.col("a.p"), F.col("b.p"))).select(*link))
    if (n or 0) > (n_packed or 0) or not found:
        a, b = words.filter("p is null").alias("a"), words.alias("b")
        once = F.when(F.col("b.p").isNull(), F.col("a.id") < F.col("b.id")).otherwise(F.lit(True))
        found.append(a.join(b, on & once & sq.is_similar(F.col("a.id"), F.col("b.id"), min_overlap, max_hamming, F.col("a.p"), F.col("b.p"))).select(*link))
    return reduce(DataFrame.unionByName, found).distinct() if len(found) > 1 or not usual else found[0]  # by parts, each pair is found once


def _longs(values: list[int]) -> Column:
    return F.expr(f"array({', '.join(f'{v}L' for v in values)})")


def _pairs_by_parts(known: DataFrame, masks: list[int], min_overlap: int, max_hamming: int, k: int) -> DataFrame:
    """(u, v), u < v: similar pairs of (id, number, p) with known positions as in the masks that share a k-mer.

    For each two masks, the positions known in both are cut into max_hamming + 2 parts. Similar IDs agree on two
    parts at least, and are joined by the first two on which they do, so that each pair is found once.
    """
    none = 1 << sq.PACKED_WIDTH  # stands for a part that is always different
    usual, rows = [], []  # of each choice of two parts: (positions known in both, earlier parts); (mask, choice, their positions)
    for x, left in enumerate(masks):
        for right in masks[x:]:
            both = left & right
            if both.bit_count() < min_overlap:
                continue
            parts = [sum(1 << int(i) for i in own) for own in np.array_split([i for i in range(sq.PACKED_WIDTH) if both >> i & 1], max_hamming + 2)]
            for i, j in combinations(range(len(parts)), 2):
                before = [p for place, p in enumerate(parts[:j]) if place != i]
                rows.append((left, right, len(usual), parts[i] | parts[j]))
                usual.append((both, before + [none] * (max_hamming - len(before))))
    if not rows:
        return known.select(F.col("id").alias("u"), F.col("id").alias("v")).limit(0)
    choices = F.broadcast(known.sparkSession.createDataFrame(rows, "left long, right long, choice int, at long"))
    own = known.select("number", F.col("p.known").alias("mask"), *[F.col(f"p.{x}").alias(x) for x in "abn"])

    def side(name: str) -> DataFrame:
        at = [F.col(x).bitwiseAND(F.col("at")) for x in "abn"]
        return own.join(choices, F.col("mask") == F.col(name)).select("choice", F.xxhash64(*at).alias("key"), "number", "a", "b", "n", (F.col("left") == F.col("right")).alias("same"))

    s, t = side("left").alias("s"), side("right").alias("t")
    differ = reduce(Column.bitwiseOR, [F.col(f"s.{x}").bitwiseXOR(F.col(f"t.{x}")) for x in "abn"]).bitwiseAND(_longs([u[0] for u in usual])[F.col("s.choice")])
    once = ~F.col("s.same") | (F.col("s.number") < F.col("t.number"))
    fits = F.bit_count(differ) <= max_hamming
    earlier = _longs([p for u in usual for p in u[1]])
    first = [differ.bitwiseOR(F.lit(none)).bitwiseAND(earlier[F.col("s.choice") * max_hamming + i]) != 0 for i in range(max_hamming)]
    links = s.join(t, (F.col("s.choice") == F.col("t.choice")) & (F.col("s.key") == F.col("t.key")) & once & reduce(Column.__and__, first, fits)).select(F.col("s.number").alias("x"), F.col("t.number").alias("y")).distinct()
    for x, u in (("x", "u"), ("y", "v")):
        links = links.join(known.select(F.col("number").alias(x), F.col("id").alias(u), F.col("p").alias(f"p{u}")), x)
    run, length = sq.packed_agreement(F.col("pu"), F.col("pv")), 1
    while length < k:  # a run of k equal known positions is a shared k-mer; only pairs without one compare texts
        step = min(length, k - length)
        run, length = run.bitwiseAND(F.shiftright(run, step)), length + step
    shared = F.when(run != 0, True).otherwise(F.arrays_overlap(sq.kmers(F.col("u"), k), sq.kmers(F.col("v"), k)))
    return links.filter(shared).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))


def pairs_in_blocks(ids: DataFrame, condition: Callable[[Column, Column], Column], per_block: int = 2048, least: int = 16) -> DataFrame:
    """(u, v), u < v, of all pairs of (id, p) that fulfil the condition on their packed forms: the ids are
    dealt into blocks, and each pair of blocks is a key of an equi-join of bounded size."""
    dealt, blocks = deal(ids, per_block, least)
    a, b = in_pairs(dealt, blocks)
    once = (F.col("a.i") < F.col("a.j")) | (F.col("a.id") < F.col("b.id"))
    return a.join(b.hint("shuffle_hash"), (F.col("a.i") == F.col("b.i")) & (F.col("a.j") == F.col("b.j")) & once & condition(F.col("a.p"), F.col("b.p"))).select(F.least("a.id", "b.id").alias("u"), F.greatest("a.id", "b.id").alias("v"))


def deal(ids: DataFrame, per_block: int = 2048, least: int = 16) -> tuple[DataFrame, int]:
    """ids with a block number, and the number of blocks, which comes from a count."""
    blocks = max(least, -(-ids.count() // per_block))
    return ids.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")), blocks


def in_pairs(dealt: DataFrame, blocks: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on (i, j), i <= j: a has the rows of block i, b those of block j."""
    a = dealt.select("*", F.col("block").alias("i"), F.explode(F.sequence(F.col("block"), F.lit(blocks - 1))).alias("j")).alias("a")
    b = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"), F.col("block").alias("j")).alias("b")
    return a, b


def correction_map(molecules: DataFrame, max_hamming: int = 5, min_overlap: int = 20, k: int = 7) -> DataFrame:
    """(clone_id, representative) of the cloneIDs that change: the most frequent of their cluster, ties to the greatest."""
    counts = materialize(molecules.groupBy("clone_id").agg(F.count("*").alias("n")))
    clusters = connected_components(similar_pairs(counts, min_overlap, max_hamming, k))
    placed = clusters.join(counts, F.col("node") == F.col("clone_id"))
    best = placed.groupBy("component").agg(F.max(F.struct("n", "clone_id"))["clone_id"].alias("representative"))
    return placed.join(best, "component").filter("clone_id <> representative").select("clone_id", "representative")


def correct(molecules: DataFrame, max_hamming: int = 5, min_overlap: int = 20, k: int = 7) -> DataFrame:
    """Molecules with clone_id corrected and the one before as original_clone_id."""
    changes = correction_map(molecules, max_hamming, min_overlap, k).withColumnRenamed("clone_id", "_from")
    return _apply(molecules, molecules.join(changes, F.col("clone_id") == F.col("_from"), "left"))


def _apply(molecules: DataFrame, joined: DataFrame) -> DataFrame:
    own = [c for c in molecules.columns if c not in ("clone_id", "original_clone_id")]
    return joined.select(*[joined[c] for c in own], F.col("clone_id").alias("original_clone_id"), F.coalesce("representative", "clone_id").alias("clone_id"))


def correction_map_per_cell(molecules: DataFrame, max_hamming: int = 5, min_overlap: int = 20) -> DataFrame:
    """(cell_id, clone_id, representative): clusters inside each cell; the representative is one of the
    longest known, of these the most frequent over all cells, ties to the greatest."""
    counts = molecules.groupBy("clone_id").agg(F.count("*").alias("n"))
    own = molecules.select("cell_id", "clone_id").distinct().filter(sq.known_length(F.col("clone_id")) >= min_overlap)
    own = own.select("cell_id", F.col("clone_id").alias("id"), sq.packed(F.col("clone_id")).alias("p"))
    a, b = own.alias("a"), own.alias("b")
    similar = sq.is_similar(F.col("a.id"), F.col("b.id"), min_overlap, max_hamming, F.col("a.p"), F.col("b.p"))
    name = lambda side: F.concat(F.col(f"{side}.cell_id"), F.lit("\t"), F.col(f"{side}.id"))
    pairs = a.join(b, (F.col("a.cell_id") == F.col("b.cell_id")) & (F.col("a.id") < F.col("b.id")) & similar).select(name("a").alias("u"), name("b").alias("v"))
    split = F.split("node", "\t")
    placed = connected_components(pairs).select("component", split[0].alias("cell_id"), split[1].alias("clone_id")).join(counts, "clone_id")
    rank = F.struct(sq.known_length(F.col("clone_id")).alias("known"), F.col("n"), F.col("clone_id"))
    best = placed.groupBy("component").agg(F.max(rank)["clone_id"].alias("representative"))
    return placed.join(best, "component").filter("clone_id <> representative").select("cell_id", "clone_id", "representative")


def correct_per_cell(molecules: DataFrame, max_hamming: int = 5, min_overlap: int = 20) -> DataFrame:
    changes = correction_map_per_cell(molecules, max_hamming, min_overlap).select(F.col("cell_id").alias("_cell"), F.col("clone_id").alias("_from"), "representative")
    return _apply(molecules, molecules.join(changes, (F.col("clone_id") == F.col("_from")) & (F.col("cell_id") == F.col("_cell")), "left"))


def _known_mask(clone_id: Column) -> Column:
    """1 where a position is known, 0 where it is not."""
    return F.regexp_replace(F.translate(clone_id, "-0", "\n\n"), "[^\n]", "1")


def _under(clone_id: Column, mask: Column) -> Column:
    """The characters at the positions that are 1 in the mask; positions past its end are left out."""
    kept = F.zip_with(F.split(clone_id, ""), F.split(mask, ""), lambda c, m: F.when(m == "1", c).otherwise(F.lit("")))
    return F.array_join(kept, "", "")


def _common_mask(a: Column, b: Column) -> Column:
    """1 where both masks are 1, cut at the shorter."""
    n = F.least(F.length(a), F.length(b))
    both = F.zip_with(F.slice(F.split(a, ""), F.lit(1), n), F.slice(F.split(b, ""), F.lit(1), n), lambda x, y: F.when((x == "1") & (y == "1"), F.lit("1")).otherwise(F.lit("0")))
    return F.array_join(both, "")


def exclude(molecules: DataFrame, excluded: DataFrame) -> DataFrame:
    """Without molecules whose cloneID is in the list, or agrees with an entry on all positions known in
    both while one of the two is partial.

    Lists may be long: equal IDs are found by hash. For the others there is one equi-join: IDs with the
    same known positions have the same mask, masks are few, and for each two masks IDs and entries are
    joined on their characters at the positions known in both, so no ID is compared with another one.
    A partial entry of another length than an ID is an error."""
    ids = molecules.select("clone_id").distinct()
    entries = excluded.select(F.col(excluded.columns[0]).alias("entry")).distinct()
    exact = ids.join(entries.select(F.col("entry").alias("clone_id")), "clone_id", "left_semi")
    rest = ids.join(exact, "clone_id", "left_anti").select("clone_id", _known_mask(F.col("clone_id")).alias("m"))
    entries = entries.select("entry", _known_mask(F.col("entry")).alias("e"))
    own = rest.groupBy("m").agg(F.lit(1).alias("one")).select("m", F.abs(F.hash(F.col("one"))).alias("x"))
    theirs = entries.groupBy("e").agg(F.lit(1).alias("one")).select("e", F.abs(F.hash(F.col("one"))).alias("x"))
    partial = F.col("m").contains("\n") | F.col("e").contains("\n")
    wrong = F.col("e").contains("\n") & (F.length("m") != F.length("e"))
    masks = own.join(theirs, "x").filter(F.when(wrong, F.raise_error(F.lit("sequences of unequal lengths")).cast("boolean")).otherwise(partial))
    masks = masks.select("m", "e", _common_mask(F.col("m"), F.col("e")).alias("both"))
    left = rest.join(masks, "m").select("clone_id", "m", "e", _under(F.col("clone_id"), F.col("both")).alias("key"))
    right = entries.join(masks, "e").select("m", "e", _under(F.col("entry"), F.col("both")).alias("key")).distinct()
    gone = exact.select("clone_id").unionByName(left.join(right, ["m", "e", "key"], "left_semi").select("clone_id"))
    return molecules.join(gone, "clone_id", "left_anti").select(*molecules.columns)


def full_id_stats(df: DataFrame) -> DataFrame:
    """(total, n_full, n_distinct_full) of a relation with clone_id."""
    full = F.when(sq.is_full(F.col("clone_id")), F.col("clone_id"))
    return df.agg(F.count("*").alias("total"), F.count(full).alias("n_full"), F.count_distinct(full).alias("n_distinct_full"))
