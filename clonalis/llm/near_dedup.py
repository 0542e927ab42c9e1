"""Near-duplicate documents by MinHash: signatures of universal hash minima, banding, signature
verification, confirmation on full shingle sets, and connected components.

1. Each document's distinct word shingles become 64-bit hashes, and these a signature (the minima
   under HASHES universal functions). Documents with equal sets form a class, represented by its
   smallest id; only representatives go on.
2. Representatives that agree on all rows of a band share a bucket. Within buckets signatures are
   compared, in units of bounded size (see _links), and links whose estimated similarity is SLACK below
   the threshold or better join the members of a unit's connected parts.
3. Components of these give groups outside which no link can be. Within groups, in units again, the
   exact intersection sizes of the full sets come from matrix products.
4. Components of the confirmed links are the result.

A row of BANDS x ROWS minima misses a pair of similarity s with probability (1 - s^ROWS)^BANDS:
8e-7 at 0.85.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .runtime import Scratch, fresh, join_hot, lean
from .textvec import NON_SPACE, mix, shingle_sets, utf8_chunks, words_of

SHINGLE, THRESHOLD_PERCENT, BANDS, ROWS = 5, 85, 24, 5
HASHES = BANDS * ROWS
SLACK = 0.14  # over four standard deviations of the estimate from 120 minima
BLOCK = 96
#: Members of a group, about, that stand in each of its blocks.
LEADERS = 6
_STEP = 2048


def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def signature(shingles: np.ndarray, functions=_functions()) -> np.ndarray:
    """Minima of (a x + b mod 2^64) >> 32 over the 32 leading bits x of the shingles."""
    a, b = functions
    x = shingles >> np.uint64(32)
    least = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(x), _STEP):
            least = np.minimum(least, (a[:, None] * x[None, i : i + _STEP] + b[:, None]).min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint32)


_DESCRIBED = "n_shingles bigint, k1 bigint, k2 bigint, signature binary, bands array<bigint>"


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for batch in batches:
        for start, texts in utf8_chunks(batch.column(1)):
            sets = shingle_sets(words_of(texts, NON_SPACE), SHINGLE)
            n = len(sets)
            sums, xors, signed = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros((n, HASHES), np.uint32)
            with np.errstate(over="ignore"):
                for i, s in enumerate(sets):
                    if len(s):
                        sums[i], xors[i] = mix(s).sum(), np.bitwise_xor.reduce(s)
                        signed[i] = signature(s)
                keys = np.repeat(salt[None, :], n, axis=0)
                for r in range(ROWS):
                    keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + signed[:, r::ROWS].astype(np.uint64))
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(keys.view(np.int64).ravel()))
            short = (signed >> np.uint32(16)).astype(np.uint16)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(start, n), pa.array(sizes), pa.array(sums.view(np.int64)), pa.array(xors.view(np.int64)), pa.array([row.tobytes() for row in short], pa.binary()), bands],
                names=["doc_id", "n_shingles", "k1", "k2", "signature", "bands"],
            )


def _parts(adjacent: np.ndarray) -> np.ndarray:
    """Label (the smallest index) of each row's connected part of a symmetric boolean matrix."""
    n = len(adjacent)
    label = np.full(n, -1)
    for i in np.flatnonzero(adjacent.sum(axis=1) > 0):
        if label[i] >= 0:
            continue
        reached, fresh = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        fresh[i] = True
        while fresh.any():
            reached |= fresh
            fresh = adjacent[fresh].any(axis=0) & ~reached
        label[reached] = i
    return np.where(label < 0, np.arange(n), label)


def _alike_signatures(ids: np.ndarray, payload: list, percent: int) -> np.ndarray:
    signed = np.frombuffer(b"".join(payload), dtype=np.uint16).reshape(len(ids), -1)
    same = np.zeros((len(ids), len(ids)), dtype=np.uint8 if HASHES < 256 else np.uint16)
    for column in np.ascontiguousarray(signed.T):
        same += column[:, None] == column[None, :]
    return same >= (percent / 100 - SLACK) * HASHES


def _alike_sets(ids: np.ndarray, payload: list, percent: int) -> np.ndarray:
    """100 * intersection >= percent * union, by products of incidence matrices, some columns at a time."""
    sets = [np.frombuffer(p, dtype=np.uint64) for p in payload]
    sizes = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat := np.concatenate(sets))
    flat, row = flat[order], row[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]]) if len(flat) else np.empty(0, bool)
    column = np.cumsum(new) - 1
    shared = np.bincount(column, minlength=1)[column] > 1 if len(flat) else np.empty(0, bool)
    row, column = row[shared], column[shared]
    column = np.cumsum(np.concatenate([[False], column[1:] != column[:-1]])) if len(column) else column
    common = np.zeros((len(sets), len(sets)), dtype=np.float64)
    width = max(64, (16 << 20) // (4 * len(sets)))
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [first, first + width])
        part = np.zeros((len(sets), min(width, int(column[-1]) + 1 - first)), dtype=np.float32)
        part[row[a:b], column[a:b] - first] = 1
        common += part @ part.T
    union = sizes[:, None] + sizes[None, :] - common
    return (100 * common >= percent * union) & (common > 0)


def _linked(alike: Callable, percent: int) -> Callable:
    """For sorted rows (unit, id, payload): (u, v) that join the members of each unit's parts."""

    def unit_links(ids: np.ndarray, payload: list) -> tuple[np.ndarray, np.ndarray]:
        adjacent = alike(ids, payload, percent)
        np.fill_diagonal(adjacent, False)
        label = _parts(adjacent)
        moved = label != np.arange(len(ids))
        return ids[label[moved]], ids[moved]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[tuple, np.ndarray, list]] = []
        out: list[tuple[np.ndarray, np.ndarray]] = []

        def close() -> None:
            if held and sum(len(h[1]) for h in held) > 1:
                out.append(unit_links(np.concatenate([h[1] for h in held]), [p for h in held for p in h[2]]))
            held.clear()

        for batch in batches:
            units = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            ids, payload = batch.column(3).to_numpy(zero_copy_only=False), batch.column(4)
            cuts = np.flatnonzero(np.any([u[1:] != u[:-1] for u in units], axis=0)) + 1 if len(ids) else []
            edges = [0, *np.asarray(cuts).tolist(), len(ids)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                unit = tuple(int(u[a]) for u in units)
                if held and held[0][0] != unit:
                    close()
                held.append((unit, ids[a:b], payload.slice(a, b - a).to_pylist()))
            if out:
                yield _edges(out)
                out.clear()
        close()
        if out:
            yield _edges(out)

    return run


def _edges(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[i] for p in parts]).astype(np.int64)) for i in (0, 1)], names=["u", "v"])


def _run(units: DataFrame, payloads: DataFrame, alike: Callable, percent: int) -> DataFrame:
    """Links within units (g, i, j, id). payloads: (id, payload). Members carry their payload to the units they are in."""
    n = max(1, int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    full = units.join(payloads, "id").select("g", "i", "j", "id", "payload")
    return full.repartition(n, "g", "i", "j").sortWithinPartitions("g", "i", "j", "id").mapInArrow(lean(_linked(alike, percent)), "u bigint, v bigint")


def _links(scratch: Scratch, members: DataFrame, payloads: DataFrame, alike: Callable, percent: int) -> DataFrame:
    """(u, v): links whose connected parts are those of all links between members (g, id) of a group.

    A group of up to BLOCK members is one unit, in which all are compared. A larger one is cut into blocks,
    and some leaders are put into every block; in most groups of near copies that joins nearly all members.
    Each member that isn't joined with the largest part so found is then compared with all others, by pairs
    of blocks: pairs within that part, which need no further link, are the only ones left out. So the work
    grows with the members times those outside the largest part.
    """
    sizes = scratch.save(members.groupBy(F.col("g").alias("_g")).agg(F.count("*").alias("n"), F.min("id").alias("_first")).filter(F.col("n") > 1), "sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    counted = scratch.save(join_hot(members, "g", sizes, "_g", "n", total).select("g", "id", "n", "_first"), "counted", total)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    small = counted.filter(F.col("n") <= BLOCK).select("g", F.lit(0).alias("i"), F.lit(0).alias("j"), "id")
    big = counted.filter(F.col("n") > BLOCK)
    own = big.select("g", F.lit(0).alias("i"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("j"), "id")
    leads = (F.col("id") == F.col("_first")) | (F.pmod(F.xxhash64(F.lit("lead"), "id"), F.ceil(F.col("n") / LEADERS)) == 0)
    everywhere = big.filter(leads).select("g", F.lit(0).alias("i"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("j"), "id")
    first = scratch.save(_run(small.unionByName(own).unionByName(everywhere).distinct(), payloads, alike, percent).distinct(), "first")
    if sizes.filter(F.col("n") > BLOCK).isEmpty():
        return first
    placed = connected_components(first)
    inside = big.select("g", "id", "n").join(placed.withColumnRenamed("node", "_node"), F.col("id") == F.col("_node"), "left")
    inside = scratch.save(inside.select("g", "id", "n", F.coalesce("component", "id").alias("part")), "inside", total)
    main = inside.groupBy("g", "part").agg(F.count("*").alias("m")).groupBy(F.col("g").alias("_g")).agg(F.max(F.struct("m", "part"))["part"].alias("_main"), F.sum("m").alias("_all"))
    rest = scratch.save(join_hot(inside, "g", scratch.save(main, "main", total // BLOCK), "_g", "_all", total).filter(F.col("part") != F.col("_main")).select("g", "id", "n"), "rest", total)
    left = scratch.save(rest.groupBy(F.col("g").alias("_g")).agg(F.count("*").alias("_r"), F.max("n").alias("_all")), "left", total // BLOCK)
    if left.isEmpty():
        return first
    across = F.ceil(F.col("_r") / BLOCK).cast("int")
    i, j = F.pmod(F.xxhash64("id"), across).cast("int").alias("i"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("j")
    alone = join_hot(rest, "g", left, "_g", "_r", total).select("g", i, F.explode(F.sequence(F.lit(0), blocks - 1)).alias("j"), "id")
    others = join_hot(inside.select("g", "id", "n"), "g", left, "_g", "_all", total).select("g", F.explode(F.sequence(F.lit(0), across - 1)).alias("i"), j, "id")
    return first.unionByName(scratch.save(_run(alone.unionByName(others).distinct(), payloads, alike, percent).distinct(), "second"))


def _keys(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that tell sets apart, 0 for the empty one."""
    return (int(mix(shingles).sum().view(np.int64)), int(np.bitwise_xor.reduce(shingles).view(np.int64))) if len(shingles) else (0, 0)


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, k1, k2) to (id, k1, k2, set) of those whose set has these keys."""
    for batch in batches:
        for start, texts in utf8_chunks(batch.column(1)):
            sets = shingle_sets(words_of(texts, NON_SPACE), SHINGLE)
            ids, k1, k2 = (batch.column(c).slice(start, len(sets)) for c in (0, 2, 3))
            kept = [i for i, s in enumerate(sets) if _keys(s) == (k1[i].as_py(), k2[i].as_py())]
            place = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(place), k1.take(place), k2.take(place), pa.array([sets[i].tobytes() for i in kept], pa.binary())], names=["id", "k1", "k2", "payload"])


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """Per document: doc_id, n_shingles, class_id (smallest id with an equal set), component_id
    (smallest id reachable over links), kept (it is that document itself).

    A document's set holds its distinct 5-word shingles (words: runs of anything but space and
    \\t\\n\\v\\f\\r, A-Z lower-cased); with fewer words, the whole sequence. Documents are linked if
    100 * intersection >= percent * union. Null, empty and blank texts have an empty set, no link, and
    are kept. Rows that repeat an id and a text are each returned with the same values; rows that share an
    id and differ in text each go with their own text, and where that id is the smallest of two texts'
    classes these are linked. Ids are integers, and a row with a null id is its own component and kept. Empty tables give empty results; other
    columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    described = scratch.save(source.mapInArrow(lean(_describe), "doc_id bigint, " + _DESCRIBED), "described")
    live = described.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = scratch.save(live.groupBy("k1", "k2", "n_shingles").agg(
        F.min("doc_id").alias("class_id"), F.count("*").alias("_rows"), F.min_by(F.struct("signature", "bands"), "doc_id").alias("own")
    ).select("k1", "k2", "n_shingles", "class_id", "_rows", "own.signature", "own.bands"), "classes")
    first = classes.select(F.col("class_id").alias("doc_id"), "k1", "k2")
    banded = classes.select(F.col("class_id").alias("id"), F.explode("bands").alias("g")).select("g", "id")
    signed = classes.select(F.col("class_id").alias("id"), F.col("signature").alias("payload"))
    likely = _links(scratch, banded, signed, _alike_signatures, percent)

    groups = scratch.save(connected_components(likely).select(F.col("component").alias("g"), F.col("node").alias("id")), "groups")
    wanted = first.join(groups.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "k1", "k2")
    texts = source.join(wanted, "doc_id").select("doc_id", "text", "k1", "k2").mapInArrow(lean(_sets_of), "id bigint, k1 bigint, k2 bigint, payload binary")
    sets = scratch.save(texts.groupBy("id", "k1", "k2").agg(F.first("payload").alias("payload")).select("id", "payload"), "sets")
    found = scratch.save(connected_components(_links(scratch, groups, sets, _alike_sets, percent)), "found")
    scratch.drop(sets)

    placed = classes.join(found, F.col("class_id") == F.col("node"), "left").select(
        F.struct("k1", "k2", "n_shingles").alias("_class"), "class_id", F.coalesce("component", "class_id").alias("component_id"), "_rows",
    )
    placed = scratch.save(placed, "placed")
    keyed = described.select("doc_id", "n_shingles", F.struct("k1", "k2", "n_shingles").alias("_key"))
    alive = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    joined = join_hot(keyed.filter(alive), "_key", placed, "_class", "_rows", described.count()).select("doc_id", "n_shingles", "class_id", "component_id")
    alone = keyed.filter(~alive).select("doc_id", "n_shingles", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    return joined.unionByName(alone).select("*", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """The documents that near_duplicates keeps: one of each component, with docs' columns. Rows that share an id
    go together: they stay if one of them is kept."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, percent=percent)
    name = fresh("_gone", docs)
    gone = found.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias(name)).agg(F.max("kept").alias("kept")).filter(~F.col("kept")).select(name)
    return docs.join(gone, docs[id_col].cast("long") == F.col(name), "left_anti")
