"""Column functions over cloneIDs: strings of bases, with - where a position is not covered and 0 where it is deleted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Widest cloneID whose bases fit into the bits of a long.
PACKED_WIDTH = 62
_PACKABLE = f"^[ACGTN0-]{{1,{PACKED_WIDTH}}}$"
_SYMBOLS = "ACGTN-0"


def is_full(clone_id: Column) -> Column:
    return ~clone_id.rlike("[-0]")


def trimmed(clone_id: Column) -> Column:
    """Without uncovered and deleted positions."""
    return F.translate(clone_id, "-0", "")


def known_length(clone_id: Column) -> Column:
    return F.length(trimmed(clone_id)).cast("long")


def n_dashes(clone_id: Column) -> Column:
    return (F.length(clone_id) - F.length(F.translate(clone_id, "-", ""))).cast("long")


def entropy(clone_id: Column) -> Column:
    """Shannon entropy in bits of the characters, each distinct one counted."""
    n = F.length(clone_id)
    share = lambda ch: (n - F.length(F.replace(clone_id, ch, F.lit("")))) / n
    return F.aggregate(F.array_distinct(F.split(clone_id, "")), F.lit(0.0), lambda acc, ch: acc - F.when(share(ch) > 0, share(ch) * F.log2(share(ch))).otherwise(0.0))


def is_low_complexity(clone_id: Column) -> Column:
    """Entropy under 1; it is 1 at least where no character has more than half of the places, which is seen first."""
    n, left = F.length(clone_id), F.length(F.translate(clone_id, _SYMBOLS, ""))
    often = F.greatest(left, *[n - F.length(F.replace(clone_id, F.lit(ch), F.lit(""))) for ch in _SYMBOLS])
    return F.when((n > 0) & (often * 2 <= n), False).otherwise(entropy(clone_id) < 1.0)


def kmers(text: Column, k: int) -> Column:
    """Overlapping k-mers; a text shorter than k has none. The characters are put side by side in k
    shifted arrays, which takes time in proportion to the text (substring would count from its start)."""
    n = F.length(text) - (k - 1)
    shifted = [F.slice(F.split(text, ""), F.lit(j + 1), n) for j in range(k)]
    joined = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.concat(x, y)), shifted)
    return F.when(n >= 1, joined).otherwise(F.array().cast("array<string>"))


def packed(clone_id: Column) -> Column:
    """struct(a, b, n, known): bit planes of the bases and of the known positions; null if they do not fit."""
    plane = lambda marks: F.conv(F.translate(clone_id, _SYMBOLS, marks), 2, 10).cast("long")
    return F.when(
        clone_id.rlike(_PACKABLE),
        F.struct(plane("0101000").alias("a"), plane("0011000").alias("b"), plane("0000100").alias("n"), plane("1111100").alias("known")),
    )


def _positions(s: Column, t: Column) -> tuple[Column, Column]:
    pairs = F.arrays_zip(F.split(s, "").alias("s"), F.split(t, "").alias("t"))
    known = F.filter(pairs, lambda p: ~p["s"].isin("-", "0", "") & ~p["t"].isin("-", "0"))
    return F.size(known), F.size(F.filter(known, lambda p: p["s"] != p["t"]))


def overlap_and_mismatches(s: Column, t: Column, ps: Column | None = None, pt: Column | None = None) -> tuple[Column, Column]:
    """Positions known in both, and those of them that differ. ps, pt: the packed forms, where already there."""
    ps, pt = packed(s) if ps is None else ps, packed(t) if pt is None else pt
    fits = ps.isNotNull() & pt.isNotNull()
    overlap, mismatches = _positions(s, t)
    return (F.when(fits, F.bit_count(_both_known(ps, pt))).otherwise(overlap), F.when(fits, packed_mismatches(ps, pt)).otherwise(mismatches))


def is_similar(s: Column, t: Column, min_overlap: int, max_hamming: int, ps: Column | None = None, pt: Column | None = None) -> Column:
    """At least min_overlap positions known in both, at most max_hamming of them differ; unequal lengths are an error."""
    overlap, mismatches = overlap_and_mismatches(s, t, ps, pt)
    found = (overlap >= min_overlap) & (mismatches <= max_hamming)
    return F.when(F.length(s) != F.length(t), F.raise_error(F.lit("sequences of unequal lengths"))).otherwise(found)


def is_similar_packed(s: Column, t: Column, min_overlap: int, max_hamming: int, ps: Column, pt: Column) -> Column:
    """is_similar for IDs that both have a packed form: on bits alone, which stay within generated code."""
    found = (F.bit_count(_both_known(ps, pt)) >= min_overlap) & (packed_mismatches(ps, pt) <= max_hamming)
    return F.when(F.length(s) != F.length(t), F.raise_error(F.lit("sequences of unequal lengths"))).otherwise(found)


def _both_known(ps: Column, pt: Column) -> Column:
    return ps["known"].bitwiseAND(pt["known"])


def packed_agreement(ps: Column, pt: Column) -> Column:
    """Bits of the positions known in both packed forms that are equal."""
    differ = ps["a"].bitwiseXOR(pt["a"]).bitwiseOR(ps["b"].bitwiseXOR(pt["b"])).bitwiseOR(ps["n"].bitwiseXOR(pt["n"]))
    return F.bitwise_not(differ).bitwiseAND(_both_known(ps, pt))


def packed_mismatches(ps: Column, pt: Column) -> Column:
    """Positions known in both packed forms that differ."""
    differ = ps["a"].bitwiseXOR(pt["a"]).bitwiseOR(ps["b"].bitwiseXOR(pt["b"])).bitwiseOR(ps["n"].bitwiseXOR(pt["n"]))
    return F.bit_count(differ.bitwiseAND(_both_known(ps, pt)))


def hamming(s: Column, t: Column) -> Column:
    """Plain Hamming distance of equally long texts."""
    pairs = F.arrays_zip(F.split(s, "").alias("s"), F.split(t, "").alias("t"))
    differ = F.size(F.filter(pairs, lambda p: p["s"] != p["t"])).cast("long")
    return F.when(F.length(s) != F.length(t), F.raise_error(F.lit("sequences of unequal lengths"))).otherwise(differ)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)
