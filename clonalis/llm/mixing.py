"""Mixing sources to target weights by capped water-filling; DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import Scratch

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Adds weight and target to (source, source_size), one row a source.

    Sources by code point, null last, get the weights in turn. share * all sizes is dealt out by
    weight; no target exceeds cap * source_size, and what a cap leaves over goes to the others by
    weight. In ascending order of cap / weight the capped sources are a prefix, so the water level
    comes from running sums instead of rounds. The table has one row a source, never one a document.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    by_ratio = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    t = sources.select("source", F.col("source_size").cast("long").alias("source_size"), pick.alias("weight"))
    t = t.select("*", (F.col("source_size") * F.lit(float(cap))).alias("_cap"))
    t = t.select("*", (F.col("_cap") / F.col("weight")).alias("_ratio"))
    t = t.select(
        "*",
        (F.sum("source_size").over(all_rows) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))).alias("_left"),
        (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("_weights"),
    )
    t = t.select("*", (F.col("_left") * F.col("weight") >= F.col("_cap") * F.col("_weights")).alias("_capped"))
    t = t.select(
        "*",
        F.min(F.when(~F.col("_capped"), F.struct("_ratio", F.col("source").isNull().alias("n"), "source", "_left", "_weights"))).over(all_rows).alias("_level"),
    )
    return t.select(
        "source", "source_size", "weight",
        F.when(
            F.col("_level").isNull() | (F.col("_ratio") < F.col("_level._ratio")) | F.col("_capped"), F.col("_cap")
        ).otherwise(F.col("weight") * F.col("_level._left") / F.col("_level._weights")).alias("target"),
    )


def mix_sources(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 5,
) -> DataFrame:
    """How much of each document a mix of the sources takes.

    Returns doc_id, source, size, source_size, weight, target (of its source), repeats, taken
    (= repeats * size). Each document is taken floor(target / source_size) times; a seeded prefix of
    its source, whose sizes add up to the remainder to within half a document, is taken once more.
    Documents stand in the order of md5(seed, id): sums over 4096 leading-digit buckets a source find
    the bucket in which the prefix ends, and only that bucket's rows are put in order, so no task
    gathers a source. Equal rows may swap places, which changes no count.

    Null text has size 0; null id and null source are values like others; a source whose texts have no
    words has target 0 and repeats 0; an empty table gives an empty result; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    narrow = scratch.save(docs.select(*_placed(docs, id_col, text_col, source_col, seed)))
    return _decided(narrow, _plan(narrow, scratch, weights, share, cap)).select(
        "doc_id", "source", "size", "source_size", "weight", "target", "repeats", (F.col("repeats") * F.col("size")).cast("long").alias("taken"),
    )


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> list[Column]:
    """doc_id, source, size, and a row's place in the seeded order with its bucket."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(docs[id_col].cast("string"), F.lit("null"))))
    bucket = F.conv(F.substring(key, 1, 3), 16, 10).cast("int")
    return [docs[id_col].alias("doc_id"), docs[source_col].alias("source"), word_count(docs[text_col]).alias("size"), key.alias("_key"), bucket.alias("_bucket")]


def _plan(narrow: DataFrame, scratch: Scratch, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """A row a source: its sums, weight and target, whole repeats, and the bucket in which the prefix ends."""
    counted = scratch.save(narrow.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum")))
    sources = water_fill(counted.groupBy("source").agg(F.sum("_sum").alias("source_size")), weights, share, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    sources = sources.select("*", whole.cast("long").alias("_whole"))
    sources = scratch.save(sources.select("*", (F.col("target") - F.col("_whole") * F.col("source_size")).alias("_more")))
    running = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    ends = (
        counted.select("source", "_bucket", "_sum", F.sum("_sum").over(running).alias("_cum"))
        .join(sources.select(F.col("source").alias("_s"), "_more"), F.col("source").eqNullSafe(F.col("_s")))
        .filter((F.col("_cum") > F.col("_more")) & (F.col("_cum") - F.col("_sum") <= F.col("_more")) & (F.col("_sum") > 0))
        .groupBy("_s").agg(F.min(F.struct("_bucket", (F.col("_cum") - F.col("_sum")).alias("_before"))).alias("_end"))
    )
    return scratch.save(sources.join(ends.select(F.col("_s"), "_end"), F.col("source").eqNullSafe(F.col("_s")), "left").select(
        F.col("source").alias("_src"), "source_size", "weight", "target", "_whole", "_more",
        F.coalesce(F.col("_end._bucket"), F.lit(BUCKETS)).alias("_last"), F.coalesce(F.col("_end._before"), F.lit(0)).alias("_before"),
    ))


def _decided(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds the plan and repeats to rows with _placed's columns: by bucket, and in the last bucket by running sums."""
    rows = rows.join(plan, rows["source"].eqNullSafe(plan["_src"]))
    at_end = rows.filter(F.col("_bucket") == F.col("_last"))
    inside = Window.partitionBy("source").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    at_end = at_end.select("*", (F.col("_before") + F.sum("size").over(inside) - F.col("size") / 2 <= F.col("_more")).alias("_extra"))
    others = rows.filter(F.col("_bucket") != F.col("_last")).select("*", (F.col("_bucket") < F.col("_last")).alias("_extra"))
    repeats = F.when(F.col("source_size") > 0, F.col("_whole") + (F.col("_extra") & (F.col("_more") > 0)).cast("long")).otherwise(0)
    return others.unionByName(at_end).withColumn("repeats", repeats.cast("long"))


def mixed_documents(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 5,
) -> DataFrame:
    """The mix itself: each row as many times as mix_sources takes it, with docs' columns.

    Rows are decided on where they stand, by source and bucket, so nothing is joined by id: rows that
    share an id, or have none, each have their own number. Only the rows of a source's last bucket, a
    4096th of it, are put in order."""
    scratch = Scratch(docs.sparkSession, "mix")
    placed = _placed(docs, id_col, text_col, source_col, seed)
    plan = _plan(scratch.save(docs.select(*placed)), scratch, weights, share, cap)
    rows = _decided(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), *placed), plan).filter(F.col("repeats") > 0)
    return rows.select("_row", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int")))).select("_row.*")
