"""Interval joins, block summaries and as-of seeks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alnspark.operators import ordered
from alnspark.sources import files

#: Bins of the lowest level span 2**FIRST places, and each level's 2**STEP times as many as those below; the last one is everything.
FIRST, STEP, LEVELS = 10, 3, 18


def _own_bin(df: DataFrame, prefix: str) -> DataFrame:
    """Add ``_level`` and ``_bin``: the least bin that holds the whole interval.  However long, it is one row."""
    lo, hi = (F.col(f"{prefix}_{end}").cast("long") for end in ("start", "stop"))
    level = F.lit(LEVELS)
    for n in range(LEVELS - 1, -1, -1):
        level = F.when(F.shiftright(lo, FIRST + STEP * n) == F.shiftright(hi, FIRST + STEP * n), n).otherwise(level)
    return df.withColumn("_level", level).withColumn("_bin", _bin_at(lo, F.col("_level")))


def _bin_at(place: Column, level: Column) -> Column:
    return F.when(level < LEVELS, F.call_function("shiftright", place.cast("long"), FIRST + STEP * level)).otherwise(0)


def _levels(df: DataFrame) -> list[int]:
    """The levels in use; there are ``LEVELS`` + 1 at most."""
    return sorted(r[0] for r in df.select("_level").distinct().collect())


def _asking(df: DataFrame, prefix: str, levels: list[int], own: bool) -> DataFrame:
    """A row for each bin of ``levels`` above the interval's own one, and with ``own`` for that too."""
    above = F.col("_level") <= F.col("_up") if own else F.col("_level") < F.col("_up")
    up = df.withColumn("_up", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>"))).where(above)
    return up.withColumns({"_level": F.col("_up"), "_bin": _bin_at(F.col(f"{prefix}_start"), F.col("_up"))}).drop("_up")


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of closed intervals of one reference that overlap.

    ``a`` has ref_id, a_start, a_stop and ``b`` has ref_id, b_start, b_stop.  Bins are nested, and each interval lies in one.  Two that overlap
    have bins of which one holds the other, so each asks the levels above its own that the other side uses."""
    a, b = _own_bin(a, "a"), _own_bin(b, "b")
    on = ["ref_id", "_level", "_bin"]
    up = _asking(a, "a", _levels(b), True).join(b, on)
    down = a.join(_asking(b, "b", _levels(a), False), on).select(up.columns)
    return up.union(down).where((F.col("a_start") <= F.col("b_stop")) & (F.col("a_stop") >= F.col("b_start"))).drop("_level", "_bin")


def contained(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs in which ``a`` lies inside ``b``: then the bin of ``b`` holds that of ``a``."""
    a, b = _own_bin(a, "a"), _own_bin(b, "b")
    both = _asking(a, "a", _levels(b), True).join(b, ["ref_id", "_level", "_bin"])
    return both.where((F.col("a_start") >= F.col("b_start")) & (F.col("a_stop") <= F.col("b_stop"))).drop("_level", "_bin")


def overlap_totals(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """``b`` with the number ``n`` and the sum ``total`` of ``value`` of the intervals of ``a`` that overlap it, if any do: ``overlap``, grouped, without its pairs."""
    return _totals(a, b, value, "a_start", "a_stop")


def contained_totals(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """``b`` with the number ``n`` and the sum ``total`` of ``value`` of the intervals of ``a`` that lie inside it, if any do: ``contained``, grouped, without its pairs."""
    return _totals(a, b, value, "a_stop", "a_start")


def _totals(a: DataFrame, b: DataFrame, value: str, x: str, y: str) -> DataFrame:
    """Of the points (``x``, ``y``) of ``a``, those with x <= b_stop and y >= b_start.

    Blocks of 2**level places are nested: a stop is the end of one block for each bit set in it, and a point lies in one block a level (an
    odd one is never asked).  Equal points are one; in each block they and the asking starts are summed up in one ordered pass, so the
    work grows with the rows of both sides times the bits of a place, however many pairs there are.  Places are within 2**62 of each other."""
    on = ["ref_id", "b_start", "b_stop"]
    points = a.where(F.col("ref_id").isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull()).select("ref_id", F.col(x).cast("long").alias("_x"), F.col(y).cast("long").alias("_y"), value)
    points = files.stored(points.groupBy("ref_id", "_x", "_y").agg(F.count("*").alias("_n"), F.sum(value).alias("_total")), "points")
    low, high = points.agg(F.min("_x"), F.max("_x")).first()
    low, high = low or 0, high or 0
    levels = F.explode(F.array(*[F.lit(n) for n in range((high - low + 1).bit_length())]))
    at = points.withColumn("_place", F.col("_x") - low).withColumn("_level", levels).withColumn("_bin", _block("_place"))
    at = at.where(F.col("_bin") % 2 == 0).select("ref_id", "_level", "_bin", F.bitwise_not("_y").alias("_order"), F.lit(0).alias("_side"), "_n", "_total", *[F.lit(None).cast("long").alias(c) for c in on[1:]])
    asked = b.where("b_start IS NOT NULL").select("ref_id", *[F.col(c).cast("long") for c in on[1:]]).distinct().where(F.col("b_stop") >= low)
    asked = asked.withColumn("_place", F.least("b_stop", F.lit(high)) - low + 1).withColumn("_level", levels).withColumn("_bin", _block("_place")).where(F.col("_bin") % 2 == 1)
    asked = asked.select("ref_id", "_level", F.col("_bin") - 1, F.bitwise_not("b_start"), F.lit(1), F.lit(0).cast("long"), F.lit(0).cast("long"), *on[1:])
    both, key, order = at.union(asked), ["ref_id", "_level", "_bin"], ["_order", "_side"]  # a point at the start itself comes before it
    for c in ("_n", "_total"):
        both = ordered.running_sum(both, key, order, F.col(c), c)
    found = both.where("_side = 1").groupBy(*on).agg(F.sum("_n").alias("n"), F.sum("_total").alias("total")).where("n > 0")
    return b.join(found, on)


def _block(place: str) -> Column:
    return F.call_function("shiftright", F.col(place), F.col("_level"))


def block_spans(aln: DataFrame, rows: int) -> DataFrame:
    """Blocks of ``rows`` alignments in coordinate order: their span, and the alignments before."""
    at = aln.withColumn("_axis", F.col("ref_id").cast("long") * (1 << 32) + F.col("pos"))
    numbered = ordered.row_numbers(at, [], ["_axis", "aln_idx"], "_n")
    where = F.struct("_axis", "aln_idx")
    return numbered.groupBy(F.floor((F.col("_n") - 1) / rows).alias("block")).agg(
        F.min(F.col("_n") - 1).alias("aln_before"), F.min_by("ref_id", where).alias("start_ref"), F.min_by("pos", where).alias("start_pos"),
        F.max_by("ref_id", where).alias("end_ref"), F.max_by("pos", where).alias("end_pos"),
    )


def seek(targets: DataFrame, blocks: DataFrame) -> DataFrame:
    """For each ``target``: the last block with fewer alignments before it.  An as-of join by one ordered pass."""
    both = targets.select(F.col("target").alias("at"), F.lit(None).cast("long").alias("block"), F.lit(0).alias("side")).union(
        blocks.select(F.col("aln_before").alias("at"), "block", F.lit(1).alias("side"))
    )
    # a block at the target itself sorts after it
    return ordered.latest(both, [], ["at", "side"], "block", "found").where("side = 0").select(F.col("at").alias("target"), F.col("found").alias("block"))


def split_by_reference(blocks: DataFrame, lengths: DataFrame) -> DataFrame:
    """One piece for each reference that a block touches: its end, whole references between, its start."""
    each = blocks.withColumn("ref_id", F.explode(F.sequence("start_ref", "end_ref"))).join(lengths, "ref_id")
    return each.select(
        "block", "ref_id", F.when(F.col("ref_id") == F.col("start_ref"), F.col("start_pos")).otherwise(0).alias("start"),
        F.when(F.col("ref_id") == F.col("end_ref"), F.col("end_pos")).otherwise(F.col("length") - 1).cast("int").alias("stop"),
    )


def overlapping_blocks(pieces: DataFrame, regions: DataFrame) -> DataFrame:
    """The blocks that regions (ref_id, start, stop) touch, each once."""
    hits = overlap(pieces.withColumnsRenamed({"start": "a_start", "stop": "a_stop"}), regions.withColumnsRenamed({"start": "b_start", "stop": "b_stop"}))
    return hits.select("block").dropDuplicates()
