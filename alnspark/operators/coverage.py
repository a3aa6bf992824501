"""Coverage depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alnspark.operators import ordered


def depth(aln: DataFrame, read_length: int) -> DataFrame:
    """(ref_id, bases, covered): sum of read lengths and covered positions, without a row for each base.

    Reads are counted at their start first; a start newly covers its distance to the one before, at most a read."""
    starts = aln.groupBy("ref_id", "pos").agg(F.count("*").alias("n"))
    rows = ordered.previous(starts, ["ref_id"], ["pos"], "pos", "_before")
    new = F.least(F.coalesce(F.col("pos") - F.col("_before"), F.lit(read_length)), F.lit(read_length))
    return rows.groupBy("ref_id").agg((F.sum("n") * read_length).alias("bases"), F.sum(new).cast("long").alias("covered"))


def depth_by_base(aln: DataFrame, read_length: int | Column) -> DataFrame:
    """(ref_id, base, depth) of every covered base."""
    stop = F.col("pos") + read_length - 1
    return aln.select("ref_id", F.explode(F.sequence("pos", stop)).alias("base")).groupBy("ref_id", "base").agg(F.count("*").alias("depth"))
