"""Streaming coverage: alignments that arrive are counted by reference and window of positions.

The state of a window is two counters, so it does not grow with the reads in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_depth(stream: DataFrame, read_length: int, width: int = 1024) -> DataFrame:
    """(ref_id, bin, reads, bases) so far of a stream of mapped alignments."""
    rows = stream.where(F.col("flag").bitwiseAND(4) == 0)
    return rows.groupBy("ref_id", F.floor(F.col("pos") / width).alias("bin")).agg(F.count("*").alias("reads"), (F.count("*") * read_length).alias("bases"))


def windowed_depth(stream: DataFrame, read_length: int, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """The same for each time window of arrival (column ts), dropped from state once ``late`` has passed."""
    rows = stream.where(F.col("flag").bitwiseAND(4) == 0).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", window), "ref_id").agg(F.count("*").alias("reads"), (F.count("*") * read_length).alias("bases"))
