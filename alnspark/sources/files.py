"""Places for files, and text with its line numbers and byte offsets."""

from __future__ import annotations

import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def new_path(spark: SparkSession, label: str) -> str:
    """A new path below the folder that driver and executors share (``spark.checkpoint.dir``)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:  # a session in one process may have a folder of its own
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(Path(tempfile.mkdtemp(prefix="spark-")).as_uri())
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` by way of files in the shared folder: what follows starts from them."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _running(rows: DataFrame, value: Column, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the file's lines before.  Sums are kept a split, and carried."""
    rows = rows.withColumn("_x", value)
    sums = rows.groupBy("file", "_split").agg(F.sum("_x").alias("_sum"))
    upto = Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select("file", "_split", F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_carry"))
    here = Window.partitionBy("file", "_split").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    both = rows.withColumn("_here", F.coalesce(F.sum("_x").over(here), F.lit(0))).join(carry, ["file", "_split"])
    return both.withColumn(out, (F.col("_carry") + F.col("_here")).cast("long")).drop("_x", "_here", "_carry")


def lines(spark: SparkSession, path: str, marks: dict[str, Column] | None = None) -> DataFrame:
    """(file, line, offset, value) of text files: line numbers and byte offsets from 0, values without the line break.

    A file is read by splits; each of ``marks`` is a condition on ``value`` and adds the number of lines before
    that meet it."""
    raw = spark.read.option("lineSep", "\n").text(path)
    rows = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_at"))
    rows = _running(_running(rows, F.lit(1).cast("long"), "line"), F.octet_length("value").cast("long") + 1, "offset")
    rows = rows.withColumn("value", F.regexp_replace("value", "\r$", ""))
    for name, condition in (marks or {}).items():
        rows = _running(rows, condition.cast("long"), name)
    return rows.drop("_split", "_at")


def write_lines(rows: DataFrame, order: list[str], path: str) -> None:
    """A small table's column ``value`` as the lines of one file, in order."""
    rows.coalesce(1).sortWithinPartitions(*order).select("value").write.text(path)
