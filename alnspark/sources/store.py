"""Alignments stored by coordinate, with the spans of their files as a zone map.

A view of a region asks the map which files can hold it and reads only these; within them Parquet's own statistics go on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

AXIS = ["ref_id", "pos", "aln_idx"]
ROWS = 1_000_000


def write(aln: DataFrame, path: str, rows_per_file: int = ROWS) -> None:
    """The alignments in ranges of coordinates, and a row of the map for each file: its rows, first and last place."""
    dealt = aln.repartitionByRange(*AXIS).sortWithinPartitions(*AXIS)
    dealt.write.option("maxRecordsPerFile", rows_per_file).parquet(f"{path}/rows")
    place = F.struct("ref_id", "pos")
    spans = aln.sparkSession.read.schema(aln.schema).parquet(f"{path}/rows").groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"), F.min(place).alias("lo"), F.max(place).alias("hi"))
    spans.write.parquet(f"{path}/spans")


def spans(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, lo, hi, before): the files in order; ``before`` counts the alignments in those ahead.  One row a file."""
    rows = spark.read.parquet(f"{path}/spans")
    ahead = Window.orderBy("lo", "hi", "file").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))


def _picked(spark: SparkSession, path: str, wanted: Column) -> DataFrame:
    """The rows of the files that the map picks."""
    schema = spark.read.parquet(f"{path}/rows").schema
    files = [r[0] for r in spark.read.parquet(f"{path}/spans").where(wanted).select("file").collect()]  # the names that the scan takes
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


def view(spark: SparkSession, path: str, ref_id: int, start: int, stop: int) -> DataFrame:
    """The alignments that begin in [start, stop) of a reference."""
    at = lambda pos: F.struct(F.lit(ref_id).alias("ref_id"), F.lit(pos).alias("pos"))
    found = _picked(spark, path, (F.col("lo") < at(stop)) & (F.col("hi") >= at(start)))
    return found.where((F.col("ref_id") == ref_id) & (F.col("pos") >= start) & (F.col("pos") < stop))


def block_of(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The rows of the file that holds the ``n``-th alignment (from 0) in coordinate order."""
    found = spans(spark, path).where((F.col("before") <= n) & (F.col("before") + F.col("n") > n)).select("file").first()
    schema = spark.read.parquet(f"{path}/rows").schema
    return spark.read.schema(schema).parquet(found[0]) if found else spark.createDataFrame([], schema)
