"""Text logs of sizes, error rates and times as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alnspark.functions.text import clock_seconds, unaligned_reads
from alnspark.sources import files


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return files.lines(spark, path).withColumnRenamed("line", "at")


def carried(lines: DataFrame, header: str) -> DataFrame:
    """Add ``section``: the match of ``header`` in the file's last line that has one.  Logs are small files."""
    found = F.regexp_extract("value", header, 1)
    return lines.withColumn("section", F.last(F.when(found != "", found), ignorenulls=True).over(Window.partitionBy("file").orderBy("at")))


def sizes(spark: SparkSession, path: str) -> DataFrame:
    """(method, bytes, path) of "# method" sections with "bytes path" rows."""
    rows = carried(_lines(spark, path), r"^#\s*(\S+)").where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return rows.select(F.col("section").alias("method"), F.regexp_extract("value", r"^\s*(\d+)", 1).cast("long").alias("bytes"), F.regexp_extract("value", r"(\S+)\s*$", 1).alias("path"))


def error_rates(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, z, edits, bytes) of "*** dataset z=..." sections with an "edits: n" row and "bytes path" rows."""
    rows = carried(_lines(spark, path), r"^\*\*\*\s*(.*\S)")
    edits, size = F.regexp_extract("value", r"[Ee]dits:\s*(\d+)", 1), F.regexp_extract("value", r"^\s*(\d+)\s+\S+", 1)
    number = lambda c: F.expr(f"try_cast({c} AS long)")
    out = rows.select("section", edits.alias("e"), size.alias("b")).groupBy("section").agg(F.max(number("e")).alias("edits"), F.sum(number("b")).alias("bytes"))
    return out.where("section IS NOT NULL").select(F.regexp_extract("section", r"^(\S+)", 1).alias("dataset"), F.regexp_extract("section", r"z=([\d.]+)", 1).cast("double").alias("z"), "edits", "bytes")


def elapsed(spark: SparkSession, path: str) -> DataFrame:
    """(seconds) of the wall clock lines."""
    rows = _lines(spark, path).where(F.col("value").contains("Elapsed (wall clock)"))
    return rows.select(clock_seconds(F.regexp_extract("value", r"(\S+)\s*$", 1)).alias("seconds"))


def read_lengths(spark: SparkSession, path: str) -> DataFrame:
    """(name, lines, length) of a list of three lines a file."""
    rows = _lines(spark, path).withColumnRenamed("at", "n")
    return rows.withColumn("slot", F.col("n") % 3).groupBy("file", F.floor(F.col("n") / 3).alias("g")).agg(
        F.max(F.when(F.col("slot") == 0, F.col("value"))).alias("name"), F.max(F.when(F.col("slot") == 1, F.col("value"))).cast("long").alias("lines"), F.max(F.when(F.col("slot") == 2, F.col("value"))).cast("int").alias("length"),
    ).drop("file", "g")


def summaries(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, alignments, unaligned, error_percent) of "=== dataset" sections: "Saw n total", "Error rate: x%", and the
    line count of the file of unaligned reads, "n /path"."""
    rows = carried(_lines(spark, path), r"^=== .*?(\S+)\s*$").where("section IS NOT NULL")
    number = lambda pattern, kind: F.max(F.regexp_extract("value", pattern, 1).try_cast(kind))
    out = rows.groupBy("file", F.col("section").alias("dataset")).agg(
        number(r"Saw (\d+)", "long").alias("alignments"), number(r"^\s*(\d+)\s+/\S", "long").alias("lines"), F.round(number(r"Error rate:\s*([\d.]+)%", "double"), 2).alias("error_percent")
    )
    return out.select("dataset", "alignments", unaligned_reads(F.col("lines")).alias("unaligned"), "error_percent")


def part_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(total, bytes, parts, consistent) of lines "[A n B n ...] total: n": a total's name, its bytes, the sum of its parts, and
    whether the two agree (null where a line has no parts)."""
    rows = _lines(spark, path).select(F.regexp_extract("value", r"(\w+):\s*([\d,]+)\s*$", 1).alias("total"), F.regexp_extract("value", r"(\w+):\s*([\d,]+)\s*$", 2).alias("n"), F.regexp_extract("value", r"\[(.*)\]", 1).alias("in_"))
    number = lambda c: F.replace(c, F.lit(","), F.lit("")).try_cast("long")
    parts = F.transform(F.regexp_extract_all("in_", F.lit(r"([\d,]+)")), number)
    total = F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x))
    out = rows.where("total <> ''").select("total", number(F.col("n")).alias("bytes"), total.alias("parts"))
    return out.withColumn("consistent", F.col("bytes") == F.col("parts"))


def lines_written(spark: SparkSession, path: str) -> DataFrame:
    """(lines) of "Written n lines", with thousands marked by commas."""
    found = F.regexp_extract("value", r"Written ([\d,]+) lines", 1)
    return spark.read.text(path).where(found != "").select(F.replace(found, F.lit(","), F.lit("")).cast("long").alias("lines"))


def stream_sums(spark: SparkSession, path: str) -> DataFrame:
    """(stream, compressed, original) sums of lines "stream: n of n"."""
    pattern = r"^\s*(\w+):\s+(\d+)\s+\S+\s+(\d+)"
    part = lambda i: F.regexp_extract("value", pattern, i)
    rows = spark.read.text(path).where(F.col("value").rlike(pattern))
    return rows.groupBy(part(1).alias("stream")).agg(F.sum(part(2).cast("long")).alias("compressed"), F.sum(part(3).cast("long")).alias("original"))


def quality_streams(spark: SparkSession, path: str) -> DataFrame:
    """(fd, name, bytes) of a run's streams: "Opened path stream for compressed data (fd=n)" names a descriptor, "Closing fd=n,
    size n" gives its bytes; for a cluster's stream ("k=" in its name) the vectors of the "Cluster i n" before it,
    times the line "Assuming uniform read len of n"."""
    rows = _lines(spark, path)
    pick = lambda c, pattern, i=1: F.regexp_extract(c, pattern, i)
    opened = rows.select("file", pick("value", r"\(fd=(\d+)\)").try_cast("int").alias("fd"), pick("value", r"Opened (\S+) stream").alias("opened")).where("opened <> ''")
    length = rows.select("file", pick("value", r"uniform read len of (\d+)").try_cast("long").alias("read_len")).groupBy("file").agg(F.max("read_len").alias("read_len"))
    parts = rows.where(F.col("value").contains("Closing fd")).select("file", "at", F.posexplode(F.split("value", ";")).alias("i", "part"))
    vectors = F.last(pick("part", r"Cluster\s+\S+\s+(\d+)").try_cast("long"), ignorenulls=True).over(Window.partitionBy("file", "at").orderBy("i"))
    closed = parts.withColumn("vectors", vectors).select("file", pick("part", r"Closing fd=(\d+)").try_cast("int").alias("fd"), pick("part", r"Closing fd=\d+,?\s+\S+\s+(\d+)").try_cast("long").alias("size"), "vectors").where("fd IS NOT NULL")
    both = closed.join(opened, ["file", "fd"]).join(length, "file")
    return both.select("fd", F.substring_index("opened", "/", -1).alias("name"), F.when(F.col("opened").contains("k="), F.col("vectors") * F.col("read_len")).otherwise(F.col("size")).alias("bytes"))
