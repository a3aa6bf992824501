"""Size and rate reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alnspark.functions.text import data_type


def by_type(sizes: DataFrame) -> DataFrame:
    """(dataset, method, type, bytes)."""
    return sizes.groupBy("dataset", "method", data_type(F.col("suffix")).alias("type")).agg(F.sum("bytes").alias("bytes"))


def shares(sizes: DataFrame) -> DataFrame:
    """Add each suffix's percent of its dataset."""
    rows = sizes.groupBy("dataset", "suffix").agg(F.sum("bytes").alias("bytes"))
    return rows.withColumn("percent", F.round(100 * F.col("bytes") / F.sum("bytes").over(Window.partitionBy("dataset")), 6))


def saving(sizes: DataFrame) -> DataFrame:
    """(dataset, best, next_best, percent): how much smaller the smallest method is than the next."""
    rows = sizes.groupBy("dataset", "method").agg(F.sum("bytes").alias("bytes")).select("dataset", "bytes").distinct()
    ranked = rows.withColumn("place", F.dense_rank().over(Window.partitionBy("dataset").orderBy("bytes"))).where("place <= 2")
    out = ranked.groupBy("dataset").agg(F.min(F.when(F.col("place") == 1, F.col("bytes"))).alias("best"), F.min(F.when(F.col("place") == 2, F.col("bytes"))).alias("next_best"))
    return out.withColumn("percent", F.round((1 - F.col("best") / F.col("next_best")) * 100, 1))


def bits_per_base(size: Column, alignments: Column, read_length: Column) -> Column:
    return size * 8.0 / (alignments * read_length)


def by_total(sizes: DataFrame) -> DataFrame:
    """(place, dataset, bytes): datasets from the smallest."""
    rows = sizes.groupBy("dataset").agg(F.sum("bytes").alias("bytes"))
    return rows.select(F.row_number().over(Window.orderBy("bytes", "dataset")).alias("place"), "dataset", "bytes")  # one row a dataset


def compression(raw: DataFrame, packed: DataFrame) -> DataFrame:
    """(dataset, ratio) of summed bytes."""
    total = lambda df, name: df.groupBy("dataset").agg(F.sum("bytes").alias(name))
    return total(raw, "raw").join(total(packed, "packed"), "dataset").select("dataset", F.round(F.col("raw") / F.col("packed"), 6).alias("ratio"))
