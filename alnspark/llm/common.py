"""Helpers that the corpus operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Stands in for a null id: such rows count as one more document, before all others.
NO_ID = -(1 << 63)
SPACE = " \t\n\x0b\x0c\r"
MOST_BUCKETS = 100_000
#: A bit table has 2**bits bits, this many times the number of values where these bounds allow.
MOST_BITS, LEAST_BITS, ROOM, BIT_PARTS = 27, 16, 64, 64
#: Spark's setting by which a query's shuffle files are deleted when it ends, not when the driver's memory is collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path below the folder that driver and executors share (``spark.checkpoint.dir``)."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:  # a session in one process, as in tests, may have a folder of its own
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(Path(tempfile.mkdtemp(prefix="spark-")).as_uri())
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, *by: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: later steps start from the
    files, also after executors are lost, and nothing is computed twice.  The write's shuffle files go with its end.

    Rows lie in a folder for each value of ``by``."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame, part: str = "") -> None:
    """Delete the files of ``stored`` tables that nothing reads any more, or of ``part`` (column=value) of them."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles() if f"/{part}/" in f or not part}:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def finished(spark: SparkSession, folder: str) -> list[str]:
    """The folders below ``folder`` that a Spark job has written to the end, in order of their names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    names = sorted(x.getPath().getName() for x in files.listStatus(path) if x.isDirectory())
    return [f"{folder}/{n}" for n in names if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]


def slices(batch, most: int = 1_000):
    """An Arrow batch or a pandas frame in parts, so that what is made from it stays small."""
    for lo in range(0, len(batch), most):
        yield batch.iloc[lo : lo + most].reset_index(drop=True) if isinstance(batch, pd.DataFrame) else batch.slice(lo, most)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, in any case."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name = f"_{name}"
    return name


def row_key(id_col: str, text_col: str) -> tuple[Column, Column]:
    """``did`` and ``th`` of a row: its id without nulls, and the digest of its text."""
    return F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)), F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(did, th, text): id without nulls, digest of the text, text without nulls.

    ``(did, th)`` names a document's row: equal rows share it and get equal results, rows with one
    id and different texts are told apart."""
    did, th = row_key(id_col, text_col)
    return docs.select(did.alias("did"), th.alias("th"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def id_or_null(column: str = "did") -> Column:
    return F.when(F.col(column) != NO_ID, F.col(column))


def ranked(df: DataFrame, group: list[str], order: list[str], out: str, rows_per_task: int = 1_000) -> DataFrame:
    """Add ``out``: a gapless rank from 0 within ``group``, of which there are few (their sizes are broadcast).

    No group meets in one task: a group's rows are dealt to buckets by the order columns' hash, as many as
    its size asks for, ranked there, and moved up by the running count of the buckets before.  ``df`` is read
    three times, so hand over a stored table."""
    # of a very large group the buckets grow instead of their number
    sizes = df.groupBy(*group).agg(F.ceil(F.count("*") / F.greatest(F.lit(rows_per_task), F.count("*") / MOST_BUCKETS)).alias("_buckets"))
    df = df.join(F.broadcast(sizes), group).withColumn("_bucket", F.pmod(F.xxhash64(*order), "_buckets")).drop("_buckets")
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        df.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
        .withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    here = Window.partitionBy(*group, "_bucket").orderBy(*order)
    return (
        df.withColumn("_here", F.row_number().over(here) - 1)
        .join(base, [*group, "_bucket"])
        .withColumn(out, (F.col("_base") + F.col("_here")).cast("long"))
        .drop("_bucket", "_base", "_here")
    )


def bit_table(rows: DataFrame, column: str) -> tuple[np.ndarray, int]:
    """A table of bits set at the 64-bit values of ``column``, made in parts, and the log of its size: at most 2**MOST_BITS bits."""
    values = rows.select(F.col(column).alias("value")).distinct()
    bits = int(min(MOST_BITS, max(LEAST_BITS, np.ceil(np.log2(max(1, values.count()) * ROOM)))))
    part = (1 << bits) // BIT_PARTS

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        held = np.zeros(part, bool)
        held[pdf["bit"].to_numpy() % part] = True
        return pd.DataFrame({"part": [int(pdf["bit"].iloc[0]) // part], "cells": [np.packbits(held).tobytes()]})

    bit = F.shiftrightunsigned("value", 64 - bits)
    parts = values.select(bit.alias("bit")).distinct().groupBy(F.floor(F.col("bit") / part)).applyInPandas(fill, "part int, cells binary").collect()
    table = np.zeros((BIT_PARTS, part // 8), np.uint8)
    for p, cells in parts:
        table[p] = np.frombuffer(cells, np.uint8)
    return table.ravel(), bits


def in_bits(table: np.ndarray, bits: int, values: np.ndarray) -> np.ndarray:
    """Which of the unsigned 64-bit ``values`` the table may hold."""
    bit = (values >> np.uint64(64 - bits)).astype(np.int64)
    return (table[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1).astype(bool)
