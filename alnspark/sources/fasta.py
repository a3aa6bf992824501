"""FASTA and FASTQ files and .fai indexes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alnspark.sources import files, ranges, records

FAI = "name string, bases long, byte_offset long, bases_per_line int, bytes_per_line int"
_PIECE = "file string, split long, group long, name string, at long, head_size long, first long, last long, n long, bases long, widest long, bytes long"
_FAI = [c.split()[0] for c in FAI.split(", ")]


def read(spark: SparkSession, path: str) -> DataFrame:
    """(name, length, seq) of each record; a record is a task's row, so it must fit in memory."""
    return records.read(spark, path).where("qual IS NULL").select("name", F.length("seq").cast("long").alias("length"), "seq")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq, qual) of records with qualities, over any number of lines."""
    return records.read(spark, path).where("qual IS NOT NULL").select("name", "seq", "qual")


def _pieces_of(lines: DataFrame) -> DataFrame:
    """For each split the parts of records in it, by the headers there (0: what comes before the first), with places from the split's first line; and the split's bytes."""
    names = [c.split()[0] for c in _PIECE.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, split, ahead, _, values in records.blocks(batches):
            split += ahead  # a block counts as a split
            at = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
            raw = values.buffers()[2]
            data = np.append(np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8), np.uint8(0))
            length, n = np.diff(at), len(values)
            size = length - ((length > 0) & (data[at[1:] - 1] == ord("\r")))
            start = at[:-1] - at[0] + np.arange(n)
            head = (length > 0) & (data[at[:-1]] == ord(">"))
            group, heads = np.cumsum(head), np.flatnonzero(head)
            body = np.flatnonzero(~head & (size > 0))
            own, many = group[body], len(heads) + 1
            first, last = np.full(many, -1), np.full(many, -1)
            last[own] = body  # of several the last one stays
            first[own[::-1]] = body[::-1]
            widest = np.zeros(many, np.int64)
            np.maximum.at(widest, own, size[body])
            none = first < 0
            place = lambda x: pa.array(np.where(none, 0, start[x]) if n else np.zeros(many, np.int64), mask=none)
            name = [None, *((values[int(h)].as_py()[1:].split() or [b""])[0].decode("utf-8", "replace") if data[at[h] + 1] > 32 else "" for h in heads)]
            begin = np.append(0, start[heads])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([file] * many), pa.array(np.full(many, split)), pa.array(np.arange(many)), pa.array(name, pa.string()), pa.array(begin), pa.array(np.append(0, size[heads])), place(first), place(last),
                    pa.array(np.bincount(own, minlength=many)), pa.array(np.bincount(own, size[body], many).astype(np.int64)), pa.array(widest),
                    pa.array(np.full(many, int(length.sum()) + n)),
                ],
                names,
            )

    return lines.mapInArrow(each, _PIECE)


def index(spark: SparkSession, path: str) -> DataFrame:
    """The columns of an .fai file and the file's path, in the files' order.

    Each split is read once and tells where its records lie in it; what lies before a split, in bytes and records, is summed over the file's splits."""
    raw = spark.read.option("lineSep", "\n").text(path)
    parts = files.stored(_pieces_of(raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))), "fasta-parts")
    ahead = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    base = parts.groupBy("file", "split").agg(F.max("bytes").alias("bytes"), F.max("group").alias("heads"))
    base = base.select("file", "split", F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("bytes_ahead"), F.coalesce(F.sum("heads").over(ahead), F.lit(0)).alias("heads_ahead"))
    own = parts.join(base, ["file", "split"]).withColumn("rec", F.col("heads_ahead") + F.col("group")).where("rec > 0")
    at = lambda c: F.col("bytes_ahead") + F.col(c)
    whole = own.groupBy("file", "rec").agg(
        F.max("name").alias("name"), F.max(F.when(F.col("group") > 0, at("at") + F.col("head_size"))).alias("head_end"), F.sum("bases").alias("bases"), F.max("widest").alias("bases_per_line"),
        F.min(at("first")).alias("byte_offset"), F.max(at("last")).alias("last"), F.sum("n").alias("n"),
    ).where("n > 0")
    width = F.when(F.col("n") > 1, (F.col("last") - F.col("byte_offset")) / (F.col("n") - 1)).otherwise(F.col("bases_per_line") + F.col("byte_offset") - F.col("head_end"))
    return whole.orderBy("file", "rec").select("name", "bases", "byte_offset", F.col("bases_per_line").cast("int").alias("bases_per_line"), width.cast("int").alias("bytes_per_line"), "file")


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FAI).option("sep", "\t").csv(path)


def write_fai(rows: DataFrame, path: str) -> None:
    rows.select(*_FAI).coalesce(1).write.option("sep", "\t").csv(path)


def write_index(rows: DataFrame, path: str) -> None:
    """The index of several files: the columns of an .fai behind the file's path."""
    rows.select("file", *_FAI).write.option("sep", "\t").csv(path)


def pieces(spark: SparkSession, index: str, path: str = "", **options: int) -> DataFrame:
    """(file, name, start, seq, bytes_read) of the records in an index, of which only the bytes wanted are read."""
    ranges.register(spark)
    return spark.read.format("fasta_ranges").options(index=index, path=path, **{k: str(v) for k, v in options.items()}).load()


def load(spark: SparkSession, index: str, path: str = "", **options: int) -> DataFrame:
    """(file, name, length, seq) of the records in an index; conditions on ``file`` and ``name`` reach the reading of it."""
    parts = pieces(spark, index, path, **options).groupBy("file", "name").agg(F.array_sort(F.collect_list(F.struct("start", "seq"))).alias("parts"))
    seq = F.array_join(F.transform("parts", lambda x: x["seq"]), "")
    return parts.select("file", "name", F.length(seq).cast("long").alias("length"), seq.alias("seq"))
