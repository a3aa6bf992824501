"""Order-dependent operators in one pass, without one task a partition key.

Rows are dealt once by ranges of (key, order), so a chromosome, or one deep position, lies in as many tasks as its rows ask for.  Each
task goes through its range in order, in Arrow batches, and writes its rows with their local result.  What a range needs from the ones before is one value:
it is worked out from one row a range, and added where the range begins within a key.  Results are files in the shared folder, so what
follows starts from there and the input is computed once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructType

from alnspark.sources import files


class _Pass:
    """One pass through a range: what came before, batch by batch."""

    def __init__(self, kind: str, key: list[str]):
        self.kind, self.key, self.last, self.held, self.begun = kind, key, None, None, True

    def __call__(self, batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
        """The results, and which rows belong to the first key of the range."""
        n = batch.num_rows
        change = np.arange(n) == 0
        for k in self.key:
            code = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            change[1:] |= code[1:] != code[:-1]
        ends = [tuple(batch.column(k)[i].as_py() for k in self.key) for i in (0, n - 1)]
        goes_on = self.last is not None and ends[0] == self.last
        self.begun &= self.last is None or goes_on
        first = np.flatnonzero(change)
        group = np.cumsum(change) - 1
        out = getattr(self, self.kind)(batch.column("_value"), change, first, group, goes_on)
        first_key = (group == 0) & self.begun
        self.last = ends[1]
        self.begun &= len(first) == 1
        return out, first_key

    def previous(self, value, change, first, group, goes_on) -> pa.Array:
        out = value.take(pa.array(np.arange(len(value)) - 1, mask=change))
        if goes_on:
            out = pa.concat_arrays([pa.array([self.held], value.type), out.slice(1)])
        self.held = value[-1].as_py()
        return out

    def running_sum(self, value, change, first, group, goes_on) -> pa.Array:
        x = value.fill_null(0).to_numpy()
        total = np.cumsum(x)
        out = total - (total[first] - x[first])[group]
        if goes_on:
            out[group == 0] += self.held
        self.held = int(out[-1])
        return pa.array(out)

    def latest(self, value, change, first, group, goes_on) -> pa.Array:
        some = np.maximum.accumulate(np.where(value.is_valid().to_numpy(zero_copy_only=False), np.arange(len(value)), -1))
        none = some < first[group]
        out = value.take(pa.array(some, mask=none))
        if goes_on and self.held is not None:
            out = pc.if_else(pa.array(none & (group == 0)), pa.scalar(self.held, value.type), out)
        self.held = out[-1].as_py()
        return out


def _passed(df: DataFrame, key: list[str], order: list[str], value: Column, kind: str, out: str) -> DataFrame:
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, step = TaskContext.get().partitionId(), 0, _Pass(kind, key)
        for batch in batches:
            n = batch.num_rows
            if n:
                result, first_key = step(batch)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(number, number + n)), pa.array(first_key), result], names)
                number += n

    dealt = df.withColumn("_value", value).repartitionByRange(*key, *order).sortWithinPartitions(*key, *order)
    own = dealt.schema
    schema = StructType(list(own)).add("_part", IntegerType()).add("_row", LongType()).add("_first", BooleanType()).add("_out", own["_value"].dataType)
    names = schema.names
    rows = files.stored(dealt.mapInArrow(go, schema), "ordered")
    name = F.struct(F.lit(0).alias("_"), *key)
    tail = F.col("_value" if kind == "previous" else "_out")
    ends = rows.groupBy("_part").agg(F.min_by(name, "_row").alias("lo"), F.max_by(name, "_row").alias("hi"), F.max_by(tail, "_row").alias("tail")).orderBy("_part").collect()  # a row a range
    carries, before, held = [], None, None
    for part, lo, hi, tail in ends:
        carry = held if lo == before else None
        if carry is not None:
            carries.append((part, carry))
        alone = lo == hi
        if kind == "running_sum":
            held = (tail or 0) + ((carry or 0) if alone else 0)
        elif kind == "latest" and alone and tail is None:
            held = carry
        else:
            held = tail
        before = hi
    result = F.col("_out")
    if carries:
        spark = df.sparkSession
        rows = rows.join(F.broadcast(spark.createDataFrame(carries, f"_part int, _carry {own['_value'].dataType.simpleString()}")), "_part", "left")
        if kind == "running_sum":
            result = result + F.when(F.col("_first"), F.coalesce("_carry", F.lit(0))).otherwise(0)
        elif kind == "latest":
            result = F.coalesce(result, F.when(F.col("_first"), F.col("_carry")))
        else:
            result = F.when(F.col("_row") == 0, F.col("_carry")).otherwise(result)
    return rows.select(*[F.col(f"`{c}`") for c in df.columns if c != out], result.alias(out))


def previous(df: DataFrame, key: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: ``value`` of the row before in ``key``, by ``order``."""
    return _passed(df, key, order, F.col(value), "previous", out)


def latest(df: DataFrame, key: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Add ``out``: the last ``value`` up to and with the row that is not null."""
    return _passed(df, key, order, F.col(value), "latest", out)


def running_sum(df: DataFrame, key: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` up to and with the row; nulls count as 0."""
    return _passed(df, key, order, value.cast("long"), "running_sum", out)


def row_numbers(df: DataFrame, key: list[str], order: list[str], out: str) -> DataFrame:
    """Add ``out``: the row's number from 1 in ``key``."""
    return running_sum(df, key, order, F.lit(1), out)
