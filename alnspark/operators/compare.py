"""Differences between tables as multisets of rows, by digests of buckets.

Rows are dealt to buckets by a hash, and a bucket's digest (its number of rows, and sums of two 64-bit hashes) does not depend on their order.  Equal
tables shuffle a digest a bucket and task, and no rows.  Only where digests differ, the bucket's rows are counted and compared as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 4_096


def _hashes(df: DataFrame, buckets: int) -> tuple[Column, Column, Column]:
    """(bucket, two hashes) of a row; nulls have a mark of their own, as Spark's hash skips them."""
    null = lambda c: F.col(f"`{c}`").isNull()
    marks = [F.concat(*[F.when(null(c), "1").otherwise("0") for c in df.columns])]
    own = [F.col(f"`{c}`") for c in df.columns]
    one = F.xxhash64(*marks, *own)
    return F.pmod(one, F.lit(buckets)).cast("int"), one, F.xxhash64(F.lit(1), *own, *marks)


def digests(df: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n, one, two): a row a bucket."""
    bucket, one, two = _hashes(df, buckets)
    total = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    return df.select(bucket.alias("bucket"), one.alias("one"), two.alias("two")).groupBy("bucket").agg(F.count("*").alias("n"), total("one"), total("two"))


def difference(a: DataFrame, b: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The rows that are not as often in ``b`` as in ``a``, with ``lost`` and ``gained``: how many fewer or more there are.

    Both have the same columns, of types that can be grouped by."""
    b = b.select(*[F.col(f"`{c}`").cast(a.schema[c].dataType) for c in a.columns])
    x, y = digests(a, buckets), digests(b, buckets)
    same = x.intersect(y).select("bucket")
    odd = [r[0] for r in x.union(y).select("bucket").distinct().join(same, "bucket", "left_anti").collect()]  # ``buckets`` numbers at most

    def counted(df: DataFrame, name: str) -> DataFrame:
        rows = df.where(_hashes(df, buckets)[0].isin(odd)) if odd else df.limit(0)
        return rows.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count("*").alias(name))

    own = [F.col(f"`{c}`") for c in a.columns]
    both = counted(a, "_a").withColumn("_b", F.lit(0).cast("long")).unionByName(counted(b, "_b").withColumn("_a", F.lit(0).cast("long")))
    totals = both.groupBy(*own).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b")).where("_a <> _b")
    return totals.select(*own, F.greatest(F.col("_a") - F.col("_b"), F.lit(0)).alias("lost"), F.greatest(F.col("_b") - F.col("_a"), F.lit(0)).alias("gained"))
