"""Edits of a read against the reference: CIGAR, MD, merging, and counting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

READ_OPS, REF_OPS = ["M", "I", "S", "=", "X"], ["M", "D", "N", "=", "X"]


def cigar_ops(aln: DataFrame) -> DataFrame:
    """(aln_idx, ord, op, len, read_at, ref_at): the CIGAR's operations and where each begins."""
    parts = F.regexp_extract_all("cigar", F.lit(r"(\d+[MIDNSHP=X])"))
    one = aln.select("aln_idx", F.posexplode(parts).alias("ord", "part")).select(
        "aln_idx", "ord", F.substring("part", -1, 1).alias("op"), F.regexp_extract("part", r"^(\d+)", 1).cast("int").alias("len")
    )
    before = Window.partitionBy("aln_idx").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)  # one read's operations
    moved = lambda ops: F.coalesce(F.sum(F.when(F.col("op").isin(ops), F.col("len")).otherwise(0)).over(before), F.lit(0)).cast("int")
    return one.select("*", moved(READ_OPS).alias("read_at"), moved(REF_OPS).alias("ref_at"))


def is_mismatch(code: Column) -> Column:
    """Whether an edit's code is a base, so that it replaces one."""
    return code.isin("A", "C", "G", "T", "N")


def has_edits(cigar: Column) -> Column:
    return cigar.rlike("[IDNSH]")


def md_mismatches(md: Column) -> Column:
    """array<struct(at, base)>: 0-based places among aligned bases where the reference differs, and its base."""
    tokens = F.regexp_extract_all(md, F.lit(r"(\d+|\^[A-Z]+|[A-Z])"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,base:string>>").alias("found"))

    def step(acc, t):
        return (
            F.when(t.rlike("^[0-9]"), F.struct((acc["at"] + t.cast("int")).alias("at"), acc["found"].alias("found")))
            .when(t.startswith("^"), acc)
            .otherwise(F.struct((acc["at"] + 1).alias("at"), F.concat(acc["found"], F.array(F.struct(acc["at"].alias("at"), t.alias("base")))).alias("found")))
        )

    return F.aggregate(tokens, start, step, lambda acc: acc["found"])


def mismatches(read: Column, reference: Column) -> Column:
    """array<struct(at, base)>: 0-based places where the read differs from the reference, and the read's base."""
    pairs = F.arrays_zip(F.split(read, "").alias("r"), F.split(reference, "").alias("g"))
    found = F.transform(pairs, lambda p, i: F.struct(i.alias("at"), p["r"].alias("base"), (p["r"] != p["g"]).alias("differs")))
    return F.transform(F.filter(found, lambda x: x["differs"]), lambda x: F.struct(x["at"].alias("at"), x["base"].alias("base")))


def merge(first: Column, second: Column) -> Column:
    """Two edit lists (structs with ``at``) as one in order of place; on ties the first list's come first."""
    tag = lambda xs, n: F.transform(xs, lambda x, i: F.struct(x["at"].alias("at"), F.lit(n).alias("side"), i.alias("i"), x["base"].alias("base")))
    return F.array_sort(F.concat(tag(first, 0), tag(second, 1)))


def deltas(edits: DataFrame) -> DataFrame:
    """Add ``delta``: the distance of an edit (aln_idx, ord, at) to the one before in its read."""
    before = Window.partitionBy("aln_idx").orderBy("ord")
    return edits.withColumn("delta", F.col("at") - F.coalesce(F.lag("at").over(before), F.lit(0)))


def indel_runs(ops: DataFrame, order: list[str]) -> DataFrame:
    """(aln_idx, run, op, at, len): one row for neighbouring inserted or deleted bases (aln_idx, op, at and ``order``)."""
    own = Window.partitionBy("aln_idx").orderBy(*order)
    new = (F.col("op") != F.coalesce(F.lag("op").over(own), F.lit(""))) | (F.col("at") != F.coalesce(F.lag("at").over(own), F.lit(-1)))
    runs = ops.withColumn("_new", new.cast("int")).withColumn("run", F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("aln_idx", "run", "op", "at").agg(F.count("*").alias("len")).select("aln_idx", F.col("run").cast("int").alias("run"), "op", "at", "len")


def soft_clips(aln: DataFrame) -> DataFrame:
    """Add ``left_clip`` and ``right_clip``, the soft-clipped bases at the ends, or null."""
    left = F.regexp_extract("cigar", r"^(?:\d+H)?(\d+)S", 1)
    right = F.regexp_extract("cigar", r"[MIDNPX=](\d+)S(?:\d+H)?$", 1)
    return aln.withColumns({
        "left_clip": F.when(left != "", F.left(F.col("seq"), left.try_cast("int"))),
        "right_clip": F.when(right != "", F.right(F.col("seq"), right.try_cast("int"))),
    })


def inserts_before(edits: DataFrame) -> DataFrame:
    """Add ``inserts``: inserted bases before an edit in its read, by which its place on the reference lags."""
    own = Window.partitionBy("aln_idx").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return edits.withColumn("inserts", F.coalesce(F.sum(F.when(F.col("op") == "I", F.col("len")).otherwise(0)).over(own), F.lit(0)).cast("int"))
