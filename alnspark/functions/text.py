"""Column functions for reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Which data a stream's suffix belongs to; others are qualities.
DATA_TYPE = {
    "offs": "seq", "left_clip": "seq", "right_clip": "seq", "edits": "seq", "has_edits": "seq",
    "quals": "quals", "unaligned": "unaligned", "opt": "fields", "flags": "fields", "ids": "ids",
}


def data_type(suffix: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in DATA_TYPE.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.substring_index(suffix, ".", 1)), F.lit("quals"))


def duration(seconds: Column) -> Column:
    """Seconds as 1h2m3s: no hours where there are none, 00 for no minutes, seconds rounded up."""
    whole = F.floor(seconds).cast("long")
    h = F.floor(whole / 3600).cast("long")
    m = F.floor((whole - h * 3600) / 60).cast("long")
    s = F.ceil(seconds - h * 3600 - m * 60).cast("long")
    return F.concat(F.when(h > 0, F.concat(h.cast("string"), F.lit("h"))).otherwise(F.lit("")), F.when(m > 0, F.concat(m.cast("string"), F.lit("m"))).otherwise(F.lit("00")), s.cast("string"), F.lit("s"))


def clock_seconds(clock: Column) -> Column:
    """h:mm:ss or m:ss as seconds."""
    return F.aggregate(F.split(clock, ":"), F.lit(0.0), lambda acc, p: acc * 60 + p.cast("double"))


def label(name: Column) -> Column:
    """A file's display name: the first part of its name, underscores escaped."""
    short = F.when(name.contains("P_aer"), F.lit("P. aeruginosa")).when(name.contains("K562"), F.substring_index(F.substring_index(name, ".", 1), "_", 1)).otherwise(F.substring_index(name, ".", 1))
    return F.replace(short, F.lit("_"), F.lit("\\_"))


def unaligned_reads(lines: Column) -> Column:
    """Reads in a file of records of four lines, or else of three."""
    return F.when(lines % 4 == 0, F.floor(lines / 4)).otherwise(F.floor(lines / 3)).cast("long")


def region(text: Column) -> Column:
    """struct(name, start, stop) of name:start-stop."""
    part = lambda i: F.regexp_extract(text, r"^(.+):(\d+)-(\d+)$", i)
    return F.struct(part(1).alias("name"), part(2).try_cast("int").alias("start"), part(3).try_cast("int").alias("stop"))


def binary_size(size: Column) -> Column:
    """A byte count with the largest binary prefix that keeps it at 1 or more."""
    out = F.concat(F.format_number(size, 0), F.lit(" B"))
    for power, unit in ((1, "KiB"), (2, "MiB"), (3, "GiB"), (4, "TiB")):
        out = F.when(size >= 1024**power, F.concat(F.format_number(size / 1024**power, 2), F.lit(f" {unit}"))).otherwise(out)
    return out
