"""The header that goes with stored alignments: references, read length and dictionaries, and the spans of blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alnspark.sources import files

DICTIONARIES = ("flags", "mapq", "rnext")


def write(references: DataFrame, dictionaries: dict[str, DataFrame], read_length: int, version: str, path: str) -> None:
    """Lines "HD version", "id name length" for each reference, "read_len=n", and "dictionary value code"."""
    spark = references.sparkSession
    text = lambda *parts: F.concat_ws(" ", *parts).alias("value")
    long = lambda n: F.lit(n).cast("long")
    out = spark.range(1).select(long(0).alias("part"), F.col("id").alias("n"), F.lit(f"HD {version}").alias("value"))
    out = out.union(references.select(long(1), F.col("ref_id").cast("long"), text(F.col("ref_id").cast("string"), "name", F.col("length").cast("string"))))
    out = out.union(spark.range(1).select(long(2), "id", F.lit(f"read_len={read_length}")))
    for i, name in enumerate(DICTIONARIES):
        if name in dictionaries:
            out = out.union(dictionaries[name].select(long(3 + i), F.col("code").cast("long"), text(F.lit(name), F.col("value").cast("string"), F.col("code").cast("string"))))
    files.write_lines(out, ["part", "n"], path)  # dictionaries and references are small


def read(spark: SparkSession, path: str) -> DataFrame:
    """(kind, key, name, number): the version (name), references (id, name, length), read length (number) and
    dictionary entries (value as name, code as number)."""
    line = F.col("value")
    part = lambda pattern, i: F.regexp_extract(line, pattern, i)
    words, ref = r"^(flags|mapq|rnext) (\S+) (\d+)$", r"^(\d+) (\S+) (\d+)$"
    rows = spark.read.text(path)
    is_word, is_ref = line.rlike(words), line.rlike(ref)
    kind = F.when(line.startswith("HD "), "HD").when(line.startswith("read_len="), "read_len").when(is_word, part(words, 1)).when(is_ref, "reference")
    name = F.when(line.startswith("HD "), F.substring(line, 4, 1 << 20)).when(is_word, part(words, 2)).when(is_ref, part(ref, 2))
    number = F.when(line.startswith("read_len="), part(r"^read_len=(\d+)$", 1)).when(is_word, part(words, 3)).when(is_ref, part(ref, 3))
    return rows.select(kind.alias("kind"), F.when(is_ref, part(ref, 1)).try_cast("int").alias("key"), name.alias("name"), number.try_cast("long").alias("number")).where("kind IS NOT NULL")


def write_spans(spans: DataFrame, suffix: str, path: str) -> None:
    """Lines "suffix alignments-before ref:pos-ref:pos", one a block."""
    at = lambda ref, pos: F.concat(F.col(ref).cast("string"), F.lit(":"), F.col(pos).cast("string"))
    value = F.concat_ws(" ", F.lit(suffix), F.col("aln_before").cast("string"), F.concat(at("start_ref", "start_pos"), F.lit("-"), at("end_ref", "end_pos")))
    files.write_lines(spans.select("block", value.alias("value")), ["block"], path)


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    """(suffix, aln_before, start_ref, start_pos, end_ref, end_pos)."""
    pattern = r"^(\S+) (\d+) (-?\d+):(-?\d+)-(-?\d+):(-?\d+)$"
    part = lambda i: F.regexp_extract("value", pattern, i)
    rows = spark.read.text(path).where(F.col("value").rlike(pattern))
    return rows.select(part(1).alias("suffix"), part(2).cast("long").alias("aln_before"), *(part(i).cast("int").alias(n) for i, n in enumerate(("start_ref", "start_pos", "end_ref", "end_pos"), 3)))
