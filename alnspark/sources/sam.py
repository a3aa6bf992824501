"""SAM text: reading, writing and the header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alnspark.operators.rebuild import sam_line
from alnspark.sources import ranges


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """(ref_id, name, length) of the @SQ lines in order."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select("value", at.alias("at")).where(F.col("value").startswith("@SQ"))
    field = lambda tag: F.regexp_extract("value", rf"\t{tag}:([^\t]+)", 1)
    rows = lines.select("at", field("SN").alias("name"), field("LN").cast("long").alias("length"))
    return rows.select((F.row_number().over(Window.orderBy("at")) - 1).cast("int").alias("ref_id"), "name", "length")  # a header is small


def read_version(spark: SparkSession, path: str) -> str | None:
    """The format version of the @HD line."""
    found = spark.read.text(path).where(F.col("value").startswith("@HD")).select(F.regexp_extract("value", r"\tVN:([^\t]+)", 1)).first()
    return found[0] if found else None


def scan(spark: SparkSession, path: str, required: int = 0, excluded: int = 0, **options: int) -> DataFrame:
    """The lines of a SAM file or of a folder of such, with names of references, 0-based positions and tags as text.

    The ordinal ``aln_idx`` grows with the files' names and the lines' byte offsets.  Conditions on ``rname``, ``pos``, ``flag`` and
    ``mapq``, and the flag bits, are tested before the rest of a line is read."""
    ranges.register(spark)
    return spark.read.format("sam_ranges").options(path=path, requiredFlags=str(required), excludedFlags=str(excluded), **{k: str(v) for k, v in options.items()}).load()


def region(spark: SparkSession, path: str, name: str, start: int, stop: int, **options: int) -> DataFrame:
    """The lines whose alignment begins in [start, stop) of a reference."""
    return scan(spark, path, **options).where((F.col("rname") == name) & (F.col("pos") >= start) & (F.col("pos") < stop))


def read(spark: SparkSession, path: str, **options: int) -> DataFrame:
    """Alignments of SAM text, with ids for reference names (-1 for none) and optional tags as
    structs (tag, type, value) in their order, repeated ones included.  ``scan`` says how they are numbered."""
    refs = read_header(spark, path).select("ref_id", "name")
    tags = F.transform("opt", lambda t: F.struct(F.substring(t, 1, 2).alias("tag"), F.substring(t, 4, 1).alias("type"), F.substring(t, 6, 1 << 30).alias("value")))
    own = scan(spark, path, **options).withColumn("opt", tags)
    own = own.join(refs.withColumnRenamed("name", "rname"), "rname", "left").join(refs.select(F.col("ref_id").alias("rnext"), F.col("name").alias("mate")), "mate", "left")
    md = F.filter("opt", lambda t: t["tag"] == "MD")
    return own.select(
        "aln_idx", "qname", "flag", F.coalesce("ref_id", F.lit(-1)).alias("ref_id"), "pos", "mapq", "cigar", F.coalesce("rnext", F.lit(-1)).alias("rnext"), F.greatest("pnext", F.lit(0)).alias("pnext"),
        "tlen", "seq", "qual", F.get(md, 0)["value"].alias("md"), "opt",
    )


def named(aln: DataFrame, references: DataFrame) -> DataFrame:
    """Add ``rname`` and ``mate``: the names of the ids, null where an id has none."""
    name = lambda key, out: references.select(F.col("ref_id").alias(key), F.col("name").alias(out))
    return aln.join(name("ref_id", "rname"), "ref_id", "left").join(name("rnext", "mate"), "rnext", "left")


def with_tags(aln: DataFrame) -> DataFrame:
    """With a column of optional tags, if there is none."""
    return aln if "opt" in aln.columns else aln.withColumn("opt", F.lit(None).cast("array<struct<tag:string,type:string,value:string>>"))


def write(aln: DataFrame, references: DataFrame, path: str, version: str = "1.6") -> None:
    """The header and the lines in coordinate order, unplaced ones last; one file a range of coordinates, the header in the first."""
    spark = aln.sparkSession
    rows = with_tags(aln)
    place = F.when(F.col("rname").isNull(), F.lit(1 << 31)).otherwise(F.col("ref_id").cast("long"))
    body = named(rows, references).select(place.alias("ref"), F.col("pos").cast("long").alias("at"), F.col("aln_idx").alias("n"), sam_line().alias("value"))
    first = spark.range(1).select(F.lit(-2).cast("long").alias("ref"), F.lit(0).cast("long").alias("at"), F.col("id").alias("n"), F.lit(f"@HD\tVN:{version}\tSO:coordinate").alias("value"))
    names = references.select(F.lit(-1).cast("long").alias("ref"), F.col("ref_id").cast("long").alias("at"), F.lit(0).cast("long").alias("n"), F.concat_ws("\t", F.lit("@SQ"), F.concat(F.lit("SN:"), "name"), F.concat(F.lit("LN:"), F.col("length").cast("string"))).alias("value"))
    first.union(names).union(body).orderBy("ref", "at", "n").select("value").write.text(path)


def unaligned_fastq(aln: DataFrame) -> DataFrame:
    """Reads that no reference holds, as FASTQ text."""
    rows = aln.where(F.col("flag").bitwiseAND(4) != 0)
    return rows.select(F.concat_ws("\n", F.concat(F.lit("@"), "qname"), "seq", F.lit("+"), "qual").alias("value"))
