"""Alignment views derived from the driver's tables, in Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

READ, REF_LENGTH, REFS = 32, 65536, 5
HEX, BASES = "0123456789abcdef", "ACGTACGTACGTACGT"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _chunk(ref: Column, n: Column) -> Column:
    """32 bases of the made-up genome."""
    return F.translate(F.md5(F.concat(ref.cast("string"), F.lit(":"), n.cast("string"))), HEX, BASES)


def genome(spark: SparkSession) -> DataFrame:
    bases = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(REF_LENGTH // 32 - 1)), lambda n: _chunk(F.col("id"), n)), "")
    return spark.range(REFS).select(F.col("id").cast("int").alias("ref_id"), F.lit(REF_LENGTH).alias("length"), bases.alias("seq"))


def genome_chunks(spark: SparkSession) -> DataFrame:
    """(ref_id, chunk, seq): the genome in pieces of 64 bases at every 32nd, so that any read lies in one of them."""
    ids = spark.range(REFS).select(F.col("id").cast("int").alias("ref_id"), F.explode(F.sequence(F.lit(0), F.lit(REF_LENGTH // 32 - 1))).alias("chunk"))
    return ids.select("ref_id", "chunk", F.concat(_chunk(F.col("ref_id"), F.col("chunk")), F.when(F.col("chunk") < REF_LENGTH // 32 - 1, _chunk(F.col("ref_id"), F.col("chunk") + 1)).otherwise(F.lit(""))).alias("seq"))


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, name, seq): a sequence for each part, of 32 to 1632 bases."""
    return contigs_of(spark.read.parquet(f"{sf_dir}/part.parquet"))


def contigs_of(part: DataFrame, *more: str) -> DataFrame:
    """(more, key, name, seq) of parts, row by row."""
    bases = F.array_join(F.transform(F.sequence(F.lit(0), F.col("p_size")), lambda n: _chunk(F.col("p_partkey"), n)), "")
    return part.select(*more, F.col("p_partkey").alias("key"), F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("name"), bases.alias("seq"))


def aln(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments of 32 bases; a read's reference slice comes from its own two chunks, so no long string is cut."""
    e, i = events(spark, sf_dir).select("event_id", "user_id"), F.col("event_id")
    bit = lambda every, rest, value: F.when(i % every == rest, value).otherwise(0)
    k = e.select(
        i.alias("aln_idx"), (F.col("user_id") % REFS).cast("int").alias("ref_id"), (((i * 7919) % 2500) * 26).cast("int").alias("pos"),
        (bit(17, 0, 4) + bit(2, 1, 16) + bit(10, 0, 256) + bit(37, 0, 2048)).cast("int").alias("flag"), ((i * 31) % 61).cast("int").alias("mapq"),
        (i % 32).cast("int").alias("mm"), (i % 3 == 0).alias("has_mm"), (i % 8 == 0).alias("noisy"), (i % 4 == 0).alias("no_mate"),
    )
    at = F.floor(F.col("pos") / 32).cast("int")
    rs = F.substring(F.concat(_chunk(F.col("ref_id"), at), _chunk(F.col("ref_id"), at + 1)), F.col("pos") % 32 + 1, F.lit(READ))
    g = k.withColumn("rs", rs)
    mm = F.col("mm")
    changed = F.concat(F.substring("rs", F.lit(1), mm), F.translate(F.substring("rs", mm + 1, F.lit(1)), "ACGT", "CGTA"), F.substring("rs", mm + 2, F.lit(READ)))
    md = F.concat(mm.cast("string"), F.substring("rs", mm + 1, F.lit(1)), (31 - mm).cast("string"))
    text = F.md5(F.concat(F.lit("q"), F.col("aln_idx").cast("string")))
    return g.select(
        "aln_idx", F.concat(F.lit("read"), F.col("aln_idx").cast("string")).alias("qname"), "flag", "ref_id", "pos", "mapq", F.lit("32M").alias("cigar"),
        F.when(F.col("no_mate"), -1).otherwise(F.col("ref_id")).alias("rnext"), F.when(F.col("no_mate"), 0).otherwise(F.col("pos") + 100).alias("pnext"),
        F.when(F.col("no_mate"), 0).otherwise(132).alias("tlen"), F.when(F.col("has_mm"), changed).otherwise(F.col("rs")).alias("seq"),
        F.when(F.col("noisy"), F.translate(text, HEX, "!#%+5:?@ABCDEFGH")).otherwise(F.translate(text, HEX, "IIIIIIIIIIIIHFDB")).alias("qual"),
        F.when(F.col("has_mm"), md).otherwise(F.lit("32")).alias("md"),
    )


def qv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aln(spark, sf_dir).where(F.col("flag").bitwiseAND(2304) == 0).select("aln_idx", "qual")


CIGARS = ["32M", "4S28M", "10M2I20M", "10M3D22M", "5H32M", "4S24M4S", "16M500N16M", "8M1I1D23M", "10=1X21="]


def with_cigars(rows: DataFrame) -> DataFrame:
    """Alignments with CIGARs of every kind of operation."""
    return rows.withColumn("cigar", F.element_at(F.array(*[F.lit(c) for c in CIGARS]), (F.col("aln_idx") % len(CIGARS)).cast("int") + 1))


def iv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals, one for each customer; every 97th covers a whole reference."""
    i = F.col("c_custkey")
    wide, start = i % 97 == 0, (i * 104729) % 65000
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return rows.select(
        i.cast("int").alias("iv_id"), (i % 5).cast("int").alias("ref_id"), F.when(wide, 0).otherwise(start).cast("int").alias("start"),
        F.when(wide, REF_LENGTH - 1).otherwise(start + (i % 50) * 10).cast("int").alias("stop"),
    )


def reference_at(ref: Column, pos: Column, span: Column) -> Column:
    """``span`` bases of the made-up genome from a position, out of the chunks that they touch."""
    first = F.floor(pos / 32).cast("int")
    chunks = F.transform(F.sequence(first, F.floor((pos + span - 1) / 32).cast("int")), lambda n: _chunk(ref, n))
    return F.substring(F.array_join(chunks, ""), pos % 32 + 1, span)


def reference_base(cigar: Column, reference: Column, spot: Column) -> Column:
    """The reference's base under a place of the read; null where none is."""
    at = lambda ops: F.aggregate(
        ops, F.struct(F.lit(0).alias("read"), F.lit(0).alias("ref"), F.lit(None).cast("int").alias("found")),
        lambda a, x: F.struct(
            (a["read"] + F.when(F.substring(x, -1, 1).isin(*"MIS=X"), F.substring(x, F.lit(1), F.length(x) - 1).cast("int")).otherwise(0)).alias("read"),
            (a["ref"] + F.when(F.substring(x, -1, 1).isin(*"MDN=X"), F.substring(x, F.lit(1), F.length(x) - 1).cast("int")).otherwise(0)).alias("ref"),
            F.when(F.substring(x, -1, 1).isin(*"M=X") & (spot >= a["read"]) & (spot < a["read"] + F.substring(x, F.lit(1), F.length(x) - 1).cast("int")), a["ref"] + spot - a["read"]).otherwise(a["found"]).alias("found"),
        ),
    )
    found = at(F.regexp_extract_all(cigar, F.lit("([0-9]+[MIDNSHP=X])"), F.lit(1)))["found"]
    return F.when(found.isNotNull(), F.substring(reference, found + 1, F.lit(1)))


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {1: "offs", 2: "left_clip", 3: "right_clip", 4: "edits", 5: "has_edits", 6: "flags"}
    suffix = F.lit("ids")
    for n, name in names.items():
        suffix = F.when(F.col("l_linenumber") == n, name).otherwise(suffix)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select(F.col("l_returnflag").alias("dataset"), F.col("l_linestatus").alias("method"), suffix.alias("suffix"), (F.col("l_quantity").cast("long") * 1000).alias("bytes"))


def leaders(spark: SparkSession, sf_dir: str, n: int = 4) -> DataFrame:
    """Fixed leaders: the first ``n`` quality strings, numbered from 1."""
    return qv(spark, sf_dir).orderBy("aln_idx").limit(n).select((F.row_number().over(_by_index())).alias("leader"), "qual")


def _by_index():
    from pyspark.sql import Window

    return Window.orderBy("aln_idx")


GENOME_SQL = """genome AS (
  SELECT CAST(id AS INT) AS ref_id, 65536 AS length,
    array_to_string(list_transform(range(0, 2048), lambda n: translate(md5(concat(CAST(id AS VARCHAR), ':', CAST(n AS VARCHAR))), '0123456789abcdef', 'ACGTACGTACGTACGT')), '') AS seq
  FROM range(5) t(id))"""
CONTIGS_SQL = """contigs AS (
  SELECT p_partkey AS key, 'part' || CAST(p_partkey AS VARCHAR) AS name,
    array_to_string(list_transform(range(0, p_size + 1), lambda n: translate(md5(concat(CAST(p_partkey AS VARCHAR), ':', CAST(n AS VARCHAR))), '0123456789abcdef', 'ACGTACGTACGTACGT')), '') AS seq
  FROM part)"""
ALN_SQL = GENOME_SQL + """,
k0 AS (
  SELECT event_id AS aln_idx, CAST(user_id % 5 AS INT) AS ref_id, CAST(((event_id * 7919) % 2500) * 26 AS INT) AS pos,
    CAST(CASE WHEN event_id % 17 = 0 THEN 4 ELSE 0 END + CASE WHEN event_id % 2 = 1 THEN 16 ELSE 0 END
       + CASE WHEN event_id % 10 = 0 THEN 256 ELSE 0 END + CASE WHEN event_id % 37 = 0 THEN 2048 ELSE 0 END AS INT) AS flag,
    CAST((event_id * 31) % 61 AS INT) AS mapq, CAST(event_id % 32 AS INT) AS mm, event_id % 3 = 0 AS has_mm,
    event_id % 8 = 0 AS noisy, event_id % 4 = 0 AS no_mate
  FROM events),
g0 AS (SELECT k0.*, substr(genome.seq, k0.pos + 1, 32) AS rs FROM k0 JOIN genome ON genome.ref_id = k0.ref_id),
aln AS (
  SELECT aln_idx, concat('read', CAST(aln_idx AS STRING)) AS qname, flag, ref_id, pos, mapq, '32M' AS cigar,
    CASE WHEN no_mate THEN -1 ELSE ref_id END AS rnext, CASE WHEN no_mate THEN 0 ELSE pos + 100 END AS pnext, CASE WHEN no_mate THEN 0 ELSE 132 END AS tlen,
    CASE WHEN has_mm THEN concat(substr(rs, 1, mm), translate(substr(rs, mm + 1, 1), 'ACGT', 'CGTA'), substr(rs, mm + 2, 32)) ELSE rs END AS seq,
    CASE WHEN noisy THEN translate(md5(concat('q', CAST(aln_idx AS STRING))), '0123456789abcdef', '!#%+5:?@ABCDEFGH')
         ELSE translate(md5(concat('q', CAST(aln_idx AS STRING))), '0123456789abcdef', 'IIIIIIIIIIIIHFDB') END AS qual,
    CASE WHEN has_mm THEN concat(CAST(mm AS STRING), substr(rs, mm + 1, 1), CAST(31 - mm AS STRING)) ELSE '32' END AS md
  FROM g0),
m AS (SELECT * FROM aln WHERE flag & 4 = 0),
qv AS (SELECT aln_idx, qual FROM aln WHERE flag & 2304 = 0)"""
CIGAR_SQL = ALN_SQL + f""",
ca AS (SELECT aln.* REPLACE (list_extract({CIGARS!r}, CAST(aln_idx % {len(CIGARS)} AS INT) + 1) AS cigar) FROM aln)"""
IV_SQL = """iv AS (
  SELECT CAST(c_custkey AS INT) AS iv_id, CAST(c_custkey % 5 AS INT) AS ref_id, CAST(CASE WHEN c_custkey % 97 = 0 THEN 0 ELSE (c_custkey * 104729) % 65000 END AS INT) AS start,
    CAST(CASE WHEN c_custkey % 97 = 0 THEN 65535 ELSE (c_custkey * 104729) % 65000 + (c_custkey % 50) * 10 END AS INT) AS stop FROM customer)"""
SIZES_SQL = """sizes AS (
  SELECT l_returnflag AS dataset, l_linestatus AS method,
    CASE l_linenumber WHEN 1 THEN 'offs' WHEN 2 THEN 'left_clip' WHEN 3 THEN 'right_clip' WHEN 4 THEN 'edits'
      WHEN 5 THEN 'has_edits' WHEN 6 THEN 'flags' ELSE 'ids' END AS suffix,
    CAST(l_quantity AS BIGINT) * 1000 AS bytes
  FROM lineitem)"""
