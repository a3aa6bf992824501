"""The registered queries, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alnspark.functions import sequence as sq
from alnspark.functions import text as tx
from alnspark.operators import compare, coverage, edits, encode, filters, intervals, ordered, quality, rebuild, report
from alnspark.plans import views as v
from alnspark.sources import fasta, files, head, logs, records, sam, store
from alnspark.streaming import offsets, runs
from alnspark.streaming.dictionary import GrowingDictionary
from alnspark.plans.views import ALN_SQL, CIGAR_SQL, CONTIGS_SQL, GENOME_SQL, IV_SQL, READ, SIZES_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, ctes: str = ALN_SQL):
    """Register a function (spark, sf_dir) under its name, with its SQL over the views in ``ctes``."""

    def put(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = f"WITH {ctes}\n{sql}" if ctes else sql
        return function

    return put


def _mapped(spark, sf):
    return filters.mapped(v.aln(spark, sf))


# ---- coverage

_DEPTH = """, s AS (SELECT ref_id, pos, count(*) AS n FROM m GROUP BY ref_id, pos),
c AS (SELECT *, least(coalesce(pos - lag(pos) OVER (PARTITION BY ref_id ORDER BY pos), 32), 32) AS new FROM s),
d AS (SELECT ref_id, CAST(sum(n) * 32 AS BIGINT) AS bases, CAST(sum(new) AS BIGINT) AS covered FROM c GROUP BY ref_id)"""


@query("SELECT ref_id, bases, covered, round(bases / covered, 6) AS depth FROM d", ALN_SQL + _DEPTH)
def depth_by_ref(spark, sf):
    return coverage.depth(_mapped(spark, sf), READ).withColumn("depth", F.round(F.col("bases") / F.col("covered"), 6))


@query("SELECT CAST(sum(bases) AS BIGINT) AS bases, CAST(sum(covered) AS BIGINT) AS covered, round(sum(bases) / sum(covered), 6) AS depth FROM d", ALN_SQL + _DEPTH)
def depth_overall(spark, sf):
    return coverage.depth(_mapped(spark, sf), READ).agg(F.sum("bases").alias("bases"), F.sum("covered").alias("covered"), F.round(F.sum("bases") / F.sum("covered"), 6).alias("depth"))


_BASES = ", b AS (SELECT ref_id, p, count(*) AS d FROM (SELECT ref_id, unnest(range(pos, pos + 32)) AS p FROM m) GROUP BY ref_id, p)"


@query("SELECT ref_id, CAST(sum(d) AS BIGINT) AS bases, count(*) AS covered, max(d) AS deepest FROM b GROUP BY ref_id", ALN_SQL + _BASES)
def depth_exploded(spark, sf):
    rows = coverage.depth_by_base(_mapped(spark, sf), READ)
    return rows.groupBy("ref_id").agg(F.sum("depth").alias("bases"), F.count("*").alias("covered"), F.max("depth").alias("deepest"))


@query("SELECT round(avg(d), 6) AS depth FROM b", ALN_SQL + _BASES)
def mean_depth_per_base(spark, sf):
    return coverage.depth_by_base(_mapped(spark, sf), READ).agg(F.round(F.avg("depth"), 6).alias("depth"))


# ---- encoding

@query("SELECT aln_idx, ref_id, CAST(pos - coalesce(lag(pos) OVER (PARTITION BY ref_id ORDER BY pos, aln_idx), 0) AS INT) AS delta FROM m")
def offset_delta(spark, sf):
    return encode.offset_deltas(_mapped(spark, sf)).select("aln_idx", "ref_id", "delta")


@query("SELECT ref_id, pos, CAST(pos - coalesce(lag(pos) OVER (PARTITION BY ref_id ORDER BY pos), 0) AS INT) AS delta, count(*) AS mult FROM m GROUP BY ref_id, pos")
def offset_rle(spark, sf):
    return encode.offset_runs(_mapped(spark, sf))


@query("SELECT ref_id, pos, count(*) AS n FROM m GROUP BY ref_id, pos")
def offset_decode(spark, sf):
    return encode.offsets_of(encode.offset_runs(_mapped(spark, sf))).groupBy("ref_id", "pos").agg(F.count("*").alias("n"))


def _dict_sql(column):
    return f"SELECT value, CAST(row_number() OVER (ORDER BY f) - 1 AS INT) AS code FROM (SELECT {column} AS value, min(aln_idx) AS f FROM aln GROUP BY {column})"


@query(_dict_sql("flag"))
def flag_dict(spark, sf):
    return encode.first_seen(v.aln(spark, sf), "flag")


@query(_dict_sql("mapq"))
def mapq_dict(spark, sf):
    return encode.first_seen(v.aln(spark, sf), "mapq")


@query(_dict_sql("rnext"))
def rnext_dict(spark, sf):
    return encode.first_seen(v.aln(spark, sf), "rnext")


_DICTS = "".join(f", {c}_d AS ({_dict_sql(c)})" for c in ("flag", "mapq", "rnext"))


@query("""SELECT aln_idx, flag_d.code AS flag_code, mapq_d.code AS mapq_code, rnext_d.code AS rnext_code, pnext, pnext - tlen AS pnext_tlen
FROM aln JOIN flag_d ON flag = flag_d.value JOIN mapq_d ON mapq = mapq_d.value JOIN rnext_d ON rnext = rnext_d.value""", ALN_SQL + _DICTS)
def flags_encode(spark, sf):
    return encode.encode_flags(v.aln(spark, sf))


@query("SELECT aln_idx, flag, mapq, rnext, pnext, tlen FROM aln")
def flags_decode(spark, sf):
    rows = v.aln(spark, sf)
    return encode.decode_flags(encode.encode_flags(rows), {c: encode.first_seen(rows, c) for c in ("flag", "mapq", "rnext")})


@query("SELECT aln_idx, pnext - tlen AS stored, pnext - (pnext - tlen) AS tlen FROM aln")
def tlen_transform(spark, sf):
    stored = F.col("pnext") - F.col("tlen")
    return v.aln(spark, sf).select("aln_idx", stored.alias("stored"), (F.col("pnext") - stored).alias("tlen"))


@query("SELECT aln_idx, flag, ref_id, pos, seq, CASE WHEN flag & 256 = 0 THEN qual END AS qual FROM aln")
def stream_zip(spark, sf):
    a = v.aln(spark, sf)
    return encode.zip_streams(a.select("aln_idx", "flag"), a.select("aln_idx", "ref_id", "pos"), a.select("aln_idx", "seq"), a.where("flag & 256 = 0").select("aln_idx", "qual"))


@query("SELECT aln_idx, CASE WHEN aln_idx % 3 = 0 THEN md END AS md FROM aln")
def sparse_zip(spark, sf):
    a = v.aln(spark, sf)
    lists = ordered.row_numbers(a.where("aln_idx % 3 = 0").select("aln_idx", "md"), [], ["aln_idx"], "n").select("n", "md")
    return encode.zip_sparse(a.select("aln_idx", (F.col("aln_idx") % 3 == 0).alias("present")), lists).select("aln_idx", "md")


# ---- filters and projections

@query("SELECT aln_idx, flag FROM aln WHERE flag & 4 <> 0")
def filter_unaligned(spark, sf):
    return v.aln(spark, sf).where(filters.is_unaligned(F.col("flag"))).select("aln_idx", "flag")


@query("SELECT aln_idx, flag FROM aln WHERE flag & 2304 = 0")
def filter_primary(spark, sf):
    return v.aln(spark, sf).where(filters.is_primary(F.col("flag"))).select("aln_idx", "flag")


@query("SELECT aln_idx, flag FROM aln WHERE flag & 16 <> 0")
def filter_reverse(spark, sf):
    return v.aln(spark, sf).where(filters.is_reverse(F.col("flag"))).select("aln_idx", "flag")


@query("SELECT aln_idx, ref_id, pos, cigar, seq, md FROM aln")
def seq_only(spark, sf):
    return filters.project(v.aln(spark, sf), 1)


@query("SELECT aln_idx, qname, flag, mapq, rnext, pnext, tlen FROM aln")
def mask_project(spark, sf):
    return filters.project(v.aln(spark, sf), 2 | 4)


@query("SELECT aln_idx, '*' AS qname, flag, ref_id, pos, mapq, cigar, -1 AS rnext, 0 AS pnext, 0 AS tlen, seq, '*' AS qual, md FROM m")
def strip_fields(spark, sf):
    return filters.strip_fields(v.aln(spark, sf))


@query("SELECT aln_idx, CASE WHEN flag & 256 <> 0 THEN '*' ELSE qual END AS qual FROM aln")
def secondary_qual_star(spark, sf):
    return filters.shown_quality(v.aln(spark, sf)).select("aln_idx", "qual")


@query("SELECT aln_idx, flag, pos, cigar, seq FROM aln")
def column_subset(spark, sf):
    return v.aln(spark, sf).select("aln_idx", "flag", "pos", "cigar", "seq")


@query("SELECT aln_idx, pos, seq FROM m WHERE ref_id = 2 AND pos >= 1000 AND pos < 5000")
def view_region(spark, sf):
    """By the zone map of alignments stored by coordinate."""
    path = files.new_path(spark, "store")
    store.write(_mapped(spark, sf).select("aln_idx", "ref_id", "pos", "seq"), path, 2_000)
    return store.view(spark, path, 2, 1000, 5000).select("aln_idx", "pos", "seq")


@query("SELECT aln_idx, pos, seq FROM m WHERE ref_id = 2 AND pos >= 1000 AND pos < 5000")
def view_region_scan(spark, sf):
    return filters.view(_mapped(spark, sf), 2, 1000, 5000).select("aln_idx", "pos", "seq")


_REGIONS = IV_SQL + """, regions AS (SELECT iv_id, CASE iv_id % 4 WHEN 0 THEN 'chr' || (ref_id + 1) || ':' || start || '-' || stop WHEN 1 THEN 'scaffold:' || ref_id || ':' || start || '-' || stop
  WHEN 2 THEN 'chr' || (ref_id + 1) ELSE 'chrX:' || start END AS region FROM iv)"""


@query("""SELECT iv_id, region, regexp_extract(region, '^(.+):(\\d+)-(\\d+)$', 1) AS name, TRY_CAST(regexp_extract(region, '^(.+):(\\d+)-(\\d+)$', 2) AS INT) AS start,
  TRY_CAST(regexp_extract(region, '^(.+):(\\d+)-(\\d+)$', 3) AS INT) AS stop FROM regions""", _REGIONS)
def parse_region(spark, sf):
    """Regions with a range, with colons in the name, without a range, and with half of one."""
    text = lambda c: F.col(c).cast("string")
    span, chromosome, kind = F.concat(text("start"), F.lit("-"), text("stop")), F.concat(F.lit("chr"), (F.col("ref_id") + 1).cast("string")), F.col("iv_id") % 4
    region = F.when(kind == 0, F.concat(chromosome, F.lit(":"), span)).when(kind == 1, F.concat(F.lit("scaffold:"), text("ref_id"), F.lit(":"), span)).when(kind == 2, chromosome).otherwise(F.concat(F.lit("chrX:"), text("start")))
    return v.iv(spark, sf).select("iv_id", region.alias("region")).select("iv_id", "region", tx.region(F.col("region")).alias("p")).select("iv_id", "region", "p.*")


@query("""SELECT count(*) AS n_reads, count(*) FILTER (WHERE flag & 4 <> 0) AS unaligned, count(*) FILTER (WHERE flag & 4 = 0) AS aligned,
  count(*) FILTER (WHERE flag & 2304 = 0) AS is_primary, count(*) FILTER (WHERE flag & 16 <> 0) AS is_reverse FROM aln""")
def record_counts(spark, sf):
    flag = F.col("flag")
    return v.aln(spark, sf).agg(
        F.count("*").alias("n_reads"), F.count_if(filters.is_unaligned(flag)).alias("unaligned"), F.count_if(~filters.is_unaligned(flag)).alias("aligned"),
        F.count_if(filters.is_primary(flag)).alias("is_primary"), F.count_if(filters.is_reverse(flag)).alias("is_reverse"),
    )


@query("""SELECT event_id, (SELECT string_agg(k || ':' || t || ':' || x, chr(9) ORDER BY k) FROM (SELECT unnest(ks) AS k, unnest(ts) AS t, unnest(xs) AS x) WHERE k NOT IN ('MD', 'NM') AND k NOT LIKE 'X%') AS tags
FROM (SELECT event_id, ['MD', 'NM', 'XS', 'AS', 'KV'] AS ks, ['Z', 'i', 'i', 'i', 'Z'] AS ts, ['32', '1', '7', CAST(event_id % 50 AS VARCHAR), json_extract_string(props, '$.k')] AS xs FROM events)""", "")
def opt_tags_filter(spark, sf):
    values = (("MD", "Z", F.lit("32")), ("NM", "i", F.lit("1")), ("XS", "i", F.lit("7")), ("AS", "i", (F.col("event_id") % 50).cast("string")), ("KV", "Z", F.get_json_object("props", "$.k")))
    tags = F.array(*[F.struct(F.lit(k).alias("tag"), F.lit(t).alias("type"), x.alias("value")) for k, t, x in values])
    shown = F.transform(F.array_sort(filters.keep_tags(tags)), lambda t: F.concat(t["tag"], F.lit(":"), t["type"], F.lit(":"), t["value"]))
    return v.events(spark, sf).select("event_id", F.array_join(shown, "\t").alias("tags"))


# ---- sequence functions

_RC = "reverse(translate(seq, 'ACGT', 'TGCA'))"
_MIN = "(SELECT min(substr({0}, i, 12)) FROM (SELECT unnest(range(1, length({0}) - 10)) AS i))"


@query(f"SELECT aln_idx, {_RC} AS rc FROM aln")
def revcomp(spark, sf):
    return v.aln(spark, sf).select("aln_idx", sq.reverse_complement(F.col("seq")).alias("rc"))


_MINS = f""", p AS (SELECT aln_idx, seq, {_RC} AS rc FROM aln),
q AS (SELECT aln_idx, seq, rc, list_min(list_transform(range(1, 22), lambda i: substr(seq, i, 12))) AS f, list_min(list_transform(range(1, 22), lambda i: substr(rc, i, 12))) AS r FROM p)"""


@query("SELECT aln_idx, f AS minimizer FROM q", ALN_SQL + _MINS)
def minimizer12(spark, sf):
    return v.aln(spark, sf).select("aln_idx", sq.minimizer(F.col("seq")).alias("minimizer"))


@query("SELECT q.aln_idx, CASE WHEN r < f THEN rc ELSE q.seq END AS canonical, r < f AS swapped, CASE WHEN r < f THEN reverse(qual) ELSE qual END AS qual FROM q JOIN aln ON q.aln_idx = aln.aln_idx", ALN_SQL + _MINS)
def canonical_strand(spark, sf):
    rows = v.aln(spark, sf).select("aln_idx", "seq", "qual", sq.swaps_strand(F.col("seq")).alias("swapped"))
    turn = lambda c, turned: sq.on_strand(F.col(c), F.col("swapped"), turned)
    return rows.select("aln_idx", turn("seq", sq.reverse_complement(F.col("seq"))).alias("canonical"), "swapped", turn("qual", F.reverse("qual")).alias("qual"))


@query("SELECT count(*) FILTER (WHERE r < f) AS swapped FROM q", ALN_SQL + _MINS)
def strand_swaps(spark, sf):
    return v.aln(spark, sf).agg(F.count_if(sq.swaps_strand(F.col("seq"))).alias("swapped"))


@query("SELECT aln_idx, translate(substr(seq, 1, 1), 'NACGT', 'VWXYZ') AS code, substr(seq, 1, 1) AS base FROM aln")
def indel_code(spark, sf):
    code = sq.insert_code(F.substring("seq", 1, 1))
    return v.aln(spark, sf).select("aln_idx", code.alias("code"), sq.inserted_base(code).alias("base"))


@query("SELECT aln_idx, CAST(list_sum(list_transform(range(0, 12), lambda i: (strpos('ACGT', substr(seq, CAST(i + 1 AS INT), 1)) - 1) * CAST(pow(4, i) AS BIGINT))) AS BIGINT) AS packed FROM aln")
def pack2bit(spark, sf):
    return v.aln(spark, sf).select("aln_idx", sq.pack_2bit(F.substring("seq", 1, 12)).alias("packed"))


@query("SELECT aln_idx, chr(mapq + 33) AS phred FROM aln")
def phred33(spark, sf):
    return v.aln(spark, sf).select("aln_idx", sq.phred33(F.col("mapq")).alias("phred"))


@query("SELECT n AS nibble, substr('=ACMGRSVTWYHKDBN', CAST(n + 1 AS INT), 1) AS base, cnt FROM (SELECT CAST(aln_idx % 16 AS INT) AS n, count(*) AS cnt FROM aln GROUP BY 1)")
def base_decode(spark, sf):
    n = (F.col("aln_idx") % 16).cast("int")
    return v.aln(spark, sf).groupBy(n.alias("nibble")).agg(F.count("*").alias("cnt")).select("nibble", sq.base_of_nibble(F.col("nibble")).alias("base"), "cnt")


_KMERS = ", km AS (SELECT aln_idx, unnest(list_transform(range(1, length(qual) - 2), lambda i: substr(qual, CAST(i AS INT), 4))) AS kmer FROM qv)"


@query("SELECT kmer, count(*) AS n FROM km GROUP BY kmer", ALN_SQL + _KMERS)
def kmer4_hist(spark, sf):
    return v.qv(spark, sf).select(F.explode(sq.kmers(F.col("qual"), 4)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))


@query("""SELECT CAST((ascii(substr(kmer, 1, 1)) - 33) * 729000 + (ascii(substr(kmer, 2, 1)) - 33) * 8100 + (ascii(substr(kmer, 3, 1)) - 33) * 90 + ascii(substr(kmer, 4, 1)) - 33 AS BIGINT) AS code, count(*) AS n
FROM km GROUP BY 1""", ALN_SQL + _KMERS)
def kmer_code90(spark, sf):
    return v.qv(spark, sf).select(F.explode(sq.kmers(F.col("qual"), 4)).alias("kmer")).groupBy(sq.kmer_code90(F.col("kmer")).alias("code")).agg(F.count("*").alias("n"))


@query("""SELECT aln_idx, c AS mode, n FROM (SELECT aln_idx, c, count(*) AS n, row_number() OVER (PARTITION BY aln_idx ORDER BY count(*) DESC, c) AS place
  FROM (SELECT aln_idx, unnest(string_split(qual, '')) AS c FROM qv) GROUP BY aln_idx, c) WHERE place = 1""")
def char_mode(spark, sf):
    chars = v.qv(spark, sf).select("aln_idx", F.explode(F.split("qual", "")).alias("c")).groupBy("aln_idx", "c").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("k"), F.col("c")))
    return chars.groupBy("aln_idx").agg(best.alias("b")).select("aln_idx", F.col("b.c").alias("mode"), (-F.col("b.k")).alias("n"))


@query("""SELECT aln_idx, string_agg(c || CAST(n AS VARCHAR), '' ORDER BY g) AS runs FROM (
  SELECT aln_idx, g, any_value(c) AS c, count(*) AS n FROM (
    SELECT *, sum(new) OVER (PARTITION BY aln_idx ORDER BY i) AS g FROM (
      SELECT *, CASE WHEN c = lag(c) OVER (PARTITION BY aln_idx ORDER BY i) THEN 0 ELSE 1 END AS new FROM (
        SELECT aln_idx, unnest(string_split(qual, '')) AS c, unnest(range(0, length(qual))) AS i FROM qv))) GROUP BY aln_idx, g) GROUP BY aln_idx""")
def char_rle(spark, sf):
    start = F.struct(F.lit("").alias("c"), F.lit(0).alias("n"), F.lit("").alias("done"))
    shut = lambda a: F.concat(a["done"], F.when(a["n"] > 0, F.concat(a["c"], a["n"].cast("string"))).otherwise(F.lit("")))
    fold = F.aggregate(F.split("qual", ""), start, lambda a, c: F.when(a["c"] == c, F.struct(c.alias("c"), (a["n"] + 1).alias("n"), a["done"].alias("done"))).otherwise(F.struct(c.alias("c"), F.lit(1).alias("n"), shut(a).alias("done"))), shut)
    return v.qv(spark, sf).select("aln_idx", fold.alias("runs"))


@query("SELECT aln_idx, CASE WHEN flag & 16 <> 0 THEN reverse(qual) ELSE qual END AS qual FROM aln")
def quality_by_strand(spark, sf):
    return v.aln(spark, sf).select("aln_idx", sq.quality_by_strand(F.col("qual"), F.col("flag")).alias("qual"))


@query("SELECT event_id, CAST(event_id * 37 % 100000 AS INT) AS length, CAST(event_id * 37 % 100000 AS INT) > 65535 AS wide, CAST((event_id * 37 % 100000) >> 16 & 255 AS INT) AS b2, CAST((event_id * 37 % 100000) >> 8 & 255 AS INT) AS b1, CAST((event_id * 37 % 100000) & 255 AS INT) AS b0 FROM events", "")
def splice_bytes(spark, sf):
    n = v.events(spark, sf).select("event_id", (F.col("event_id") * 37 % 100000).cast("int").alias("n"))
    parts = n.withColumn("p", sq.splice_bytes(F.col("n")))
    return parts.select("event_id", sq.splice_length(F.col("p")).alias("length"), "p.*")


@query("""SELECT aln_idx, row_number() OVER (PARTITION BY b ORDER BY seq, aln_idx) AS place, b AS batch, seq
FROM (SELECT aln_idx, seq, CAST((aln_idx) // 10000 AS BIGINT) AS b FROM aln WHERE flag & 4 <> 0)""")
def unaligned_sorted(spark, sf):
    rows = v.aln(spark, sf).where(filters.is_unaligned(F.col("flag"))).select("aln_idx", "seq", F.floor(F.col("aln_idx") / 10000).alias("batch"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("batch").orderBy("seq", "aln_idx")).cast("long"))


# ---- references and edits

_REFSEQ = ", r AS (SELECT aln.*, substr(genome.seq, pos + 1, 32) AS ref FROM aln JOIN genome USING (ref_id))"


def _with_reference(spark, sf, rows=None):
    """Alignments with their reference slice, by way of genome chunks."""
    chunks = v.genome_chunks(spark).select("ref_id", "chunk", F.col("seq").alias("piece"))
    own = (rows if rows is not None else v.aln(spark, sf)).withColumn("chunk", F.floor(F.col("pos") / 32).cast("int"))
    return own.join(chunks, ["ref_id", "chunk"]).withColumn("ref", F.substring("piece", F.col("pos") % 32 + 1, F.lit(READ))).drop("chunk", "piece")


@query("SELECT aln_idx, ref FROM r", ALN_SQL + _REFSEQ)
def ref_lookup(spark, sf):
    return _with_reference(spark, sf).select("aln_idx", "ref")


@query("""SELECT name, start, CASE WHEN start + 40 <= length(seq) THEN substr(seq, CAST(start + 1 AS INT), 40) END AS slice
FROM (SELECT name, seq, CAST((key * 37) % (length(seq) + 20) AS INT) AS start FROM contigs)""", CONTIGS_SQL)
def ref_slice_checked(spark, sf):
    at = ((F.col("key") * 37) % (F.length("seq") + 20)).cast("int")
    return v.contigs(spark, sf).withColumn("start", at).select("name", "start", sq.checked_slice(F.col("seq"), F.col("start"), F.lit(40)).alias("slice"))


_MM = ", mm AS (SELECT aln_idx, i AS spot, substr(seq, CAST(i + 1 AS INT), 1) AS base, substr(ref, CAST(i + 1 AS INT), 1) AS ref_base FROM (SELECT *, unnest(range(0, 32)) AS i FROM r) WHERE substr(seq, CAST(i + 1 AS INT), 1) <> substr(ref, CAST(i + 1 AS INT), 1))"


def _mismatches(spark, sf):
    found = edits.mismatches(F.col("seq"), F.col("ref"))
    return _with_reference(spark, sf).select("aln_idx", F.posexplode(found).alias("ord", "e")).select("aln_idx", "ord", F.col("e.at").alias("at"), F.col("e.base").alias("base"))


@query("SELECT aln_idx, CAST(spot AS INT) AS spot, base FROM mm", ALN_SQL + _REFSEQ + _MM)
def mismatch_list(spark, sf):
    return _mismatches(spark, sf).select("aln_idx", F.col("at").alias("spot"), "base")


@query("SELECT aln_idx, CAST(spot AS INT) AS spot, ref_base AS base FROM mm", ALN_SQL + _REFSEQ + _MM)
def md_parse(spark, sf):
    found = F.explode(edits.md_mismatches(F.col("md")))
    return v.aln(spark, sf).select("aln_idx", found.alias("e")).select("aln_idx", F.col("e.at").alias("spot"), F.col("e.base").alias("base"))


_OPS = """, cp AS (SELECT aln_idx, unnest(regexp_extract_all(cigar, '\\d+[MIDNSHP=X]')) AS part, unnest(range(0, len(regexp_extract_all(cigar, '\\d+[MIDNSHP=X]')))) AS ord FROM ca),
co AS (SELECT aln_idx, CAST(ord AS INT) AS ord, right(part, 1) AS op, CAST(left(part, length(part) - 1) AS INT) AS len FROM cp),
ops AS (SELECT *, CAST(coalesce(sum(CASE WHEN op IN ('M', 'I', 'S', '=', 'X') THEN len ELSE 0 END) OVER w, 0) AS INT) AS read_at,
  CAST(coalesce(sum(CASE WHEN op IN ('M', 'D', 'N', '=', 'X') THEN len ELSE 0 END) OVER w, 0) AS INT) AS ref_at
  FROM co WINDOW w AS (PARTITION BY aln_idx ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _ops(spark, sf):
    return edits.cigar_ops(v.with_cigars(v.aln(spark, sf)))


@query("SELECT aln_idx, ord, op, len, read_at, ref_at FROM ops", CIGAR_SQL + _OPS)
def cigar_parse(spark, sf):
    return _ops(spark, sf)


@query("SELECT aln_idx, regexp_matches(cigar, '[IDNSH]') AS edited FROM ca", CIGAR_SQL)
def cigar_has_edits(spark, sf):
    return v.with_cigars(v.aln(spark, sf)).select("aln_idx", edits.has_edits(F.col("cigar")).alias("edited"))


@query("SELECT aln_idx, ord, op, len FROM ops WHERE op = 'X'", CIGAR_SQL + _OPS)
def mismatch_only(spark, sf):
    return _ops(spark, sf).where(F.col("op") == "X").select("aln_idx", "ord", "op", "len")


_EDITS = """, e1 AS (SELECT aln_idx, ord, op, len, read_at AS spot FROM ops WHERE op NOT IN ('M', '=')),
dl AS (SELECT *, CAST(spot - coalesce(lag(spot) OVER (PARTITION BY aln_idx ORDER BY ord), 0) AS INT) AS delta,
  CAST(coalesce(sum(CASE WHEN op = 'I' THEN len ELSE 0 END) OVER (PARTITION BY aln_idx ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS inserts FROM e1)"""


def _edit_rows(spark, sf):
    return _ops(spark, sf).where(~F.col("op").isin("M", "=")).select("aln_idx", "ord", "op", "len", F.col("read_at").alias("at"))


@query("SELECT aln_idx, ord, op, spot, delta FROM dl", CIGAR_SQL + _OPS + _EDITS)
def edit_delta(spark, sf):
    return edits.deltas(_edit_rows(spark, sf)).select("aln_idx", "ord", "op", F.col("at").alias("spot"), "delta")


@query("SELECT aln_idx, ord, op, inserts FROM dl", CIGAR_SQL + _OPS + _EDITS)
def insert_running(spark, sf):
    return edits.inserts_before(_edit_rows(spark, sf)).select("aln_idx", "ord", "op", "inserts")


@query("SELECT CAST(sum(n) AS BIGINT) AS edits, count(*) AS n_reads FROM (SELECT aln_idx, count(*) AS n FROM e1 GROUP BY aln_idx)", CIGAR_SQL + _OPS + _EDITS)
def total_edits(spark, sf):
    return _edit_rows(spark, sf).groupBy("aln_idx").agg(F.count("*").alias("n")).agg(F.sum("n").alias("edits"), F.count("*").alias("n_reads"))


@query("SELECT aln_idx, count(*) AS n FROM e1 GROUP BY aln_idx HAVING count(*) <= 1", CIGAR_SQL + _OPS + _EDITS)
def long_edit_reject(spark, sf):
    return _edit_rows(spark, sf).groupBy("aln_idx").agg(F.count("*").alias("n")).where("n <= 1")


@query("""SELECT (SELECT count(*) FROM mm) AS edits, (SELECT count(DISTINCT aln_idx) FROM mm) AS edited, count(*) AS n_reads,
  round((SELECT count(*) FROM mm) * 100 / (count(*) * 32), 6) AS percent FROM aln""", ALN_SQL + _REFSEQ + _MM)
def error_rate(spark, sf):
    rows = _with_reference(spark, sf).select(F.size(edits.mismatches(F.col("seq"), F.col("ref"))).alias("n"))
    return rows.agg(F.sum("n").alias("edits"), F.count_if(F.col("n") > 0).alias("edited"), F.count("*").alias("n_reads"), F.round(F.sum("n") * 100 / (F.count("*") * READ), 6).alias("percent"))


_MERGED = """, two AS (SELECT aln_idx, spot, 0 AS side, ord, op AS base FROM e1 UNION ALL SELECT aln_idx, CAST(spot AS INT), 1, 0, base FROM mm)"""


@query("SELECT aln_idx, string_agg(CAST(spot AS VARCHAR) || base, ',' ORDER BY spot, side, ord) AS edits FROM two GROUP BY aln_idx", CIGAR_SQL + _REFSEQ + _MM + _OPS + _EDITS + _MERGED)
def edits_merge(spark, sf):
    cig = _edit_rows(spark, sf).groupBy("aln_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "at", "op"))), lambda x: F.struct(x["at"].alias("at"), x["op"].alias("base"))).alias("c"))
    md = _with_reference(spark, sf).select("aln_idx", edits.mismatches(F.col("seq"), F.col("ref")).alias("m"))
    none = F.array().cast("array<struct<at:int,base:string>>")
    both = md.join(cig, "aln_idx", "left").withColumn("e", edits.merge(F.coalesce("c", none), F.col("m"))).where(F.size("e") > 0)
    return both.select("aln_idx", F.array_join(F.transform("e", lambda x: F.concat(x["at"].cast("string"), x["base"])), ",").alias("edits"))



@query("SELECT aln_idx, count(*) AS n FROM two WHERE base IN ('A', 'C', 'G', 'T', 'N') GROUP BY aln_idx", CIGAR_SQL + _REFSEQ + _MM + _OPS + _EDITS + _MERGED)
def mismatch_codes(spark, sf):
    codes = _edit_rows(spark, sf).select("aln_idx", F.col("op").alias("code")).union(_mismatches(spark, sf).select("aln_idx", "base"))
    return codes.where(edits.is_mismatch(F.col("code"))).groupBy("aln_idx").agg(F.count("*").alias("n"))


@query("SELECT aln_idx, CAST(row_number() OVER (PARTITION BY aln_idx ORDER BY ord) AS INT) AS run, op, read_at AS at, CAST(len AS BIGINT) AS len FROM ops WHERE op IN ('I', 'D')", CIGAR_SQL + _OPS)
def indel_runs(spark, sf):
    each = _ops(spark, sf).where(F.col("op").isin("I", "D")).select("aln_idx", "ord", "op", F.col("read_at").alias("at"), F.explode(F.sequence(F.lit(0), F.col("len") - 1)).alias("i"))
    return edits.indel_runs(each, ["ord", "i"])


@query("""SELECT aln_idx, CASE WHEN cigar LIKE '4S%' THEN left(seq, 4) END AS left_clip, CASE WHEN cigar LIKE '%4S' THEN right(seq, 4) END AS right_clip FROM ca WHERE cigar LIKE '%S%'""", CIGAR_SQL)
def softclips(spark, sf):
    return edits.soft_clips(v.with_cigars(v.aln(spark, sf)).where(F.col("cigar").contains("S"))).select("aln_idx", "left_clip", "right_clip")


_REBUILT = _OPS + """,
ro AS (SELECT o.*, coalesce(sum(CASE WHEN op IN ('M', '=', 'X') THEN len ELSE 0 END) OVER w, 0) AS m_at, coalesce(sum(CASE WHEN op = 'I' THEN len ELSE 0 END) OVER w, 0) AS ins_at,
    ca.aln_idx % 3 = 0 AS has, ca.aln_idx % 32 AS spot, substr(g.seq, pos + 1, 600) AS ref, translate(md5('i' || ca.aln_idx), '0123456789abcdef', 'ACGTACGTACGTACGT') AS own
  FROM ops o JOIN ca ON o.aln_idx = ca.aln_idx JOIN genome g ON g.ref_id = ca.ref_id WINDOW w AS (PARTITION BY o.aln_idx ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rp AS (SELECT *, has AND op IN ('M', '=', 'X') AND spot >= read_at AND spot < read_at + len AS hit, substr(ref, CAST(ref_at + spot - read_at + 1 AS INT), 1) AS ref_base,
    CASE WHEN op IN ('M', '=', 'X') THEN substr(ref, ref_at + 1, len) WHEN op = 'I' THEN substr(own, CAST(ins_at + 1 AS INT), len) WHEN op = 'S' AND read_at = 0 THEN substr(own, 9, len) WHEN op = 'S' THEN substr(own, 17, len) ELSE '' END AS piece FROM ro),
rs AS (SELECT aln_idx, string_agg(CASE WHEN hit THEN left(piece, CAST(spot - read_at AS INT)) || translate(ref_base, 'ACGT', 'CGTA') || substr(piece, CAST(spot - read_at + 2 AS INT)) ELSE piece END, '' ORDER BY ord) AS seq,
    sum(CASE WHEN op IN ('M', '=', 'X') THEN len ELSE 0 END) AS aligned FROM rp GROUP BY aln_idx),
re AS (SELECT aln_idx, m_at + spot - read_at AS m, 1 AS width, ref_base AS text FROM rp WHERE hit UNION ALL SELECT aln_idx, m_at, 0, '^' || substr(ref, ref_at + 1, len) FROM ro WHERE op = 'D'),
rt AS (SELECT *, CAST(m - coalesce(lag(m + width) OVER (PARTITION BY aln_idx ORDER BY m, width), 0) AS BIGINT) AS gap FROM re),
rm AS (SELECT aln_idx, string_agg(gap || text, '' ORDER BY m, width) AS md, max(m + width) AS stop FROM rt GROUP BY aln_idx)"""


@query("SELECT rs.aln_idx, seq, coalesce(md, '') || CAST(aligned - coalesce(stop, 0) AS BIGINT) AS md FROM rs LEFT JOIN rm ON rs.aln_idx = rm.aln_idx", CIGAR_SQL + _REBUILT)
def sam_rebuild(spark, sf):
    """Reads with every kind of operation, from reference, clips, inserts and a mismatch in every third."""
    rows, own = v.with_cigars(v.aln(spark, sf)), F.translate(F.md5(F.concat(F.lit("i"), F.col("aln_idx").cast("string"))), v.HEX, v.BASES)
    span = F.aggregate(F.regexp_extract_all("cigar", F.lit("([0-9]+)[MDNX=]"), F.lit(1)), F.lit(0), lambda n, x: n + x.cast("int"))
    spot, reference = F.col("aln_idx").cast("int") % 32, v.reference_at(F.col("ref_id"), F.col("pos"), span)
    base = F.translate(v.reference_base(F.col("cigar"), F.col("reference"), spot), "ACGT", "CGTA")
    rows = rows.withColumn("reference", reference)
    change = F.when((F.col("aln_idx") % 3 == 0) & base.isNotNull(), F.array(F.struct(spot.alias("at"), base.alias("base"))))
    held = rows.select("aln_idx", "cigar", "reference", change.alias("mismatches"), own.alias("inserts"), F.substring(own, 9, 8).alias("left_clip"), F.substring(own, 17, 8).alias("right_clip"))
    return rebuild.rebuild(held).select("aln_idx", "seq", "md")


@query("""SELECT aln_idx, concat_ws(chr(9), qname, CAST(flag AS VARCHAR), 'ref' || CAST(ref_id AS VARCHAR), CAST(pos + 1 AS VARCHAR), CAST(mapq AS VARCHAR), cigar,
  CASE WHEN rnext < 0 THEN '*' WHEN rnext = ref_id THEN '=' ELSE 'ref' || CAST(rnext AS VARCHAR) END, CASE WHEN rnext < 0 THEN '0' ELSE CAST(pnext + 1 AS VARCHAR) END,
  CAST(tlen AS VARCHAR), seq, qual, 'MD:Z:' || md) AS line FROM aln""")
def sam_lines(spark, sf):
    rows = v.aln(spark, sf).withColumn("opt", F.lit(None).cast("array<struct<tag:string,type:string,value:string>>"))
    return sam.named(rows, _ref_names(spark)).select("aln_idx", rebuild.sam_line().alias("line"))


@query("SELECT CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS gained, count(*) AS n_reads FROM aln")
def roundtrip_diff(spark, sf):
    a = v.aln(spark, sf).select("aln_idx", "flag", "mapq", "rnext", "pnext", "tlen")
    found = compare.difference(a, flags_decode(spark, sf))
    side = lambda df, *x: df.agg(*x)
    lost = side(found, F.coalesce(F.sum("lost"), F.lit(0)).alias("lost"), F.coalesce(F.sum("gained"), F.lit(0)).alias("gained"))
    return lost.join(F.broadcast(side(a, F.count("*").alias("n_reads"))))  # single rows


_CHANGED = """, b AS (SELECT aln_idx, CASE WHEN aln_idx % 997 = 3 THEN NULL ELSE mapq END AS mapq, qname FROM aln WHERE aln_idx % 1009 <> 5 UNION ALL SELECT aln_idx, mapq, qname FROM aln WHERE aln_idx % 499 = 7),
c AS (SELECT aln_idx, mapq, qname, count(*) FILTER (side = 'a') AS na, count(*) FILTER (side = 'b') AS nb FROM (SELECT aln_idx, mapq, qname, 'a' AS side FROM aln UNION ALL SELECT *, 'b' FROM b) GROUP BY ALL)"""


@query("SELECT aln_idx, mapq, qname, greatest(na - nb, 0) AS lost, greatest(nb - na, 0) AS gained FROM c WHERE na <> nb", ALN_SQL + _CHANGED)
def planted_diff(spark, sf):
    """Some rows changed, some left out and some twice."""
    a = v.aln(spark, sf).select("aln_idx", "mapq", "qname")
    changed = a.where("aln_idx % 1009 <> 5").withColumn("mapq", F.when(F.col("aln_idx") % 997 != 3, F.col("mapq")))
    return compare.difference(a, changed.union(a.where("aln_idx % 499 = 7")))


@query("SELECT CAST(row_number() OVER (ORDER BY key) - 1 AS INT) AS ref_id, name, CAST(length(seq) AS BIGINT) AS length FROM contigs", CONTIGS_SQL)
def ref_name_map(spark, sf):
    """Names and their ids, by the header of a SAM file."""
    path = files.new_path(spark, "header")
    line = F.concat(F.lit("@SQ\tSN:"), "name", F.lit("\tLN:"), F.length("seq").cast("string"))
    files.write_lines(v.contigs(spark, sf).select("key", line.alias("value")), ["key"], path)
    return sam.read_header(spark, path)


def _ref_names(spark):
    return v.genome(spark).select("ref_id", F.concat(F.lit("ref"), F.col("ref_id").cast("string")).alias("name"), "length")


@query("SELECT CAST(row_number() OVER (ORDER BY ref_id) AS INT) AS place, ref_id FROM (SELECT DISTINCT ref_id FROM m)")
def ref_ids_sorted(spark, sf):
    return _mapped(spark, sf).select("ref_id").distinct().withColumn("place", F.row_number().over(Window.orderBy("ref_id")))


# ---- intervals

_READS = ", rd AS (SELECT ref_id, aln_idx, pos AS start, pos + 31 AS stop FROM m)"


def _iv_and_reads(spark, sf):
    a = v.iv(spark, sf).select("iv_id", "ref_id", F.col("start").alias("b_start"), F.col("stop").alias("b_stop"))
    b = _mapped(spark, sf).select("ref_id", "aln_idx", F.col("pos").alias("a_start"), (F.col("pos") + READ - 1).alias("a_stop"))
    return b, a


@query("SELECT iv_id, count(*) AS n, CAST(sum(aln_idx) AS BIGINT) AS ids FROM iv JOIN rd ON iv.ref_id = rd.ref_id AND rd.start <= iv.stop AND rd.stop >= iv.start GROUP BY iv_id", ALN_SQL + ", " + IV_SQL + _READS)
def interval_overlap(spark, sf):
    return intervals.overlap_totals(*_iv_and_reads(spark, sf), "aln_idx").groupBy("iv_id").agg(F.sum("n").alias("n"), F.sum("total").alias("ids"))


@query("SELECT iv_id, count(*) AS n, CAST(sum(aln_idx) AS BIGINT) AS ids FROM iv JOIN rd ON iv.ref_id = rd.ref_id AND rd.start >= iv.start AND rd.stop <= iv.stop GROUP BY iv_id", ALN_SQL + ", " + IV_SQL + _READS)
def interval_contained(spark, sf):
    return intervals.contained_totals(*_iv_and_reads(spark, sf), "aln_idx").groupBy("iv_id").agg(F.sum("n").alias("n"), F.sum("total").alias("ids"))


@query("SELECT ref_id, start, iv_id FROM iv QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY start, iv_id) = 1", IV_SQL)
def first_interval(spark, sf):
    return v.iv(spark, sf).groupBy("ref_id").agg(F.min(F.struct("start", "iv_id")).alias("first")).select("ref_id", "first.*")


@query("SELECT iv_id, row_number() OVER (PARTITION BY ref_id ORDER BY start, iv_id) AS place, ref_id FROM iv", IV_SQL)
def intervals_sorted(spark, sf):
    return ordered.row_numbers(v.iv(spark, sf), ["ref_id"], ["start", "iv_id"], "place").select("iv_id", "place", "ref_id")


_BLOCKS = """, num AS (SELECT ref_id, pos, aln_idx, row_number() OVER (ORDER BY ref_id, pos, aln_idx) AS n FROM m),
blk AS (SELECT (n - 1) // 1000 AS block, min(n - 1) AS aln_before, arg_min(ref_id, n) AS start_ref, arg_min(pos, n) AS start_pos, arg_max(ref_id, n) AS end_ref, arg_max(pos, n) AS end_pos FROM num GROUP BY 1)"""


@query("SELECT block, aln_before, start_ref, start_pos, end_ref, end_pos FROM blk", ALN_SQL + _BLOCKS)
def block_spans(spark, sf):
    return intervals.block_spans(_mapped(spark, sf), 1000)


@query("SELECT target, max(block) AS block FROM (SELECT unnest(range(1, 9000, 700)) AS target) LEFT JOIN blk ON aln_before < target GROUP BY target", ALN_SQL + _BLOCKS)
def block_seek_asof(spark, sf):
    targets = spark.range(1, 9000, 700).select(F.col("id").alias("target"))
    return intervals.seek(targets, intervals.block_spans(_mapped(spark, sf), 1000))


_PIECES = """, pc AS (SELECT block, CAST(r AS INT) AS ref_id, CASE WHEN r = start_ref THEN start_pos ELSE 0 END AS start, CASE WHEN r = end_ref THEN end_pos ELSE 65535 END AS stop
  FROM (SELECT *, unnest(range(start_ref, end_ref + 1)) AS r FROM blk))"""


@query("SELECT block, ref_id, start, stop FROM pc", ALN_SQL + _BLOCKS + _PIECES)
def block_split_ref(spark, sf):
    return intervals.split_by_reference(intervals.block_spans(_mapped(spark, sf), 1000), v.genome(spark).select("ref_id", "length"))


@query("SELECT DISTINCT block FROM pc JOIN iv ON pc.ref_id = iv.ref_id AND pc.start <= iv.stop AND pc.stop >= iv.start WHERE iv_id < 12", ALN_SQL + ", " + IV_SQL + _BLOCKS + _PIECES)
def block_dedupe(spark, sf):
    return intervals.overlapping_blocks(block_split_ref(spark, sf), v.iv(spark, sf).where("iv_id < 12").select("ref_id", "start", "stop"))


# ---- quality strings

def _mode_sql():
    fold = "list_reduce(list_prepend({'m': -1, 'f': 0}, list_transform(range(0, 90), lambda i: {'m': CAST(i AS INT), 'f': CAST(length(qual) - length(replace(qual, chr(CAST(i + 32 AS INT)), '')) AS INT)})), lambda acc, x: CASE WHEN x.m * x.f >= acc.f * 10 THEN x ELSE acc END)"
    return f", wm AS (SELECT aln_idx, qual, chr(w.m + 32) AS mode, w.f AS frequency FROM (SELECT aln_idx, qual, {fold} AS w FROM qv))"


@query("SELECT aln_idx, mode, frequency FROM wm", ALN_SQL + _mode_sql())
def weighted_mode(spark, sf):
    return v.qv(spark, sf).select("aln_idx", sq.weighted_mode(F.col("qual")).alias("w")).select("aln_idx", "w.*")


@query("SELECT aln_idx, frequency * 100 < length(qual) * 26 AS pile FROM wm", ALN_SQL + _mode_sql())
def low_complexity_gate(spark, sf):
    return quality.low_complexity(v.qv(spark, sf)).select("aln_idx", "pile")


_D2 = _KMERS + """, h AS (SELECT aln_idx, kmer, count(*) / 29.0 AS f FROM km GROUP BY aln_idx, kmer),
ld AS (SELECT CAST(row_number() OVER (ORDER BY aln_idx) AS INT) AS leader, aln_idx AS id FROM (SELECT aln_idx FROM qv ORDER BY aln_idx LIMIT 4)),
lh AS (SELECT leader, kmer, f FROM ld JOIN h ON h.aln_idx = ld.id),
cells AS (SELECT h.aln_idx, ld.leader, h.kmer, h.f, 0.0 AS g FROM h, ld UNION ALL SELECT q.aln_idx, lh.leader, lh.kmer, 0.0, lh.f FROM (SELECT DISTINCT aln_idx FROM h) q, lh),
one AS (SELECT aln_idx, leader, kmer, sum(f) AS f, sum(g) AS g FROM cells GROUP BY ALL),
d2 AS (SELECT aln_idx, leader, round(sum((f - g) * (f - g)), 6) AS d2 FROM one GROUP BY aln_idx, leader)"""


def _d2(spark, sf):
    return quality.d2(v.qv(spark, sf), v.leaders(spark, sf))


@query("SELECT aln_idx, leader, d2 FROM d2", ALN_SQL + _D2)
def d2_distance(spark, sf):
    return _d2(spark, sf).select("aln_idx", "leader", F.round(F.abs("d2"), 6).alias("d2"))


_ASSIGN = _D2 + ", asg AS (SELECT aln_idx, coalesce(min(CASE WHEN d2 < 0.05 THEN leader END), 0) AS cluster FROM d2 GROUP BY aln_idx)"


@query("SELECT aln_idx, cluster FROM asg", ALN_SQL + _ASSIGN)
def leader_assign(spark, sf):
    return quality.nearest(v.qv(spark, sf), v.leaders(spark, sf))


@query("SELECT cluster, count(*) AS n FROM asg GROUP BY cluster HAVING count(*) > 0.05 * (SELECT count(*) FROM asg)", ALN_SQL + _ASSIGN)
def cluster_abundance(spark, sf):
    return quality.abundant(leader_assign(spark, sf))


@query("SELECT cluster, count(*) AS n FROM asg GROUP BY cluster", ALN_SQL + _ASSIGN)
def membership_tally(spark, sf):
    return leader_assign(spark, sf).groupBy("cluster").agg(F.count("*").alias("n"))


_TRIM = """, tp AS (SELECT aln_idx, qual, mode, length(qual) AS n, strpos(qual, mode) - 1 AS a, length(qual) - strpos(reverse(qual), mode) AS b FROM wm WHERE frequency * 100 >= length(qual) * 26),
th AS (SELECT *, greatest(a, 1) AS head FROM tp),
tt AS (SELECT *, greatest(least(b + 1, n - 1), least(head + 1, n - 1)) AS tail FROM th),
tc AS (SELECT *, CASE WHEN head >= 8 THEN head ELSE 0 END AS lo, greatest(CASE WHEN head >= 8 THEN head ELSE 0 END, CASE WHEN n - tail >= 8 THEN tail ELSE n END) AS hi FROM tt)"""


@query("SELECT aln_idx, left(qual, lo) AS prefix, substr(qual, lo + 1, hi - lo) AS core, substr(qual, hi + 1) AS suffix FROM tc", ALN_SQL + _mode_sql() + _TRIM)
def trim_ends(spark, sf):
    return quality.split_strings(quality.low_complexity(v.qv(spark, sf)).where("NOT pile")).select("aln_idx", "prefix", "core", "suffix")


_LEADERS = _mode_sql() + _TRIM + """,
sm AS (SELECT aln_idx FROM qv ORDER BY aln_idx LIMIT 200001),
cr AS (SELECT aln_idx, substr(qual, lo + 1, hi - lo) AS core FROM tc WHERE hi - lo >= 4),
ks AS (SELECT aln_idx, t, k, count(*) AS c FROM (SELECT aln_idx, length(core) - 3 AS t, unnest(list_transform(range(1, length(core) - 2), lambda i: substr(core, i, 4))) AS k FROM cr) GROUP BY ALL),
nm AS (SELECT aln_idx, t, CAST(sum(c * c) AS DOUBLE) / (t * t) AS norm FROM ks GROUP BY aln_idx, t),
least_n AS (SELECT count(*) * 0.05 AS least FROM sm),
rec AS (  -- what is left at each step; its first string is the step's leader
  SELECT 0 AS step, aln_idx FROM cr WHERE aln_idx IN (SELECT aln_idx FROM sm)
  UNION ALL
  SELECT r.step + 1, r.aln_idx
  FROM rec r JOIN (SELECT min(aln_idx) AS one, count(*) AS n FROM rec) l ON l.n > (SELECT least FROM least_n) JOIN nm a ON a.aln_idx = r.aln_idx JOIN nm b ON b.aln_idx = l.one
    LEFT JOIN (SELECT x.aln_idx, sum(x.c * y.c) AS dot FROM ks x JOIN ks y ON x.k = y.k WHERE y.aln_idx = (SELECT min(aln_idx) FROM rec) GROUP BY x.aln_idx) d ON d.aln_idx = r.aln_idx
  WHERE round(a.norm + b.norm - 2 * coalesce(dot, 0) / (a.t * b.t), 9) >= 0.05),
st AS (SELECT step, min(aln_idx) AS one, count(*) AS n FROM rec GROUP BY step),
ld AS (SELECT one, row_number() OVER (ORDER BY step) AS leader FROM (SELECT *, n - coalesce(lead(n) OVER (ORDER BY step), 0) AS took FROM st) WHERE n > (SELECT least FROM least_n) AND took > (SELECT least FROM least_n)),
nr AS (
  SELECT a.aln_idx, min(leader) AS leader FROM nm a CROSS JOIN ld JOIN nm b ON b.aln_idx = ld.one
    LEFT JOIN (SELECT x.aln_idx, y.aln_idx AS one, sum(x.c * y.c) AS dot FROM ks x JOIN ks y ON x.k = y.k WHERE y.aln_idx IN (SELECT one FROM ld) GROUP BY ALL) d ON d.aln_idx = a.aln_idx AND d.one = ld.one
  WHERE round(a.norm + b.norm - 2 * coalesce(dot, 0) / (a.t * b.t), 9) < 0.05 GROUP BY a.aln_idx)"""


@query("SELECT qv.aln_idx, CAST(coalesce(leader, 0) AS INT) AS cluster FROM qv LEFT JOIN nr ON nr.aln_idx = qv.aln_idx", "RECURSIVE " + ALN_SQL + _LEADERS)
def leader_clustering(spark, sf):
    qv = v.qv(spark, sf)
    leaders = [r["qual"] for r in quality.leaders_of(qv).orderBy("leader").collect()]  # 20 at most
    rows = quality.low_complexity(qv)
    core = F.when(F.col("pile"), "").otherwise(quality.trimmed(F.col("qual"), F.col("mode"))["core"])  # the pile is near no leader
    return quality.with_leader(rows.select("aln_idx", core.alias("qual")), leaders).select("aln_idx", "cluster")


@query("SELECT aln_idx, qual FROM wm WHERE frequency * 100 >= length(qual) * 26", ALN_SQL + _mode_sql())
def mode_delta_roundtrip(spark, sf):
    return quality.restore_strings(quality.split_strings(quality.low_complexity(v.qv(spark, sf)).where("NOT pile")))


@query("SELECT aln_idx, qual FROM qv")
def quality_restore(spark, sf):
    rows = quality.low_complexity(v.qv(spark, sf))
    pile = rows.where("pile").select("aln_idx", "qual")
    return quality.restore_strings(quality.split_strings(rows.where("NOT pile"))).unionByName(pile)


@query("SELECT aln_idx, qual FROM qv")
def membership_restore(spark, sf):
    members = files.stored(leader_assign(spark, sf), "members")
    parts, pile = quality.stored_clusters(quality.low_complexity(v.qv(spark, sf)), members)
    return quality.restore_members(members, parts, pile)


# ---- reports

_TYPE = "CASE suffix WHEN 'flags' THEN 'fields' WHEN 'ids' THEN 'ids' ELSE 'seq' END"


@query(f"SELECT dataset, method, {_TYPE} AS type, CAST(sum(bytes) AS BIGINT) AS bytes FROM sizes GROUP BY ALL", SIZES_SQL)
def size_by_type(spark, sf):
    return report.by_type(v.sizes(spark, sf))


@query("SELECT DISTINCT suffix, CASE suffix WHEN 'flags' THEN 'fields' WHEN 'ids' THEN 'ids' ELSE 'seq' END AS type FROM sizes UNION ALL SELECT 'k=4', 'quals'", SIZES_SQL)
def suffix_class(spark, sf):
    seen = v.sizes(spark, sf).select("suffix").distinct().union(spark.createDataFrame([("k=4",)], "suffix string"))
    return seen.select("suffix", tx.data_type(F.col("suffix")).alias("type"))


@query("SELECT dataset, suffix, CAST(sum(bytes) AS BIGINT) AS bytes, round(100 * sum(bytes) / sum(sum(bytes)) OVER (PARTITION BY dataset), 6) AS percent FROM sizes GROUP BY dataset, suffix", SIZES_SQL)
def pct_of_total(spark, sf):
    return report.shares(v.sizes(spark, sf))


@query("""SELECT dataset, best, next_best, round((1 - best / next_best) * 100, 1) AS percent FROM (
  SELECT dataset, CAST(min(bytes) AS BIGINT) AS best, CAST(min(bytes) FILTER (WHERE bytes > low) AS BIGINT) AS next_best FROM (
    SELECT *, min(bytes) OVER (PARTITION BY dataset) AS low FROM (SELECT dataset, method, sum(bytes) AS bytes FROM sizes GROUP BY ALL)) GROUP BY dataset)""", SIZES_SQL)
def next_best_saving(spark, sf):
    return report.saving(v.sizes(spark, sf))


@query("SELECT dataset, round(sum(bytes) * 8.0 / (count(*) * 100), 6) AS bits FROM sizes GROUP BY dataset", SIZES_SQL)
def bits_per_base(spark, sf):
    rows = v.sizes(spark, sf).groupBy("dataset").agg(F.sum("bytes").alias("b"), F.count("*").alias("n"))
    return rows.select("dataset", F.round(report.bits_per_base(F.col("b"), F.col("n"), F.lit(100)), 6).alias("bits"))


@query("SELECT CAST(row_number() OVER (ORDER BY bytes, dataset) AS INT) AS place, dataset, bytes FROM (SELECT dataset, CAST(sum(bytes) AS BIGINT) AS bytes FROM sizes GROUP BY dataset)", SIZES_SQL)
def files_by_size(spark, sf):
    return report.by_total(v.sizes(spark, sf))


@query("SELECT dataset, round(sum(bytes) / sum(bytes) FILTER (WHERE method = 'F'), 6) AS ratio FROM sizes GROUP BY dataset HAVING sum(bytes) FILTER (WHERE method = 'F') > 0", SIZES_SQL)
def compression_ratio(spark, sf):
    rows = v.sizes(spark, sf)
    return report.compression(rows, rows.where("method = 'F'"))


@query("SELECT dataset, method, CAST(sum(bytes) AS BIGINT) AS bytes, CASE dataset WHEN 'A' THEN 'archive' WHEN 'N' THEN 'new' END AS title FROM sizes GROUP BY ALL", SIZES_SQL)
def dataset_enrich(spark, sf):
    names = spark.createDataFrame([("A", "archive"), ("N", "new")], "dataset string, title string")
    return v.sizes(spark, sf).groupBy("dataset", "method").agg(F.sum("bytes").alias("bytes")).join(F.broadcast(names), "dataset", "left")


@query("""SELECT event_id, CASE WHEN h > 0 THEN CAST(h AS VARCHAR) || 'h' ELSE '' END || CASE WHEN m > 0 THEN CAST(m AS VARCHAR) || 'm' ELSE '00' END || CAST(s AS VARCHAR) || 's' AS took FROM (
  SELECT event_id, t // 3600 AS h, (t % 3600) // 60 AS m, t % 60 AS s FROM (SELECT event_id, event_id * 7 AS t FROM events))""", "")
def duration_text(spark, sf):
    return v.events(spark, sf).select("event_id", tx.duration(F.col("event_id") * 7).alias("took"))


@query("SELECT event_id AS n_lines, CASE WHEN event_id % 4 = 0 THEN event_id // 4 ELSE event_id // 3 END AS n_reads FROM events", "")
def unaligned_from_lines(spark, sf):
    return v.events(spark, sf).select(F.col("event_id").alias("n_lines"), tx.unaligned_reads(F.col("event_id")).alias("n_reads"))


_FILES = ["P_aer", "SRR1294122.k", "K562_cytosol", "NA12878.S1", "my_file"]


@query("""SELECT iv_id, name, CASE iv_id % 5 WHEN 0 THEN 'P. aeruginosa' WHEN 1 THEN 'SRR1294122' WHEN 2 THEN 'K562' WHEN 3 THEN 'NA12878' ELSE 'my\\_file\\_' || iv_id END AS label
FROM (SELECT iv_id, ['P_aer', 'SRR1294122.k', 'K562_cytosol', 'NA12878.S1', 'my_file'][iv_id % 5 + 1] || '_' || iv_id || '.sam' AS name FROM iv)""", IV_SQL)
def name_label(spark, sf):
    name = F.concat(F.element_at(F.array(*map(F.lit, _FILES)), F.col("iv_id") % 5 + 1), F.lit("_"), F.col("iv_id").cast("string"), F.lit(".sam"))
    return v.iv(spark, sf).select("iv_id", name.alias("name")).select("iv_id", "name", tx.label(F.col("name")).alias("label"))


# ---- sorts and sets

@query("SELECT ref_id, aln_idx, pos FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY pos, aln_idx) AS n FROM m) WHERE n = 5")
def nth_row(spark, sf):
    return ordered.row_numbers(_mapped(spark, sf), ["ref_id"], ["pos", "aln_idx"], "n").where("n = 5").select("ref_id", "aln_idx", "pos")


@query("SELECT row_number() OVER (ORDER BY mapq) AS place, mapq FROM (SELECT DISTINCT mapq FROM aln)")
def distinct_sorted(spark, sf):
    return v.aln(spark, sf).select("mapq").distinct().select(F.row_number().over(Window.orderBy("mapq")).cast("long").alias("place"), "mapq")


@query("SELECT aln_idx, flag, seq FROM aln")
def aligned_union(spark, sf):
    a = v.aln(spark, sf).select("aln_idx", "flag", "seq")
    return a.where("flag & 4 = 0").unionByName(a.where("flag & 4 <> 0"))


@query("SELECT aln_idx, row_number() OVER (ORDER BY ref_id, pos, aln_idx) AS place FROM m")
def coordinate_sorted(spark, sf):
    rows = _mapped(spark, sf).withColumn("axis", F.col("ref_id").cast("long") * (1 << 32) + F.col("pos"))
    return ordered.row_numbers(rows, [], ["axis", "aln_idx"], "place").select("aln_idx", "place")


# ---- streams that begin apart

@query("""SELECT n, ref_id, pos, CASE WHEN aln_idx % 3 = 0 THEN md END AS md FROM (SELECT *, row_number() OVER (ORDER BY ref_id, pos, aln_idx) AS n FROM m)
WHERE n >= (SELECT min(n) FROM (SELECT *, row_number() OVER (ORDER BY ref_id, pos, aln_idx) AS n FROM m) WHERE n >= 150 AND ref_id >= 2 AND pos >= 4000)""")
def stream_sync(spark, sf):
    rows = _mapped(spark, sf).withColumn("axis", F.col("ref_id").cast("long") * (1 << 32) + F.col("pos"))
    rows = ordered.row_numbers(rows, [], ["axis", "aln_idx"], "n")
    lists = rows.where("aln_idx % 3 = 0 AND n >= 150").select("n", "md")
    return encode.sync_streams(rows.where("n >= 100").select("n", "ref_id", "pos"), lists, 100, 150, 2, 4000)


@query("SELECT aln_idx, CASE WHEN aln_idx % 3 = 0 THEN md END AS md FROM aln WHERE aln_idx >= 200 AND aln_idx < 300")
def edit_sync(spark, sf):
    a = v.aln(spark, sf).withColumn("block", F.floor(F.col("aln_idx") / 100))
    lists = ordered.row_numbers(a.where("aln_idx % 3 = 0").select("block", "aln_idx", "md"), ["block"], ["aln_idx"], "n").select("block", "n", "md")
    blocks = a.select("block").distinct().withColumn("aln_before", F.col("block") * 100)
    return encode.sync_edits(a.select("aln_idx", (F.col("aln_idx") % 3 == 0).alias("present")), lists, blocks, 250).select("aln_idx", "md")


# ---- streams: a table arrives in four parts, and the query goes on from its checkpoint after each

def _parts(rows, by, n=4):
    """The rows in ranges of ``by``, one after the other."""
    lo, hi = rows.agg(F.min(by), F.max(by)).first()
    for i in range(n):
        yield rows.where((F.col(by) >= (lo or 0) + ((hi or 0) + 1 - (lo or 0)) * i // n) & (F.col(by) < (lo or 0) + ((hi or 0) + 1 - (lo or 0)) * (i + 1) // n))


@query("SELECT ref_id, pos, CAST(pos - coalesce(lag(pos) OVER (PARTITION BY ref_id ORDER BY pos), 0) AS INT) AS delta, count(*) AS mult FROM m GROUP BY ref_id, pos")
def stream_offset_rle(spark, sf):
    runs.enable(spark)
    path, rows = files.new_path(spark, "stream"), _mapped(spark, sf).select("ref_id", "pos")
    ends = rows.select("ref_id", F.lit(None).cast("int").alias("pos")).distinct()
    for part in (*_parts(rows, "pos"), ends):
        part.write.mode("append").parquet(f"{path}/in")
        stream = runs.offset_runs(spark.readStream.schema(rows.schema).parquet(f"{path}/in"))
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return spark.read.schema(runs.OUT).parquet(f"{path}/out")


@query(_dict_sql("flag"))
def stream_flag_dict(spark, sf):
    path, rows = files.new_path(spark, "stream"), v.aln(spark, sf).select("aln_idx", "flag")
    words = GrowingDictionary(spark, f"{path}/words", "flag")
    for part in _parts(rows, "aln_idx"):
        part.write.mode("append").parquet(f"{path}/in")
        words.follow(spark.readStream.schema(rows.schema).parquet(f"{path}/in"), f"{path}/checkpoint").awaitTermination()
    return words.words()


@query("""SELECT CAST(floor(epoch(ts) / 300) * 300 AS BIGINT) AS start, ref_id, count(*) AS reads, count(*) * 32 AS bases FROM m JOIN events ON aln_idx = event_id GROUP BY ALL""")
def stream_windowed_depth(spark, sf):
    """Reads and bases by five minutes of arrival."""
    path = files.new_path(spark, "stream")
    rows = v.aln(spark, sf).select("aln_idx", "ref_id", "flag").join(v.events(spark, sf).select(F.col("event_id").alias("aln_idx"), F.col("ts").cast("timestamp").alias("ts")), "aln_idx")
    rows.write.parquet(f"{path}/in")
    depth = offsets.windowed_depth(spark.readStream.schema(rows.schema).parquet(f"{path}/in"), READ)
    keep = lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/out")  # noqa: E731  each batch has all windows
    depth.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out").select(F.unix_timestamp("window.start").alias("start"), "ref_id", "reads", "bases")


# ---- files: written from a table, and read back

@query("SELECT CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS gained, count(*) AS n_reads, CAST(5 AS BIGINT) AS n_refs, '1.6' AS version FROM aln")
def sam_roundtrip(spark, sf):
    """Names, header, unplaced reads and tags (types, repeated ones) survive."""
    refs = v.genome(spark).select("ref_id", F.concat(F.lit("chr"), (F.col("ref_id") + 1).cast("string")).alias("name"), "length")
    unplaced, tag = filters.is_unaligned(F.col("flag")), lambda k, t, x: F.struct(F.lit(k).alias("tag"), F.lit(t).alias("type"), x.alias("value"))
    tags = F.array(tag("XA", "Z", F.col("qname")), tag("AS", "i", F.col("mapq").cast("string")), tag("XA", "Z", F.lit("a:b")))
    rows = v.aln(spark, sf).withColumns({"ref_id": F.when(unplaced, -1).otherwise(F.col("ref_id")), "pos": F.when(unplaced, -1).otherwise(F.col("pos")), "opt": tags})
    path = files.new_path(spark, "sam")
    sam.write(rows, refs, path)
    columns = ["qname", "flag", "ref_id", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual", "md", "opt"]
    back = sam.read(spark, path).withColumn("opt", F.filter("opt", lambda t: t["tag"] != "MD"))
    a, b = rows.select(columns), files.stored(back.select(columns), "sam-back")
    side = lambda df, n: F.broadcast(df.agg(F.count("*").alias(n)))  # noqa: E731  single rows
    # digests of buckets move; rows only where these differ
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("long"))
    odd = compare.difference(b, a).agg(total("gained").alias("lost"), total("lost").alias("gained"))  # from what was read, whose fields may be null
    both = F.broadcast(odd).join(side(b, "n_reads")).join(side(sam.read_header(spark, path).join(refs, ["ref_id", "name", "length"]), "n_refs"))
    return both.withColumn("version", F.lit(sam.read_version(spark, path)))


def _sam_folder(spark, sf):
    """Five folders of mixed sizes, each in the order of its reads by its files' names."""
    refs = v.genome(spark).select("ref_id", F.concat(F.lit("chr"), (F.col("ref_id") + 1).cast("string")).alias("name"))
    part = F.when(F.col("aln_idx") % 10 < 6, 3).otherwise(F.col("aln_idx") % 10 - 5).cast("int")
    rows = sam.named(sam.with_tags(v.aln(spark, sf)), refs).select("aln_idx", part.alias("part"), rebuild.sam_line().alias("value"))
    path = files.new_path(spark, "sam")
    # a folder for each file's reads, in as many files as they ask for, by name in their order
    rows.repartitionByRange("part", "aln_idx").sortWithinPartitions("part", "aln_idx").select("part", "value").write.partitionBy("part").text(path)
    return path


_PLACED = "x AS (SELECT *, CASE WHEN aln_idx % 10 < 6 THEN 3 ELSE aln_idx % 10 - 5 END AS part, 'chr' || CAST(ref_id + 1 AS VARCHAR) AS rname FROM aln)"


@query("SELECT qname, row_number() OVER (ORDER BY part, aln_idx) AS place FROM x", f"{ALN_SQL}, {_PLACED}")
def sam_folder_order(spark, sf):
    """The reads of a folder by the scan's ordinal: files by name, lines by place."""
    rows = sam.scan(spark, _sam_folder(spark, sf), partitionBytes=1 << 20).select("aln_idx", "qname")
    return ordered.row_numbers(rows.withColumn("one", F.lit(0)), ["one"], ["aln_idx"], "n").select("qname", F.col("n").alias("place"))


@query("SELECT qname, pos, flag, cigar, mapq, seq, md FROM x WHERE rname = 'chr2' AND pos >= 20000 AND pos < 30000 AND flag & 4 = 0 AND flag & 16 <> 0", f"{ALN_SQL}, {_PLACED}")
def sam_region(spark, sf):
    """A region's mapped reverse reads; the scan tests name, position and flags."""
    found = sam.region(spark, _sam_folder(spark, sf), "chr2", 20_000, 30_000, required=16, excluded=4)
    md = F.filter("opt", lambda t: t.startswith("MD:"))
    return found.select("qname", "pos", "flag", "cigar", "mapq", "seq", F.substring(F.get(md, 0), 6, 1 << 30).alias("md"))


@query("SELECT qname AS name, seq, qual FROM aln WHERE flag & 4 <> 0")
def fastq_roundtrip(spark, sf):
    path = files.new_path(spark, "fastq")
    sam.unaligned_fastq(v.aln(spark, sf)).write.text(path)
    return fasta.read_fastq(spark, path)


@query("""SELECT qname AS name, 'len=32 a->b @c' AS comment, seq, CASE WHEN aln_idx % 5 > 0 THEN qual END AS qual FROM aln""")
def wrapped_records(spark, sf):
    """Reads as FASTQ and every fifth as FASTA, over lines of seven bases and five qualities, some with carriage returns."""
    end = F.when(F.col("aln_idx") % 3 == 0, "\r\n").otherwise("\n")
    wrap = lambda c, n: F.array_join(F.regexp_extract_all(c, F.lit(f"(.{{1,{n}}})"), F.lit(1)), "\n")
    head = lambda mark: F.concat(F.lit(mark), "qname", F.lit(" len=32 a->b @c"))
    fastq = F.concat_ws("\n", head("@"), wrap("seq", 7), F.lit("+"), wrap("qual", 5))
    text = F.when(F.col("aln_idx") % 5 > 0, fastq).otherwise(F.concat_ws("\n", head(">"), wrap("seq", 7)))
    path = files.new_path(spark, "records")
    v.aln(spark, sf).select(F.regexp_replace(text, "\n", end).alias("value")).write.text(path)
    return records.read(spark, path).select("name", "comment", "seq", "qual")


def _fasta(spark, sf):
    """Four files of sequences in lines of 60 bases, in the order of their keys."""
    path = files.new_path(spark, "fasta")
    text = F.concat(F.lit(">"), F.col("name"), F.lit(" made > up\n"), F.array_join(F.regexp_extract_all("seq", F.lit("(.{1,60})"), F.lit(1)), "\n"))
    keys = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_size", (F.col("p_partkey") % 4).alias("part"))
    dealt = keys.repartition("part").sortWithinPartitions("part", "p_partkey")  # keys move; a file's writer makes its sequences
    v.contigs_of(dealt, "part").select("part", text.alias("value")).write.partitionBy("part").text(path)
    return path


def _file(c="file"):
    """The number of the file."""
    return F.regexp_extract(c, "part=([0-9])", 1).cast("int")


@query("SELECT name, CAST(length(seq) AS BIGINT) AS length, md5(seq) AS digest FROM contigs", CONTIGS_SQL)
def fasta_records(spark, sf):
    return fasta.read(spark, _fasta(spark, sf)).select("name", "length", F.md5("seq").alias("digest"))


_FAI_SQL = """SELECT CAST(key % 4 AS INT) AS file, name, CAST(length(seq) AS BIGINT) AS bases, CAST(sum(size) OVER w - size + length(name) + 12 AS BIGINT) AS byte_offset,
  CAST(least(60, length(seq)) AS INT) AS bases_per_line, CAST(least(60, length(seq)) + 1 AS INT) AS bytes_per_line
FROM (SELECT *, length(name) + 12 + length(seq) + CAST(ceil(length(seq) / 60) AS BIGINT) AS size FROM contigs) WINDOW w AS (PARTITION BY key % 4 ORDER BY key)"""


@query(_FAI_SQL, CONTIGS_SQL)
def fasta_index(spark, sf):
    found = fasta.index(spark, _fasta(spark, sf))
    return found.select(_file().alias("file"), "name", "bases", "byte_offset", "bases_per_line", "bytes_per_line")


@query(_FAI_SQL.replace("SELECT CAST(key % 4 AS INT) AS file, name", "SELECT name"), CONTIGS_SQL)
def fai_roundtrip(spark, sf):
    path = files.new_path(spark, "fai")
    fasta.write_fai(fasta.index(spark, _fasta(spark, sf)), path)
    return fasta.read_fai(spark, path)


def _indexed(spark, sf):
    path = files.new_path(spark, "index")
    fasta.write_index(fasta.index(spark, _fasta(spark, sf)), path)
    return path


@query("SELECT CAST(key % 4 AS INT) AS file, name, CAST(length(seq) AS BIGINT) AS length, md5(seq) AS digest FROM contigs", CONTIGS_SQL)
def fasta_load(spark, sf):
    """All sequences by their index, in pieces of a few lines."""
    return fasta.load(spark, _indexed(spark, sf), pieceBytes=300).select(_file().alias("file"), "name", "length", F.md5("seq").alias("digest"))


@query("SELECT name, md5(seq) AS digest, CAST(length(seq) + ceil(length(seq) / 60) - 1 AS BIGINT) AS bytes_read FROM contigs WHERE name IN ('part1', 'part7', 'part100')", CONTIGS_SQL)
def fasta_fetch(spark, sf):
    """A few sequences by name: only their bytes are read."""
    parts = fasta.pieces(spark, _indexed(spark, sf)).where("name IN ('part1', 'part7', 'part100')")
    return parts.groupBy("name").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "seq"))), lambda x: x["seq"]), "")).alias("digest"), F.sum("bytes_read").alias("bytes_read"))


@query("""SELECT 'HD' AS kind, CAST(NULL AS INT) AS key, '1.6' AS name, CAST(NULL AS BIGINT) AS number UNION ALL SELECT 'read_len', NULL, NULL, 32
UNION ALL SELECT 'reference', ref_id, 'ref' || CAST(ref_id AS VARCHAR), length FROM genome
UNION ALL SELECT 'flags', NULL, CAST(value AS VARCHAR), code FROM flag_d UNION ALL SELECT 'mapq', NULL, CAST(value AS VARCHAR), code FROM mapq_d
UNION ALL SELECT 'rnext', NULL, CAST(value AS VARCHAR), code FROM rnext_d""", ALN_SQL + _DICTS)
def head_roundtrip(spark, sf):
    rows, path = v.aln(spark, sf), files.new_path(spark, "head")
    words = {name: encode.first_seen(rows, column) for name, column in (("flags", "flag"), ("mapq", "mapq"), ("rnext", "rnext"))}
    head.write(_ref_names(spark), words, READ, "1.6", path)
    return head.read(spark, path)


@query("SELECT 'offs' AS suffix, aln_before, start_ref, start_pos, end_ref, end_pos FROM blk", ALN_SQL + _BLOCKS)
def block_span_lines(spark, sf):
    path = files.new_path(spark, "spans")
    head.write_spans(intervals.block_spans(_mapped(spark, sf), 1000), "offs", path)
    return head.read_spans(spark, path)


def _log(spark, rows, *order):
    """The path of a small log with the lines ``value`` in order."""
    path = files.new_path(spark, "log")
    files.write_lines(rows, list(order), path)
    return path


def _sections(rows, by, title):
    """(s, k, value): ``rows`` (s, k, value) below a line ``title`` for each ``s``."""
    return rows.select(by, "k", "value").union(rows.select(by).distinct().select(by, F.lit(""), title))


_SUMS = ", sm AS (SELECT dataset, method, suffix, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS n FROM sizes GROUP BY ALL)"


def _sums(spark, sf):
    return v.sizes(spark, sf).groupBy("dataset", "method", "suffix").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))


@query("SELECT method, bytes, dataset || '/x.' || suffix AS path FROM sm", SIZES_SQL + _SUMS)
def size_log(spark, sf):
    path = F.concat("dataset", F.lit("/x."), "suffix")
    rows = _sums(spark, sf).select("method", path.alias("k"), F.concat_ws(" ", F.col("bytes").cast("string"), path).alias("value"))
    return logs.sizes(spark, _log(spark, _sections(rows, "method", F.concat(F.lit("# "), "method")), "method", "k"))


@query("SELECT dataset, CASE method WHEN 'F' THEN 0.9 ELSE 0.8 END::DOUBLE AS z, CAST(sum(n) AS BIGINT) AS edits, CAST(sum(bytes) AS BIGINT) AS bytes FROM sm GROUP BY ALL", SIZES_SQL + _SUMS)
def error_log(spark, sf):
    title = F.concat("dataset", F.lit(" z="), F.when(F.col("method") == "F", "0.9").otherwise("0.8"))
    rows = _sums(spark, sf).withColumn("t", title)
    edit = rows.groupBy("t").agg(F.sum("n").alias("n")).select("t", F.lit(" ").alias("k"), F.concat(F.lit("edits: "), F.col("n").cast("string")).alias("value"))
    lines = edit.union(rows.select("t", "suffix", F.concat_ws(" ", F.col("bytes").cast("string"), "suffix")))
    return logs.error_rates(spark, _log(spark, _sections(lines, "t", F.concat(F.lit("*** "), "t")), "t", "k"))


@query("SELECT '/data/' || dataset AS dataset, count(*) AS alignments, CASE WHEN count(*) % 4 = 0 THEN count(*) // 4 ELSE count(*) // 3 END AS unaligned, round((count(*) % 1000) / 100, 2) AS error_percent FROM sizes GROUP BY dataset", SIZES_SQL)
def summary_log(spark, sf):
    n = F.col("n").cast("string")
    parts = [F.concat(F.lit("Saw "), n, F.lit(" total alignments; of them")), F.concat(F.lit("Error rate: "), F.format_string("%.2f", (F.col("n") % 1000) / 100), F.lit("%")), F.concat(n, F.lit(" /data/reads"))]
    rows = v.sizes(spark, sf).groupBy("dataset").agg(F.count("*").alias("n")).select("dataset", F.posexplode(F.array(*parts)).alias("k", "value")).withColumn("k", F.col("k").cast("string"))
    return logs.summaries(spark, _log(spark, _sections(rows, "dataset", F.concat(F.lit("=== /data/"), "dataset")), "dataset", "k"))


@query("SELECT dataset || '_' || method AS total, CAST(sum(bytes) + (method = 'F')::INT AS BIGINT) AS bytes, CAST(sum(bytes) AS BIGINT) AS parts, method <> 'F' AS consistent FROM sm GROUP BY dataset, method", SIZES_SQL + _SUMS)
def part_log(spark, sf):
    pair = F.concat_ws(" ", "suffix", F.format_number("bytes", 0))
    rows = _sums(spark, sf).groupBy("dataset", "method").agg(F.array_join(F.array_sort(F.collect_list(pair)), " ").alias("p"), F.sum("bytes").alias("b"))
    total = F.col("b") + (F.col("method") == "F").cast("int")  # one kind of line does not add up
    value = F.concat(F.lit("["), "p", F.lit("] "), "dataset", F.lit("_"), "method", F.lit(": "), total.cast("string"))
    return logs.part_sizes(spark, _log(spark, rows.select("dataset", "method", value.alias("value")), "dataset", "method"))


@query("SELECT n AS lines FROM sm", SIZES_SQL + _SUMS)
def written_log(spark, sf):
    rows = _sums(spark, sf).select("n", F.concat(F.lit("Written "), F.format_number("n", 0), F.lit(" lines")).alias("value"))
    return logs.lines_written(spark, _log(spark, rows, "n"))


@query("SELECT suffix AS stream, CAST(sum(bytes) AS BIGINT) AS compressed, CAST(sum(n) AS BIGINT) AS original FROM sm GROUP BY suffix", SIZES_SQL + _SUMS)
def stream_log(spark, sf):
    rows = _sums(spark, sf).select("dataset", F.concat(F.lit(" "), "suffix", F.lit(": "), F.col("bytes").cast("string"), F.lit(" of "), F.col("n").cast("string")).alias("value"))
    return logs.stream_sums(spark, _log(spark, rows, "dataset"))


@query("""SELECT CAST(row_number() OVER (ORDER BY dataset, method, suffix) AS INT) AS fd, dataset || method || '.' || CASE WHEN suffix = 'offs' THEN 'k=4' ELSE suffix END AS name,
  CASE WHEN suffix = 'offs' THEN n * 100 ELSE bytes END AS bytes FROM sm""", SIZES_SQL + _SUMS)
def quality_log(spark, sf):
    rows = _sums(spark, sf).withColumn("fd", F.row_number().over(Window.orderBy("dataset", "method", "suffix")))  # a row a stream
    name = F.concat("dataset", "method", F.lit("."), F.when(F.col("suffix") == "offs", "k=4").otherwise(F.col("suffix")))
    fd = F.col("fd").cast("string")
    opened = rows.select(F.lit(1).alias("part"), "fd", F.concat(F.lit("Opened /data/"), name, F.lit(" stream for compressed data (fd="), fd, F.lit(")")).alias("value"))
    closed = rows.select(F.lit(2).alias("part"), "fd", F.concat(F.lit("Cluster "), fd, F.lit(" "), F.col("n").cast("string"), F.lit("; Closing fd="), fd, F.lit(", size "), F.col("bytes").cast("string"), F.lit(" bytes;")).alias("value"))
    length = spark.range(1).select(F.lit(0).alias("part"), F.lit(0).alias("fd"), F.lit("Assuming uniform read len of 100 bases").alias("value"))
    return logs.quality_streams(spark, _log(spark, opened.union(closed).union(length), "part", "fd"))


@query("SELECT CAST((iv_id * 997) % 90000 AS DOUBLE) AS seconds FROM iv", IV_SQL)
def time_log(spark, sf):
    s = F.col("id")
    two = lambda n: F.lpad(n.cast("int").cast("string"), 2, "0")
    clock = F.when(s >= 3600, F.concat(F.floor(s / 3600).cast("string"), F.lit(":"), two(F.floor(s % 3600 / 60)), F.lit(":"), two(s % 60))).otherwise(F.concat(F.floor(s / 60).cast("string"), F.lit(":"), two(s % 60)))
    rows = v.iv(spark, sf).select(F.col("iv_id").alias("key"), ((F.col("iv_id") * 997) % 90000).alias("id")).select("key", F.concat(F.lit("\tElapsed (wall clock) time (h:mm:ss or m:ss): "), clock).alias("value"))
    return logs.elapsed(spark, _log(spark, rows, "key"))


@query("SELECT dataset || '_' || suffix AS name, bytes AS lines, CAST(n AS INT) AS length FROM (SELECT dataset, suffix, CAST(sum(bytes) AS BIGINT) AS bytes, sum(n) AS n FROM sm GROUP BY ALL)", SIZES_SQL + _SUMS)
def length_log(spark, sf):
    rows = _sums(spark, sf).groupBy("dataset", "suffix").agg(F.sum("bytes").alias("b"), F.sum("n").alias("n"))
    value = F.concat_ws("\n", F.concat_ws("_", "dataset", "suffix"), F.col("b").cast("string"), F.col("n").cast("string"))
    return logs.read_lengths(spark, _log(spark, rows.select("dataset", "suffix", value.alias("value")), "dataset", "suffix"))


@query("""SELECT event_id, CASE WHEN u = 'B' THEN CASE WHEN x >= 1000 THEN '1,' || substr(CAST(n AS VARCHAR), 2) ELSE CAST(n AS VARCHAR) END
  WHEN x >= 1000 THEN '1,' || substr(printf('%.2f', x), 2) ELSE printf('%.2f', x) END || ' ' || u AS size FROM (
  SELECT event_id, n, CASE WHEN n >= 1 << 30 THEN 'GiB' WHEN n >= 1 << 20 THEN 'MiB' WHEN n >= 1024 THEN 'KiB' ELSE 'B' END AS u,
    CAST(n AS DOUBLE) / CASE WHEN n >= 1 << 30 THEN 1 << 30 WHEN n >= 1 << 20 THEN 1 << 20 WHEN n >= 1024 THEN 1024 ELSE 1 END AS x
  FROM (SELECT event_id, CAST(event_id * event_id * 3 % 900000000000 AS BIGINT) AS n FROM events))""", "")
def binary_sizes(spark, sf):
    return v.events(spark, sf).select("event_id", tx.binary_size(F.col("event_id") * F.col("event_id") * 3 % 900000000000).alias("size"))


@query("SELECT ref_id, CAST(pos // 1024 AS BIGINT) AS bin, count(*) AS reads, count(*) * 32 AS bases FROM m GROUP BY ALL")
def stream_depth(spark, sf):
    """Alignments that arrive as files, counted by a stream until all are read."""
    path = files.new_path(spark, "arriving")
    rows = v.aln(spark, sf).select("ref_id", "pos", "flag")
    rows.write.parquet(path)
    counts, out = offsets.running_depth(spark.readStream.schema(rows.schema).parquet(path), READ), files.new_path(spark, "depth")
    # complete mode: each batch replaces the table
    run = counts.writeStream.outputMode("complete").option("checkpointLocation", files.new_path(spark, "stream")).trigger(availableNow=True)
    run.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(out)).start().awaitTermination()
    return spark.read.schema(counts.schema).parquet(out)
