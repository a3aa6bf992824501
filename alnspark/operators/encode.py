"""Delta, run-length and dictionary encoding of positions and flags, and the way back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alnspark.operators import ordered


def offset_deltas(aln: DataFrame) -> DataFrame:
    """Add ``delta``: the distance to the alignment before on the reference; the first has its position."""
    rows = ordered.previous(aln, ["ref_id"], ["pos", "aln_idx"], "pos", "_before")
    return rows.withColumn("delta", F.col("pos") - F.coalesce("_before", F.lit(0))).drop("_before")


def offset_runs(aln: DataFrame) -> DataFrame:
    """(ref_id, pos, delta, mult): one row for alignments with equal offsets."""
    runs = aln.groupBy("ref_id", "pos").agg(F.count("*").alias("mult"))
    rows = ordered.previous(runs, ["ref_id"], ["pos"], "pos", "_before")
    return rows.select("ref_id", "pos", (F.col("pos") - F.coalesce("_before", F.lit(0))).alias("delta"), "mult")


def offsets_of(runs: DataFrame, order: str = "pos") -> DataFrame:
    """(ref_id, pos): one row an alignment, from runs of deltas in ``order``."""
    at = ordered.running_sum(runs, ["ref_id"], [order], F.col("delta"), "_at")
    return at.select("ref_id", F.col("_at").cast("int").alias("pos"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("mult"))).alias("_")).drop("_")


def first_seen(aln: DataFrame, column: str) -> DataFrame:
    """(value, code): distinct values numbered by their first appearance.  Dictionaries of flags are small."""
    seen = aln.groupBy(F.col(column).alias("value")).agg(F.min("aln_idx").alias("first"))
    return seen.select("value", (F.row_number().over(Window.orderBy("first")) - 1).cast("int").alias("code"))


def encode_flags(aln: DataFrame) -> DataFrame:
    """(aln_idx, flag, mapq, rnext codes, pnext, pnext - tlen)."""
    out = aln
    for c in ("flag", "mapq", "rnext"):
        out = out.join(first_seen(aln, c).select(F.col("value").alias(c), F.col("code").alias(f"{c}_code")), c)
    return out.select("aln_idx", "flag_code", "mapq_code", "rnext_code", "pnext", (F.col("pnext") - F.col("tlen")).alias("pnext_tlen"))


def decode_flags(codes: DataFrame, dictionaries: dict[str, DataFrame]) -> DataFrame:
    """The way back; a code that its dictionary lacks stays."""
    out = codes
    for c, words in dictionaries.items():
        look = words.select(F.col("code").alias(f"{c}_code"), F.col("value").alias(c))
        out = out.join(look, f"{c}_code", "left").withColumn(c, F.coalesce(c, f"{c}_code"))
    return out.select("aln_idx", *dictionaries, "pnext", (F.col("pnext") - F.col("pnext_tlen")).alias("tlen"))


def zip_streams(*streams: DataFrame) -> DataFrame:
    """Rebuild rows from columns stored apart, by ordinal."""
    out = streams[0]
    for s in streams[1:]:
        out = out.join(s, "aln_idx", "left")
    return out


def sync_edits(flags: DataFrame, lists: DataFrame, blocks: DataFrame, target: int) -> DataFrame:
    """Bring the flags (aln_idx, present) and the edit lists to one alignment, and zip them from there.

    ``blocks`` has aln_before of each block of lists, ``lists`` block and n, counted from 1 in its block.  The last
    block that begins at ``target`` or before is read; flags before its first alignment are skipped."""
    start = blocks.where(F.col("aln_before") <= target).agg(F.max(F.struct("aln_before", "block")).alias("s")).select("s.*")
    own = flags.join(F.broadcast(start.select("aln_before")), F.col("aln_idx") >= F.col("aln_before")).drop("aln_before")  # one row
    stop = F.broadcast(blocks.join(F.broadcast(start.select(F.col("aln_before").alias("_from"))), F.col("aln_before") > F.col("_from")).agg(F.min("aln_before").alias("_stop")))
    own = own.join(stop).where(F.col("_stop").isNull() | (F.col("aln_idx") < F.col("_stop"))).drop("_stop")
    return zip_sparse(own, lists.join(F.broadcast(start.select("block")), "block").drop("block"))


def sync_streams(offsets: DataFrame, edits: DataFrame, off_start: int, edit_start: int, ref_id: int, coord: int) -> DataFrame:
    """Two streams by ordinal ``n`` whose blocks begin at different ordinals: both from the later beginning on, and
    there from the first alignment that reaches ``ref_id`` and ``coord``."""
    begun = offsets.where(F.col("n") >= max(off_start, edit_start))
    first = begun.where((F.col("ref_id") >= ref_id) & (F.col("pos") >= coord)).agg(F.min("n").alias("_first"))
    return begun.join(F.broadcast(first), F.col("n") >= F.col("_first")).drop("_first").join(edits, "n", "left")  # one row


def zip_sparse(flags: DataFrame, lists: DataFrame) -> DataFrame:
    """Give the n-th row whose ``present`` is set the n-th list (n from 1)."""
    n = ordered.running_sum(flags, [], ["aln_idx"], F.col("present").cast("long"), "n")
    return n.withColumn("n", F.when(F.col("present"), F.col("n"))).join(lists, "n", "left")
