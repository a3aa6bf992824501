"""Predicates and projections on alignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alnspark.model import MASK_COLUMNS, REVERSE, SECONDARY, SUPPLEMENTARY, UNMAPPED


def is_unaligned(flag: Column) -> Column:
    return flag.bitwiseAND(UNMAPPED) != 0


def is_primary(flag: Column) -> Column:
    return flag.bitwiseAND(SECONDARY | SUPPLEMENTARY) == 0


def is_reverse(flag: Column) -> Column:
    return flag.bitwiseAND(REVERSE) != 0


def mapped(aln: DataFrame, primary_only: bool = False) -> DataFrame:
    kept = aln.where(~is_unaligned(F.col("flag")))
    return kept.where(is_primary(F.col("flag"))) if primary_only else kept


def project(aln: DataFrame, mask: int) -> DataFrame:
    """The columns of the field groups in ``mask``, and the ordinal."""
    wanted = [c for bit, cols in MASK_COLUMNS.items() if mask & bit for c in cols if c in aln.columns]
    return aln.select("aln_idx", *wanted)


def view(aln: DataFrame, ref_id: int, start: int, stop: int) -> DataFrame:
    """Alignments that start in [start, stop) of a reference."""
    return aln.where((F.col("ref_id") == ref_id) & (F.col("pos") >= start) & (F.col("pos") < stop))


def strip_fields(aln: DataFrame) -> DataFrame:
    """Aligned rows with name, mates and qualities blanked."""
    return aln.where(~is_unaligned(F.col("flag"))).withColumns({
        "qname": F.lit("*"), "rnext": F.lit(-1), "pnext": F.lit(0), "tlen": F.lit(0), "qual": F.lit("*"),
    })


def shown_quality(aln: DataFrame) -> DataFrame:
    """Qualities as restored text shows them: a star for secondary rows."""
    return aln.withColumn("qual", F.when(F.col("flag").bitwiseAND(SECONDARY) != 0, F.lit("*")).otherwise(F.col("qual")))


def keep_tags(opt: Column) -> Column:
    """Optional tags, structs with ``tag``, but MD, NM and those that begin with X."""
    return F.filter(opt, lambda t: ~t["tag"].isin("MD", "NM") & ~t["tag"].startswith("X"))
