"""Column functions on bases and qualities.  All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def _once(value: Column, of) -> Column:
    """``of(value)`` with ``value`` computed once: inside another function's lambda it would be computed for each element."""
    return F.transform(F.array(value), of)[0]


def kmers(seq: Column, k: int) -> Column:
    """All substrings of length ``k``, in order; none where ``seq`` is shorter."""

    def of(s: Column) -> Column:
        last = F.length(s) - k + 1
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(s, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))

    return _once(seq, of)


def minimizer(seq: Column, k: int = 12) -> Column:
    """The least k-mer; null where ``seq`` is shorter."""
    return F.array_min(kmers(seq, k))


def swaps_strand(seq: Column, k: int = 12) -> Column:
    return _once(seq, lambda s: F.coalesce(minimizer(reverse_complement(s), k) < minimizer(s, k), F.lit(False)))


def on_strand(value: Column, swapped: Column, turned: Column) -> Column:
    """``turned`` where the strand is swapped.  Compute ``swapped`` once, for all that turns with it."""
    return F.when(swapped, turned).otherwise(value)


def insert_code(base: Column) -> Column:
    return F.translate(base, "NACGT", "VWXYZ")


def inserted_base(code: Column) -> Column:
    return F.translate(code, "VWXYZ", "NACGT")


def base_of_nibble(nibble: Column) -> Column:
    """The base of a 4-bit code."""
    return F.substring(F.lit("=ACMGRSVTWYHKDBN"), nibble + 1, F.lit(1))


def pack_2bit(seq: Column) -> Column:
    """Bases as a number of two bits each, the first base lowest; for up to 31 bases of ACGT."""
    codes = F.transform(F.split(F.translate(seq, "ACGT", "0123"), ""), lambda c: c.cast("long"))
    folded = F.aggregate(
        codes, F.struct(F.lit(0).cast("long").alias("v"), F.lit(1).cast("long").alias("unit")),
        lambda acc, c: F.struct((acc["v"] + c * acc["unit"]).alias("v"), (acc["unit"] * 4).alias("unit")), lambda acc: acc["v"],
    )
    return F.when(F.length(seq) == 0, F.lit(0).cast("long")).otherwise(folded)


def phred33(q: Column) -> Column:
    return F.char(q + 33)


def kmer_code90(kmer: Column) -> Column:
    """A 4-mer of qualities as a base-90 number."""
    digit = lambda i: (F.ascii(F.substring(kmer, i, 1)) - 33).cast("long")
    return digit(1) * 729000 + digit(2) * 8100 + digit(3) * 90 + digit(4)


def quality_by_strand(qual: Column, flag: Column) -> Column:
    return F.when(flag.bitwiseAND(16) != 0, F.reverse(qual)).otherwise(qual)


def weighted_mode(qual: Column) -> Column:
    """struct(mode, frequency): going up the alphabet, a character replaces the held one when its weight
    (a tenth of its value times its frequency) reaches the held one's frequency.

    One fold over the sorted characters; a run of equal ones is weighed when the next begins."""
    codes = F.array_sort(F.transform(F.split(qual, ""), lambda c: F.ascii(c) - 32))

    def weighed(a: Column) -> tuple[Column, Column]:
        wins = a["c"].between(0, 89) & (a["c"] * a["n"] >= a["f"] * 10)  # whole numbers keep the comparison exact
        return F.when(wins, a["c"]).otherwise(a["m"]).alias("m"), F.when(wins, a["n"]).otherwise(a["f"]).alias("f")

    def step(a: Column, c: Column) -> Column:
        m, f = weighed(a)
        return F.when(a["c"] == c, F.struct(a["c"].alias("c"), (a["n"] + 1).alias("n"), a["m"].alias("m"), a["f"].alias("f"))).otherwise(F.struct(c.alias("c"), F.lit(1).alias("n"), m, f))

    start = F.struct(F.lit(-99).alias("c"), F.lit(0).alias("n"), F.lit(89).alias("m"), F.lit(0).alias("f"))
    best = F.aggregate(codes, start, step, lambda a: F.struct(*weighed(a)))
    return _once(best, lambda b: F.struct(F.char(b["m"] + 32).alias("mode"), b["f"].alias("frequency")))


def splice_bytes(length: Column) -> Column:
    """struct(wide, b2, b1, b0): a splice length in two bytes, or in three where it is above 65535."""
    byte = lambda s: F.shiftright(length, s).bitwiseAND(255)
    return F.struct((length > 65535).alias("wide"), byte(16).alias("b2"), byte(8).alias("b1"), byte(0).alias("b0"))


def splice_length(parts: Column) -> Column:
    return parts["b2"] * 65536 + parts["b1"] * 256 + parts["b0"]


def checked_slice(seq: Column, start: Column, length: Column) -> Column:
    """Bases ``start`` (from 0) to start + length; null where that leaves the sequence."""
    return F.when((start >= 0) & (start + length <= F.length(seq)), F.substring(seq, start + 1, length))
