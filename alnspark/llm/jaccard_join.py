"""Exact n-gram Jaccard self-join by PartEnum signatures.

Sets of similarity ``t`` or more differ in few elements: |r ^ s| <= (1 - t) / (1 + t) * (|r| + |s|).  Sizes fall
into bands; a set is signed in its band and, if a larger partner may lie there, in the next.  A band's
scheme splits the feature domain into groups of three parts.  Some group has at most one part that differs, so for
one of its subsets of two parts both sets hold the same elements: each such subset is a signature.  In bands of
large sets, where a shared passage weighs less, a group is one part and more groups than elements can differ.

Equal sets are one node.  Nodes that share a signature are linked through the signature's least node, and
these stars are verified on the texts.  Where a star's link fails, the signature's members meet its best-linked
sets, and those then still in different components are compared pairwise, all behind an exact lower bound of
their difference.  No group is gathered in one task, and copies are never expanded into pairs.

Sets and features are named by 64-bit hashes.

Defined cases: null or empty texts have empty sets that link with nothing and are their own component (a
null id: null); texts with fewer words than a shingle are one shingle; equal rows are equal sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alnspark.llm.common import NO_ID, discard, fresh, id_or_null, keyed, row_key, slices, stored
from alnspark.llm.components import components
from alnspark.llm.wordhash import NOT_SPACE, U, Words, chunks, mix

#: Bands up to this size take three parts a group.
THREE_PARTS_UP_TO = 256
SALTS = 16
SKETCH = 8
#: Sets of more elements, in whose ``SKETCH`` nearly every cell is as often odd as even, have parities of as many cells as elements beside it.
WIDE = 400
#: Rounds, and best-linked sets a signature, before its members are compared pairwise.
ROUNDS, CENTRES = 2, 3
SIGNATURES = 500_000
#: A signature's bits beside its part; expected signatures an element of a set, and signatures a part.  A chance meeting is one more pair to verify.
KEY_BITS, EXPECTED, PART_ENTRIES = 40, 0.6, 250_000
#: Unlike elements share a 32-bit mark once in 2**32 pairs of them: within ``SURE`` of them ``SPARE`` times by chance in 1 of 10**13 comparisons.
SPARE, SURE = 4, 1 << 22
#: A table of needed sets is handed to every task up to this many rows (16 bytes each).
BROADCAST_ROWS = 2_000_000


class Scheme:
    """Signatures of the sets in one size band."""

    def __init__(self, band: int, smallest: int, largest: int, t: Fraction):
        self.band = band
        self.k = math.floor((1 - t) / (1 + t) * 2 * largest)
        self.parts = 3 if largest <= THREE_PARTS_UP_TO else 1
        self.spoilt = self.k // 2 if self.parts == 3 else self.k  # groups that no subset of survives, at most
        self.subsets = list(combinations(range(self.parts), max(1, self.parts - 1)))
        self.groups = next((g for g in range(self.spoilt + 1, 3 * self.spoilt + 2) if self._idle(g, smallest) <= g - self.spoilt - 1), self.spoilt + 1)

    def _idle(self, groups: int, size: int) -> float:
        """As many groups of a set of ``size`` elements as may well have an empty subset."""
        empty = math.exp(-size / (groups * self.parts))
        mean = groups * (empty if self.parts == 1 else 3 * empty**2)
        return mean + 2.5 * math.sqrt(mean)

    def sign(self, row: np.ndarray, feature: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(set numbers, signatures) of ``n`` sets, given as (set number, feature) pairs.

        A signature of no elements says nothing.  Sets with too few groups that have elements in every subset
        sign again with another salt; two such sets meet there."""
        todo = np.arange(n)
        width = self.groups * self.parts
        for salt in range(SALTS):
            place = mix(feature ^ U((self.band << 8) + salt + 1))
            cell = row * width + (place % U(width)).astype(np.int64)
            size = np.bincount(cell, minlength=len(todo) * width).reshape(len(todo), self.groups, self.parts)
            total = np.zeros(len(todo) * width, U)
            code = mix(place + U(7))
            for shift in (0, 22, 44):  # exact sums of 22 bits each
                bits = ((code >> U(shift)) & U((1 << 22) - 1)).astype(float)
                total += np.bincount(cell, bits, len(total)).astype(U) << U(shift)
            total = total.reshape(size.shape)
            good = np.ones(size.shape[:2], bool)
            for i, subset in enumerate(self.subsets):
                filled = size[:, :, subset].sum(axis=2) > 0
                good &= filled
                value = total[:, :, subset[0]]
                for j in subset[1:]:
                    value = mix(value) + total[:, :, j]
                where = U(self.band << 40 | salt << 36 | i << 32) + np.arange(self.groups, dtype=U)
                value = mix(mix(value) ^ where)
                at, group = np.nonzero(filled if salt < SALTS - 1 else np.ones_like(filled))
                yield todo[at], value[at, group]
            again = good.sum(axis=1) <= self.spoilt
            if not again.any():
                return
            new = np.cumsum(again) - 1
            here = again[row]
            row, feature, todo = new[row[here]], feature[here], todo[again]


class Bands:
    """Size bands of ratio 1 / t or more, so that partners lie in neighbouring bands."""

    def __init__(self, t: Fraction, power: float = 2.0):
        self.t, self.lows, self.schemes = t, [1], []
        self.ratio = float(1 / t) ** power

    def scheme(self, band: int) -> Scheme:
        while len(self.schemes) <= band:
            high = max(self.lows[-1], math.floor(self.lows[-1] * self.ratio))
            self.schemes.append(Scheme(len(self.schemes), math.ceil(self.lows[-1] * self.t), high, self.t))
            self.lows.append(high + 1)
        return self.schemes[band]

    def of(self, sizes: np.ndarray) -> np.ndarray:
        while self.lows[-1] <= sizes.max(initial=0):
            self.scheme(len(self.schemes))
        return np.searchsorted(self.lows, sizes, side="right") - 1

    def signatures(self, row: np.ndarray, feature: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = self.of(sizes)
        rows, values = [np.zeros(0, np.int64)], [np.zeros(0, U)]
        for band in np.unique(own[sizes > 0]):
            for scheme in (self.scheme(band), self.scheme(band + 1)):
                take = (own == band) & (sizes > 0)
                if scheme.band > band:  # only what reaches a partner there
                    take &= sizes >= math.ceil(self.lows[band + 1] * self.t)
                if not scheme.k or not take.any():  # without room to differ, equal sets alone match
                    continue
                ids = np.flatnonzero(take)
                new = np.full(len(sizes), -1)
                new[ids] = np.arange(len(ids))
                here = take[row]
                for r, v in scheme.sign(new[row[here]], feature[here], len(ids)):
                    rows.append(ids[r])
                    values.append(v)
        return np.concatenate(rows), np.concatenate(values)


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, feature) pairs without repeats, sorted by text, and each text's set size."""
    w = Words(texts, NOT_SPACE, True, streams=1)
    valid, (h,) = w.windows(words, 1)
    at = np.flatnonzero(valid)
    row, feature = w.doc[at], h[at]
    count = np.diff(w.first)
    for n in range(1, words):  # the whole sequence as one
        few = np.flatnonzero(count == n)
        if len(few):
            _, (h,) = w.windows(n, 1)
            row, feature = np.concatenate([row, few]), np.concatenate([feature, h[w.first[few]]])
    order = np.lexsort((feature, row))
    row, feature = row[order], feature[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (feature[1:] != feature[:-1])
    row, feature = row[new], feature[new]
    return row, feature, np.bincount(row, minlength=len(texts))


def sketches(row: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
    """Parities of the sets' elements in 512 cells, as eight numbers a set."""
    cell = row * SKETCH * 64 + (mix(feature + U(99)) >> U(55)).astype(np.int64)
    odd = (np.bincount(cell, minlength=n * SKETCH * 64) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, -1), axis=1).view(np.int64)


def wide_sketches(row: np.ndarray, feature: np.ndarray, sizes: np.ndarray) -> list[bytes | None]:
    """Parities of the elements of each set of more than ``WIDE`` in cells of a power of two, at least their number.  The halves of a sketch, added, are the one of half the cells."""
    large = sizes > WIDE
    cells = np.where(large, 1 << np.ceil(np.log2(np.maximum(sizes, 8))).astype(np.int64), 0)
    stop = np.cumsum(cells)
    own = large[row]
    r = row[own]
    cell = (stop - cells)[r] + (mix(feature[own] + U(98)) & (cells[r] - 1).astype(U)).astype(np.int64)
    packed = np.packbits((np.bincount(cell, minlength=int(cells.sum())) & 1).astype(np.uint8))
    return [packed[(j - n) // 8 : j // 8].tobytes() if n else None for j, n in zip(stop.tolist(), cells.tolist())]


def odd_cells(x: bytes, y: bytes) -> int:
    """Cells in which two wide sketches differ, the larger one folded to the other's size."""
    x, y = (np.frombuffer(v, np.uint8) for v in (x, y))
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _set_ids(row: np.ndarray, feature: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    code, total = mix(feature ^ U(0x5DEECE66D)), np.zeros(len(sizes), U)
    some = np.flatnonzero(sizes)
    if len(some):
        total[some] = np.add.reduceat(code, np.concatenate([[0], np.cumsum(sizes[some])[:-1]]))
    return mix(total + sizes.astype(U)).view(np.int64)


def set_rows(docs: DataFrame, words: int) -> DataFrame:
    """(did, th, n, sid, wide, s0 ... s7): each document's set size, set and parities."""
    parities = [f"s{i}" for i in range(SKETCH)]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (part for whole in batches for part in slices(whole)):
            for begin, texts in chunks(pdf["text"]):
                row, feature, size = shingle_sets(texts, words)
                mark = sketches(row, feature, len(texts))
                own = pdf.iloc[begin : begin + len(texts)]
                yield pd.DataFrame({"did": own["did"].to_numpy(), "th": own["th"].to_numpy(), "n": size, "sid": _set_ids(row, feature, size), "wide": wide_sketches(row, feature, size), **{p: mark[:, i] for i, p in enumerate(parities)}})

    return docs.mapInPandas(cut, "did long, th long, n long, sid long, wide binary, " + ", ".join(f"{p} long" for p in parities))


def signature_rows(docs: DataFrame, words: int, t: Fraction, parts: int) -> DataFrame:
    """(sig, sid, lo): the sets that share a signature with a smaller one, ``lo``.

    Within a batch (of about ``SIGNATURES`` at most) a signature keeps one row as its own, that of its least set; the other sets have found
    theirs.  Only the own rows meet, in ``parts`` that their hashes deal, packed in 13 bytes a row; a very common signature has one a batch."""
    names = ["part", "keys", "sids", "met"]

    def packed(sids: list[np.ndarray], sigs: list[np.ndarray]) -> pa.RecordBatch:
        sid, sig = np.concatenate(sids), np.concatenate(sigs)
        part = (sig & U(0xFFFFFF)).astype(np.int64) % parts
        name = (part << KEY_BITS) + (sig >> U(64 - KEY_BITS)).astype(np.int64)
        order = np.lexsort((sid, name))
        sid, name = sid[order], name[order]
        head = np.ones(len(name), bool)
        head[1:] = name[1:] != name[:-1]
        rep = sid[np.flatnonzero(head)][np.cumsum(head) - 1]
        other = np.flatnonzero(sid != rep)
        met = np.stack([name[other], sid[other], rep[other]], 1)
        own, sid = name[head], sid[head]
        cut = np.flatnonzero(np.append(True, (own[1:] >> KEY_BITS) != (own[:-1] >> KEY_BITS)))
        stop = np.append(cut[1:], len(own))
        five = np.ascontiguousarray(own & ((1 << KEY_BITS) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : KEY_BITS // 8]
        share = np.array_split(met, len(cut))  # no matter where
        return pa.RecordBatch.from_arrays(
            [pa.array((own[cut] >> KEY_BITS).astype(np.int32)), pa.array([five[i:j].tobytes() for i, j in zip(cut, stop)]), pa.array([sid[i:j].astype("<i8").tobytes() for i, j in zip(cut, stop)]), pa.array([m.astype("<i8").tobytes() for m in share])],
            names,
        )

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(t)
        for batch in batches:
            sids, sigs, held = [], [], 0
            for part in slices(batch):
                for _, texts in chunks(part.column("text").to_pylist()):
                    row, feature, size = shingle_sets(texts, words)
                    sid = _set_ids(row, feature, size)
                    _, once = np.unique(sid, return_index=True)
                    first = np.zeros(len(sid), bool)
                    first[once] = True
                    keep = first[row]
                    r, v = bands.signatures(row[keep], feature[keep], np.where(first, size, 0))
                    sids.append(sid[r])
                    sigs.append(v)
                    held += len(r)
                    if held > SIGNATURES:
                        yield packed(sids, sigs)
                        sids, sigs, held = [], [], 0
            if held:
                yield packed(sids, sigs)

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        raw = np.zeros((sum(map(len, pdf["keys"])) * 8 // KEY_BITS, 8), np.uint8)
        raw[:, : KEY_BITS // 8] = np.frombuffer(b"".join(pdf["keys"]), np.uint8).reshape(-1, KEY_BITS // 8)
        name = raw.view("<u8").ravel().astype(np.int64) + (int(pdf["part"].iloc[0]) << KEY_BITS)
        sid = np.frombuffer(b"".join(pdf["sids"]), "<i8")
        order = np.lexsort((sid, name))
        name, sid = name[order], sid[order]
        head = np.ones(len(name), bool)
        head[1:] = name[1:] != name[:-1]
        lo = sid[np.flatnonzero(head)][np.cumsum(head) - 1]
        new = (sid != lo) & (head | np.append(True, sid[1:] != sid[:-1]))
        met = np.frombuffer(b"".join(pdf["met"]), "<i8").reshape(-1, 3)
        return pd.DataFrame({"sig": np.append(name[new], met[:, 0]), "sid": np.append(sid[new], met[:, 1]), "lo": np.append(lo[new], met[:, 2])})

    posted = docs.select("text").mapInArrow(post, "part int, keys binary, sids binary, met binary")
    return posted.groupBy("part").applyInPandas(meet, "sig long, sid long, lo long")


def _needed(texts: DataFrame, wanted: DataFrame, on: list[str]) -> DataFrame:
    """The rows of ``texts`` that ``wanted`` (stored) names: without moving texts while ``wanted`` is small."""
    return texts.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, on)


def _rows_of(docs: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(sid, text): a text for each set in ``pairs``, or several equal rows."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    one = sets.join(ends, "sid", "left_semi").groupBy("sid").agg(F.min(F.struct("did", "th")).alias("d")).select("sid", "d.*")
    return _needed(docs, stored(one, "jaccard-wanted"), ["did", "th"]).select("sid", "text")


def _marked(rows: DataFrame, words: int) -> DataFrame:
    """(sid, marks): 32 bits of each element of a set, packed."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (part for whole in batches for part in slices(whole)):
            for begin, texts in chunks(pdf["text"]):
                row, feature, size = shingle_sets(texts, words)
                mark, stop = (feature >> U(32)).astype("<u4"), np.cumsum(size)
                yield pd.DataFrame({"sid": pdf["sid"].to_numpy()[begin : begin + len(texts)], "marks": [mark[i:j].tobytes() for i, j in zip(stop - size, stop)]})

    return rows.mapInPandas(cut, "sid long, marks binary")


def _sides(pairs: DataFrame, own: DataFrame, *columns: str, how: str = "inner") -> DataFrame:
    """The pairs with ``columns`` of both sets."""
    side = lambda c: own.select(F.col("sid").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in columns])
    return pairs.select("a", "b").join(side("a"), "a", how).join(side("b"), "b", how).select("a", "b", *[f"{x}_{c}" for x in columns for c in "ab"])


def exact(pairs: DataFrame, texts: DataFrame, words: int, t: Fraction) -> DataFrame:
    """The pairs (a, b) of sets whose similarity is ``t`` or more, by their texts."""
    num, den = t.numerator, t.denominator

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (part for whole in batches for part in slices(whole)):
            keep = []
            for x, y in zip(pdf["text_a"], pdf["text_b"]):
                row, feature, size = shingle_sets([x.encode(), y.encode()], words)
                both = len(feature) - len(np.unique(feature))
                keep.append(den * both >= num * (int(size.sum()) - both))
            yield pdf.loc[keep, ["a", "b"]]

    return _sides(pairs, texts, "text").mapInPandas(test, "a long, b long")


def in_common(x: np.ndarray, y: np.ndarray) -> int:
    """Elements that two sets share, at most: unlike elements may have one mark, equal ones always have."""
    u, v = np.unique(x, return_counts=True), np.unique(y, return_counts=True)
    _, i, j = np.intersect1d(u[0], v[0], assume_unique=True, return_indices=True)
    return int(np.minimum(u[1][i], v[1][j]).sum())


def screened(pairs: DataFrame, wide: DataFrame, t: Fraction) -> DataFrame:
    """The pairs (a, b) whose wide sketches leave room for similarity ``t``: ``_close`` for large sets, by a bit an element.

    Chance pairs of large sets grow with the square of the documents.  They end here, before marks of 32 bits an element move."""
    num, den = t.numerator, t.denominator

    def test(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (part for whole in batches for part in slices(whole)):
            keep = [
                x is None or y is None or odd_cells(x, y) * (den + num) <= (n + m) * (den - num)
                for x, y, n, m in zip(pdf["wide_a"], pdf["wide_b"], pdf["n_a"], pdf["n_b"])
            ]
            yield pdf.loc[keep, ["a", "b"]]

    return _sides(pairs, wide, "n", "wide", how="left").mapInPandas(test, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, words: int, t: Fraction) -> DataFrame:
    """The pairs (a, b) of sets whose similarity is ``t`` or more.

    Half the bytes move: marks never count too few common elements, so what they refuse is refused, and too many only by chance.  A pair is a
    link by them if it would be one with ``SPARE`` fewer; the texts decide the others, and those of so large sets that chance matters."""
    num, den = t.numerator, t.denominator
    marks = stored(_marked(_rows_of(docs, sets, pairs), words).dropDuplicates(["sid"]), "jaccard-marks")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in (part for whole in batches for part in slices(whole)):
            fits, sure = np.zeros(len(pdf), bool), np.zeros(len(pdf), bool)
            for i, (x, y) in enumerate(zip(pdf["marks_a"], pdf["marks_b"])):
                x, y = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
                both = in_common(x, y)
                least = -(-num * (len(x) + len(y)) // (den + num))  # den * both >= num * (all - both)
                fits[i], sure[i] = both >= least, both >= least + SPARE and len(x) * len(y) <= SURE
            yield pdf[["a", "b"]].assign(sure=sure)[fits]

    found = stored(_sides(pairs, marks, "marks").mapInPandas(judge, "a long, b long, sure boolean"), "jaccard-judged")
    discard(marks)
    sure, open_ = found.where("sure").select("a", "b"), found.where("NOT sure").select("a", "b")
    if open_.isEmpty():
        return sure
    texts = stored(_rows_of(docs, sets, open_).dropDuplicates(["sid"]), "jaccard-texts")
    more = stored(exact(open_, texts, words, t), "jaccard-exact")
    discard(texts)
    return sure.union(more)


def _close(t: Fraction):
    """Of rows with both ends' sizes and sketches: whether sizes and parities leave room for similarity ``t``.

    Sets differ at least as often as their parities, so no link is lost."""
    num, den = t.numerator, t.denominator
    differ = sum((F.bit_count(F.col(f"x.s{i}").bitwiseXOR(F.col(f"y.s{i}"))) for i in range(SKETCH)), F.lit(0))
    sizes = F.least("x.n", "y.n") * den >= F.greatest("x.n", "y.n") * num
    return sizes & (differ * (den + num) <= (F.col("x.n") + F.col("y.n")) * (den - num))


def _unjoined(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """The edges (a, b) whose ends are in different components."""
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    both = edges.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def join(docs: DataFrame, words: int = 5, t: Fraction = Fraction(4, 5), id_col: str = "doc_id", text_col: str = "text", root: bool = False) -> DataFrame:
    """Per row of ``docs``: did, th, n (set size), component (least did reachable by links of ``t`` or more), and with
    ``root`` the component's set, which also tells components of one id apart."""
    own = keyed(docs, id_col, text_col)
    sets = stored(set_rows(own, words), "jaccard-sets")
    parts = min(1 << 22, max(1, math.ceil((sets.agg(F.sum("n")).first()[0] or 0) * EXPECTED / PART_ENTRIES)))
    shared = stored(signature_rows(own, words, t, parts), "jaccard-shared")
    edges = stored(shared.select("sid", "lo").where("sid <> lo").distinct().toDF("a", "b"), "jaccard-edges")
    marks = sets.select("sid", "n", *[f"s{i}" for i in range(SKETCH)]).dropDuplicates(["sid"])
    wide = stored(sets.where("wide IS NOT NULL").select("sid", "n", "wide").dropDuplicates(["sid"]), "jaccard-wide")
    x, y = marks.alias("x"), marks.alias("y")
    # most edges of unlike sets end here, before any text is fetched
    both = edges.join(x, F.col("a") == F.col("x.sid")).join(y, (F.col("b") == F.col("y.sid")) & _close(t))
    hopeful = stored(screened(both, wide, t), "jaccard-hopeful")
    # first each set's least partner; then the edges that still lead to another component
    links = stored(verified(hopeful.groupBy("a").agg(F.min("b").alias("b")), own, sets, words, t), "jaccard-links")
    rest = stored(_unjoined(hopeful, components(links)), "jaccard-rest")
    links = stored(links.union(verified(rest, own, sets, words, t)).distinct(), "jaccard-links")
    roots = components(links)
    # signatures with a failed link: all their members in different components
    failed = stored(_unjoined(edges, roots), "jaccard-failed")
    if not failed.isEmpty():
        members = shared.union(shared.select("sig", F.col("lo").alias("sid"), "lo"))
        open_sigs = members.join(failed.toDF("sid", "lo"), ["sid", "lo"]).select("sig").distinct()
        found = stored(members.join(open_sigs, "sig", "left_semi").select("sig", "sid").distinct(), "jaccard-open")
        tested = hopeful.select("a", "b")

        def compare(y_of) -> tuple[DataFrame, DataFrame]:
            """Members of open signatures against ``y_of`` them, where components differ: (pairs tested, links)."""
            degree = links.select(F.explode(F.array("a", "b")).alias("sid")).groupBy("sid").agg(F.count("*").alias("degree"))
            side = found.join(marks, "sid").join(roots.toDF("sid", "root"), "sid", "left").join(degree, "sid", "left")
            side = stored(side.withColumns({"root": F.coalesce("root", "sid"), "degree": F.coalesce("degree", F.lit(0))}), "jaccard-members")
            x, y = side.alias("x"), y_of(side).alias("y")
            met = x.join(y, (F.col("x.sig") == F.col("y.sig")) & (F.col("x.root") != F.col("y.root")) & _close(t))
            pairs = met.select(F.greatest("x.sid", "y.sid").alias("a"), F.least("x.sid", "y.sid").alias("b")).distinct()
            pairs = stored(screened(pairs.join(tested, ["a", "b"], "left_anti"), wide, t), "jaccard-pairs")
            more = verified(pairs, own, sets, words, t)
            discard(side)
            return pairs, more

        # a signature's best-linked sets first: they join most of a large group of near copies
        best = Window.partitionBy("sig").orderBy(F.desc("degree"), "sid")
        centres = lambda side: side.withColumn("place", F.row_number().over(best)).where(F.col("place") <= CENTRES).drop("place")
        for y_of in (*[centres] * ROUNDS, lambda side: side):
            pairs, more = compare(y_of)
            if not more.isEmpty():
                links = links.union(more)
                roots = components(links)
            tested = tested.union(pairs)
    # written apart: a grouping above a join would keep Spark from splitting a giant component's rows
    placed = stored(sets.select("did", "th", "n", "sid").join(roots.toDF("sid", "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid")), "jaccard-placed")
    least = stored(placed.where("n > 0").groupBy("root").agg(F.min("did").alias("component")), "jaccard-least")
    placed = placed.join(least, "root", "left")
    return placed.select("did", "th", "n", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("did")).alias("component"), *(["root"] if root else []))


def keep_one(docs: DataFrame, words: int = 5, t: Fraction = Fraction(4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` for each component, with its columns: the least by id, nulls last, and text digest; of equal
    rows any one.  Rows without words have no shingles and belong to no group: all stay."""
    did, th, equal = (fresh(docs, c) for c in ("did", "th", "equal"))
    found = join(docs, words, t, id_col, text_col, root=True)
    rows = found.where("n > 0").groupBy("root", "did", "th").agg(F.count("*").alias("rows"))
    heads = rows.groupBy("root").agg(F.min(F.struct(F.col("did") == NO_ID, "did", "th", "rows")).alias("h")).select("h.did", "h.th", "h.rows")
    bare = found.where("n = 0").select("did", "th", F.lit(1).cast("long").alias("rows")).distinct()
    heads = stored(heads.union(bare).toDF(did, th, equal), "jaccard-heads")
    kept = docs.withColumns(dict(zip((did, th), row_key(id_col, text_col)))).join(heads, [did, th])
    # only heads with equal rows are shuffled by their texts
    one = kept.where(F.col(equal) == 1).unionByName(kept.where(F.col(equal) > 1).dropDuplicates([did, th]))
    return one.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    out = join(docs, 4, Fraction(85, 100))
    return out.select(id_or_null().alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("component") != NO_ID, F.col("component")).alias("component_id"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[p:p + 3], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
g AS (SELECT r, list_sort(list(g)) AS g FROM s GROUP BY r),
k AS (SELECT r, min(r) OVER (PARTITION BY g) AS u FROM g),
su AS (SELECT s.r, s.g FROM s JOIN k ON s.r = k.r WHERE k.r = k.u),
c AS (SELECT a.r AS x, b.r AS y, count(*) AS both_ FROM su a JOIN su b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
l AS (SELECT x, y FROM c JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * both_ >= 85 * (a.n + b.n - both_)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l UNION ALL SELECT r, u FROM k WHERE r <> u UNION ALL SELECT u, r FROM k WHERE r <> u),
walk(r, z) AS (SELECT r, r FROM d UNION SELECT walk.r, e.y FROM walk JOIN e ON e.x = walk.z)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(o.doc_id) AS component_id
FROM walk JOIN d ON d.r = walk.r JOIN d o ON o.r = walk.z LEFT JOIN n ON n.r = d.r GROUP BY d.r, d.doc_id
"""
