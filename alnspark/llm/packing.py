"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

Documents are tokenised where they lie; only their lengths matter for packing, so the packer works on
the number of pieces of each length (at most ``capacity`` numbers).  It fills a bin greedily with the
longest piece that still fits, then replaces the bin's smallest piece by the two unpacked pieces that
fill the widened gap best, and repeats the bin while the counts last.  Pieces are ranked within their length
and look up their bin in that plan.

Defined cases: a null text is empty and gives the single token 0; longer documents are cut into pieces of
``capacity`` tokens of which the first may be shorter; null ids and equal rows are packed like others.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from alnspark.llm.common import ranked, stored

CAPACITY, END_ID = 2048, 0
VOCABULARY = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"
#: Documents of a slice in a worker, and white space in a row that the quick coder may see.
SLICE, MOST_SPACE = 64, 2_000


class Encoder:
    """Ids of ``tokenizers``' vocabulary file.  The same vocabulary as ranks gives the same ids in a third of the time
    (the tests compare both); texts with a special token's string, or with more white space in a row than the
    quick coder's pattern can take, go to the tokenizer itself."""

    def __init__(self, vocabulary: str, ranks: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals the work
        self.tokenizer = Tokenizer.from_file(vocabulary)
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        specials = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.slow = re.compile("|".join([rf"\s{{{MOST_SPACE}}}", *specials]))

    def __call__(self, text: str) -> np.ndarray:
        """Unsigned 32-bit ids."""
        if self.slow.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return self.quick.encode_to_numpy(text, disallowed_special=())


@cache
def encoder(vocabulary: str, ranks: str) -> Encoder:
    return Encoder(vocabulary, ranks)


def pieces(docs: DataFrame, vocabulary: str, ranks: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of each document's ids and a closing 0."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, ranks)
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                row, piece, start, length, crc = [], [], [], [], []
                for i, text in enumerate(part.column("text")):
                    ids = np.append(encode(text.as_py() or ""), np.uint32(END_ID)).astype("<u4", copy=False)
                    cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                    row += [i] * (len(cuts) - 1)
                    piece += range(len(cuts) - 1)
                    start += cuts[:-1]
                    length += np.diff(cuts).tolist()
                    crc += [zlib.crc32(ids[a:b]) for a, b in zip(cuts, cuts[1:])]
                columns = [part.column("doc_id").take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return own.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """From pieces of each length: (length, first rank, end rank, uses in a bin, first bin, first offset)."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    given = np.zeros(capacity + 1, np.int64)
    out, bins = [], 0
    while True:
        some = np.flatnonzero(left)
        if not len(some):
            return out
        used: dict[int, int] = {}
        gap = capacity
        while gap > 0:  # the longest that fits
            i = int(np.searchsorted(some, gap, side="right")) - 1
            while i >= 0 and left[some[i]] <= used.get(int(some[i]), 0):
                i -= 1
            if i < 0:
                break
            length = int(some[i])
            n = min(gap // length, int(left[length]) - used.get(length, 0))
            used[length] = used.get(length, 0) + n
            gap -= n * length
        if gap and (pair := best_two(some, left, used, gap)):
            small = min(used)
            used[small] -= 1
            used = {k: v for k, v in used.items() if v}
            for length in pair:
                used[length] = used.get(length, 0) + 1
        times = min(int(left[k]) // v for k, v in used.items())
        at = 0
        for length in sorted(used, reverse=True):
            n = used[length]
            out.append((length, int(given[length]), int(given[length]) + n * times, n, bins, at))
            given[length] += n * times
            left[length] -= n * times
            at += n * length
        bins += times


def best_two(some: np.ndarray, left: np.ndarray, used: dict[int, int], gap: int) -> tuple[int, int] | None:
    """Two unpacked lengths that fit the gap widened by the bin's smallest piece, and fill it better than that piece."""
    small = min(used)
    wide = gap + small
    free = np.array([k for k in some[some < wide] if left[k] > used.get(int(k), 0)], np.int64)
    if not len(free):
        return None
    mate = np.searchsorted(free, wide - free, side="right") - 1  # the longest partner of each
    ok = (mate >= 0)
    same = ok & (free[np.maximum(mate, 0)] == free)
    lone = np.array([left[k] - used.get(int(k), 0) < 2 for k in free])
    mate = np.where(same & lone, mate - 1, mate)
    ok = mate >= 0
    total = np.where(ok, free + free[np.maximum(mate, 0)], 0)
    best = int(np.argmax(total))
    return (int(free[best]), int(free[mate[best]])) if total[best] > small else None


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored pieces."""
    counts = {int(r[0]): int(r[1]) for r in cut.groupBy("length").count().collect()}  # at most ``capacity`` rows
    steps = plan(counts, capacity)
    if not steps:
        return cut.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    length, first, _, uses, bins, at = (np.array(x, np.int64) for x in zip(*sorted(steps)))
    by_rank = ranked(cut, ["length"], ["doc_id", "piece", "start", "ids_crc32"], "rank")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lows = np.searchsorted(length, np.arange(capacity + 2))
        for batch in batches:
            own, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            i = np.zeros(len(own), np.int64)
            for k in np.unique(own):
                here = own == k
                lo, hi = lows[k], lows[k + 1]
                i[here] = lo + np.searchsorted(first[lo:hi], rank[here], side="right") - 1
            turn, slot = np.divmod(rank - first[i], uses[i])
            columns = [*batch.columns[:-1], pa.array(bins[i] + turn), pa.array(at[i] + slot * own)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return by_rank.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, schema)


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return pack(stored(pieces(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.path(RANKS)), "pieces"))
