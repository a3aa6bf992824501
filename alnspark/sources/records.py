"""FASTA and FASTQ records of any layout: a parallel scan of a line machine.

Between records (state 0) a line that begins with ``>`` or ``@`` opens a record.  In its bases (state 1, with the number so far) such a
line opens the next one, a line that begins with ``+`` ends them, and any other line adds to them.  In its qualities (state 2,
with the number that is missing) every line counts, whatever it begins with, until there are as many as bases.  So a quality line
that begins with ``@`` or ``+`` is no header, and ``>`` inside a header opens nothing.  White space and carriage returns count nowhere.

What a line means depends on all lines before it, so a split alone cannot tell.  Each split yields its transition function instead: the state that it ends in
for each state that it may begin in.  From state 0 that is one state; from 2 it is a step function of the missing number, and as runs soon meet,
a few steps; 1 leads to 2 or to a header.  The functions are composed along each file, a row a split, and then all splits cut their
records at once.  Records across blocks leave pieces, which are put together.

A split is gone through in blocks of some ``BLOCK_BYTES``, each with a function of its own, and only the block at hand and a record must fit in a task's memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of lines that a task holds at a time.
BLOCK_BYTES = 2 << 20
BETWEEN, BASES, QUALITIES = 0, 1, 2
HEAD, PLUS = 1, 2
STATE = ("state", "count", "at")
FUNCTION = "file string, split long, ahead long, state int, count long, at long, total long, kind int, before long, after long, f_state int, f_count long, f_at long, bound array<long>, s_state array<int>, s_count array<long>, s_at array<long>"


class Lines:
    """The lines of one split: kinds, and running numbers of printable characters."""

    def __init__(self, split: int, values: pa.Array):
        values = values.cast(pa.large_binary()).fill_null(b"")
        at = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
        raw = values.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        data = np.concatenate([data[at[0] : at[-1]], np.zeros(1, np.uint8)])
        at = at - at[0]
        n = self.n = len(values)
        first = np.where(np.diff(at) > 0, data[at[:-1]], 0)
        self.kind = np.where((first == ord(">")) | (first == ord("@")), HEAD, np.where(first == ord("+"), PLUS, 0))
        seen = np.concatenate([[0], np.cumsum((data > 32) & (data < 127))])
        self.sum = seen[at]  # before each line, and after the last
        self.place = split + at[:-1] + np.arange(n)  # grows along the file and names a record
        self.split, self.values = split, values
        self.heads = np.flatnonzero(self.kind == HEAD)
        self.special = np.flatnonzero(self.kind > 0)

    def _next(self, places: np.ndarray, i: int) -> int:
        k = np.searchsorted(places, i)
        return int(places[k]) if k < len(places) else self.n

    def filled(self, target: int) -> int:
        """The line with which the number of characters reaches ``target``; ``n`` if none does."""
        return int(np.searchsorted(self.sum, target)) - 1 if target <= self.sum[-1] else self.n

    def step(self, head: int) -> tuple[int, int, int]:
        """(next special line, last line of the qualities, next header) of the record that ``head`` opens; ``n`` where there is none."""
        p = self._next(self.special, head + 1)
        if p == self.n or self.kind[p] == HEAD:
            return p, self.n, p
        end = self.filled(self.sum[p + 1] + self.sum[p] - self.sum[head + 1])
        return p, end, self._next(self.heads, end + 1) if end < self.n else self.n

    def ends(self) -> list[tuple[int, int, int]]:
        """For each header the state at the split's end, if it opens a record; the last entry is for none."""
        out = [(BETWEEN, 0, 0)] * (len(self.heads) + 1)
        for k in range(len(self.heads) - 1, -1, -1):
            head = int(self.heads[k])
            p, end, following = self.step(head)
            if following < self.n:
                out[k] = out[np.searchsorted(self.heads, following)]
            elif p == self.n:
                out[k] = (BASES, int(self.sum[-1] - self.sum[head + 1]), int(self.place[head]))
            elif end == self.n:
                out[k] = (QUALITIES, int(self.sum[p + 1] + self.sum[p] - self.sum[head + 1] - self.sum[-1]), int(self.place[head]))
        return out

    def function(self) -> dict:
        """The transition function of the split."""
        ends = self.ends()
        run = np.searchsorted(self.heads, np.arange(self.n + 1))  # between records at a line: which header is next
        number = {s: i for i, s in enumerate(dict.fromkeys(ends))}
        label = np.array([number[s] for s in ends])[run[1:]]  # after each line
        last = np.flatnonzero(np.append(label[1:] != label[:-1], True)) if self.n else np.zeros(0, int)
        steps = [ends[run[i + 1]] for i in last]
        p = self._next(self.special, 0)
        some = p < self.n
        first = ends[np.searchsorted(self.heads, p)] if some and self.kind[p] == HEAD else (BETWEEN, 0, 0)
        return dict(zip(STATE, ends[run[0]] if self.n else ends[-1])) | {
            "total": int(self.sum[-1]), "kind": int(self.kind[p]) if some else 0, "before": int(self.sum[p]), "after": int(self.sum[p + 1]) if some else int(self.sum[p]),
            "f_state": first[0], "f_count": first[1], "f_at": first[2],
            "bound": [int(self.sum[i + 1]) for i in last], "s_state": [s[0] for s in steps], "s_count": [s[1] for s in steps], "s_at": [s[2] for s in steps],
        }

    def records(self, state: int, count: int, at: int) -> Iterator[tuple[int, int | None, slice, slice | None, bool]]:
        """(at, header line, lines of bases, lines of qualities, whole) of what lies here, with the rest of an open record first."""
        head = 0
        if state == BASES:
            p = self._next(self.special, 0)
            if p < self.n and self.kind[p] == PLUS:
                end = self.filled(self.sum[p + 1] + count + self.sum[p])
                yield at, None, slice(0, p), slice(p + 1, min(end + 1, self.n)), False
                head = end + 1
            else:
                yield at, None, slice(0, p), None, False
                head = p
        elif state == QUALITIES:
            end = self.filled(count)
            yield at, None, slice(0, 0), slice(0, min(end + 1, self.n)), False
            head = end + 1
        head = self._next(self.heads, head)
        while head < self.n:
            p, end, following = self.step(head)
            plus = p < self.n and self.kind[p] == PLUS
            whole = end < self.n if plus else p < self.n
            yield int(self.place[head]), head, slice(head + 1, p), slice(p + 1, min(end + 1, self.n)) if plus else None, whole
            head = following


def state_after(f: dict, state: int, count: int, at: int) -> tuple[int, int, int]:
    """Where a split ends that begins in a state."""
    if state == BETWEEN:
        return f["state"], f["count"], f["at"]
    target = count
    if state == BASES:
        if f["kind"] == 0:
            return BASES, count + f["total"], at
        if f["kind"] == HEAD:
            return f["f_state"], f["f_count"], f["f_at"]
        target = f["after"] + count + f["before"]
    if target > f["total"]:
        return QUALITIES, target - f["total"], at
    i = int(np.searchsorted(f["bound"], target))
    return f["s_state"][i], f["s_count"][i], f["s_at"][i]


def blocks(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[tuple[str, int, int, pa.RecordBatch, pa.Array]]:
    """(file, split, bytes before in the split, first rows, lines) by blocks of about ``most`` bytes, in order; the lines are a block's whole."""
    most = most or BLOCK_BYTES
    held, size, key, ahead = [], 0, None, 0

    def block():
        values = pa.chunked_array([b.column("value").cast(pa.large_binary()) for b in held]).combine_chunks()
        return *key, ahead, held[0].slice(0, 1), values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values

    for batch in batches:
        if not batch.num_rows:
            continue
        split, file = batch.column("split").to_numpy(), batch.column("file")
        cut = np.flatnonzero(split[1:] != split[:-1]) + 1
        names = file.dictionary_encode().indices.to_numpy() if batch.num_rows > 1 else np.zeros(1, int)
        cut = np.union1d(cut, np.flatnonzero(names[1:] != names[:-1]) + 1).astype(int)
        end = np.cumsum(pc.fill_null(pc.binary_length(batch.column("value")), 0).to_numpy().astype(np.int64) + 1)  # bytes up to and with each line
        for lo, hi in zip([0, *cut], [*cut, batch.num_rows]):
            own = file[int(lo)].as_py(), int(split[lo])
            if own != key:
                if held:
                    yield block()
                held, size, key, ahead = [], 0, own, 0
            while lo < hi:
                if size >= most:
                    yield block()
                    held, size, ahead = [], 0, ahead + size
                before = int(end[lo - 1]) if lo else 0
                to = min(int(hi), max(int(lo) + 1, int(np.searchsorted(end, before + most - size))))
                held.append(batch.slice(int(lo), to - int(lo)))
                size, lo = size + int(end[to - 1]) - before, to
    if held:
        yield block()


def functions(lines: DataFrame) -> DataFrame:
    """The transition functions of each split's blocks, one row each."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for file, split, ahead, _, values in blocks(batches):
            yield pa.RecordBatch.from_pylist([{"file": file, "split": split, "ahead": ahead} | Lines(split + ahead, values).function()], schema=_SCHEMA)

    return lines.mapInArrow(each, FUNCTION)


_LIST = {"array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "long": pa.int64(), "int": pa.int32(), "string": pa.string()}
_SCHEMA = pa.schema([(n, _LIST[t]) for n, t in (c.rsplit(" ", 1) for c in FUNCTION.split(", "))])


def starts(found: DataFrame) -> DataFrame:
    """(file, split, state, count, at): the state in which each split begins, by composing the functions along its file."""

    def along(rows: pd.DataFrame) -> pd.DataFrame:
        now, out = (BETWEEN, 0, 0), []
        for f in rows.sort_values(["split", "ahead"]).to_dict("records"):
            if not f["ahead"]:
                out.append((f["file"], f["split"], *now))
            now = state_after(f, *now)
        return pd.DataFrame(out, columns=["file", "split", *STATE])

    return found.groupBy("file").applyInPandas(along, "file string, split long, state int, count long, at long")  # a file's blocks, a short row each


RECORD = "file string, at long, split long, head string, seq string, qual string"
_NAMES = [c.split()[0] for c in RECORD.split(", ")]
_KINDS = [_LIST[c.split()[1]] for c in RECORD.split(", ")]
_UNPRINTED = bytes(x for x in range(256) if not 32 < x < 127)


def _cut(lines: DataFrame, whole: bool) -> DataFrame:
    """The records that lie in one block (``whole``), or the pieces of the others; ``qual`` is null before the qualities."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), _KINDS)], _NAMES)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for file, split, ahead, first, values in blocks(batches):
            own, rows, size = Lines(split + ahead, values), [], 0
            now = now if ahead else tuple(first.column(c)[0].as_py() for c in STATE)
            text = lambda x: b"".join(own.values[x.start : x.stop].to_pylist()).translate(None, _UNPRINTED).decode()
            for at, head, bases, qualities, complete in own.records(*now):
                if complete == whole:
                    name = None if head is None else own.values[head].as_py()[1:].rstrip(b"\r").decode("utf-8", "replace")
                    rows.append((file, at, split + ahead, name, text(bases), None if qualities is None else text(qualities)))
                    size += len(rows[-1][4])
                if len(rows) >= 10_000 or size > 1 << 24:
                    yield batch(rows)
                    rows, size = [], 0
            if rows:
                yield batch(rows)
            now = state_after(own.function(), *now)

    return lines.mapInArrow(cut, RECORD)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, name, comment, seq, qual) of FASTA and FASTQ records; ``at`` grows along a file.

    ``qual`` is null for records without a ``+`` line; one with too few qualities at its file's end is left out, like a record without a name's line."""
    raw = spark.read.option("lineSep", "\n").text(path)
    lines = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))
    begun = starts(functions(lines))
    own = lines.join(F.broadcast(begun), ["file", "split"])  # one short row a split: some 60 MB for 100 TB
    pieces = _cut(own, False).groupBy("file", "at").agg(F.array_sort(F.collect_list(F.struct("split", "head", "seq", "qual"))).alias("x"))
    joined = lambda c: F.array_join(F.transform("x", lambda y: y[c]), "")
    pieces = pieces.select("file", "at", F.get("x", F.lit(0))["head"].alias("head"), joined("seq").alias("seq"), F.when(F.exists("x", lambda y: y["qual"].isNotNull()), joined("qual")).alias("qual"))
    both = _cut(own, True).drop("split").unionByName(pieces)
    both = both.withColumn("qual", F.substring("qual", F.lit(1), F.length("seq"))).where("qual IS NULL OR length(qual) = length(seq)")
    parts = F.split("head", r"\s+", 2)
    return both.select("file", "at", parts[0].alias("name"), F.get(parts, F.lit(1)).alias("comment"), "seq", "qual")
