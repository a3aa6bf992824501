"""Rebuilding reads and SAM lines from edits: the bases of a batch are gathered at once from the reference slices and the edits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALIGNED, IN_READ, IN_REFERENCE = b"M=X", b"M=XIS", b"M=XDN"
#: Columns that ``rebuild`` reads.
PARTS = ["cigar", "reference", "mismatches", "inserts", "left_clip", "right_clip"]


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each string begins (and the last one ends)."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    return (np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8))[at[0] : at[-1]], at - at[0]


def _strings(data: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each piece, one piece after the other."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


def _before(size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum of the sizes before each operation in its row, whose operations begin at ``first``."""
    total = np.concatenate([[0], np.cumsum(size)])
    return total[:-1] - np.repeat(total[first[:-1]], np.diff(first))


def _operations(cigar: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(operation, length, first operation of each row and the number of all)."""
    data, at = _bytes(cigar)
    place = np.flatnonzero((data < ord("0")) | (data > ord("9")))
    first = np.searchsorted(place, at)
    begin = np.concatenate([[-1], place[:-1]]) + 1  # a row's text ends with an operation, so its digits begin behind the one before
    power = 10 ** np.minimum(np.repeat(place, place - begin) - 1 - _spread(begin, place - begin), 18)
    digits = np.concatenate([[0], np.cumsum((data[_spread(begin, place - begin)] - ord("0")).astype(np.int64) * power)])
    ends = np.cumsum(place - begin)
    return data[place], digits[ends] - digits[ends - (place - begin)], first


def read_and_md(batch: pa.RecordBatch) -> tuple[pa.Array, pa.Array]:
    """The sequence and the MD text of each row.

    ``reference`` starts at the read's position; ``mismatches`` are (at, base) of places in the read, of which those in aligned stretches count;
    ``inserts`` has the inserted bases in order; the clips are as long as their operations."""
    op, size, first = _operations(batch.column("cigar"))
    row = np.repeat(np.arange(batch.num_rows), np.diff(first))
    kind = lambda some: np.isin(op, np.frombuffer(some, np.uint8))
    sized = lambda some: np.where(kind(some), size, 0)
    read_at, ref_at, ins_at, m_at = (_before(sized(some), first) for some in (IN_READ, IN_REFERENCE, b"I", ALIGNED))
    sources, begins, lengths, total = [], [], [], 0
    for name in ("reference", "inserts", "left_clip", "right_clip"):
        data, at = _bytes(batch.column(name))
        sources.append(data)
        begins.append(at[:-1] + total)
        lengths.append(np.diff(at))
        total += len(data)
    source = np.concatenate(sources)
    # a clip before anything of the read is the left one
    which = np.select([kind(ALIGNED), kind(b"I"), kind(b"S") & (_before(sized(b"M=XIDN"), first) == 0)], [0, 1, 2], 3)
    inner = np.select([which == 0, which == 1], [ref_at, ins_at], 0)
    made = kind(IN_READ)
    lacks = made & (inner + size > np.choose(which, [x[row] for x in lengths]))
    if lacks.any():
        raise ValueError(f"CIGAR {batch.column('cigar')[int(row[lacks][0])]} asks for more bases than there are")
    start = np.choose(which, [x[row] for x in begins]) + inner
    seq = source[_spread(start[made], size[made])]
    seq_at = np.concatenate([[0], np.cumsum(np.bincount(row[made], size[made], batch.num_rows).astype(np.int64))])
    # mismatches: the aligned operation that holds each, and the reference's base there
    mm = batch.column("mismatches")
    many = pc.fill_null(pc.list_value_length(mm), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = mm.flatten()
    spot = flat.field("at").to_numpy(zero_copy_only=False).astype(np.int64)
    base = _bytes(flat.field("base"))[0]
    owner = np.repeat(np.arange(batch.num_rows), many)
    order = np.lexsort((base, spot, owner))
    owner, spot, base = owner[order], spot[order], base[order]
    lead = np.ones(len(spot), bool)
    lead[1:] = (owner[1:] != owner[:-1]) | (spot[1:] != spot[:-1])  # the first of several at a place
    use = np.flatnonzero(kind(ALIGNED) & (size > 0))
    far = int(max(read_at.max(initial=0) + size.max(initial=0), spot.max(initial=0))) + 1
    found = np.searchsorted(row[use] * far + read_at[use], owner * far + spot, side="right") - 1
    lead &= found >= 0
    at = use[np.maximum(found, 0)] if len(use) else np.zeros(len(spot), np.int64)
    if len(use):
        lead &= (row[at] == owner) & (spot < read_at[at] + size[at])
    owner, spot, base, at = owner[lead], spot[lead], base[lead], at[lead]
    own = source[start[at] + spot - read_at[at]] if len(at) else base
    differs = own != base
    owner, spot, base, at, own = owner[differs], spot[differs], base[differs], at[differs], own[differs]
    seq[seq_at[owner] + spot] = base
    # MD: deletions and mismatches by aligned bases before them; a deletion comes first
    gone = np.flatnonzero(op == ord("D"))
    event_row = np.concatenate([row[gone], owner])
    event_m = np.concatenate([m_at[gone], m_at[at] + spot - read_at[at]])
    width = np.repeat([0, 1], [len(gone), len(owner)])
    pieces = np.concatenate([size[gone] + 1, np.ones(len(owner), np.int64)])
    text = np.full(pieces.sum(), ord("^"), np.uint8)
    text_at = np.concatenate([[0], np.cumsum(pieces)])
    if len(gone):
        text[_spread(text_at[: len(gone)] + 1, size[gone])] = source[_spread(begins[0][row[gone]] + ref_at[gone], size[gone])]
    text[text_at[len(gone) : -1]] = own
    order = np.lexsort((width, event_m, event_row))
    end = (event_m + width)[order]
    same = np.zeros(len(order), bool)
    same[1:] = event_row[order][1:] == event_row[order][:-1]
    gap = event_m[order] - np.where(same, np.concatenate([[0], end[:-1]])[: len(order)], 0)
    tokens = pc.binary_join_element_wise(pa.array(gap).cast(pa.string()), _strings(text, text_at).take(pa.array(order)), "")
    held = np.searchsorted(event_row[order], np.arange(batch.num_rows + 1))
    aligned = np.bincount(row, sized(ALIGNED), batch.num_rows).astype(np.int64)
    last = np.where(np.diff(held) > 0, np.concatenate([end, [0]])[held[1:] - 1], 0)
    md = pc.binary_join_element_wise(pc.binary_join(pa.ListArray.from_arrays(pa.array(held.astype(np.int32)), tokens), ""), pa.array(aligned - last).cast(pa.string()), "")
    return _strings(seq, seq_at), md


def rebuild(rows: DataFrame) -> DataFrame:
    """Add ``seq`` and ``md`` to rows with cigar, reference, mismatches (array of at, base), inserts, left_clip, right_clip.

    Sources that are shorter than the CIGAR asks for are an error; null edits and clips are empty."""
    own = rows.select(*rows.columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seq, md = read_and_md(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, seq, md], [*batch.schema.names, "seq", "md"])

    return own.mapInArrow(gather, f"{schema}, seq string, md string")


def sam_line() -> Column:
    """The text of an alignment with ``rname`` and ``mate`` (reference names or null): 1-based positions, = for a mate on
    the same reference, * and 0 for what is missing; then MD, and the optional tags with their types."""
    text = lambda c: F.col(c).cast("string")
    placed = lambda name, pos: F.when(F.col(name).isNotNull() & (F.col(pos) >= 0), (F.col(pos) + 1).cast("string")).otherwise(F.lit("0"))
    mate = F.when(F.col("mate").isNull(), F.lit("*")).when(F.col("mate") == F.col("rname"), F.lit("=")).otherwise(F.col("mate"))
    tags = F.filter(F.coalesce("opt", F.array().cast("array<struct<tag:string,type:string,value:string>>")), lambda t: t["tag"] != "MD")
    return F.concat_ws(
        "\t", "qname", text("flag"), F.coalesce("rname", F.lit("*")), placed("rname", "pos"), text("mapq"), "cigar", mate, placed("mate", "pnext"), text("tlen"), "seq", "qual",
        F.concat(F.lit("MD:Z:"), "md"), F.transform(tags, lambda t: F.concat_ws(":", t["tag"], t["type"], t["value"])),
    )
