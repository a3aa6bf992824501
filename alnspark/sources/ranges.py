"""Data sources whose partitions are byte ranges of files.

``fasta_ranges`` reads what an index says: each wanted record is cut into ranges of whole lines, and only these bytes are read.
``sam_ranges`` reads alignments by ranges of their files, in the order of file names and byte offsets, and
tests pushed conditions on a line's first columns before the rest is looked at.

Both take conditions from the plan (``where`` on their columns) once ``register`` has been called, and open files through pyarrow, so a
path may be local or in any store that pyarrow knows."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Bytes of a partition, and of one piece of a record.
PARTITION_BYTES, PIECE_BYTES = 32 << 20, 4 << 20
BATCH = 8_192
#: An index up to this size is read by the driver; bytes of a task's range of a larger one.
PLAN_BYTES, INDEX_BYTES = 4 << 20, 1 << 20


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (FastaRanges, SamRanges):
        spark.dataSource.register(source)


def located(path: str) -> tuple[fs.FileSystem, str]:
    """A path's store and its place there; Spark writes ``file:/x`` where others write ``file:///x``."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the data files below a folder, by name."""
    store, place = located(path)
    info = store.get_file_info(place)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    found = store.get_file_info(fs.FileSelector(place, recursive=True))
    hidden = lambda p: any(x[:1] in "._" for x in p.removeprefix(place).split("/") if x)
    stem = path.rstrip("/")
    return sorted((stem + f.path.removeprefix(place.rstrip("/")), f.size) for f in found if f.type == fs.FileType.File and f.size and not hidden(f.path))


_COMPARE = {EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}


class Pushing(DataSourceReader):
    """Takes comparisons of ``columns`` with values; the others stay with Spark."""

    columns: tuple[str, ...] = ()

    def __init__(self, options):
        self.options = dict(options)
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in _COMPARE and len(f.attribute) == 1 and f.attribute[0] in self.columns:
                self.tests.append((f.attribute[0], type(f), f.value))
            else:
                yield f

    def passes(self, **values) -> bool:
        """Whether the values meet all conditions on them."""
        return all(values[c] is not None and _COMPARE[kind](values[c], v) for c, kind, v in self.tests if c in values)


@dataclass
class Ranges(InputPartition):
    """(file, first byte, bytes, name, first base) of each range."""

    parts: Sequence[tuple]


@dataclass
class IndexRange(InputPartition):
    """A byte range of an index."""

    file: str
    first: int
    size: int
    whole: int


class FastaReader(Pushing):
    columns = ("file", "name")

    def entry(self, row: list[str]) -> tuple | None:
        """(file, name, bases, first byte, bases and bytes a line) of a line of the index, if it is wanted."""
        file, name, *numbers = row if len(row) > 5 else [self.options["path"], *row]
        return (file, name, *map(int, numbers)) if self.passes(file=file, name=name) else None

    def entries(self) -> Iterator[tuple]:
        for path, _ in listed(self.options["index"]):
            store, place = located(path)
            with store.open_input_stream(place) as f:
                for row in csv.reader(io.TextIOWrapper(f), delimiter="\t"):
                    if found := self.entry(row):
                        yield found

    def cut(self, entry: tuple) -> Iterator[tuple]:
        """The ranges of an entry, of whole lines."""
        piece = int(self.options.get("piecebytes", PIECE_BYTES))
        file, name, bases, offset, width, line = entry
        lines = max(1, piece // max(line, 1))
        total = bases + (-(-bases // width) - 1) * (line - width) if bases else 0  # without the last line's end
        for k in range(0, max(total, 1), lines * max(line, 1)):
            yield file, offset + k, min(lines * line, total - k) if total else 0, name, k // line * width if line else 0

    def partitions(self) -> list[Ranges | IndexRange]:
        """An index of few records is cut here, so that long ones are shared out; of a larger one, each task cuts its own lines."""
        files = listed(self.options["index"]) if "index" in self.options else []
        if sum(size for _, size in files) > int(self.options.get("planbytes", PLAN_BYTES)):
            step = int(self.options.get("indexbytes", INDEX_BYTES))
            return [IndexRange(file, k, min(step, size - k), size) for file, size in files for k in range(0, size, step)]
        most, out, held = int(self.options.get("partitionbytes", PARTITION_BYTES)), [], 0
        for entry in sorted(self.entries(), key=lambda e: (e[0], e[3])):
            for part in self.cut(entry):
                if not out or held + part[2] > most:
                    out.append(Ranges([]))
                    held = 0
                out[-1].parts.append(part)
                held += part[2]
        return out or [Ranges([])]

    def parts(self, partition: Ranges | IndexRange) -> Iterator[tuple]:
        if isinstance(partition, Ranges):
            yield from partition.parts
            return
        lines = (line.decode() for _, line in _lines(partition.file, partition.first, partition.size, partition.whole))
        for row in csv.reader((x for x in lines if x), delimiter="\t"):
            if found := self.entry(row):
                yield from self.cut(found)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        path = handle = None
        rows, held = [], 0
        for file, offset, size, name, base in self.parts(partition):
            if file != path:
                if handle:
                    handle.close()
                store, place = located(file)
                path, handle = file, store.open_input_file(place)
            data = handle.read_at(size, offset)
            rows.append((file, name, base, data.translate(None, b"\r\n\t ").decode(), len(data)))
            held += len(data)
            if len(rows) == BATCH or held >= PIECE_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), _PIECES.types)], schema=_PIECES)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), _PIECES.types)], schema=_PIECES)
        if handle:
            handle.close()


_PIECES = pa.schema([("file", pa.string()), ("name", pa.string()), ("start", pa.int64()), ("seq", pa.string()), ("bytes_read", pa.int64())])


class FastaRanges(DataSource):
    """Pieces of indexed sequences.  Options: ``index`` (tab-separated: name, bases, first byte, bases and bytes a line; a first column names the
    file if there are several), ``path`` of the only file otherwise."""

    @classmethod
    def name(cls) -> str:
        return "fasta_ranges"

    def schema(self) -> str:
        return "file string, name string, start long, seq string, bytes_read long"

    def reader(self, schema) -> FastaReader:
        return FastaReader(self.options)


_SAM = pa.schema([
    ("aln_idx", pa.int64()), ("qname", pa.string()), ("flag", pa.int32()), ("rname", pa.string()), ("pos", pa.int32()), ("mapq", pa.int32()), ("cigar", pa.string()),
    ("mate", pa.string()), ("pnext", pa.int32()), ("tlen", pa.int32()), ("seq", pa.string()), ("qual", pa.string()), ("opt", pa.list_(pa.string())),
])
#: Bits of the ordinal that hold a file's byte offsets; the bits above number the files.
OFFSET_BITS = 44


class SamReader(Pushing):
    columns = ("flag", "rname", "pos", "mapq")

    def partitions(self) -> list[Ranges]:
        most, out, held = int(self.options.get("partitionbytes", PARTITION_BYTES)), [], 0
        for number, (file, size) in enumerate(listed(self.options["path"])):
            if size >> OFFSET_BITS:
                raise ValueError(f"{file} has more than 2**{OFFSET_BITS} bytes")
            for k in range(0, size, most):
                part = min(most, size - k)
                if not out or held + part > most:
                    out.append(Ranges([]))
                    held = 0
                out[-1].parts.append((file, k, part, number, size))
                held += part
        return out or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        needed, barred = (int(self.options.get(k, 0)) for k in ("requiredflags", "excludedflags"))
        rows = []
        for file, first, size, number, whole in partition.parts:
            for at, line in _lines(file, first, size, whole):
                if line[:1] == b"@" or not line:
                    continue
                qname, flag, rname, pos, mapq, rest = line.split(b"\t", 5)
                flag, name, pos, mapq = int(flag), rname.decode(), int(pos) - 1, int(mapq)
                if flag & needed != needed or flag & barred or not self.passes(flag=flag, rname=name, pos=pos, mapq=mapq):
                    continue
                cigar, mate, pnext, tlen, seq, qual, *opt = rest.decode().split("\t")
                rows.append(((number << OFFSET_BITS) + at, qname.decode(), flag, name, pos, mapq, cigar, name if mate == "=" else mate, int(pnext) - 1, int(tlen), seq, qual, opt))
                if len(rows) == BATCH:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), _SAM.types)], schema=_SAM)


def _lines(file: str, first: int, size: int, whole: int, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(byte offset, line) of the lines that begin in a range."""
    store, name = located(file)
    place = at = max(first - 1, 0)  # what goes on from the byte before the range is the end of another's line
    held, other = b"", first > 0
    with store.open_input_file(name) as f:
        while at < first + size:
            data = f.read_at(chunk, place)
            place += len(data)
            lines = (held + data).split(b"\n")
            held = lines.pop() if place < whole else b""
            for line in lines:
                if at >= first + size:
                    return
                if not other:
                    yield at, line.removesuffix(b"\r")
                other, at = False, at + len(line) + 1
            if place >= whole:
                return


class SamRanges(DataSource):
    """Alignment lines of a SAM file or a folder of such.  Options: ``path``; ``requiredFlags`` and ``excludedFlags``, bits of which all or none are set."""

    @classmethod
    def name(cls) -> str:
        return "sam_ranges"

    def schema(self) -> str:
        return "aln_idx long, qname string, flag int, rname string, pos int, mapq int, cigar string, mate string, pnext int, tlen int, seq string, qual string, opt array<string>"

    def reader(self, schema) -> SamReader:
        return SamReader(self.options)
