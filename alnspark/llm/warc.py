"""WARC archives with revisit records.

Headers (id, digest, size) are grouped by payload digest; the smallest page of a digest keeps its response record
and the others become revisit records that refer to it.  Payloads stay where they are while the repeated digests
are few enough to hand out.  Beyond that a bit table of bounded size tells which payloads may be repeated: only
these move, dealt by digest and page, and revisit records are made of headers alone.

The archives are ordinary ``.warc.gz`` files: a ``warcinfo`` record, then the records with fresh headers, each a gzip member of its own.  A data
source writes them through pyarrow, hidden until the job commits, so a task that runs twice leaves one file.  They are read back as a
stream: the text reader cuts at the four bytes that end a record, and records
are put together again by their Content-Length, one at a time.

Defined cases: a null html is an empty payload; payloads under ``min_bytes`` are always responses; a null
page_id never becomes the original while the digest has another; pages with one page_id and equal
payloads are all responses when that page_id is the smallest; a null url gives no target header; line
breaks in a url are percent-encoded; an empty table gives no records; a record must fit in a task's memory.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from alnspark.llm.common import bit_table, in_bits, shared_path, stored
from alnspark.sources.ranges import located

END = "\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Compressed bytes of a file, about; and repeated digests (of some 100 bytes) that are handed to every task.
FILE_BYTES, BROADCAST_ROWS = 256 << 20, 1_000_000


def resolve(pages: DataFrame, min_bytes: int = 100) -> DataFrame:
    """(page_id, url, payload, payload_bytes, digest, refers_to); ``refers_to`` is set for revisits, whose payload may be null."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).select(
        "*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2(F.encode("payload", "utf-8"), 256).alias("digest")
    )
    large = F.col("payload_bytes") >= min_bytes
    first = rows.where(large).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = stored(first, "warc-firsts")
    other = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    refers = F.when(other, F.col("first")).alias("refers_to")
    names = ["page_id", "url", "payload", "payload_bytes", "digest", "refers_to"]
    if first.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(first), "digest", "left").select(*names[:-1], refers)
    table, bits = bit_table(first.select(F.xxhash64("digest").alias("mark")), "mark")
    shared = pages.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def may_repeat(marks: pd.Series) -> pd.Series:
        return pd.Series(in_bits(shared.value, bits, marks.to_numpy().view(np.uint64)))

    marked = rows.withColumn("repeats", large & may_repeat(F.xxhash64("digest")))
    alone, maybe = marked.where("NOT repeats").drop("repeats"), marked.where("repeats").drop("repeats")
    revisits = maybe.drop("payload").join(first, "digest").select("*", refers).where("refers_to IS NOT NULL")
    x, y = maybe.alias("x"), revisits.select("digest", "page_id").alias("y")
    kept = x.join(y, (F.col("x.digest") == F.col("y.digest")) & F.col("x.page_id").eqNullSafe(F.col("y.page_id")), "left_anti")
    none = F.lit(None).cast("long").alias("refers_to")
    return alone.select(*names[:-1], none).union(kept.select(*names[:-1], none)).union(revisits.withColumn("payload", F.lit(None).cast("string")).select(*names))


def _uuid(*parts) -> F.Column:
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def records(resolved: DataFrame) -> DataFrame:
    """One column ``value``: the text of each WARC record without its closing line breaks."""
    revisit = F.col("refers_to").isNotNull()
    block = F.concat(F.lit(HTTP), F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(END))
    optional = lambda name, value: F.coalesce(field(name, value), F.lit(""))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    head = F.concat(
        F.lit(f"WARC/1.1{END}"),
        field("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        field("WARC-Record-ID", _uuid(F.col("page_id"), F.col("digest"))),
        field("WARC-Date", F.lit(DATE)),
        optional("WARC-Target-URI", url),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        optional("X-Page-Id", F.col("page_id")),
        field("X-Payload-Bytes", F.col("payload_bytes")),
        F.when(revisit, F.concat(
            field("WARC-Profile", F.lit(PROFILE)), field("WARC-Refers-To", _uuid(F.col("refers_to"), F.col("digest"))), field("X-Refers-To-Page", F.col("refers_to"))
        )).otherwise(F.lit("")),
        field("Content-Type", F.lit("application/http; msgtype=response")),
        field("Content-Length", F.octet_length(block)),
        F.lit(END),
    )
    return resolved.select(F.concat(head, block).alias("value"))


class _Writer(DataSourceArrowWriter):
    """Archives of about ``filebytes`` compressed bytes below ``path``, from rows with a record's text."""

    def __init__(self, options):
        self.path, self.most = options["path"].rstrip("/"), int(options["filebytes"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, folder = located(self.path)
        made, out, size = [], None, 0
        try:
            for batch in iterator:
                for value in batch.column("value"):
                    if out is None or size > self.most:
                        if out:
                            out.close()
                        made.append(f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz")
                        out, size = store.open_output_stream(f"{folder}/_{made[-1]}", compression=None), 0
                        out.write(member(about(made[-1])))
                    data = member(value.as_py())
                    out.write(data)
                    size += len(data)
        finally:
            if out:
                out.close()
        return Made(made)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder = located(self.path)
        for name in (n for m in messages if m for n in m.files):
            store.move(f"{folder}/_{name}", f"{folder}/{name}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder = located(self.path)
        for name in (n for m in messages if m for n in m.files):
            store.delete_file(f"{folder}/_{name}")


@dataclass
class Made(WriterCommitMessage):
    files: list[str]


class Archives(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc_archives"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options)


def about(name: str) -> str:
    """The record that opens an archive."""
    block = f"format: WARC File Format 1.1{END}"
    head = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields"), ("Content-Length", len(block))]
    return f"WARC/1.1{END}" + "".join(f"{k}: {v}{END}" for k, v in head) + END + block


def member(record: str) -> bytes:
    return gzip.compress((record + END * 2).encode(), 6, mtime=0)


def write(resolved: DataFrame, path: str) -> None:
    spark = resolved.sparkSession
    spark.dataSource.register(Archives)
    store, folder = located(path)
    store.create_dir(folder)
    records(resolved).write.format("warc_archives").mode("append").option("fileBytes", FILE_BYTES).save(path)


def parse(data: bytearray) -> tuple[dict[str, str], bytes] | int:
    """The first record's (headers, block), taken from ``data``; or how many bytes it needs at least."""
    stop = data.find(b"\r\n\r\n")
    if stop < 0:
        return len(data) + 1
    head = dict(x.split(": ", 1) for x in data[:stop].decode().split(END)[1:])
    end = stop + 4 + int(head["Content-Length"])
    if len(data) < end + 4:
        return end + 4
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("a record does not end where its Content-Length says")
    block = bytes(data[stop + 4 : end])
    del data[: end + 4]
    return head, block


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Per record of the archives below ``path``: page_id, payload_bytes, payload_digest, record_type, refers_to, url and,
    with ``payloads``, payload."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload string"
    names = [x.split()[0] for x in schema.split(", ")]

    def row(head: dict[str, str], block: bytes) -> tuple:
        page, revisit = head.get("X-Page-Id"), head["WARC-Type"] == "revisit"
        payload = block.split(b"\r\n\r\n", 1)[1]
        return (
            None if page is None else int(page), int(head["X-Payload-Bytes"]) if revisit else len(payload),
            head["WARC-Payload-Digest"].removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest(),
            head["WARC-Type"], int(head["X-Refers-To-Page"]) if revisit else None, head.get("WARC-Target-URI"), payload.decode() if payloads and not revisit else None,
        )

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, need, file = bytearray(), 0, None
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            rows, size = [], 0
            for name, part in zip(batch.column("file").to_pylist(), batch.column("value").cast(pa.binary()).to_pylist()):
                if name != file:  # what is left of a file are line breaks
                    if held.strip():
                        raise ValueError("a file ends within a record")
                    held, need, file = bytearray(), 0, name
                held += part + b"\r\n\r\n"
                while len(held) >= need and held.strip(b"\r\n"):
                    found = parse(held)
                    if isinstance(found, int):
                        need = found
                        break
                    need = 0
                    if found[0]["WARC-Type"] == "warcinfo":
                        continue
                    rows.append(row(*found))
                    size += len(found[1])
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)
        if held.strip():
            raise ValueError("a file ends within a record")

    lines = spark.read.schema("value string").option("lineSep", END * 2).text(path).select("value", F.xxhash64("_metadata.file_path").alias("file"))
    return lines.mapInArrow(assemble, schema)


def query(spark: SparkSession, pages: DataFrame) -> DataFrame:
    path = shared_path(spark, "warc")
    write(resolve(pages), path)
    return read(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
h AS (SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM h)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM m
"""
