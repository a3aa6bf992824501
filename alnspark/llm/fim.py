"""Fill-in-middle transformation by overlapping chunks.

Texts are cut into units (lines) at two random ranks, and the part between the cuts moves to the end.  A unit ends where an
adjacent pair of characters is a newline and another character.  The texts of a batch lie in one buffer, seen as
chunks that share one byte with the next, so that each pair belongs to one chunk; the pairs of all chunks
are tested at once and counted by chunk.  Prefix sums of the counts give each text's number of units and route its two ranks to
the chunks that own them, and only those are scanned again for the place of the cut.  A text is one cell, so
nothing moves between tasks and there is no shuffle.

Newlines are single bytes in UTF-8, so cuts in bytes are cuts between code points.

Defined cases: null texts are empty; empty texts and texts that hold a sentinel stay as they are (form ``plain``);
a null id has no digits; equal rows get equal results; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alnspark.llm.common import slices
from alnspark.llm.wordhash import chunks

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM = 7, 100, 50
CHUNK = 1 << 16
OUT = "n long, form string, prefix_chars long, middle_chars long, output string"


class Units:
    """The units of texts that lie in ``data`` from ``start`` to ``end``, counted by chunks of ``chunk`` pairs of adjacent bytes."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, chunk: int = CHUNK):
        self.start, self.end = start, end
        pairs = np.maximum(end - start - 1, 0)
        many = -(-pairs // chunk)
        first = np.concatenate([[0], np.cumsum(many)])
        owner = np.repeat(np.arange(len(start)), many)
        self.lo = start[owner] + (np.arange(len(owner)) - first[owner]) * chunk
        self.hi = np.minimum(self.lo + chunk, end[owner] - 1)
        self.newline = data == 0x0A  # of a pair's first byte; its second one is in the same text
        edges = np.column_stack([self.lo, self.hi]).ravel()
        count = np.add.reduceat(self.newline, edges, dtype=np.int64)[::2] if len(edges) else np.zeros(0, np.int64)
        self.before = np.concatenate([[0], np.cumsum(count)])
        self.base = self.before[first[:-1]]
        self.n = self.before[first[1:]] - self.base + (end > start)

    def cut(self, rank: np.ndarray) -> np.ndarray:
        """For each text the byte at which its first ``rank`` units end."""
        out = np.where(rank <= 0, self.start, self.end)
        inner = np.flatnonzero((rank > 0) & (rank < self.n))
        wanted = self.base[inner] + rank[inner]
        own = np.searchsorted(self.before, wanted) - 1  # the chunk that holds the boundary
        for i, c, k in zip(inner, own, wanted - self.before[own]):
            out[i] = self.lo[c] + np.flatnonzero(self.newline[self.lo[c] : self.hi[c]])[k - 1] + 1
        return out


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four numbers of 32 bits that a document's id decides."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of each row: its text with the middle moved to the end.

    ``rate`` in a hundred documents change, ``spm`` in a hundred of these with the suffix first (the others: the prefix)."""
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            for begin, texts in chunks(batch.column("text").to_pylist()):
                ids = batch.column("id").slice(begin, len(texts))
                size = np.fromiter(map(len, texts), np.int64, len(texts))
                end = np.cumsum(size)
                units = Units(np.frombuffer(b"".join(texts) + b"\0", np.uint8), end - size, end, chunk)
                h = np.array([draws(i, seed) for i in ids.to_pylist()], np.int64)
                one, two = h[:, 0] % (units.n + 1), h[:, 1] % (units.n + 1)
                a, b = (units.cut(r) - units.start for r in (np.minimum(one, two), np.maximum(one, two)))
                rows = []
                for text, a, b, h3, h4 in zip(texts, a.tolist(), b.tolist(), h[:, 2], h[:, 3]):
                    if not text or any(m in text for m in marks) or h3 % 100 >= rate:
                        rows.append(("plain", None, None, text.decode()))
                        continue
                    prefix, middle, suffix = text[:a].decode(), text[a:b].decode(), text[b:].decode()
                    if h4 % 100 < spm:
                        rows.append(("spm", len(prefix), len(middle), f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"))
                    else:
                        rows.append(("psm", len(prefix), len(middle), f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"))
                form, before, between, output = zip(*rows)
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
                columns = [pa.array(x, kind) for x, kind in zip((form, before, between, output), kinds)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(units.n), *columns], ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return own.mapInArrow(move, f"id long, {OUT}").withColumnRenamed("id", id_col)


def restored(form: Column | str = "form", output: Column | str = "output") -> Column:
    """The text that ``transform`` made ``output`` of: no sentinel is in it, so each occurs once in the output."""
    form, output = (F.col(x) if isinstance(x, str) else x for x in (form, output))
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    digest = lambda c: F.sha2(F.encode(c, "utf-8"), 256)
    out = transform(docs)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored()).alias("restored_sha256"))


_DRAW = "CAST('0x' || substr(h, {at}, 8) AS BIGINT)"
SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u FROM documents),
r AS (SELECT *, len(u) AS n, {_DRAW.format(at=1)} % (len(u) + 1) AS a, {_DRAW.format(at=9)} % (len(u) + 1) AS b FROM d),
f AS (
  SELECT doc_id, text, n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR {_DRAW.format(at=17)} % 100 >= 100 THEN 'plain'
      WHEN {_DRAW.format(at=25)} % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS s FROM r)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM f
"""
