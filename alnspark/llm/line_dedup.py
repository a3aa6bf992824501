"""Line deduplication: sharded cuckoo filters in front of exact reference-count tables.

A ``LineIndex`` lives in one folder and can be opened again.  Its exact side is a log of references
(key, did, delta), one file set a batch: inserting documents appends +1 for each key and document, deleting
them appends -1, so every step can be taken back; a table of counts sums the log.  Its fast side is one cuckoo
filter a shard of the keys that enough documents hold.  A batch recounts the keys that it touches; those that
now pass the threshold are inserted into their shard's filter and those that fall below it are deleted from it.
The filters have no false negatives: a line that they do not know is kept at once, and only the others are
joined with the exact counts.  Small filters go to every task; large ones are dealt by shard, and the lines to them.

Defined cases: a null text is an empty one (one empty line); null ids count as one document that comes
before all others; rows with one id are one document for counting, and each gets its row; a line's key is
the line stripped of ASCII space with A-Z lower-cased; a key's lines in the document that keeps it all stay;
references that are deleted more often than inserted count as none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alnspark.llm.common import SPACE, finished, id_or_null, keyed, row_key, shared_path, slices
from alnspark.llm.wordhash import group_starts

SLOTS, KICKS = 4, 500
SPACE_BYTES = SPACE.encode()
#: Only the number of shards follows from the first; beyond the second, filters are dealt by shard.
KEYS_PER_SHARD, BROADCAST_BYTES = 200_000, 32 << 20
#: Lines of a shard that share a copy of its filter.
LINES_PER_COPY = 1_000_000
REFS, COUNTS, FILTERS = "key binary, did long, delta long", "key binary, n_docs long, last_doc long", "shard int, buckets long, cells binary"


class Cuckoo:
    """A cuckoo filter with 16-bit fingerprints over keys of two 64-bit words."""

    def __init__(self, buckets: int, cells: bytes | None = None):
        self.buckets = buckets
        self.cells = np.zeros((buckets, SLOTS), np.uint16) if cells is None else np.frombuffer(cells, np.uint16).reshape(buckets, SLOTS).copy()

    @classmethod
    def of(cls, words: np.ndarray) -> Cuckoo:
        """A filter that holds all the rows of ``words``; grown until they fit."""
        buckets = 1 << max(4, int(np.ceil(np.log2(max(1, len(words)) / SLOTS / 0.85))))
        while not (made := cls(buckets)).insert_all(words):
            buckets *= 2
        return made

    def places(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = (words[:, 1] & np.uint64(0xFFFF)).astype(np.uint16)
        mark[mark == 0] = 1
        first = (words[:, 0] & np.uint64(self.buckets - 1)).astype(np.int64)
        return mark, first, self.other(first, mark)

    def other(self, place: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return place ^ ((mark.astype(np.int64) * 0x5BD1E995 >> 3) & (self.buckets - 1))

    def insert_all(self, words: np.ndarray) -> bool:
        """Insert the rows of ``words``; False when the filter is too full for one of them."""
        mark, *both = self.places(words)
        left = np.arange(len(words))
        for place in both:
            left = left[~self._fill(place[left], mark[left])]
        return all(self._kick(int(both[0][i]), int(mark[i])) for i in left)

    def _fill(self, place: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Put marks into free slots of their buckets as long as there are any; which ones found room."""
        order = np.argsort(place, kind="stable")
        bucket = place[order]
        first = group_starts(bucket)
        rank = np.arange(len(bucket)) - np.repeat(first, np.diff(np.append(first, len(bucket))))
        taken = self.cells[bucket] != 0
        fits = rank < SLOTS - taken.sum(axis=1)
        slot = np.argsort(taken[fits], axis=1, kind="stable")  # the free ones first
        self.cells[bucket[fits], slot[np.arange(len(slot)), rank[fits]]] = mark[order[fits]]
        placed = np.zeros(len(place), bool)
        placed[order[fits]] = True
        return placed

    def _kick(self, place: int, mark: int) -> bool:
        for kick in range(KICKS):  # deterministic victim, so that a rebuilt filter is the same
            free = np.flatnonzero(self.cells[place] == 0)
            if len(free):
                self.cells[place, free[0]] = mark
                return True
            slot = (kick + mark) % SLOTS
            mark, self.cells[place, slot] = int(self.cells[place, slot]), mark
            place = int(self.other(np.array([place]), np.array([mark]))[0])
        return False

    def delete(self, word: np.ndarray) -> bool:
        """Take out a key that was inserted."""
        marks, a, b = self.places(word[None, :])
        for place in (int(a[0]), int(b[0])):
            slots = np.flatnonzero(self.cells[place] == marks[0])
            if len(slots):
                self.cells[place, slots[0]] = 0
                return True
        return False

    def holds(self, words: np.ndarray) -> np.ndarray:
        mark, a, b = self.places(words)
        return ((self.cells[a] == mark[:, None]) | (self.cells[b] == mark[:, None])).any(axis=1)


def _words(keys) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, keys)), np.uint64).reshape(-1, 2)


def long_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(did, th, pos, key): the lines of keyed documents whose key has ``min_chars`` code points or more, by 128 bits."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch)):
            row, at, keys = [], [], []
            for i, text in enumerate(part.column("text").cast(pa.binary()).to_pylist()):
                for pos, line in enumerate(text.split(b"\n")):
                    key = line.strip(SPACE_BYTES)
                    if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars):
                        row.append(i)
                        at.append(pos)
                        keys.append(hashlib.md5(key.lower(), usedforsecurity=False).digest())  # bytes.lower changes A-Z only
            row = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("did").take(row), part.column("th").take(row), pa.array(at, pa.int32()), pa.array(keys, pa.binary())], ["did", "th", "pos", "key"])

    return docs.mapInArrow(cut, "did long, th long, pos int, key binary")


def _built(pdf: pd.DataFrame) -> pd.DataFrame:
    made = Cuckoo.of(_words(sorted(pdf["key"])))
    return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "buckets": [made.buckets], "cells": [made.cells.tobytes()]})


def _updated(held: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
    """A shard's filter after deletions and insertions; without cells if it is too small for them."""
    shard = int((changes if len(changes) else held)["shard"].iloc[0])
    new, old = (_words(sorted(changes["key"][changes["enters"] == x])) for x in (True, False))
    if not len(held):
        made = Cuckoo.of(new)
        return pd.DataFrame({"shard": [shard], "buckets": [made.buckets], "cells": [made.cells.tobytes()]})
    made = Cuckoo(int(held["buckets"].iloc[0]), held["cells"].iloc[0])
    for word in old:
        made.delete(word)
    fits = made.insert_all(new)
    return pd.DataFrame({"shard": [shard], "buckets": [made.buckets], "cells": [made.cells.tobytes() if fits else None]})


class LineIndex:
    """Reversible, incremental line deduplication in ``path``; an index that lies there already is opened again."""

    def __init__(self, spark: SparkSession, path: str, min_chars: int = 20, min_docs: int = 3, shards: int | None = None):
        self.spark, self.path, self.min_chars, self.min_docs, self.shards = spark, path, min_chars, min_docs, shards
        self.batches = finished(spark, f"{path}/refs")
        made = finished(spark, f"{path}/filters")
        if len(made) < len(self.batches):  # a batch that was cut short before its filters were written never counted
            self.batches = self.batches[: len(made)]
        if made:
            self.shards = int(made[-1].rsplit("-", 1)[1])

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        self._append(docs, id_col, text_col, 1)

    def delete(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Take back the references of documents that were inserted, given with their texts."""
        self._append(docs, id_col, text_col, -1)

    def _append(self, docs: DataFrame, id_col: str, text_col: str, delta: int) -> None:
        n = len(self.batches)
        refs = long_lines(keyed(docs, id_col, text_col), self.min_chars).groupBy("key", "did").agg((F.count("*") * delta).alias("delta"))
        out = f"{self.path}/refs/{n:05d}"
        refs.write.mode("overwrite").parquet(out)
        self.batches.append(out)
        if not n:
            self._write_counts(self._live(), 0)
            held = self.counts()
            self.shards = self.shards or max(1, -(-held.count() // KEYS_PER_SHARD))
            self._write_filters(self._sharded(held).groupBy("shard").applyInPandas(_built, FILTERS), 0)
            return
        keys = self._refs([out]).select("key").distinct()
        touched = self._live(keys)
        before = self.counts(n - 1)
        self._write_counts(before.join(keys, "key", "left_anti").union(touched), n)
        size = self.counts(n).count()
        if size > 2 * self.shards * KEYS_PER_SHARD:  # an index that began small gets more shards, and all filters anew
            self.shards = -(-size // KEYS_PER_SHARD)
            self._write_filters(self._sharded(self.counts(n)).groupBy("shard").applyInPandas(_built, FILTERS), n)
            return
        was, now = before.join(keys, "key", "left_semi").select("key"), touched.select("key")
        changes = now.join(was, "key", "left_anti").withColumn("enters", F.lit(True)).union(was.join(now, "key", "left_anti").withColumn("enters", F.lit(False)))
        made = self.filters(n - 1).groupBy("shard").cogroup(self._sharded(changes).groupBy("shard")).applyInPandas(_updated, FILTERS)
        tried = f"{self.path}/tried/{n:05d}"
        made.write.mode("overwrite").parquet(tried)
        made = self.spark.read.schema(FILTERS).parquet(tried)
        outgrown = made.where("cells IS NULL").select("shard")
        rebuilt = self._sharded(self.counts(n)).join(outgrown, "shard").groupBy("shard").applyInPandas(_built, FILTERS)
        self._write_filters(made.where("cells IS NOT NULL").union(rebuilt), n)

    def _refs(self, batches: list[str]) -> DataFrame:
        return self.spark.read.schema(REFS).parquet(*batches)

    def _live(self, keys: DataFrame | None = None) -> DataFrame:
        """(key, n_docs, last_doc) of the keys (of ``keys``) that ``min_docs`` live documents hold."""
        refs = self._refs(self.batches)
        if keys is not None:
            refs = refs.join(keys, "key", "left_semi")
        if len(self.batches) > 1:
            refs = refs.groupBy("key", "did").agg(F.sum("delta").alias("delta"))
        live = refs.where("delta > 0").groupBy("key").agg(F.count("*").alias("n_docs"), F.max("did").alias("last_doc"))
        return live.where(F.col("n_docs") >= self.min_docs)

    def _write_counts(self, counts: DataFrame, n: int) -> None:
        counts.write.mode("overwrite").parquet(f"{self.path}/counts/{n:05d}")

    def _write_filters(self, filters: DataFrame, n: int) -> None:
        filters.write.mode("overwrite").parquet(f"{self.path}/filters/{n:05d}-{self.shards}")

    def counts(self, n: int | None = None) -> DataFrame:
        """(key, n_docs, last_doc) of the keys that ``min_docs`` live documents hold."""
        return self.spark.read.schema(COUNTS).parquet(f"{self.path}/counts/{len(self.batches) - 1 if n is None else n:05d}")

    def filters(self, n: int | None = None) -> DataFrame:
        """(shard, buckets, cells): the cuckoo filter of each shard that has keys."""
        return self.spark.read.schema(FILTERS).parquet(f"{self.path}/filters/{len(self.batches) - 1 if n is None else n:05d}-{self.shards}")

    def _sharded(self, keys: DataFrame) -> DataFrame:
        return keys.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int"))

    def suspects(self, lines: DataFrame) -> DataFrame:
        """The lines that the filters know."""
        filters, names = self.filters(), lines.columns
        size = filters.agg(F.sum(F.octet_length("cells"))).first()[0] or 0
        if size > BROADCAST_BYTES:
            return self._dealt(lines, filters).select(*names)
        blobs = [tuple(r) for r in filters.collect()]  # bounded by BROADCAST_BYTES

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ready = {s: Cuckoo(n, bytes(c)) for s, n, c in blobs}
            for batch in batches:
                keep = np.zeros(batch.num_rows, bool)
                words, shard = _words(batch.column("key").to_pylist()), batch.column("shard").to_numpy()
                for s in np.unique(shard).tolist():
                    if s in ready:
                        at = np.flatnonzero(shard == s)
                        keep[at] = ready[s].holds(words[at])
                yield batch.filter(pa.array(keep))

        rows = self._sharded(lines)
        return rows.mapInArrow(probe, rows.schema).select(*names)

    def _dealt(self, lines: DataFrame, filters: DataFrame) -> DataFrame:
        """The same where filters are too large to hand out: lines and filters are dealt by shard, and a shard with
        many lines has several copies of its filter.  A copy comes ahead of its lines, which stream past it."""
        copies = self._sharded(self._refs(self.batches)).groupBy("shard").agg(F.ceil(F.count("*") / LINES_PER_COPY).alias("copies"))
        copies = F.broadcast(copies)  # a row a shard
        none = F.lit(None)
        one = F.coalesce("copies", F.lit(1).cast("long"))
        rows = self._sharded(lines).join(copies, "shard", "left").withColumn("copy", F.pmod(F.xxhash64("did", "th", "pos"), one))
        rows = rows.select("shard", "copy", "did", "th", "pos", "key", none.cast("long").alias("buckets"), none.cast("binary").alias("cells"))
        every = filters.join(copies, "shard", "left").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), one - 1)))
        heads = every.select("shard", "copy", none.cast("long").alias("did"), none.cast("long").alias("th"), none.cast("int").alias("pos"), none.cast("binary").alias("key"), "buckets", "cells")
        both = rows.union(heads).repartition("shard", "copy").sortWithinPartitions("shard", "copy", F.col("cells").isNull())

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, current = None, None
            for batch in batches:
                place = np.stack([batch.column("shard").to_numpy(), batch.column("copy").to_numpy()], 1)
                is_head = np.asarray(batch.column("cells").is_valid())
                new = np.ones(len(place), bool)
                new[1:] = (place[1:] != place[:-1]).any(axis=1)
                starts = np.flatnonzero(new | is_head)
                for lo, hi in zip(starts, np.append(starts[1:], len(place))):
                    if is_head[lo]:
                        at, current = tuple(place[lo]), Cuckoo(batch.column("buckets")[lo].as_py(), batch.column("cells")[lo].as_py())
                        lo += 1
                    if lo < hi and at == tuple(place[lo]):  # else the shard has no filter
                        group = batch.slice(lo, hi - lo)
                        yield group.filter(pa.array(current.holds(_words(group.column("key").to_pylist())))).select(["did", "th", "pos", "key"])

        return both.mapInArrow(probe, "did long, th long, pos int, key binary")

    def drops(self, docs: DataFrame) -> DataFrame:
        """(did, th, drop): for keyed documents, the numbers of the lines that go."""
        lines = self.suspects(long_lines(docs, self.min_chars))
        gone = lines.join(self.counts(), "key").where(F.col("did") != F.col("last_doc"))
        return gone.select("did", "th", "pos").distinct().groupBy("did", "th").agg(F.collect_list("pos").alias("drop"))

    def apply(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
        """Per row of ``docs``: did, n_lines, n_dropped, kept (the text that stays) and, with ``carry``, a
        struct ``row`` of the row's other columns."""
        did, th = row_key(id_col, text_col)
        text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
        others = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row")] if carry and len(docs.columns) > 1 else []
        own = docs.select(did.alias("did"), th.alias("th"), text.alias("text"), *others)
        both = own.join(self.drops(keyed(docs, id_col, text_col)), ["did", "th"], "left")

        @F.pandas_udf("n_lines long, n_dropped long, kept string")
        def rewrite(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            for texts, drops in parts:
                for lo in range(0, len(texts), 500):
                    rows = []
                    for text, drop in zip(texts.iloc[lo : lo + 500], drops.iloc[lo : lo + 500]):
                        lines = text.split("\n")
                        gone = set() if drop is None else set(drop)
                        rows.append((len(lines), len(gone), "\n".join([x for i, x in enumerate(lines) if i not in gone]) if gone else text))
                    yield pd.DataFrame(rows, columns=["n_lines", "n_dropped", "kept"])

        made = both.withColumn("made", rewrite("text", "drop"))
        return made.select("did", "made.*", *(["row"] if others else []))


def index_of(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> LineIndex:
    index = LineIndex(docs.sparkSession, shared_path(docs.sparkSession, "line-index"), min_chars, min_docs)
    index.insert(docs, id_col, text_col)
    return index


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Index ``docs`` as one batch and drop the lines that ``min_docs`` documents share from all but the last."""
    return index_of(docs, id_col, text_col, min_chars, min_docs).apply(docs, id_col, text_col)


def rewrite_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with the lines dropped and, where there is such a column, n_chars counted anew.  A text that
    loses all it had goes; texts that lose nothing keep their rows as they are."""
    out = index_of(docs, id_col, text_col, min_chars, min_docs).apply(docs, id_col, text_col, carry=True)
    out = out.where((F.col("n_dropped") == 0) | (F.length(F.btrim("kept", F.lit(SPACE))) > 0))
    value = {text_col: F.col("kept"), "n_chars": F.length("kept").cast("long")}
    # a null text that lost nothing comes back as an empty one
    return out.select(*[(value[c].cast(docs.schema[c].dataType) if c in value else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return dedup_lines(docs).select(id_or_null().alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, -9223372036854775808) AS did,
    string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents),
l AS (SELECT r, doc_id, did, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(did) AS last_doc FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT did) >= 3),
m AS (SELECT k.*, c.key IS NOT NULL AND k.did <> c.last_doc AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""
