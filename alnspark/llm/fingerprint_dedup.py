"""Substring deduplication with a log-structured fingerprint index.

The fingerprint of a window of words is the least hash of the short word sequences in it.  Neighbouring
windows mostly share one, so a document is a row of stretches (fingerprint, digest of the words covered).
Each batch adds an immutable run: its stretches counted by fingerprint and digest, in buckets and sorted by
fingerprint.  The new run is merge-joined with the historical runs, bucket by bucket and without moving them, which
tells the fingerprints that now occur more than once; only their stretches go on.  Where a
fingerprint's stretches are all alike they repeat as a whole; otherwise their windows are verified one by one
by 128 bits over all words.  Runs are merged into one when they become many.  An index that lies in its folder
already is opened again.

Counts and digests come ready summed from each batch, so a passage in a third of all documents is one row of a
run, and joins on fingerprints have no further grouping above them that would keep Spark from splitting.

Defined cases: null or empty texts have no words; texts shorter than a window keep all; windows that occur
twice in one text are repeated; each of several equal rows is a document; null ids are documents like others.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alnspark.llm.common import finished, id_or_null, keyed, shared_path, slices, stored
from alnspark.llm.wordhash import NOT_SPACE, U, Words, chunks, mix, powers, running_min

WINDOW, GRAM, RUNS = 35, 8, 4
TEXTS = "did long, th long, size long, n long, text string"
BROADCAST_ROWS = 2_000_000
#: Rows of a run's bucket (34 bytes each), which one task sorts and merges.
BUCKET_ROWS = 4_000_000


def _stretches(words: Words, window: int, gram: int):
    """(text number, first window, windows, fingerprint, digest, whether a window may occur twice among these texts)."""
    valid, (whole,) = words.windows(window, 1)
    if not valid.any():
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(U), none.astype(U), none.astype(bool)
    least = running_min(words.windows(gram, 1)[1][0], window - gram + 1)
    n = len(valid)
    edge = np.ones(n + 1, bool)
    edge[1:n] = (least[1:] != least[:-1]) | (valid[1:] != valid[:-1]) | (words.doc[1:] != words.doc[:-1])
    edge = np.flatnonzero(edge)
    start, stop = edge[:-1], edge[1:]
    keep = valid[start]
    start, stop = start[keep], stop[keep]
    sums = np.zeros(n + 1, U)
    np.cumsum(whole * powers(0, n), out=sums[1:])  # of windows: long rows of words have collisions that these lack
    digest = mix((sums[stop] - sums[start]) * powers(0, n + 1, True)[start] + (stop - start).astype(U))
    held = np.sort(whole[valid])
    twice = np.unique(held[1:][held[1:] == held[:-1]])
    again = np.zeros(n + 1, np.int64)
    if len(twice):
        again[1:] = np.cumsum(valid & (twice[np.minimum(np.searchsorted(twice, whole), len(twice) - 1)] == whole))
    doc = words.doc[start]
    return doc, start - words.first[doc], stop - start, least[start], digest, again[stop] > again[start]


ENTRIES = "did long, th long, size long, start int, windows int, print long, digest long, n long, twice boolean"


def _few(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df``, handed to every task while it has few rows (of some 40 bytes); a shuffled join's side beyond that."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def _sized(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return keyed(docs, id_col, text_col).withColumn("size", F.octet_length("text").cast("long"))


def entries(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The stretches of documents (did, th, size, n, text), of which each stands for ``n`` equal texts."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            did, th, size, n = (pdf[c].to_numpy() for c in ("did", "th", "size", "n"))
            for begin, texts in chunks(pdf["text"]):
                doc, start, windows, prints, digest, twice = _stretches(Words(texts, NOT_SPACE, False, streams=1), window, gram)
                at = begin + doc
                yield pd.DataFrame({"did": did[at], "th": th[at], "size": size[at], "n": n[at], "start": start.astype(np.int32), "windows": windows.astype(np.int32), "print": prints.view(np.int64), "digest": digest.view(np.int64), "twice": twice})

    return docs.mapInPandas(cut, ENTRIES)


RUN = "print long, digest long, n long, twice boolean"


class FingerprintIndex:
    """Batches of documents in ``path``: their texts and stretches, sorted runs of fingerprint counts, and what each found repeated."""

    def __init__(self, spark: SparkSession, path: str, window: int = WINDOW, gram: int = GRAM, buckets: int | None = None):
        self.spark, self.path, self.window, self.gram = spark, path, window, gram
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.batches = len(finished(spark, f"{path}/repeats"))
        self.runs: list[tuple[int, int, str]] = []  # first and last batch, table
        # the widest of the finished runs; merged ones cover those that they were made of
        for name in sorted((x.rsplit("/", 1)[1] for x in finished(spark, f"{path}/runs")), key=lambda x: (x[:5], -int(x[6:11]))):
            first, last, n = int(name[:5]), int(name[6:11]), int(name[12:])
            if first == (self.runs[-1][1] + 1 if self.runs else 0) and last < self.batches:
                self.buckets = n
                self.runs.append((first, last, self._table(name, create=True)))

    def _table(self, name: str, create: bool = False) -> str:
        table = f"fingerprint_run_{uuid.uuid4().hex}"
        if create:
            self.spark.sql(f"CREATE TABLE {table} ({RUN}) USING parquet CLUSTERED BY (print) SORTED BY (print) INTO {self.buckets} BUCKETS LOCATION '{self.path}/runs/{name}'")
        return table

    def _batch(self, kind: str, schema: str) -> DataFrame:
        """What all batches wrote of a kind."""
        places = [f"{self.path}/{kind}/{i:05d}" for i in range(self.batches)]
        return self.spark.read.schema(schema).parquet(*places) if places else self.spark.createDataFrame([], schema)

    def append(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        at = f"{self.batches:05d}"
        own = _sized(docs, id_col, text_col)
        # equal texts lose the same words: the first stands for all
        copies = stored(own.groupBy("th", "size").agg(F.min("did").alias("first"), F.count("*").alias("n")).where("n > 1"), "fingerprint-copies")
        marked = own.join(_few(copies), ["th", "size"], "left").where("first IS NULL OR did = first")
        firsts = marked.select("did", "th", "size", F.coalesce("n", F.lit(1)).alias("n"), "text")
        write = lambda df, kind: df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{kind}/{at}")
        write(firsts, "texts")
        write(entries(self.spark.read.schema(TEXTS).parquet(f"{self.path}/texts/{at}"), self.window, self.gram), "entries")
        new = self._write(self.spark.read.schema(ENTRIES).parquet(f"{self.path}/entries/{at}").select("print", "digest", "n", "twice"), self.batches, self.batches)
        write(self._found(new), "repeats")
        self.runs.append((self.batches, self.batches, new))
        self.batches += 1
        if len(self.runs) > RUNS:
            self.compact()

    def _write(self, rows: DataFrame, first: int, last: int) -> str:
        """A run of counts, in buckets and sorted; its table."""
        counts = rows.groupBy("print", "digest").agg(F.sum("n").alias("n"), F.max("twice").alias("twice"))
        name = f"{first:05d}-{last:05d}-{self.buckets}"
        table = self._table(name)
        dealt = counts.repartition(self.buckets, "print").sortWithinPartitions("print", "digest")
        dealt.write.mode("overwrite").bucketBy(self.buckets, "print").sortBy("print").option("path", f"{self.path}/runs/{name}").option("compression", "zstd").saveAsTable(table)
        return table

    def _prints(self, table: str, i: int) -> DataFrame:
        rows = self.spark.table(table).groupBy("print")
        return rows.agg(F.sum("n").alias(f"n{i}"), F.min("digest").alias(f"lo{i}"), F.max("digest").alias(f"hi{i}"), F.max("twice").alias(f"twice{i}"))

    def _found(self, new: str) -> DataFrame:
        """(print, mixed): fingerprints of the new run that occur more than once by now; mixed where stretches differ or hold a
        window twice.  Runs have the same buckets, so they are merge-joined where they lie."""
        both = self._prints(new, 0)
        for i, (_, _, table) in enumerate(self.runs, 1):
            both = both.join(self._prints(table, i).hint("merge"), "print", "left")
        every = range(len(self.runs) + 1)
        some = lambda name, first: [first, *(F.coalesce(f"{name}{i}", f"{name}0") for i in every)]
        n = sum((F.coalesce(f"n{i}", F.lit(0)) for i in every), F.lit(0))
        lo, hi, twice = F.least(*some("lo", "lo0")), F.greatest(*some("hi", "hi0")), F.greatest(*some("twice", "twice0"))
        return both.where((n > 1) | twice).select("print", ((lo != hi) | twice).alias("mixed"))

    def compact(self) -> None:
        """Merge all runs into one."""
        old = self.runs
        rows = reduce(DataFrame.union, [self.spark.table(t) for _, _, t in old])
        self.buckets = max(self.buckets, -(-rows.count() // BUCKET_ROWS))  # an index that grows gets more buckets
        self.runs = [(old[0][0], old[-1][1], self._write(rows, old[0][0], old[-1][1]))]
        for _, _, table in old:
            self.spark.sql(f"DROP TABLE {table}")  # the files stay, for readers of before

    def repeated(self) -> DataFrame:
        """(print, mixed): fingerprints that occur more than once."""
        return self._batch("repeats", "print long, mixed boolean").groupBy("print").agg(F.max("mixed").alias("mixed"))

    def spans(self) -> DataFrame:
        """(th, size, spans): for each text that loses words, its [first word, end) spans in order, apart from each other."""
        width = self.window - 1
        found = stored(self._batch("entries", ENTRIES).drop("twice").join(stored(self.repeated(), "fingerprint-repeated"), "print"), "fingerprint-hits")
        sure = found.where("NOT mixed").select("th", "size", "start", (F.col("start") + F.col("windows") + width).alias("stop"))
        mixed = found.where("mixed")
        kinds = stored(mixed.groupBy("print", "digest").agg(F.sum("n").alias("n"), F.min(F.struct("did", "th", "start", "windows")).alias("at")).select("print", "digest", "n", "at.*"), "fingerprint-kinds")
        good = self._verified(kinds)
        checked = mixed.join(good, ["print", "digest"]).select("th", "size", (F.col("start") + F.col("lo")).alias("start"), (F.col("start") + F.col("hi") + width).alias("stop"))
        every = sure.union(checked).groupBy("th", "size").agg(F.collect_set(F.struct("start", "stop")).alias("found"))

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in (part for batch in batches for part in slices(batch)):
                found = part.column("found")
                size = np.diff(found.offsets.to_numpy())
                pairs = found.flatten()
                start, stop = (pairs.field(c).to_numpy().astype(np.int64) for c in ("start", "stop"))
                text = np.repeat(np.arange(len(size)), size)
                order = np.lexsort((start, text))
                text, start, stop = text[order], start[order], stop[order]
                far = int(stop.max(initial=0)) + 1
                reach = np.maximum.accumulate(text * far + stop)  # texts in order, so it starts anew with each
                new = np.ones(len(text), bool)
                new[1:] = (text[1:] * far + start[1:] > reach[:-1]) | (text[1:] != text[:-1])
                first = np.flatnonzero(new)
                end = reach[np.append(first[1:], len(text)) - 1] - text[first] * far
                spans = pa.StructArray.from_arrays([pa.array(start[first].astype(np.int32)), pa.array(end.astype(np.int32))], ["start", "stop"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(text[first], np.arange(len(size) + 1)).astype(np.int32)), spans)
                yield pa.RecordBatch.from_arrays([part.column("th"), part.column("size"), lists], ["th", "size", "spans"])

        return every.mapInArrow(merge, "th long, size long, spans array<struct<start:int,stop:int>>")

    def _verified(self, kinds: DataFrame) -> DataFrame:
        """(print, digest, lo, hi): the windows lo ... hi - 1 of a kind of stretch that occur more than once.

        Equal windows have equal fingerprints, so these and a hash over all words name a window by 128 bits."""
        window = self.window
        wanted = kinds.groupBy("did", "th").agg(F.collect_list(F.struct("print", "digest", "n", "start", "windows")).alias("kinds"))
        texts = self._batch("texts", TEXTS).select("did", "th", "text").join(_few(wanted, kinds.count()), ["did", "th"])

        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in (part for whole in batches for part in slices(whole)):
                for begin, texts in chunks(pdf["text"]):
                    words = Words(texts, NOT_SPACE, False, streams=1)
                    _, (whole,) = words.windows(window, 1)
                    out = []
                    for i in range(len(texts)):
                        for k in pdf["kinds"].iloc[begin + i]:
                            out.append((k["print"], k["digest"], k["n"], words.first[i] + k["start"], k["windows"]))
                    print_, digest, n, at, size = (np.array([o[j] for o in out], np.int64) for j in range(5))
                    off = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    col = lambda x: np.repeat(x, size)
                    yield pd.DataFrame({"print": col(print_), "digest": col(digest), "n": col(n), "off": off.astype(np.int32), "whole": whole[col(at) + off].view(np.int64)})

        # a repeated row is cut twice, but then its kinds count twice anyway
        rows = stored(texts.select("text", "kinds").mapInPandas(cut, "print long, digest long, n long, off int, whole long"), "fingerprint-windows")
        # written apart: a grouping below a join would keep Spark from splitting a very common window's rows
        many = stored(rows.groupBy("print", "whole").agg(F.sum("n").alias("m")).where("m > 1").drop("m"), "fingerprint-many")
        offs = rows.join(many, ["print", "whole"]).groupBy("print", "digest").agg(F.sort_array(F.collect_set("off")).alias("offs"))

        def stretch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for p, d, offs in zip(pdf["print"], pdf["digest"], pdf["offs"]):
                    offs = np.asarray(offs)
                    cut = np.flatnonzero(np.diff(offs) > 1) + 1
                    out += [(p, d, x[0], x[-1] + 1) for x in np.split(offs, cut)]
                yield pd.DataFrame(out, columns=["print", "digest", "lo", "hi"])

        return offs.mapInPandas(stretch, "print long, digest long, lo int, hi int")

    def apply(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
        """Per row of ``docs`` (appended before): did, n_words, n_removed, kept_sha256 and, with ``texts``, kept
        (the other words joined by spaces)."""
        gone = stored(self.spans(), "fingerprint-spans")
        size = gone.agg(F.sum(F.size("spans"))).first()[0] or 0
        both = _sized(docs, id_col, text_col).join(_few(gone, size), ["th", "size"], "left")

        def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in (part for whole in batches for part in slices(whole)):
                rows = []
                for did, text, spans in zip(pdf["did"], pdf["text"], pdf["spans"]):
                    words = text.encode().split()
                    n = len(words)
                    if spans is not None:
                        at, kept = 0, []
                        for span in spans:
                            kept += words[at : span["start"]]
                            at = span["stop"]
                        words = kept + words[at:]
                    kept = b" ".join(words)
                    rows.append((did, n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode() if texts else None))
                yield pd.DataFrame(rows, columns=["did", "n_words", "n_removed", "kept_sha256", "kept"])

        return both.select("did", "text", "spans").mapInPandas(rewrite, "did long, n_words long, n_removed long, kept_sha256 string, kept string")


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    index = FingerprintIndex(spark, shared_path(spark, "fingerprints"))
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(2))
    for i in range(2):  # the second batch is merge-joined with the first
        index.append(docs.where(part == i))
    index.compact()
    return index.apply(docs, texts=False).select(id_or_null().alias("doc_id"), "n_words", "n_removed", "kept_sha256")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT r, p, array_to_string(w[p:p + 34], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35)),
m AS (SELECT k FROM x GROUP BY k HAVING count(*) > 1),
g AS (SELECT DISTINCT r, unnest(range(p, p + 35)) AS i FROM x JOIN m ON x.k = m.k),
a AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT a.r, count(*) AS n_kept, string_agg(word, ' ' ORDER BY a.i) AS kept FROM a ANTI JOIN g ON a.r = g.r AND a.i = g.i GROUP BY a.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.r = k.r
"""
