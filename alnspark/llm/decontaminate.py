"""Benchmark decontamination by winnowing.

Of the ``gram``-word hashes in each window the least are fingerprints, so equal windows of a document and of a
benchmark item have equal fingerprints at the same place, whatever surrounds them.  A fingerprint carries the
hashes of the words around it as far as a window can reach.  Fingerprints of documents and items are joined, and
each hit is extended to both sides while the words agree: spans of a window or more are hit.  A bit table of the
benchmark's fingerprints, of bounded size, spares most document fingerprints the join.

Item fingerprints that agree with their surroundings are one row, with the digest of the set of items that hold
it; documents gather these few digests, and item names are looked up once for each different collection.

Defined cases: null texts have no words; items with fewer words than a window are one window of their
own length; items without an id hit words, but are neither counted nor named; rows with one item_id are one
item; equal document rows get equal results; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alnspark.llm.common import bit_table, fresh, id_or_null, in_bits, keyed, row_key, slices, stored
from alnspark.llm.wordhash import ALNUM, Words, chunks, running_max, running_min

WINDOW, GRAM = 10, 5

PRINT = "start int, n int, print long, before array<long>, after array<long>"


class Prints:
    """The fingerprints of some texts for windows of ``n`` words: where they start, their hashes, and the words around.

    A window shorter than a gram is its own fingerprint; its second hash stands in for words around it."""

    def __init__(self, words: Words, n: int, gram: int):
        self.words, self.n, self.gram = words, n, min(n, gram)
        valid, hashes = words.windows(self.gram, 2 if n < gram else 1)
        if n <= gram:
            self.at = np.flatnonzero(valid)
        else:
            width = n - gram + 1
            whole, _ = words.windows(n, 0)
            least = np.where(whole, running_min(hashes[0], width), np.uint64(0))
            # a gram is chosen if it is the least of a window that holds it; ties are all chosen
            self.at = np.flatnonzero(valid & (running_max(least, width) == hashes[0]))
        self.print = hashes[0]
        self.second = hashes[1] if n < gram else None

    def keep(self, chosen: np.ndarray) -> None:
        self.at = self.at[chosen]

    def around(self, lo: np.ndarray, hi: np.ndarray) -> tuple[pa.ListArray, pa.ListArray]:
        """For each fingerprint the words before it (the nearest first) and after it, within its text's words lo ... hi - 1."""
        if self.second is not None:
            none = pa.ListArray.from_arrays(pa.array(np.zeros(len(self.at) + 1, np.int32)), pa.array([], pa.int64()))
            return none, _lists(np.ones(len(self.at), np.int64), self.second[self.at])
        reach = self.n - self.gram
        left = np.minimum(self.at - lo, reach)
        right = np.minimum(hi - self.at - self.gram, reach)
        step = lambda size: np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        h = self.words.hash[0]
        return _lists(left, h[np.repeat(self.at, left) - 1 - step(left)]), _lists(right, h[np.repeat(self.at + self.gram, right) + step(right)])


def _lists(sizes: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.view(np.int64)))


def item_prints(benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id string, n, print, before, after) of every fingerprint of every item, once each."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in chunks(batch.column("text").to_pylist()):
                words = Words(texts, ALNUM, True)
                count = np.diff(words.first)
                for n in range(1, window + 1):
                    found = Prints(words, n, gram)
                    found.keep((count[words.doc[found.at]] == n) | ((n == window) & (count[words.doc[found.at]] >= n)))
                    doc = words.doc[found.at]
                    before, after = found.around(words.first[doc], words.first[doc + 1])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("item_id").take(pa.array(begin + doc)), pa.array(np.full(len(doc), n, np.int32)), pa.array(found.print[found.at].view(np.int64)), before, after],
                        ["item_id", "n", "print", "before", "after"],
                    )

    own = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("item_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return own.mapInArrow(cut, "item_id string, n int, print long, before array<long>, after array<long>").distinct()


def item_classes(prints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(n, print, before, after, class) of different fingerprints, and (class, item_id): the set of items that holds them.

    A class is named by sums over its items' hashes, so no set is gathered in one place."""
    hashes = [F.xxhash64("item_id"), F.xxhash64(F.lit(7), "item_id")]
    total = lambda h: F.sum(h.cast("decimal(20,0)")).cast("string")
    kinds = stored(prints.groupBy("n", "print", "before", "after").agg(F.concat_ws(",", F.count("item_id"), *map(total, hashes)).alias("class")), "item-kinds")
    one = kinds.groupBy("class").agg(F.min(F.struct("n", "print", "before", "after")).alias("k")).select("class", "k.*")
    return kinds, stored(one.join(prints.where("item_id IS NOT NULL"), ["n", "print", "before", "after"]).select("class", "item_id").distinct(), "item-classes")


def candidates(docs: DataFrame, table: np.ndarray, bits: int, lengths: list[int], gram: int = GRAM) -> DataFrame:
    """(did, th, n_words, found): each keyed document with its fingerprints that the table may have."""
    shared = docs.sparkSession.sparkContext.broadcast(table)
    names = ["start", "n", "print", "before", "after"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for begin, texts, batch in ((begin, texts, part) for batch in batches for part in slices(batch) for begin, texts in chunks(part.column("text").to_pylist())):
            words = Words(texts, ALNUM, True, streams=2 if lengths and lengths[0] < gram else 1)
            docs, columns = [], [[] for _ in names]
            for n in lengths:
                found = Prints(words, n, gram)
                found.keep(in_bits(table, bits, found.print[found.at]))
                doc = words.doc[found.at]
                docs.append(doc)
                values = (pa.array((found.at - words.first[doc]).astype(np.int32)), pa.array(np.full(len(doc), n, np.int32)), pa.array(found.print[found.at].view(np.int64)), *found.around(words.first[doc], words.first[doc + 1]))
                for column, value in zip(columns, values):
                    column.append(value)
            doc = np.concatenate(docs) if docs else np.zeros(0, np.int64)
            order = np.argsort(doc, kind="stable")
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            struct = pa.StructArray.from_arrays([pa.concat_arrays([pa.array([], kind), *c]).take(pa.array(order)) for c, kind in zip(columns, kinds)], names)
            found = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[order], np.arange(len(texts) + 1)).astype(np.int32)), struct)
            own = batch.slice(begin, len(texts))
            yield pa.RecordBatch.from_arrays([own.column("did"), own.column("th"), pa.array(np.diff(words.first).astype(np.int64)), found], ["did", "th", "n_words", "found"])

    kind = PRINT.replace(", ", ",").replace(" ", ":")
    return docs.mapInArrow(cut, f"did long, th long, n_words long, found array<struct<{kind}>>")


def _agreeing(a: Column, b: Column) -> Column:
    """How many elements two lists have in common from the front."""
    n = F.least(F.size(a), F.size(b))
    differs = F.array_position(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x == y), F.lit(False))
    return F.when(differs > 0, differs - 1).otherwise(n).cast("int")


def extended(hits: DataFrame, gram: int) -> DataFrame:
    """Of joined fingerprints (before, after of both sides as x and y): their spans as start * 16 + length, where they reach a window."""
    left, right = _agreeing(F.col("x.before"), F.col("y.before")), _agreeing(F.col("x.after"), F.col("y.after"))
    rows = hits.select("did", "th", "x.start", "x.n", "class", left.alias("l"), right.alias("r"))
    short = F.col("n") < gram
    start = F.when(short, F.col("start")).otherwise(F.col("start") - F.col("l")).cast("long")
    length = F.when(short, F.col("n")).otherwise(gram + F.col("l") + F.col("r"))
    return rows.where(F.when(short, F.col("r") == 1).otherwise(length >= F.col("n"))).select("did", "th", (start * 16 + length).alias("span"), "class")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", names: bool = True) -> DataFrame:
    """Per row of ``docs``: did, th, n_words, n_hit, spans (hit windows as start * 16 + length) and, with ``names``, items."""
    if not gram <= window <= 15 - window + gram:
        raise ValueError("a window has at least as many words as a gram, and an extended one at most 15")
    items = stored(item_prints(benchmark, window, gram), "item-prints")
    table, bits = bit_table(items, "print")
    lengths = sorted(r[0] for r in items.select("n").distinct().collect())  # at most ``window`` numbers
    scanned = stored(candidates(keyed(docs, id_col, text_col), table, bits, lengths, gram), "doc-prints")
    kinds, classes = item_classes(items)
    x = scanned.where(F.size("found") > 0).select("did", "th", F.explode("found").alias("x"))
    y = kinds.select("class", F.struct("n", "print", "before", "after").alias("y"))
    spans = extended(x.join(y, (F.col("x.n") == F.col("y.n")) & (F.col("x.print") == F.col("y.print"))), gram)
    hits = spans.groupBy("did", "th").agg(F.sort_array(F.collect_set("span")).alias("spans"), F.sort_array(F.collect_set("class")).alias("classes"))
    end = lambda acc, x: F.greatest(acc["end"], F.shiftright(x, 4) + x % 16)
    union = F.aggregate(
        "spans", F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("sum")),
        lambda acc, x: F.struct(end(acc, x).alias("end"), (acc["sum"] + end(acc, x) - F.greatest(acc["end"], F.shiftright(x, 4))).alias("sum")),
        lambda acc: acc["sum"],
    )
    hits = stored(hits.withColumn("n_hit", union), "doc-hits")
    if names:  # once for each collection of classes
        named = hits.select("classes").distinct().select("classes", F.explode("classes").alias("class")).join(classes, "class")
        hits = hits.join(named.groupBy("classes").agg(F.sort_array(F.collect_set("item_id")).alias("items")), "classes", "left")
    return scanned.drop("found").join(hits.drop("classes"), ["did", "th"], "left").withColumn("n_hit", F.coalesce("n_hit", F.lit(0)).cast("long"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no window of ``benchmark`` occurs, with their columns."""
    did, th = fresh(docs, "did"), fresh(docs, "th")
    bad = contamination(docs, benchmark, id_col=id_col, text_col=text_col, names=False).where("n_hit > 0").select(F.col("did").alias(did), F.col("th").alias(th)).distinct()
    return docs.withColumns(dict(zip((did, th), row_key(id_col, text_col)))).join(bad, [did, th], "left_anti").drop(did, th)


def query(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = contamination(docs, benchmark)
    names = F.coalesce(F.array_join("items", ","), F.lit(""))
    return found.select(
        id_or_null().alias("doc_id"), "n_words", "n_hit", F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.encode(names, "utf-8"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_SPLIT = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
SQL = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_SPLIT} AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, {_SPLIT} AS w FROM documents),
dw AS (
  SELECT r, s, n, array_to_string(w[s:s + n - 1], ' ') AS k
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
h AS (SELECT r, s, dw.n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.k = iw.k),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT r, item_id FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.r = c.r LEFT JOIN t ON d.r = t.r
"""
