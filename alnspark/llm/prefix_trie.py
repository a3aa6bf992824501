"""The prefix trie of conversations, by partition refinement.

At first all conversations are one class.  A round takes the next turns of the members of active classes and splits each
class by them: members with the same turns so far stay together, and each class on the way is a node of the
trie.  A class with one member retires: the rest of its turns is a unary chain, written out turn by turn.  Rounds take
4 turns, then 8, up to ``MOST_TURNS``, so long common stretches need few rounds.  Then the rounds are folded back
from the last to the first: of each node its least member is the owner, and each member brings to the nodes above what it owns
below, so leaves and saved code points of subtrees are sums over members.

A turn is its 16-byte digest; texts never move, and a class is the digest of its turns so far.  Turns are numbered within
conversations on ranges of rows with a carry from range to range, so a conversation with a third of all rows is spread.  A very
common first turn is one row of partial counts a task.  The ids of members that end at one node are joined in pieces where
they lie and hashed piece by piece, as SHA-256 asks for one stream.

Defined cases: turns go by number (null first), equal numbers by digest; null roles and texts are empty; rows without
conv_id belong to no conversation; repeated rows are turns of their own; an empty table has no nodes; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alnspark.llm.common import stored

HEADS, NEAR = 6, 100
FEWEST_TURNS, MOST_TURNS = 4, 512
PIECE = 512
ROOT = bytes(16)


def turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(c, turn, key, chars): narrow rows; ``key`` is a digest of role and text."""
    role, text = (F.coalesce(F.col(f"`{x}`").cast("string"), F.lit("")) for x in (role_col, text_col))
    key = F.unhex(F.substring(F.sha2(F.encode(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), "utf-8"), 256), 1, 32))
    own = conversations.select(F.col(f"`{id_col}`").cast("long").alias("c"), F.col(f"`{turn_col}`").cast("long").alias("turn"), key.alias("key"), F.length(text).cast("long").alias("chars"))
    return own.where("c IS NOT NULL")


def numbered(own: DataFrame) -> DataFrame:
    """(c, d, key, chars): the turns of each conversation numbered from 1.

    Rows are dealt by ranges of (conversation, turn), numbered in their range, and those of a conversation that goes on from the
    range before are moved up; ranges tell the driver one row each."""
    order = [F.col("c"), F.asc_nulls_first("turn"), F.col("key")]
    dealt = own.withColumn("salt", F.rand(7)).repartitionByRange(*order, F.col("salt")).drop("salt").sortWithinPartitions(*order)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, held = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            c = batch.column("c").to_numpy()
            if not len(c):
                continue
            first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
            size = np.diff(np.append(first, len(c)))
            place = np.arange(len(c)) - np.repeat(first, size) + 1
            if c[0] == last:
                place[: size[0]] += held
            last, held = c[-1], int(place[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), part, np.int32)), batch.column("c"), pa.array(place), batch.column("key"), batch.column("chars")], ["part", "c", "d", "key", "chars"])

    rows = stored(dealt.mapInArrow(number, "part int, c long, d long, key binary, chars long"), "trie-turns")
    ends = rows.groupBy("part").agg(F.min("c").alias("lo"), F.max(F.struct("c", "d")).alias("hi")).orderBy("part").collect()
    moves, last, held = [], None, 0
    for part, lo, (hi, n) in ends:
        before = held if lo == last else 0
        if before:
            moves.append((part, lo, before))
        last, held = hi, n + (before if hi == lo else 0)
    if not moves:
        return rows.drop("part")
    moved = F.broadcast(own.sparkSession.createDataFrame(moves, "part int, c long, before long"))  # a row a range at most
    return rows.join(moved, ["part", "c"], "left").select("c", (F.col("d") + F.coalesce("before", F.lit(0))).alias("d"), "key", "chars")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored turns (c, d, key, chars) and conversations (c, length) after each conversation's first turns are taken from its hundred's first one."""
    h = (F.crc32(F.encode(F.col("c").cast("string"), "utf-8")) % HEADS).cast("long")
    convs = stored(rows.groupBy("c").agg(F.count("*").alias("own")).withColumns({"h": h, "base": F.col("c") - F.col("c") % NEAR}), "trie-own")
    bases = convs.where("c = base").select("base", F.col("own").alias("there"))
    convs = convs.join(bases, "base", "left").withColumn("m", F.least("h", F.coalesce("there", F.lit(0))))
    convs = stored(convs.select("c", "base", "h", "m", (F.col("m") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length")), "trie-convs")
    kept = rows.join(convs.select("c", "h", "m"), "c").where("d > h").select("c", (F.col("d") - F.col("h") + F.col("m")).alias("d"), "key", "chars")
    heads = rows.where((F.col("d") < HEADS) & (F.col("c") % NEAR == 0)).withColumnRenamed("c", "base")
    taken = heads.join(convs.where("h > 0").select("c", "base", "h"), "base").where("d <= h").select("c", "d", "key", "chars")
    return stored(kept.unionByName(taken), "trie-rebuilt"), convs.select("c", "length")


def refined(rows: DataFrame, active: DataFrame, start: int, take: int) -> DataFrame:
    """(c, length, d, digest, parent, chars) of the next ``take`` turns of ``active`` (c, length, digest) conversations."""

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for c, length, digest, own in zip(*(batch.column(x).to_pylist() for x in ("c", "length", "digest", "own"))):
                for turn in own:
                    parent, digest = digest, hashlib.blake2b(digest + turn["key"], digest_size=16).digest()
                    for column, value in zip(out, (c, length, turn["d"], digest, parent, turn["chars"])):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds)], ["c", "length", "d", "digest", "parent", "chars"])

    now = rows.where((F.col("d") > start) & (F.col("d") <= start + take)).join(active, "c")
    now = now.groupBy("c", "length", "digest").agg(F.sort_array(F.collect_list(F.struct("d", "key", "chars"))).alias("own"))  # ``take`` turns at most
    return stored(now.mapInArrow(chain, "c long, length long, d long, digest binary, parent binary, chars long"), "trie-round")


def ends_digests(ends: DataFrame) -> DataFrame:
    """(d, digest, sha): for each node the hash of the ids c that end there, ascending and joined by commas."""
    order = ["d", "digest", "c"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, digest, c = (batch.column(x).to_pylist() for x in order)
            out, lo = [], 0
            for i in range(1, len(c) + 1):
                if i == len(c) or i - lo == PIECE or d[i] != d[lo] or digest[i] != digest[lo]:
                    out.append((d[lo], digest[lo], c[lo], ",".join(map(str, c[lo:i]))))
                    lo = i
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out), (pa.int64(), pa.binary(), pa.int64(), pa.string()))], ["d", "digest", "first", "ids"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(node, state):
            return pa.RecordBatch.from_arrays([pa.array([node[0]]), pa.array([node[1]], pa.binary()), pa.array([state.hexdigest()])], ["d", "digest", "sha"])

        node, state = None, None
        for batch in batches:
            for d, digest, ids in zip(*(batch.column(x).to_pylist() for x in ("d", "digest", "ids"))):
                if (d, digest) == node:
                    state.update(b"," + ids.encode())
                    continue
                if node:
                    yield row(node, state)
                node, state = (d, digest), hashlib.sha256(ids.encode())
        if node:
            yield row(node, state)

    pieces = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, "d long, digest binary, first long, ids string")
    return pieces.repartition("d", "digest").sortWithinPartitions("d", "digest", "first").mapInArrow(join, "d long, digest binary, sha string")


def trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of stored turns (c, d, key, chars) of stored conversations (c, length)."""
    least, count = convs.agg(F.min("c"), F.count("*")).first()
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    sha = lambda c: F.sha2(F.encode(c, "utf-8"), 256)
    # refinement: rounds of (rows, nodes), and the classes that retired
    rounds: list[tuple[DataFrame, DataFrame]] = []
    start, take = 0, FEWEST_TURNS
    active = convs.where("length > 0").withColumn("digest", F.lit(ROOT))
    over = [active.withColumn("d", F.lit(0).cast("long"))] if count == 1 else []
    while count > 1 and not active.isEmpty():
        own = refined(rows, active, start, take)
        ends = F.when(F.col("d") == F.col("length"), F.col("c"))
        nodes = own.groupBy("d", "digest").agg(F.min("c").alias("conv_id"), F.count("*").alias("n"), F.min("parent").alias("parent"), F.min("chars").alias("chars"), F.count(ends).alias("n_ends"), F.min(ends).alias("end"))
        nodes = stored(nodes, "trie-nodes")
        rounds.append((own, nodes))
        start, take = start + take, min(2 * take, MOST_TURNS)
        last = own.where((F.col("d") == start) & (F.col("length") > start)).select("c", "length", "d", "digest")
        last = stored(last.join(nodes.where(F.col("d") == start).select("digest", "n"), "digest"), "trie-active")
        over.append(last.where("n = 1").drop("n"))
        active = last.where("n > 1").select("c", "length", "digest")
    retired = stored(union(over), "trie-retired") if over else None
    one = F.lit(1).cast("long")
    # children: nodes of the rounds, and a chain's first one
    kids = [nodes.select((F.col("d") - 1).alias("d"), F.col("parent").alias("digest")) for _, nodes in rounds] + ([retired.select("d", "digest")] if retired else [])
    empty = convs.sparkSession.createDataFrame([], "d long, digest binary")
    kids = stored(union([*kids, empty]).groupBy("d", "digest").agg(F.count("*").alias("n_children")), "trie-children")
    # fold back: what each conversation owns below the round
    carry = retired.select("c", one.alias("leaf"), F.lit(0).cast("long").alias("saved")) if retired else None
    folded = []
    for own, nodes in reversed(rounds):
        # written apart: a join below a join would keep Spark from splitting a very common node's members
        known = stored(nodes.join(kids, ["d", "digest"], "left").select("d", "digest", "conv_id", "n", "n_children"), "trie-known")
        mine = F.col("c") == F.col("conv_id")
        parts = own.join(known, ["d", "digest"]).select(
            "c", "d", "digest", F.when(mine, (F.col("n") - 1) * F.col("chars")).otherwise(0).alias("part"),
            (mine & (F.col("d") == F.col("length")) & F.col("n_children").isNull()).cast("long").alias("end"),
        )
        parts = stored(parts, "trie-parts").join(carry, "c", "left")
        below = Window.partitionBy("c").orderBy(F.desc("d"))  # the turns of one round
        parts = stored(parts.select(
            "c", "d", "digest", (F.sum("part").over(below) + F.coalesce("saved", F.lit(0))).alias("saved"),
            F.greatest(F.max("end").over(Window.partitionBy("c")), F.coalesce("leaf", F.lit(0))).alias("leaf"),
        ), "trie-fold")
        folded.append(parts.groupBy("d", "digest").agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens")))
        begin = parts.groupBy("c").agg(F.max("leaf").alias("leaf"), F.max("saved").alias("saved"))  # the first turn has all below it
        waiting = carry.join(own.select("c").distinct(), "c", "left_anti")
        carry = stored(waiting.unionByName(begin), "trie-carry")
    leaves, saved = carry.agg(F.sum("leaf"), F.sum("saved")).first() if carry else (None, None)
    # members that end together
    several = union([own.where("d = length").join(nodes.where("n_ends > 1").select("d", "digest"), ["d", "digest"]).select("d", "digest", "c") for own, nodes in rounds] + [convs.where("length = 0").select(F.lit(0).cast("long").alias("d"), F.lit(ROOT).alias("digest"), "c")])
    several = stored(ends_digests(several), "trie-ends")
    nodes = union([nodes for _, nodes in rounds]) if rounds else None
    out = []
    if nodes:
        above = nodes.select((F.col("d") + 1).alias("d"), F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
        above = above.unionByName(convs.sparkSession.createDataFrame([(1, ROOT, least)], "d long, parent binary, parent_conv_id long"))
        inner = nodes.join(above, ["d", "parent"]).join(kids, ["d", "digest"], "left").join(union(folded), ["d", "digest"]).join(several, ["d", "digest"], "left")
        out.append(inner.select(
            "conv_id", F.col("d").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"), F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens",
            F.coalesce("sha", F.when(F.col("n_ends") == 1, sha(F.col("end").cast("string"))), sha(F.lit(""))).alias("ends_sha256"),
        ))
    if retired:
        chain = rows.select("c", F.col("d").alias("depth")).join(retired.select("c", "length", "d"), "c").where("depth > d")
        more = F.col("depth") < F.col("length")
        out.append(chain.select(
            F.col("c").alias("conv_id"), "depth", F.col("c").alias("parent_conv_id"), one.alias("n_convs"), more.cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
            F.when(more, sha(F.lit(""))).otherwise(sha(F.col("c").cast("string"))).alias("ends_sha256"),
        ))
    if least is not None:
        root = convs.agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs")).join(kids.where("d = 0").select("n_children"), F.lit(True), "left").join(several.where("d = 0").select("sha"), F.lit(True), "left")
        out.append(root.select(
            "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
            F.lit(leaves or 1).cast("long").alias("n_leaves"), F.lit(saved or 0).cast("long").alias("saved_tokens"), F.coalesce("sha", sha(F.lit(""))).alias("ends_sha256"),
        ))
    return union(out) if out else convs.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")


def query(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    rows, convs = rebuilt(numbered(turns(conversations)))
    return trie(rows, stored(convs, "trie-lengths"))


_BIT = "xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END)"
SQL = rf"""
WITH RECURSIVE o AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS d,
    sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, length(coalesce(text, '')) AS chars
  FROM conversations WHERE conv_id IS NOT NULL),
z AS (SELECT c, CAST(c AS VARCHAR) AS s, 4294967295 AS a, 0 AS i FROM (SELECT DISTINCT c FROM o)
  UNION ALL
  SELECT c, s, CASE WHEN i % 9 = 0 THEN xor(a, CAST(ascii(s[i // 9 + 1]) AS BIGINT)) ELSE {_BIT} END, i + 1 FROM z WHERE i < 9 * length(s)),
h AS (SELECT c, c - c % 100 AS base, xor(a, 4294967295) % 6 AS h FROM z WHERE i = 9 * length(s)),
t AS (
  SELECT h.c, o.d, o.k, o.chars FROM h JOIN o ON o.c = h.base WHERE o.d <= h
  UNION ALL
  SELECT h.c, o.d - h + least(h, coalesce(b.n, 0)), o.k, o.chars FROM h JOIN o ON o.c = h.c LEFT JOIN (SELECT c, count(*) AS n FROM o GROUP BY c) b ON b.c = h.base WHERE o.d > h),
l AS (SELECT h.c, list(k ORDER BY d) FILTER (k IS NOT NULL) AS ks, list(chars ORDER BY d) FILTER (k IS NOT NULL) AS cs FROM h LEFT JOIN t ON t.c = h.c GROUP BY h.c),
p AS (SELECT c, coalesce(len(ks), 0) AS size, unnest(range(0, coalesce(len(ks), 0) + 1)) AS d, coalesce(ks, []) AS ks, cs FROM l),
n AS (
  SELECT d, ks[1:d] AS x, min(c) AS c, count(*) AS n, max(CASE WHEN d > 0 THEN cs[d] ELSE 0 END) AS chars,
    coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = size), '') AS ends FROM p GROUP BY d, ks[1:d]),
f AS (SELECT n.*, coalesce(m.n_children, 0) AS n_children, u.c AS parent FROM n
  LEFT JOIN (SELECT x[1:d - 1] AS x, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1) m ON m.x = n.x
  LEFT JOIN n u ON u.d = n.d - 1 AND u.x = n.x[1:n.d - 1]),
s AS (SELECT x[1:a] AS x, count(*) FILTER (n_children = 0) AS n_leaves, sum((n - 1) * chars) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM f) GROUP BY 1)
SELECT c AS conv_id, d AS depth, parent AS parent_conv_id, n AS n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256
FROM f JOIN s ON s.x = f.x
"""
