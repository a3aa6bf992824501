"""Resharding by minimum-cost flow.

To move the fewest bytes an overfull shard gives up its smallest rows.  How many it gives depends on whether it
is one of the shards that hold a row more, so two sizes matter in each shard: those of the last row that goes in
either case.  They are found digit by digit from counts.  They cut a shard's rows into at most four blocks; rows
below go, rows above stay.  A flow network with one node a block and a shard (its size depends on the number of
shards, not of rows) then gives each new shard its capacity in rows, and places the extra rows, at the fewest
bytes moved.  Rows of blocks with several targets are ranked without gaps and dealt by the flow, and files of
shards that neither lose nor gain a row are left alone.

Defined cases: a null text has no bytes; null ids are placed like any other row; equal rows are separate
rows; an empty table gives no rows; columns of any name pass.  Law ``rows``: counts of any two shards differ by
one at most.
"""

from __future__ import annotations

import heapq
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alnspark.llm.common import fresh, ranked, shared_path, stored

SHARDS, OLD_SHARDS, OVERHEAD = 24, 16, 8


def min_cost_flow(n: int, edges: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each (from, to, capacity, cost >= 0) of a maximum flow of least cost: shortest paths with potentials."""
    to, room, cost, out = [], [], [], [[] for _ in range(n)]
    for a, b, most, price in edges:
        for x, y, r, c in ((a, b, most, price), (b, a, 0, -price)):
            out[x].append(len(to))
            to.append(y)
            room.append(r)
            cost.append(c)
    height = [0] * n
    while True:
        dist, via, heap = [None] * n, [-1] * n, [(0, source)]
        dist[source] = 0
        while heap:
            d, x = heapq.heappop(heap)
            if d > dist[x]:
                continue
            for e in out[x]:
                if room[e] and (dist[to[e]] is None or d + cost[e] + height[x] - height[to[e]] < dist[to[e]]):
                    dist[to[e]] = d + cost[e] + height[x] - height[to[e]]
                    via[to[e]] = e
                    heapq.heappush(heap, (dist[to[e]], to[e]))
        if dist[sink] is None:
            return [most - room[2 * i] for i, (_, _, most, _) in enumerate(edges)]
        far = max(d for d in dist if d is not None)
        height = [h + (far if d is None else d) for h, d in zip(height, dist)]
        path, x = [], sink
        while x != source:
            path.append(via[x])
            x = to[via[x] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push


def plan(blocks: list[tuple[int, int, int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """From (old shard, block, rows, bytes): (old shard, block, new shard, first rank, end rank).

    Rows cost their block's mean size, and a little, so that of equal bytes the fewest rows move."""
    total = sum(rows for _, _, rows, _ in blocks)
    b = len(blocks)
    source, pool, extra, sink = b + shards, b + shards + 1, b + shards + 2, b + shards + 3
    edges, stay, move = [], {}, {}
    for i, (old, _, rows, size) in enumerate(blocks):
        edges.append((source, i, rows, 0))
        if old < shards:
            stay[i] = len(edges)
            edges.append((i, b + old, rows, 0))
        move[i] = len(edges)
        edges.append((i, pool, rows, (size << 20) // rows + 1))
    into = {}
    for s in range(shards):
        into[s] = len(edges)
        edges.append((pool, b + s, total, 0))
        edges.append((b + s, sink, total // shards, 0))
        edges.append((b + s, extra, 1, 0))
    edges.append((extra, sink, total % shards, 0))
    flow = min_cost_flow(b + shards + 4, edges, source, sink)
    wants = [[s, flow[into[s]]] for s in range(shards) if flow[into[s]]]
    out = []
    for i, (old, block, rows, _) in enumerate(blocks):
        at = flow[stay[i]] if i in stay else 0
        if at:
            out.append((old, block, old, 0, at))
        left = flow[move[i]]
        while left:
            target = wants[-1]
            n = min(left, target[1])
            out.append((old, block, target[0], at, at + n))
            at, left = at + n, left - n
            target[1] -= n
            if not target[1]:
                wants.pop()
    return out


def nth_sizes(rows: DataFrame, ranks: list[tuple[int, int]]) -> dict[tuple[int, int], int]:
    """The size of the ``rank``-th smallest row (from 1) of a shard, for each (old shard, rank): a byte at a time, by counts."""
    most = rows.agg(F.max("size")).first()[0] or 0
    state = {key: (0, key[1]) for key in ranks}
    for shift in range((max(1, most.bit_length()) + 7) // 8 * 8 - 8, -1, -8):
        heads = rows.sparkSession.createDataFrame(sorted({(old, at) for (old, _), (at, _) in state.items()}), "old int, head long")  # two a shard
        held = rows.join(F.broadcast(heads), (rows["old"] == heads["old"]) & (F.shiftright("size", shift + 8) == F.col("head")))
        digits: dict[tuple[int, int], list[tuple[int, int]]] = {}
        counts = held.groupBy(heads["old"], "head", F.shiftright("size", shift).bitwiseAND(255).alias("digit")).count()
        for old, head, digit, n in sorted(map(tuple, counts.collect())):  # 512 rows a shard
            digits.setdefault((old, head), []).append((digit, n))
        for key, (head, left) in state.items():
            for digit, n in digits[key[0], head]:
                if left <= n:
                    break
                left -= n
            state[key] = (head * 256 + digit, left)
    return {key: size for key, (size, _) in state.items()}


def reshard(rows: DataFrame, old: str, size: str, order: list[str], shards: int) -> DataFrame:
    """Add ``shard`` to ``rows``; ``old`` is the shard a row lies in, ``size`` its bytes, ``order`` tells rows apart."""
    spark = rows.sparkSession
    own = F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != "shard"]).alias("row")
    keys = [f"o{i}" for i in range(len(order))]
    packed = stored(rows.select(own, F.col(f"`{old}`").cast("int").alias("old"), F.col(f"`{size}`").cast("long").alias("size"), *[F.col(f"`{c}`").alias(k) for c, k in zip(order, keys)]), "reshard-rows")
    held = {r["old"]: r["count"] for r in packed.groupBy("old").count().collect()}  # shards
    each, extra = divmod(sum(held.values()), shards)
    gives = {o: sorted({n - each - (extra > 0), n - each} - {0}) for o, n in held.items() if o < shards and n > each}
    sizes = nth_sizes(packed, [(o, r) for o, ranks in gives.items() for r in ranks]) if any(gives.values()) else {}
    cuts = [(o, *([-1] * (2 - len(ranks)) + [sizes[o, r] for r in ranks])) for o, ranks in gives.items()]
    low, high = F.col("low"), F.col("high")
    # low and high are neighbours in the shard's order, so nothing lies between them
    block = F.when(low.isNull() | (F.col("size") < high) & (F.col("size") != low), 0).when(F.col("size") == low, 1).when(F.col("size") == high, 2).otherwise(3)
    packed = packed.join(F.broadcast(spark.createDataFrame(cuts, "old int, low long, high long")), "old", "left").withColumn("block", block).drop("low", "high")
    blocks = [tuple(map(int, r)) for r in packed.groupBy("old", "block").agg(F.count("*"), F.sum("size")).orderBy("old", "block").collect()]
    steps = plan(blocks, shards)
    rows_of = {(o, c): n for o, c, n, _ in blocks}
    table = lambda some: F.broadcast(spark.createDataFrame(some, "old int, block int, shard int, first long, end long"))  # noqa: E731  blocks and shards
    whole = [s for s in steps if s[4] - s[3] == rows_of[s[0], s[1]]]
    parts = [s for s in steps if s not in whole]
    out = packed.join(table(whole), ["old", "block"]).select("row.*", "shard")
    if not parts:
        return out
    split = stored(packed.join(table(parts).select("old", "block").distinct(), ["old", "block"], "left_semi"), "reshard-split")
    dealt = ranked(split, ["old", "block"], keys, "rank").join(table(parts), ["old", "block"]).where("rank >= first AND rank < end")
    return out.union(dealt.select("row.*", "shard"))


def rewrite(docs: DataFrame, assigned: DataFrame, ids: list[str], path: str) -> list[int]:
    """Write the rows of the shards that change to ``path``/shard=N; returns those shards.

    ``assigned`` has ``ids``, ``old`` and ``shard``, a row for each of ``docs``; the other shards' files stay as they
    are.  Rows are matched by ``ids`` and any further columns that both have, nulls being equal, and the k-th row of
    a key takes its k-th place.  Where a key has different texts, its rows' old shards can't be told, so all shards
    of the key are written if one is.  ``docs`` may lie in ``path``: rows are staged before a file is replaced, and
    a shard that loses all rows ends without files."""
    spark = docs.sparkSession
    keys = [c for c in docs.columns if c in ids or c in assigned.columns and c != "shard"]
    texts = [c for c in docs.columns if c not in (*keys, "shard")]
    assigned = stored(assigned.select(*dict.fromkeys([*keys, "old", "shard"])), "reshard-places")
    moved = assigned.where("old <> shard")
    changed = {r[0] for r in moved.select("old").union(moved.select("shard")).distinct().collect()}  # shards, not rows
    if not changed:
        return []
    same = lambda cols: reduce(and_, (F.col(f"x.`{c}`").eqNullSafe(F.col(f"y.`{c}`")) for c in cols))
    digest = F.xxhash64(*texts) if texts else F.lit(0)
    repeated = stored(docs.groupBy(*keys).agg(F.min(digest).alias("_lo"), F.max(digest).alias("_hi"), F.count("*").alias("_n")).where("_n > 1"), "reshard-repeated")
    mixed = repeated.where("_lo <> _hi")
    places = assigned.alias("x").join(mixed.alias("y"), same(keys), "left_semi").withColumn("_at", F.explode(F.array("old", "shard")))
    sets = places.groupBy(*keys).agg(F.sort_array(F.collect_set("_at")).alias("_at"))
    linked = sets.select(F.col("_at")[0].alias("a"), F.explode("_at").alias("b")).distinct().collect()  # pairs of shards
    while more := {s for a, b in linked if a in changed or b in changed for s in (a, b)} - changed:
        changed |= more
    place = fresh(docs, "nth")  # a name that no column has
    nth = lambda df, *order: df.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    if repeated.isEmpty():  # texts are dealt once
        both = docs.alias("x").join(assigned.alias("y"), same(keys))
    else:
        both = nth(docs, digest).alias("x").join(nth(assigned, "old", "shard").alias("y"), same([*keys, place]))
    both = both.where(F.col("y.shard").isin(changed))
    staged = stored(both.select(*[F.col(f"x.`{c}`") for c in [*keys, *texts]], "y.shard"), "reshard-staged")
    if staged.count() != assigned.where(F.col("shard").isin(changed)).count():
        raise ValueError("docs and assigned don't have the same rows")
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", 1_000_000).option("compression", "zstd").partitionBy("shard").parquet(path)
    held = {r[0] for r in staged.select("shard").distinct().collect()}
    for shard in changed - held:  # nothing was written there, so the old files would stay
        gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/shard={shard}")
        gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)
    return sorted(changed)


def old_layout(source: Column, shards: int = OLD_SHARDS) -> Column:
    """Where rows lie before: all of a source in one shard, so one shard holds a hot source."""
    return F.pmod(F.xxhash64(source), F.lit(shards)).cast("int")


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Lays the documents out by source, solves the transfers, rewrites the files of the shards that change, and reads the result."""
    path, kept = shared_path(spark, "shards"), "doc_id long, text string, shard int"
    old = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), old_layout(F.col("source")).alias("shard"))
    old.write.option("compression", "zstd").partitionBy("shard").parquet(path)
    data = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    measured = lambda df: df.withColumns({"size": (F.octet_length(data) + OVERHEAD).cast("long"), "text_crc32": F.crc32(data)})
    rows, keys = measured(spark.read.schema(kept).parquet(path)), ["doc_id", "text_crc32", "size"]
    placed = stored(reshard(rows.select(*keys, F.col("shard").alias("old")), "old", "size", keys, SHARDS), "resharded")
    rewrite(rows.select(*keys, "text"), placed, keys, path)
    out = stored(measured(spark.read.schema(kept).parquet(path)).select(*keys, "shard"), "reshard-result")
    out = ranked(out, ["shard"], keys, "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
