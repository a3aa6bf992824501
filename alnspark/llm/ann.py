"""Approximate nearest neighbours by cosine: a robust-pruned directed graph in each shard.

Distinct vectors are dealt over shards of bounded size.  A shard starts from a random graph; each point's
greedy search proposes neighbours, and relaxed distance pruning keeps a diverse few (a candidate goes if a
kept one is nearer to it, by the factor ``alpha``, than the point is).  Edges are mirrored and pruned again.
Queries, in blocks, are dealt to every shard and stream past its graph, which is searched with a beam; the finds are
scored in double precision on the original vectors and merged.  All work inside a shard is on arrays of many
points at once.  A shard's graph does not move for a block; shards grow with the table up to a bound, so that
their number, and with it the copies of the queries, stays small for long.

Equal vectors are one node that carries their smallest ids, as many as a result can need.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do
rows without an id or with another dimension than most vectors; of rows with one id the least vector counts;
with fewer candidates than ``k`` all are returned; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alnspark.llm.common import stored

K, DEGREE, BEAM, ALPHA = 5, 32, 96, 1.2
BLOCK_ROWS, BATCH = 2_048, 256
#: Vectors of a shard: the table dealt to ``SHARDS`` shards, within these bounds.
LEAST_ROWS, MOST_ROWS, SHARDS = 4_096, 262_144, 64
#: Bytes of a shard's vectors, which are one cell: wide vectors make more shards.
MOST_BYTES = 256 << 20


class Graph:
    """A pruned graph over unit vectors; ``out`` has each point's neighbours, -1 where there are fewer."""

    def __init__(self, vectors: np.ndarray, out: np.ndarray | None = None, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA):
        self.x, self.degree, self.beam = vectors, degree, beam
        self.n = len(vectors)
        centre = vectors.mean(axis=0) if self.n else None
        self.entry = int(np.argmax(vectors @ centre)) if self.n else 0
        if out is not None:
            self.out = out
            return
        rng = np.random.default_rng(self.n)
        self.out = np.full((self.n, degree), -1, np.int32)
        if self.n <= beam:  # searches look at every point
            return
        self.out[:, : degree // 2] = rng.integers(0, self.n, (self.n, degree // 2))
        for a in (1.0, alpha):
            for points in np.array_split(rng.permutation(self.n), -(-self.n // BATCH)):
                self._insert(points, a)

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(points, similarities) of the ``beam`` best found for each query, best first; -1 where there are fewer."""
        b = len(queries)
        if self.n <= beam:
            sim = queries @ self.x.T
            order = np.argsort(-sim, axis=1, kind="stable")
            return order, np.take_along_axis(sim, order, 1)
        rows = np.arange(b)
        ids = np.full((b, beam), -1, np.int64)
        sim = np.full((b, beam), -np.inf, np.float32)
        done = np.ones((b, beam), bool)
        seen = np.zeros((b, self.n + 1), bool)  # the last column takes the -1s
        ids[:, 0], sim[:, 0], done[:, 0] = self.entry, queries @ self.x[self.entry], False
        seen[:, self.entry] = True
        while True:
            best = np.argmin(done, axis=1)  # the best that is not expanded; ids are kept sorted
            live = ~done[rows, best]
            if not live.any():
                return ids, sim
            r = rows[live]
            done[r, best[live]] = True
            near = self.out[ids[r, best[live]]]
            new = (near >= 0) & ~seen[r[:, None], near]
            seen[r[:, None], near] = True
            seen[:, -1] = True
            s = np.einsum("bd,bkd->bk", queries[r], self.x[near])
            s[~new] = -np.inf
            all_ids = np.concatenate([ids[r], np.where(new, near, -1)], 1)
            all_sim = np.concatenate([sim[r], s], 1)
            all_done = np.concatenate([done[r], ~new], 1)
            order = np.argsort(-all_sim, axis=1, kind="stable")[:, :beam]
            ids[r] = np.take_along_axis(all_ids, order, 1)
            sim[r] = np.take_along_axis(all_sim, order, 1)
            done[r] = np.take_along_axis(all_done, order, 1)

    def prune(self, points: np.ndarray, cands: np.ndarray, alpha: float) -> np.ndarray:
        """For each point, up to ``degree`` of its candidates (-1: none), near and in different directions."""
        cands = np.where(cands == points[:, None], -1, cands)
        order = np.argsort(cands, axis=1)
        cands = np.take_along_axis(cands, order, 1)
        cands[:, 1:][cands[:, 1:] == cands[:, :-1]] = -1  # once each
        x = self.x[cands]
        far = 2 - 2 * np.einsum("bd,bkd->bk", self.x[points], x)
        far[cands < 0] = np.inf
        between = 2 - 2 * np.einsum("bid,bjd->bij", x, x, optimize=True)
        rows, out = np.arange(len(points)), np.full((len(points), self.degree), -1, np.int32)
        alive = np.isfinite(far)
        for i in range(self.degree):
            pick = np.argmin(np.where(alive, far, np.inf), axis=1)
            live = alive[rows, pick]
            if not live.any():
                break
            out[live, i] = cands[rows, pick][live]
            alive &= alpha * alpha * between[rows, pick] > far
            alive[rows, pick] = False
        return out

    def _insert(self, points: np.ndarray, alpha: float) -> None:
        found, _ = self.search(self.x[points], self.beam)
        self.out[points] = self.prune(points, np.concatenate([found, self.out[points]], 1), alpha)
        # mirror the edges; points with too many are pruned
        src, dst = np.repeat(points, self.degree), self.out[points].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        targets, begin, count = np.unique(dst, return_index=True, return_counts=True)
        most = int(count.max(initial=0))
        extra = np.full((len(targets), most), -1, np.int64)
        extra[np.repeat(np.arange(len(targets)), count), np.arange(len(dst)) - np.repeat(begin, count)] = src
        both = np.concatenate([self.out[targets], extra], 1)
        held = (both >= 0).sum(axis=1)
        small = held <= self.degree
        packed = np.sort(both[small], axis=1)[:, ::-1][:, : self.degree]
        self.out[targets[small]] = packed
        for part in np.array_split(np.flatnonzero(~small), -(-len(targets) // BATCH)):
            if len(part):
                self.out[targets[part]] = self.prune(targets[part], both[part], alpha)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): the rows that take part, one an id."""
    v = F.col("embedding")
    whole = F.size(v) > 0
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    some = F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col("vec_id").isNotNull() & v.isNotNull() & whole & finite & some).select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v"))
    most = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    return rows.where(F.size("v") == (most[0] if most else 0))


def _matrix(arrays) -> np.ndarray:
    return np.stack([np.asarray(a, np.float64) for a in arrays])


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)


def shards_of(n: int, dim: int) -> int:
    """Shards for ``n`` vectors of ``dim`` numbers."""
    most = max(1, min(MOST_ROWS, MOST_BYTES // (8 * max(dim, 1))))
    return max(1, -(-n // min(most, max(LEAST_ROWS, -(-n // SHARDS)))))


def build(rows: DataFrame, k: int = K) -> tuple[DataFrame, int]:
    """The index (shard, dim, vectors, edges, members, sizes) of usable rows, and its number of shards."""
    own = Window.partitionBy("v").orderBy("vec_id")
    nodes = rows.withColumn("place", F.row_number().over(own)).where(F.col("place") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = stored(nodes, "ann-nodes")
    n, dim = nodes.agg(F.count("*"), F.max(F.size("v"))).first()
    shards = shards_of(n, dim or 0)

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.iloc[np.argsort([i[0] for i in pdf["ids"]])]
        x = _matrix(pdf["v"])
        members = np.full((len(pdf), k + 1), -1, np.int64)
        for i, ids in enumerate(pdf["ids"]):
            members[i, : len(ids)] = ids
        lens = np.array([len(i) for i in pdf["ids"]], np.int32)
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "dim": [x.shape[1]], "vectors": [x.tobytes()], "edges": [Graph(_unit(x)).out.tobytes()], "members": [members.tobytes()], "sizes": [lens.tobytes()]})

    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(shards)).cast("int"))
    # a task a shard, however small the shards are
    return dealt.repartition(shards, "shard").groupBy("shard").applyInPandas(make, "shard int, dim int, vectors binary, edges binary, members binary, sizes binary"), shards


def search(queries: DataFrame, index: DataFrame, shards: int, k: int = K, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest found of each query (vec_id, v)."""
    blocks = max(1, -(-queries.count() // BLOCK_ROWS))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        q = _matrix(pdf["v"])
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "dim": [q.shape[1]], "vectors": [q.tobytes()], "members": [pdf["vec_id"].to_numpy(np.int64).tobytes()]})

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, graph = None, None
        for one in (one for pdf in batches for one in pdf.itertuples()):
            if one.block < 0:  # a shard's graph, ahead of the blocks that ask it
                at = (one.shard, one.copy)
                exact = np.frombuffer(one.vectors, np.float64).reshape(-1, int(one.dim))
                graph = Graph(_unit(exact), np.frombuffer(one.edges, np.int32).reshape(len(exact), -1))
                members, sizes = np.frombuffer(one.members, np.int64).reshape(len(exact), -1), np.frombuffer(one.sizes, np.int32)
                norm = np.sqrt((exact * exact).sum(axis=1))
                continue
            if at != (one.shard, one.copy):
                raise ValueError("a block came without its shard")
            ids, q = np.frombuffer(one.members, np.int64), np.frombuffer(one.vectors, np.float64).reshape(-1, int(one.dim))
            for lo in range(0, len(ids), BATCH):
                part, own = q[lo : lo + BATCH], ids[lo : lo + BATCH]
                found, _ = graph.search(_unit(part), beam)
                found = found[:, : 4 * (k + 1)]
                score = np.einsum("bd,bkd->bk", part, exact[found]) / (norm[found] * np.sqrt((part * part).sum(axis=1))[:, None])
                score[found < 0] = -np.inf
                # each node stands for up to k + 1 ids
                near = members[found]
                valid = (np.arange(members.shape[1]) < sizes[found][..., None]) & (near != own[:, None, None]) & (found >= 0)[..., None]
                near, value = near.reshape(len(own), -1), np.where(valid, score[..., None], -np.inf).reshape(len(own), -1)
                order = np.lexsort((near, -value), axis=1)[:, :k]
                near, value = np.take_along_axis(near, order, 1), np.take_along_axis(value, order, 1)
                some = np.isfinite(value)
                yield pd.DataFrame({"query_id": np.repeat(own, some.sum(axis=1)), "vec_id": near[some], "score": value[some]})

    packed = queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).groupBy("block").applyInPandas(pack, "block int, dim int, vectors binary, members binary")
    # where shards are few, several copies of each share the blocks
    copies = min(blocks, max(1, -(-queries.sparkSession.sparkContext.defaultParallelism // shards)))
    asked = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("copy", F.col("block") % copies)
    none = F.lit(None).cast("binary")
    heads = index.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    columns = ["shard", "copy", "block", "dim", "vectors", "edges", "members", "sizes"]
    both = heads.withColumn("block", F.lit(-1)).select(columns).union(asked.withColumns({"edges": none, "sizes": none}).select(columns))
    finds = both.repartition(shards * copies, "shard", "copy").sortWithinPartitions("shard", "copy", "block").mapInPandas(look, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return finds.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    rows = stored(usable(vectors), "ann-vectors")
    index, shards = build(rows)
    return search(rows.where("vec_id % 50 = 0"), stored(index, "ann-index"), shards)
