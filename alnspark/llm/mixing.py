"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame functions alone.

A mix has as many words as the corpus.  Each source's target is its share by weight, at most ``REPEATS`` times the words that
it has; what is above is shared again by weight among the others.  The mix is cut into blocks of equally many
words, and blocks go to sources by the highest quotients target / (2 s + 1), then to a source's shards by the same
rule on the words that these hold: integer quotas per shard.  In a shard the documents lie on a ring in a seeded order,
and the shard's blocks are laid around it one after the other from a seeded place, at most ``REPEATS`` times round, so every
word is taken equally often but for one.

Highest quotients are found without making a row for each block: how many quotients lie above a bound is a sum over parties, so a grid of
bounds, narrowed a few times, leaves the few quotients that are ranked in the end.  Equal rows are one unit until the end, and a
source has a shard for about ``SHARD_ROWS`` units (at most ``MOST_SHARDS``), so neither a hot source nor a group of
copies meets in one task.  Sources are one narrow row each.

Defined cases: null or empty texts have no words, and nothing is taken of them; sources go by code point, a null source
last; a null id is an id like others; equal rows share what their unit takes in a fixed order; an
empty corpus gives no rows; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alnspark.llm.common import stored

WEIGHTS, REPEATS, SEED = (5, 2, 1), 3, 11
SHARD_ROWS, MOST_SHARDS = 1_000, 100_000
#: Blocks are at most so long, and short enough for so many in the mean target of a shard.
MOST_WORDS, LEAST_BLOCKS = 1_024, 1_000
#: Bounds tried at once, and how often their range is narrowed.
GRID, PASSES = 32, 5
COPIES = 4_096
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(source, did, size, mark, n): the different rows, with how many of each there are; ``mark`` orders them by seed."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    did = F.col(f"`{id_col}`").cast("long")
    mark = F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce(did.cast("string"), F.lit("")), F.md5(text)))
    rows = docs.select(F.col(f"`{source_col}`").cast("string").alias("source"), did.alias("did"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), mark.alias("mark"))
    return rows.groupBy("source", "did", "size", "mark").agg(F.count("*").alias("n"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> tuple[DataFrame, int]:
    """Add ``number`` (place by code point), ``most`` and ``target`` to (source, words), and the words of all.

    Each round shares what is left by weight and fixes the sources that then reach their bound, until none does."""
    number = (F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1).cast("long")
    weight = F.get(F.array(*map(F.lit, weights)), F.col("number") % len(weights)).cast("long")
    sources = stored(sources.withColumn("number", number).withColumns({"weight": weight, "most": repeats * F.col("words")}), "mix-sources")
    total = sources.agg(F.sum("words")).first()[0] or 0
    level, fixed = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) >= F.col("most")
        n, most, weight = sources.agg(F.count_if(full), F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight")))).first()
        if n == fixed or not weight:
            break
        fixed, level = n, (total - (most or 0)) / weight
    own = F.col("weight") * F.lit(level)
    return sources.withColumn("target", F.when(own >= F.col("most"), F.col("most").cast("double")).otherwise(own)), total


def apportion(parties: DataFrame) -> DataFrame:
    """Add ``quota`` to stored (party, key, votes, most, seats), where ``party`` names a group: of its ``seats`` a key gets those
    with the highest quotients votes / (2 s + 1), at most ``most``; equal quotients go to the smaller key."""
    some = parties.where("votes > 0 AND most > 0").withColumn("votes", F.col("votes").cast("double"))

    def above(bound: Column) -> Column:
        """How many quotients of a key are above half of ``bound``."""
        return F.least(F.col("most"), F.floor(F.col("votes") / bound + 0.5))

    def bound(i: Column) -> Column:
        return F.when(i >= GRID, F.col("lo")).otherwise(F.col("hi") * F.pow(F.col("lo") / F.col("hi"), i / GRID))

    ends = some.groupBy("party").agg((2 * F.max("votes") + 1).alias("hi"), F.min(F.col("votes") / (F.col("most") + 1)).alias("lo"), F.max("seats").alias("room"))
    for _ in range(PASSES):  # hi gives at most the seats, lo at least
        grid = F.explode(F.sequence(F.lit(0), F.lit(GRID)))
        tried = some.join(ends, "party").withColumn("i", grid).groupBy("party", "hi", "lo", "room", "i").agg(F.sum(above(bound(F.col("i")))).alias("given"))
        best = tried.where("given <= room").groupBy("party", "hi", "lo", "room").agg(F.max(F.struct("i", "given")).alias("at"))
        ends = best.select("party", "room", bound(F.col("at.i")).alias("hi"), bound(F.col("at.i") + 1).alias("lo"), "at.given")
    near = stored(some.join(ends, "party").withColumns({"sure": above(F.col("hi")), "able": above(F.col("lo"))}).select("party", "key", "votes", "sure", "able", "room", "given"), "mix-quotients")
    open_ = near.where("able > sure AND given < room").withColumn("turn", F.explode(F.sequence(F.col("sure") + 1, "able")))
    order = Window.partitionBy("party").orderBy(F.desc(F.col("votes") / (2 * F.col("turn") - 1)), "key")  # a few quotients a key
    won = open_.withColumn("rank", F.row_number().over(order)).where("rank <= room - given").groupBy("party", "key").agg(F.count("*").alias("more"))
    quota = near.join(won, ["party", "key"], "left").select("party", "key", (F.col("sure") + F.coalesce("more", F.lit(0))).alias("quota"))
    return parties.join(quota, ["party", "key"], "left").withColumn("quota", F.coalesce("quota", F.lit(0)).cast("long"))


def _number(digest: Column) -> Column:
    """The first eight hex digits as a number."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, block: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row of ``docs``: source, did, mark, size, source_size, target, taken, times and spans.

    The mix takes the whole text ``times`` times, and once more its words of ``spans`` [start, stop)."""
    units = stored(sized(docs, id_col, text_col, source_col), "mix-units")
    sources = units.groupBy("source").agg(F.count("*").alias("units"), F.sum(F.col("size") * F.col("n")).alias("words"))
    sources, total = targets(sources, weights, repeats)
    shards = F.least(F.lit(MOST_SHARDS), F.ceil(F.col("units") / SHARD_ROWS))
    sources = stored(sources.withColumn("shards", shards), "mix-targets")
    if block is None:
        least = sources.where("target > 0").agg(F.min(F.col("target") / F.col("shards"))).first()[0] or 1
        block = 2 ** max(0, min(MOST_WORDS.bit_length(), int(least / LEAST_BLOCKS).bit_length()) - 1)
    blocks = lambda words: F.floor(repeats * F.col(words) / block)
    parties = stored(sources.select(F.lit(0).cast("long").alias("party"), F.col("number").alias("key"), F.col("target").alias("votes"), blocks("words").alias("most"), F.lit(total // block).alias("seats")), "mix-parties")
    quotas = apportion(parties).select(F.col("key").alias("number"), F.col("quota").alias("seats"))
    named = sources.select("source", "number", F.col("words").alias("source_size"), "target", "shards").join(quotas, "number")
    own = units.join(named.withColumnRenamed("source", "named"), F.col("source").eqNullSafe(F.col("named"))).drop("named")
    own = stored(own.withColumn("shard", _number(F.col("mark")) % F.col("shards")), "mix-own")
    held = own.groupBy("number", "shard").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.max("seats").alias("seats"))
    parties = stored(held.select(F.col("number").alias("party"), F.col("shard").alias("key"), F.col("words").alias("votes"), blocks("words").alias("most"), "seats"), "mix-shards")
    start = F.when(F.col("votes") > 0, _number(F.md5(F.concat_ws(":", F.lit(SEED), "party", "key"))) % F.col("votes")).otherwise(0)
    rings = apportion(parties).select(F.col("party").alias("number"), F.col("key").alias("shard"), F.col("votes").alias("words"), (F.col("quota") * block).alias("length"), start.alias("at"))
    before = Window.partitionBy("number", "shard").orderBy("mark", F.col("did").isNull(), "did", "size")
    placed = own.withColumn("begin", F.sum(F.col("size") * F.col("n")).over(before) - F.col("size") * F.col("n")).join(rings, ["number", "shard"])
    return _copies(stored(placed, "mix-placed"))


def _copies(placed: DataFrame) -> DataFrame:
    """A row for each of the equal rows of a unit; very many are dealt before they are made."""
    many = placed.where(F.col("n") > COPIES).withColumn("lot", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / COPIES))))
    lots = placed.where(F.col("n") <= COPIES).withColumn("lot", F.lit(0).cast("long")).unionByName(many.repartition(F.col("mark"), F.col("lot")))
    first = F.col("lot") * COPIES
    rows = lots.withColumn("copy", F.explode(F.sequence(first, F.least(first + COPIES, F.col("n")) - 1)))
    a = F.col("begin") + F.col("copy") * F.col("size")
    rest, words = F.when(F.col("words") > 0, F.col("length") % F.col("words")).otherwise(0), F.col("words")
    stop = F.col("at") + rest

    def part(lo: Column, hi: Column) -> Column:
        lo, hi = F.greatest(lo - a, F.lit(0)), F.least(hi - a, F.col("size"))
        return F.struct(lo.cast("long").alias("start"), F.greatest(lo, hi).cast("long").alias("stop"))

    arcs = F.array(part(F.lit(0), stop - words), part(F.col("at"), F.least(stop, words)))
    spans = F.filter(arcs, lambda x: x["start"] < x["stop"])
    times = F.when(words > 0, F.floor(F.col("length") / words)).otherwise(0).cast("long")
    rows = rows.withColumns({"times": times, "spans": spans})
    more = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"])
    return rows.select("source", "did", "mark", "size", "source_size", "target", (F.col("times") * F.col("size") + more).alias("taken"), "times", "spans")


def texts(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(source, did, text) of the mix that ``mix(docs)`` planned: whole texts, and parts as words joined by a space."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    did = F.col(f"`{id_col}`").cast("long")
    own = docs.select(F.col(f"`{source_col}`").cast("string").alias("source"), did.alias("did"), F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce(did.cast("string"), F.lit("")), F.md5(text))).alias("mark"), text.alias("text"))
    own = own.dropDuplicates(["source", "did", "mark"]).alias("x")
    plan = mixed.where("taken > 0").alias("y")
    both = own.join(plan, (F.col("x.mark") == F.col("y.mark")) & F.col("x.did").eqNullSafe(F.col("y.did")) & F.col("x.source").eqNullSafe(F.col("y.source")))
    words = F.regexp_extract_all("x.text", F.lit(WORD), F.lit(0))
    parts = F.transform("y.spans", lambda s: F.array_join(F.slice(words, (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")), " "))
    return both.select("x.source", "x.did", F.explode(F.concat(F.array_repeat(F.col("x.text"), F.col("y.times").cast("int")), parts)).alias("text"))


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return mix(docs).select(F.col("did").alias("doc_id"), "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT source, doc_id, len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS size,
    md5('11:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS mark FROM documents),
g AS (SELECT source, count(DISTINCT (doc_id, size, mark)) AS units, sum(size) AS words FROM d GROUP BY source),
s AS (
  SELECT source, CAST(words AS BIGINT) AS words, least(100000, CAST(ceil(units / 1000) AS BIGINT)) AS shards, row_number() OVER o - 1 AS number,
    [5, 2, 1][(row_number() OVER o - 1) % 3 + 1] AS weight, CAST(3 * words AS BIGINT) AS most, CAST(sum(words) OVER () AS BIGINT) AS total
  FROM g WINDOW o AS (ORDER BY source IS NULL, source)),
l AS (  -- sources that reach their bound first come first; the level is that of the first which does not
  SELECT most, weight, CAST(total - coalesce(sum(most) OVER (p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
      / CAST(sum(weight) OVER (p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level, row_number() OVER p AS i
  FROM s WINDOW p AS (ORDER BY most / weight, number)),
t AS (SELECT s.*, CASE WHEN weight * level >= most THEN CAST(most AS DOUBLE) ELSE weight * level END AS target FROM s, (SELECT coalesce(arg_min(level, i), 0) AS level FROM l WHERE most > weight * level)),
b AS (SELECT CAST(2 ** greatest(0, floor(log2(least(1024, greatest(1, floor(min(target / shards) / 1000)))))) AS BIGINT) AS block FROM t WHERE target > 0),
q AS (
  SELECT number, count(*) AS quota FROM (
    SELECT number, row_number() OVER (ORDER BY target / (2 * j + 1) DESC, number) AS i, total // block AS seats
    FROM (SELECT number, target, total, block, unnest(range(3 * words // block)) AS j FROM t, b))
  WHERE i <= seats GROUP BY number),
u AS (SELECT t.number, doc_id, size, mark, words AS source_size, target, CAST('0x' || substr(mark, 1, 8) AS BIGINT) % shards AS shard FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
h AS (SELECT number, shard, CAST(sum(size) AS BIGINT) AS words FROM u GROUP BY number, shard),
r AS (
  SELECT number, shard, count(*) AS n FROM (
    SELECT number, shard, quota, row_number() OVER (PARTITION BY number ORDER BY CAST(words AS DOUBLE) / (2 * j + 1) DESC, shard) AS i
    FROM (SELECT h.number, shard, words, quota, unnest(range(3 * words // block)) AS j FROM h JOIN q ON h.number = q.number, b))
  WHERE i <= quota GROUP BY number, shard),
c AS (SELECT h.number, h.shard, words, coalesce(n, 0) * block AS length, CAST('0x' || substr(md5('11:' || h.number || ':' || h.shard), 1, 8) AS BIGINT) % nullif(words, 0) AS place
  FROM h LEFT JOIN r ON h.number = r.number AND h.shard = r.shard, b),
w AS (
  SELECT u.*, c.words, length, place, place + length % nullif(c.words, 0) AS stop,
    CAST(sum(size) OVER (PARTITION BY u.number, u.shard ORDER BY mark, doc_id IS NULL, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - size AS a
  FROM u LEFT JOIN c ON u.number = c.number AND u.shard = c.shard)
SELECT doc_id, size, source_size, target, CASE WHEN size = 0 THEN 0 ELSE CAST(size * (length // words)
  + greatest(0, least(a + size, stop, words) - greatest(a, place)) + greatest(0, least(a + size, stop - words) - a) AS BIGINT) END AS taken
FROM w
"""
