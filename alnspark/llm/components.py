"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alnspark.llm.common import stored


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Large star: link a node's larger neighbours to the least it knows; small star: its smaller ones and itself."""
    both = links.union(links.select("b", "a").toDF("a", "b")) if large else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    if large:
        moved = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = both.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return moved.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); the root is the component's least node."""
    links = stored(links.select("a", "b").where("a <> b").distinct(), "links")
    while True:
        done = stored(_star(_star(links, True), False), "stars")
        # settled once every node has one link and no root has a root
        moved = done.groupBy("a").count().where("count > 1").select("a").union(done.select(F.col("b").alias("a")).distinct().join(done.select("a").distinct(), "a", "left_semi"))
        if moved.isEmpty():
            break
        links = done
    return done.select(F.col("a").alias("node"), F.col("b").alias("root")).union(done.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
