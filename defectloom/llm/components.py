"""Connected components by alternating large and small stars, with edges in the shared folder between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from defectloom.llm.common import checkpointed


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return both.join(least, F.col("a") == F.col("u")).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
    moved = edges.join(least, F.col("a") == F.col("u")).where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (id, component) for all ids in ``edges`` (a, b): the smallest id that links lead to.

    Rounds end when the edges are stars that no longer change. Loops and
    repeated edges do no harm; no edges give no rows.
    """

    def state(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    cur = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    was = state(cur)
    for _ in range(max_rounds):
        if not was[0]:
            break
        cur = checkpointed(_small_star(_large_star(cur)))
        now = state(cur)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("components did not settle")
    found = cur.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return found.unionByName(cur.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
