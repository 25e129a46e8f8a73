"""Connected components of an edge list by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorage.llm.common import discard, stash


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in ``edges`` (a, b), with component the smallest id reachable.

    Every round hooks neighbours to the smallest of their neighbourhood, first
    towards larger ids and then towards smaller ones; the edges become stars in
    O(log^2) rounds.  Edges stay distributed; two numbers a round reach the
    driver.  The least neighbours are written before they are joined, so both
    sides of a join are plain shuffles, of which Spark splits the hub of a star.
    """
    now = stash(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stash(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")))
        larger = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stash(larger.filter("a <> b").distinct())
        nearest = stash(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(nearest, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        later = stash(small.unionByName(nearest.select("a", F.col("m").alias("b"))).distinct())
        discard(now, least, large, nearest)
        now, before, state = later, state, _state(later)
        if state == before:
            break
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
    return row[0], row[1]
