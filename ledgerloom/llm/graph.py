"""Connected groups of an undirected graph given as edges, by alternating star steps.

Each step is two aggregations and joins over the edges; hot vertices are met by
partial aggregation (the smallest neighbour) and by splitting skewed joins,
never by collecting a neighbourhood. Every round is staged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import stage

MAX_ROUNDS = 40


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every vertex of ``edges(a, b)``; root is its group's smallest id.

    Self loops and repeated edges do no harm; null ends are left out.
    """
    e = edges.select("a", "b").dropna().where("a <> b")
    e = stage(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
              "edges")                                   # a < b
    state = _state(e)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        # Large star: every vertex passes its smallest neighbour (or itself) to larger ones.
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("v"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, F.col("a") == F.col("v")) \
            .select(F.col("m").alias("a"), "b").distinct()
        # Small star: every vertex joins its smaller neighbours to the smallest of them.
        low = large.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("v"), "m")
        joined = large.join(low, F.col("b") == F.col("v"))
        small = joined.select(F.col("m").alias("a"), F.col("a").alias("b")).where("a <> b") \
            .unionByName(low.select(F.col("m").alias("a"), F.col("v").alias("b")))
        e = stage(small.select("a", "b").distinct(), "edges")
        now = _state(e)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("connected groups did not settle")
    return e.select(F.col("b").alias("id"), F.col("a").alias("root")).unionByName(
        e.select(F.col("a").alias("id"), F.col("a").alias("root")).distinct())


def _state(e: DataFrame):
    r = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0] or 0, r[1]
