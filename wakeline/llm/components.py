"""Connected components of an edge table by alternating stars, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import staged


def _lowest(both: DataFrame) -> DataFrame:
    """``u, m``: the lowest of a node and its neighbours. A hub's rows meet map-side first."""
    return both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """``node, component`` (its lowest node) for every node that an edge ``a, b`` touches.

    Each round links a node's larger neighbours to the lowest one, then its smaller neighbours, and
    writes the edges to the shared folder; it ends when a round changes nothing, which for n nodes
    takes about log n rounds. Null ends are no edges; loops and repeats do not matter; no edges give
    no rows. Raises if ``rounds`` do not suffice rather than return components cut short.
    """
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).na.drop()
    loops = staged(now.filter("u = v").select("u").distinct(), "loops", narrow=True)
    now = staged(now.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", narrow=True)
    before = None if not now.isEmpty() else (0, None, None)
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_lowest(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(_lowest(large), "u")
        small = small.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        now = staged(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u <> v").distinct(), "edges", narrow=True)
        state = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node")).distinct()
    alone = loops.select(F.col("u").alias("node")).join(now.select(F.col("u").alias("node")).union(roots).distinct(), "node", "left_anti")
    return found.unionByName(roots.unionByName(alone).select("node", F.col("node").alias("component")))
