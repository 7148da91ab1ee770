"""Connected components of an edge table by large and small stars; every round is a few shuffles, nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from milaan.llm.common import Scratch

# A vertex with more than one in HUBS of all edge ends is joined by broadcast instead of by a shuffle on it; there are at most
# HUBS of them in any graph, so that is the bound of what is sent.
HUBS = 4096


def _star(edges: DataFrame, ends: int, keep, least_of_all: bool) -> DataFrame:
    """Point the neighbours that ``keep`` names, seen from every vertex u, at the least vertex around u."""
    least = edges.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"), F.count("v").alias("degree")).withColumn("m", F.least("m", "w"))
    at, hub = F.col("u") == F.col("w"), F.col("degree") > ends // HUBS
    hubs = F.broadcast(least.filter(hub))
    few = edges.join(hubs, at, "left_anti").join(least.filter(~hub), at)
    met = edges.join(hubs, at).unionByName(few)
    out = met.filter(keep).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if least_of_all:
        out = out.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(u, v) pairs of long numbers -> (id, root): every vertex of an edge but the roots, with the least id of its component.

    Rounds go on until one changes nothing; every round but the last brings vertices nearer to their root, so they end.  Each
    round drops the tables of the one before; the result reads the last one.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    now = scratch.written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "stars")
    state = None
    while True:
        seen = now.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            return now.select(F.col("u").alias("id"), F.col("v").alias("root"))
        state = seen
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = scratch.written(_star(both, 2 * seen[0], F.col("v") > F.col("u"), False), "stars")
        small = scratch.written(_star(large, large.count(), F.lit(True), True), "stars")
        scratch.drop(now, large)
        now = small
