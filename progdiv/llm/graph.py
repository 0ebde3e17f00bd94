"""Connected components by repeated contraction, every step a join of distributed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from progdiv.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """id and component (its smallest reachable id) of every vertex of edges (a, b).

    Each round every vertex takes a parent among itself and its neighbours, and edges move to the parents.
    Even rounds take the smallest id, which ends stars at once; odd rounds the least of a hash that
    changes by round, which shortens chains by a constant share. Roots carry the smallest id they stand for.
    """
    rest = materialize(edges.where("a <> b").select("a", "b").distinct(), "edges")
    levels, k = [], 0
    while not rest.isEmpty():
        both = rest.select(F.col("a").alias("v"), F.col("b").alias("w")).union(rest.select("b", "a"))
        rank = F.lit(0).cast("long") if k % 2 == 0 else F.xxhash64("w", F.lit(k))
        own = F.lit(0).cast("long") if k % 2 == 0 else F.xxhash64("v", F.lit(k))
        best = both.groupBy("v").agg(F.min(F.struct(rank.alias("r"), F.col("w").alias("p"))).alias("m"))
        best = best.select("v", F.least(F.col("m"), F.struct(own.alias("r"), F.col("v").alias("p")))["p"].alias("p"))
        best = materialize(best, "parents")
        levels.append(best)
        pa, pb = best.select(F.col("v").alias("a"), F.col("p").alias("pa")), best.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        moved = rest.join(pa, "a").join(pb, "b").where("pa <> pb")
        rest = materialize(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        k += 1
    if not levels:
        return rest.select(F.col("a").alias("id"), F.col("b").alias("component"))
    found = levels[0].select(F.col("v").alias("id"), F.col("p").alias("root"))
    for best in levels[1:]:
        found = found.join(best.select(F.col("v").alias("root"), "p"), "root", "left").select("id", F.coalesce("p", "root").alias("root"))
    found = materialize(found, "roots")
    least = materialize(found.groupBy("root").agg(F.min("id").alias("component")), "least")
    return found.join(least, "root").select("id", "component")
