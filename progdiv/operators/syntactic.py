"""Syntactic diversity from subtree rows (functions.pyast.subtree_rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from progdiv.operators.lexical import uniforms
from progdiv.operators.overlap import alike, bootstrap_pairs, sampled_pairs

GROUP = ["variant", "height"]


def distinct_subtrees(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct of all subtrees of exactly a height; null for at most one."""
    per = rows.where("g IS NOT NULL").groupBy(*keys, *GROUP, "g").agg(F.sum("c").alias("c"))
    agg = per.groupBy(*keys, *GROUP).agg(F.count("*").alias("n_distinct"), F.sum("c").alias("n_total"))
    all_ = rows.select(*keys, *GROUP).distinct().join(agg, [*keys, *GROUP], "left").fillna(0, ["n_distinct", "n_total"])
    return all_.withColumn("prop_distinct", F.when(F.col("n_total") > 1, F.col("n_distinct") / F.col("n_total")))


def jaccard_subtrees(rows: DataFrame, keys: list[str], member: str) -> DataFrame:
    """Mean over pairs of 1 - shared / all subtrees of a height; pairs without any at all don't count."""
    keys = [*keys, *GROUP]
    near = alike(rows.where("g IS NOT NULL"), keys, member).withColumnRenamed("n", "n_full")
    members = rows.groupBy(*keys).agg(F.count_distinct(member).alias("n"))
    empty = F.col("n") - F.coalesce("n_full", F.lit(0))
    pairs = F.col("n") * (F.col("n") - 1) / 2 - empty * (empty - 1) / 2
    out = members.join(near, keys, "left")
    return out.select(*keys, "n", F.when(F.col("n") > 1, 1 - F.try_divide(F.coalesce("alike", F.lit(0.0)), pairs)).alias("jaccard"))


def bootstrap_subtrees(rows: DataFrame, keys: list[str], member: str, iterations: int = 300, seed: int = 42) -> DataFrame:
    return bootstrap_pairs(rows.where("g IS NOT NULL"), [*keys, *GROUP], member, uniforms(iterations, 2, seed))


def sampled_jaccard_subtrees(rows: DataFrame, keys: list[str], member: str, iterations: int = 300, seed: int = 42) -> DataFrame:
    """Mean over iterations of the Jaccard distance of two members drawn with replacement of all that parse; pairs without any
    subtree of a height don't count."""
    return sampled_pairs(rows, [*keys, *GROUP], member, uniforms(iterations, 2, seed))
