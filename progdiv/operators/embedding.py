"""Embedding diversity: mean pairwise cosine distance in closed form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cosine_distance(vectors: DataFrame, keys: list[str], column: str = "embedding", dropped: str | None = None, null_value: float | None = None) -> DataFrame:
    """n and cosine_distance by group: the mean over pairs of 1 - cos, from the sum of unit vectors.

    Sum of cosines = (|sum u|^2 - sum |u|^2) / 2, so rows are added up by dimension before any shuffle of pairs.
    With null_value, `dropped` (a count column of the group) documents without embedding count as that many further
    terms of that value. Null for no vectors, for one without dropped documents, and if a vector is zero.
    """
    v = F.transform(column, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    rows = vectors.select(*keys, *([dropped] if dropped else []), v.alias("v")).withColumn("norm", norm)
    heads = rows.groupBy(*keys).agg(F.count("v").alias("n"), F.min("norm").alias("least"), *([F.first(dropped).alias("_dropped")] if dropped else [F.lit(0).alias("_dropped")]))
    dims = rows.where("norm > 0").select(*keys, F.posexplode(F.transform("v", lambda x: x / F.col("norm"))).alias("dim", "u"))
    sums = dims.groupBy(*keys, "dim").agg(F.sum("u").alias("s"), F.sum(F.col("u") * F.col("u")).alias("q"))
    sums = sums.groupBy(*keys).agg(F.sum(F.col("s") * F.col("s")).alias("square"), F.sum("q").alias("own"))
    n = F.col("n")
    pairs = n * (n - 1) / 2
    total = pairs - (F.col("square") - F.col("own")) / 2
    extra = F.coalesce("_dropped", F.lit(0)) if null_value is not None else F.lit(0)
    value = F.try_divide(total + extra * (null_value or 0.0), pairs + extra)
    return heads.join(sums, keys, "left").select(*keys, "n", F.when(F.col("least") > 0, value).alias("cosine_distance"))
