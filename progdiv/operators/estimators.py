"""Uncertainty estimates from similarities, scores and log-likelihoods."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from progdiv.operators import spectral


#: Log-likelihoods are added up by stretches of so many, whose exponentials are in the range of doubles.
STRETCH = 64


def semantic_entropy(scores: DataFrame, keys: list[str], output: str, nll: str) -> DataFrame:
    """Groups of equal outputs join their likelihoods (log-sum-exp of nll); minus their mean.

    Likelihoods are added up by stretches of nll from which the stretch's start is taken, so scores are not joined with their
    group's greatest: that scales the few sums of the stretches."""
    rows = scores.select(*keys, output, F.col(nll).cast("double").alias("_x")).withColumn("_e", F.floor(F.col("_x") / STRETCH).cast("double") * STRETCH)
    sums = rows.groupBy(*keys, output, "_e").agg(F.max("_x").alias("_top"), F.sum(F.exp(F.col("_x") - F.col("_e"))).alias("_s"))
    parts = sums.groupBy(*keys, output).agg(F.max("_top").alias("_top"), F.collect_list(F.struct("_e", "_s")).alias("_p"))
    total = F.aggregate(F.filter("_p", lambda p: p["_s"].isNotNull()), F.lit(0.0), lambda a, p: a + p["_s"] * F.exp(p["_e"] - F.col("_top")))
    return parts.groupBy(*keys).agg((-F.avg(F.col("_top") + F.ln(total))).alias("semantic_entropy"))


def sequence_nll(average: Column, length: Column) -> Column:
    return average * length


def pointwise_information(nll: Column, unconditional: Column) -> Column:
    return unconditional - nll


def degree(similarities: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Confidence of each i (mean similarity to all j), and the group's uncertainty 1/n - sum / n^2.

    Rows (keys, i, j, sim) hold both directions and the diagonal; pairs that are not there have similarity 0.
    """
    n = similarities.groupBy(*keys).agg(F.count_distinct("i").alias("_n"))
    each = similarities.groupBy(*keys, "i").agg(F.sum("sim").alias("_s")).join(n, keys).select(*keys, "i", (F.col("_s") / F.col("_n")).alias("confidence"))
    n = F.count_distinct("i")
    return each, similarities.groupBy(*keys).agg((1 / n - F.sum("sim") / (n * n)).alias("uncertainty"))


def _laplacian(group: pd.DataFrame) -> tuple[list, np.ndarray, np.ndarray]:
    names = sorted(group["i"].unique())
    at = {k: p for p, k in enumerate(names)}
    w = np.zeros((len(names), len(names)))
    w[group["i"].map(at), group["j"].map(at)] = group["sim"]
    w = (w + w.T) / 2
    d = np.maximum(w.sum(axis=1), 1e-12)
    lap = np.eye(len(names)) - w / np.sqrt(d[:, None] * d[None, :])
    values, vectors = np.linalg.eigh(lap)
    return names, values, vectors


def eccentricity(similarities: DataFrame, keys: list[str], key_ddl: str, threshold: float = 0.1, dense: int = spectral.DENSE) -> DataFrame:
    """Of each i minus its distance from the group's centre in the span of the Laplacian's eigenvectors with values
    under threshold; and the group's uncertainty, the 2-norm of all distances clipped to [-1, 1].

    Groups of at most dense members have their matrix in one task; larger ones stay edges, whose eigenvectors come from joins
    and sums (spectral.top_space)."""

    def run(key, group):
        names, values, vectors = _laplacian(group)
        kept = vectors[:, values < threshold] if (values < threshold).any() else vectors[:, :1]
        off = kept - kept.mean(axis=0)
        out = pd.DataFrame({"i": names, "confidence": -np.linalg.norm(off, axis=1), "uncertainty": float(np.clip(np.linalg.norm(off, 2), -1, 1))})
        return out.assign(**dict(zip(keys, key, strict=True)))[[*keys, "i", "confidence", "uncertainty"]]

    n = similarities.groupBy(*keys).agg(F.count_distinct("i").alias("_n"))
    small = similarities.join(n.where(F.col("_n") <= dense).drop("_n"), keys, "left_semi")
    out = small.groupBy(*keys).applyInPandas(run, f"{key_ddl}, i bigint, confidence double, uncertainty double")
    large = similarities.join(n.where(F.col("_n") > dense).drop("_n"), keys, "left_semi")
    if large.isEmpty():
        return out
    return out.union(spectral.eccentricity_of_edges(large, keys, threshold).select(out.columns))


def spectral_trace(similarities: DataFrame, keys: list[str]) -> DataFrame:
    """spectral_eigenvalues of similarities without negative eigenvalues, as those of sets by Jaccard are: then 1 - e is never
    negative and the sum is the trace of the normalised matrix, which takes the degrees and the diagonal alone."""
    each = similarities.groupBy(*keys, "i").agg(F.sum("sim").alias("d"), F.sum(F.when(F.col("i") == F.col("j"), F.col("sim"))).alias("own"))
    return each.groupBy(*keys).agg(F.sum(F.coalesce("own", F.lit(0.0)) / F.greatest("d", F.lit(1e-12))).alias("spectral_eigv"))


def spectral_eigenvalues(similarities: DataFrame, keys: list[str], key_ddl: str, low: float = 0.0) -> DataFrame:
    """Sum over the Laplacian's eigenvalues e of max(1 - e, low): a soft count of meanings."""

    def run(key, group):
        _, values, _ = _laplacian(group)
        out = pd.DataFrame({"spectral_eigv": [float(np.maximum(1 - values, low).sum())]})
        return out.assign(**dict(zip(keys, key, strict=True)))[[*keys, "spectral_eigv"]]

    return similarities.groupBy(*keys).applyInPandas(run, f"{key_ddl}, spectral_eigv double")


def jaccard_similarities(frame: DataFrame, keys: list[str], member: str, tokens: str) -> DataFrame:
    """Similarities of ordered pairs of a group by the share of common tokens, the diagonal being 1; pairs without any in common
    are not there."""
    from progdiv.operators.lexical import gram_sets
    from progdiv.operators.overlap import set_sizes, shared

    sets = gram_sets(frame, keys, member, tokens, 1)
    sizes = set_sizes(sets, keys, member)
    a = sizes.select(*keys, F.col(member).alias("a"), F.col("size").alias("sa"))
    b = sizes.select(*keys, F.col(member).alias("b"), F.col("size").alias("sb"))
    near = shared(sets, keys, member).join(a, [*keys, "a"]).join(b, [*keys, "b"])
    sim = (F.col("shared") / (F.col("sa") + F.col("sb") - F.col("shared"))).alias("sim")
    ways = F.explode(F.array(F.struct(F.col("a").alias("i"), F.col("b").alias("j")), F.struct(F.col("b").alias("i"), F.col("a").alias("j")))).alias("p")
    near = near.select(*keys, ways, sim).select(*keys, "p.i", "p.j", "sim")
    return near.union(sizes.select(*keys, F.col(member).alias("i"), F.col(member).alias("j"), F.lit(1.0).alias("sim")))
