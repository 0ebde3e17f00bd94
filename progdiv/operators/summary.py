"""Roll-ups: long metric tables, describe, leaderboard, rates and regressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def to_long(metrics: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    return metrics.select(*keys, *(F.col(n).cast("double") for n in names)).unpivot(keys, names, "metric", "value")


def describe(long: DataFrame, keys: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles (linear) and max of value by keys; nulls and NaN are dropped."""
    v = F.when(~F.isnan("value"), F.col("value"))
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = long.groupBy(*keys).agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), q.alias("q"), F.max(v).alias("max"))
    return out.select(*keys, "count", "mean", "std", "min", *(F.element_at("q", i + 1).alias(n) for i, n in enumerate(("q25", "q50", "q75"))), "max")


def scaled(metric: Column, value: Column) -> Column:
    """As the leaderboard shows it: counts to 2 places, shares in percent to 2 places."""
    return F.when(metric.contains("semantic_count"), F.round(value, 2)).otherwise(F.round(value * 100, 2))


def leaderboard(experiments: DataFrame, stats: DataFrame, names: list[str]) -> DataFrame:
    """A row an experiment with its stats as strings: NOT_FOUND where one is missing, ERROR where all failed.

    experiments: experiment_id, failed and base columns; stats: experiment_id, metric, value.
    """
    shown = stats.withColumn("shown", scaled(F.col("metric"), F.col("value")).cast("string"))
    wide = shown.groupBy("experiment_id").pivot("metric", names).agg(F.first("shown"))
    out = experiments.join(wide, "experiment_id", "left")
    return out.withColumns({n: F.when(F.col("failed"), "ERROR").otherwise(F.coalesce(n, F.lit("NOT_FOUND"))) for n in names})


def solve_rate(submissions: DataFrame, keys: list[str], accepted: Column) -> DataFrame:
    return submissions.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(accepted.cast("double")).alias("solve_rate"))


def threshold_survival(rates: DataFrame, rate: str = "solve_rate", step: int = 5) -> DataFrame:
    """For thresholds 0, step .. 100: how many and what share of rows have a rate above; one pass, no join."""
    steps = range(0, 101, step)
    agg = rates.agg(F.count("*").alias("n"), *(F.count_if(F.col(rate) > t / 100).alias(f"c{t}") for t in steps))
    rows = agg.select("n", F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"c{t}").alias("n_above")) for t in steps))).alias("x"))
    return rows.select("x.threshold", "x.n_above", F.try_divide("x.n_above", "n").alias("share_above"))


def regression(points: DataFrame, keys: list[str], y: str, x: str) -> DataFrame:
    return points.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(y, x).alias("r"), _slope_error(y, x).alias("stderr"), correlation_p(F.corr(y, x), F.count("*") - 2).alias("p"))


#: Degrees of freedom up to which a t distribution is summed term by term.
_SUMMED = 2000


def _normal_p(z: Column) -> Column:
    """P(|N(0, 1)| > z) for z from 0, by the rational form of Abramowitz and Stegun, 7.1.26 (right to 2e-7)."""
    x = z / F.lit(2.0**0.5)
    t = 1.0 / (1.0 + 0.3275911 * x)
    return t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)


def correlation_p(r: Column, freedom: Column) -> Column:
    """Two-sided p of a correlation, or of its slope, under no relation: Student's t with so many degrees of freedom; null for
    none.

    With t = r sqrt(f / (1 - r^2)) the distribution is a finite sum in r; beyond _SUMMED degrees Wallace's normal form is right to 1e-6.
    """
    s = F.least(F.abs(r), F.lit(1.0))
    rest = 1 - s * s
    odd = (freedom % 2).cast("int")
    terms = F.floor((F.least(freedom, F.lit(_SUMMED)) - odd) / 2).cast("int")  # even: all terms; odd: the angle and one less
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"))

    def step(a: Column, j: Column) -> Column:
        grown = a["term"] * rest * (2 * j - 1 + odd) / (2 * j + odd)
        return F.struct(grown.alias("term"), (a["sum"] + a["term"]).alias("sum"))

    steps = F.when(terms > 0, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(steps, start, step, lambda a: a["sum"])
    within = F.when(odd == 0, s * total).otherwise((F.asin(s) + s * F.sqrt(rest) * total) * F.lit(2 / math.pi))
    z = (8 * freedom + 1) / (8 * freedom + 3) * F.sqrt(-freedom * F.ln(rest))
    far = F.when(rest > 0, _normal_p(z)).otherwise(0.0)
    return F.when((freedom > 0) & r.isNotNull(), F.when(freedom > _SUMMED, far).otherwise(F.greatest(1 - within, F.lit(0.0))))


def _slope_error(y: str, x: str) -> Column:
    """Standard error of the slope; null for fewer than three points or equal x."""
    rest = F.greatest(F.regr_syy(y, x) - F.regr_slope(y, x) * F.regr_sxy(y, x), F.lit(0.0))
    return F.sqrt(F.try_divide(F.try_divide(rest, F.count("*") - 2), F.regr_sxx(y, x)))


def histogram(frame: DataFrame, column: str, low: float, high: float, bins: int = 10) -> DataFrame:
    """Counts of equal bins over [low, high], the last one closed."""
    at = F.least(F.floor((F.col(column) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return frame.where(F.col(column).between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def box_stats(frame: DataFrame, keys: list[str], column: str) -> DataFrame:
    q = F.percentile(column, F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0))))
    return frame.groupBy(*keys).agg(q.alias("q")).select(*keys, *(F.element_at("q", i + 1).alias(n) for i, n in enumerate(("low", "q25", "median", "q75", "high"))))


def group_borders(frame: DataFrame, keys: list[str], order: list[str], column: str) -> DataFrame:
    """Whether a row's value differs from the row before in its table (keys); the first is a border."""
    before = F.lag(column).over(Window.partitionBy(*keys).orderBy(*order))
    return frame.withColumn("border", F.coalesce(before != F.col(column), F.lit(True)))


def custom_rank(column: Column, values: list[str]) -> Column:
    """Place in a list; null (sorted last) for others."""
    place = F.array_position(F.array(*map(F.lit, values)), column)
    return F.when(place > 0, place)


def derived_ratios(stats: DataFrame, cosine: str, coherent: str, count: str, generations: int = 30) -> DataFrame:
    """What the analysis derives: cosine distance weighted by the coherent percentage, and clusters of all generations in percent."""
    weighted = F.col(cosine) * (F.col(coherent) / 100)
    return stats.withColumns({"heuristic_cosine": weighted, "semantic_share": F.round(F.col(count) / generations, 4) * 100})
