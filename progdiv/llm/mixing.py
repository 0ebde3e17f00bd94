"""Mixing sources to target weights.

Tokens are totalled per source, targets follow from weights under a cap on repetition, and each document
is emitted floor(rate) times plus one hash-seeded Bernoulli copy whose probability is the rate's fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from progdiv.llm.common import hash_key, materialize, word_count

#: Weights of the sources in code point order (null last), repeating.
WEIGHTS = (3.0, 1.0, 2.0)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, target of a table with source and size.

    The budget is a multiple of all sizes. A target is min(weight * level, cap * source size); the level is
    where they add up to the budget, which is what resharing the excess by weight ends in. It is found from
    running sums over the sources ordered by the level at which each reaches its cap. One row a source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = _before(per, [F.col("source").asc_nulls_last()], place=F.lit(1))
    position = F.pmod(F.col("place"), F.lit(len(weights))).cast("int") + 1
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), position))
    per = per.withColumn("most", cap * F.col("source_size")).withColumn("full_at", F.col("most") / F.col("weight"))
    per = _before(per, [F.col("full_at"), F.col("source").asc_nulls_last()], most_before=F.col("most"), weight_before=F.col("weight"))
    whole = per.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    left = F.lit(budget * (whole["size"] or 0)) - F.col("most_before")
    per = per.withColumn("level", F.try_divide(left, F.lit(float(whole["weight"] or 0)) - F.col("weight_before")))
    first = per.where(F.col("full_at") > F.col("level")).agg(F.min(F.struct("full_at", F.col("source").isNull().alias("last"), "source", "level")).alias("s")).first()["s"]
    target = F.least(F.col("weight") * F.lit(first["level"] if first else float("inf")), F.col("most"))
    return per.select("source", "source_size", target.alias("target"))


def _before(rows: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """Adds each sum over the rows before, in an order over all rows: within ranges, and over the ranges' totals."""
    rows = materialize(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranges = Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    totals = rows.groupBy(F.col("_range").alias("_at")).agg(*(F.sum(c).alias(f"_{k}") for k, c in sums.items()))
    totals = totals.select("_at", *(F.coalesce(F.sum(f"_{k}").over(ranges), F.lit(0)).alias(f"_{k}") for k in sums))
    rows = rows.select("*", *(F.coalesce(F.sum(c).over(own), F.lit(0)).alias(k) for k, c in sums.items()))
    rows = rows.join(totals, F.col("_range") == F.col("_at"))
    return rows.select(*(c for c in rows.columns if c not in ("_range", "_at", *sums, *(f"_{k}" for k in sums))), *((F.col(k) + F.col(f"_{k}")).alias(k) for k in sums))


def copies(rate: Column, *key: Column) -> Column:
    whole = F.floor(rate)
    return whole + (hash_key(*key) < rate - whole).cast("long")


#: Slices over which equal rows are numbered.
_SLICES = 256


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds _draw, the hash of doc_id, source and text_hash, and _nth: 0, 1, ... among rows that are equal in those.

    Rows are numbered within slices and by the slices' counts, so no task has all rows of a common text. Which of equal
    rows gets which number does not matter."""
    rows = rows.withColumn("_draw", F.xxhash64("doc_id", F.lit(0), "_text", F.lit(1), "source"))
    if rows.groupBy("_draw").count().where("count > 1").isEmpty():
        return rows.withColumn("_nth", F.lit(0).cast("long"))
    rows = materialize(rows.withColumn("_slice", F.pmod(F.monotonically_increasing_id(), F.lit(_SLICES))), "slices")
    before = Window.partitionBy("_d").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(F.col("_draw").alias("_d"), F.col("_slice").alias("_s")).count()
    counts = counts.select("_d", "_s", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_draw", "_slice").orderBy(F.lit(0))) - 1
    rows = rows.withColumn("_own", own).join(counts, (F.col("_draw") == F.col("_d")) & (F.col("_slice") == F.col("_s")))
    return materialize(rows.withColumn("_nth", F.col("_before") + F.col("_own")).drop("_d", "_s", "_slice", "_before", "_own"), "numbered")


def source_plan(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = 1.5, cap: float = 2.0, seeds: int = 32) -> tuple[DataFrame, DataFrame]:
    """Rows of sizes with source_size, target and rate; and source, rate and seed of each source.

    Of `seeds` hash seeds each source gets the one whose draws come nearest to its target, so that small
    sources do not stray; every copy is still one Bernoulli draw by that seed. The choice binds the draws of a source to
    each other: in one of a few documents a copy's chance can be off the rate's fraction, in large ones all seeds
    come near the target and the choice changes next to nothing.
    """
    t = source_targets(sizes, weights, budget, cap).withColumnRenamed("source", "t_source")
    joined = sizes.join(t, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = materialize(joined.withColumn("rate", F.least(rate, F.lit(cap))), "rates")
    taken = [F.sum(F.col("size") * _copies(F.lit(k))).alias(f"s{k}") for k in range(seeds)]
    tried = joined.groupBy("source").agg(F.first("target").alias("target"), F.first("rate").alias("rate"), *taken)
    off = F.array_min(F.array(*(F.struct(F.abs(F.col(f"s{k}") - F.col("target")).alias("off"), F.lit(k).alias("seed")) for k in range(seeds))))
    return joined, tried.select("source", "rate", off["seed"].alias("seed"))


def _copies(seed: Column, rate: str = "rate") -> Column:
    return copies(F.col(rate), F.col("_draw"), F.col("_nth"), seed)


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _sizes(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _text_hash().alias("_text"))
    return _numbered(materialize(rows, "sizes"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: one row a document.

    size is the number of words. A null text has size 0 and takes no words; null sources are one source, the
    last. Draws depend on doc_id, source and text, and among rows equal in those on their number, so rows without doc_id
    and rows that repeat one are drawn each. Long texts count by their words; other columns don't matter; an empty table
    gives no rows. Reruns agree.
    """
    rows, plan = source_plan(_sizes(docs), weights, budget, cap)
    best = plan.select(F.col("source").alias("b_source"), "seed")
    out = rows.join(best, F.col("source").eqNullSafe(F.col("b_source"))).withColumn("copies", _copies(F.col("seed")))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """docs with each row as often as the mix takes it, by the same draws as mix_sources."""
    columns = docs.columns
    _, plan = source_plan(_sizes(docs), weights, budget, cap)
    best = materialize(plan.select(F.col("source").alias("_mix_source"), F.col("rate").alias("_mix_rate"), F.col("seed").alias("_mix_seed")), "plan")
    rows = _numbered(docs.withColumn("_text", _text_hash()))
    rows = rows.join(best, F.col("source").eqNullSafe(F.col("_mix_source"))).withColumn("_mix_copies", _copies(F.col("_mix_seed"), "_mix_rate"))
    return rows.where("_mix_copies > 0").withColumn("_mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_copies")))).select(*columns)
