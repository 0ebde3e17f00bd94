"""Lexical diversity: n-grams, distinct shares, Jaccard and BLEU distances, all by joins of n-gram rows."""

from __future__ import annotations

import random
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from progdiv.functions.text import strip_comments
from progdiv.operators import places
from progdiv.operators.overlap import bootstrap_pairs, mean_pair_distance, sampled_pairs


def word_tokens(text: Column) -> Column:
    return F.array_remove(F.split(text, " "), "")


def code_tokens(code: Column, comments: bool = True) -> Column:
    """Tokens of code by a pattern that never fails: strings, numbers, names, operators, line ends."""
    pattern = r"""("[^"\n]*"|'[^'\n]*'|#[^\n]*|[0-9]+\.?[0-9]*|[A-Za-z_][A-Za-z0-9_]*|[-+*/%&|^<>=!:]=|\*\*|//|->|\n|[^\sA-Za-z0-9_])"""
    return F.regexp_extract_all(code if comments else strip_comments(code), F.lit(pattern), F.lit(1))


def ngrams(frame: DataFrame, keys: list[str], member: str, tokens: str, orders: range) -> DataFrame:
    """Rows (keys, member, n, gram): the n-grams of each member's tokens for every order, one explode for all."""
    upto = F.size(tokens)

    def of_order(n: int) -> Column:
        return F.when(upto >= n, F.transform(F.sequence(F.lit(1), upto - n + 1), lambda i: F.struct(F.lit(n).alias("n"), F.slice(tokens, i, F.lit(n)).alias("gram"))))

    arrays = [of_order(n) for n in orders]
    none = F.array().cast("array<struct<n:int,gram:array<string>>>")
    return frame.select(*keys, member, F.explode(F.concat(*(F.coalesce(a, none) for a in arrays))).alias("x")).select(*keys, member, "x.n", "x.gram")


def gram_hashes(frame: DataFrame, keys: list[str], tokens: str, orders: range, always: bool = False) -> DataFrame:
    """Rows (keys, n, h): 64-bit hashes of the n-grams of every row's tokens. Words are hashed once, and each order's hashes
    are those of the order below joined with the next word's. With always, a row without n-grams of an order gives one null h."""
    df = frame.select(*keys, F.transform(tokens, lambda w: F.xxhash64(w)).alias("_w"))
    df = df.select(*keys, "_w", F.col("_w").alias("_g1"))
    for n in range(2, orders.stop):
        left = F.size("_w") - (n - 1)
        made = F.when(left > 0, F.zip_with(F.slice(f"_g{n - 1}", F.lit(1), left), F.slice("_w", F.lit(n), left), lambda g, w: F.xxhash64(g, w)))
        df = df.select("*", made.alias(f"_g{n}"))
    tagged = lambda n, of: F.transform(of, lambda h: F.struct(F.lit(n).alias("n"), h.alias("h")))
    none = lambda n: tagged(n, F.array(F.lit(None).cast("bigint")) if always else F.array().cast("array<bigint>"))
    rows = [F.when(F.size(f"_g{n}") > 0, tagged(n, f"_g{n}")).otherwise(none(n)) for n in orders]
    return df.select(*keys, F.explode(F.concat(*rows)).alias("x")).select(*keys, "x.n", "x.h")


def distinct_n(frame: DataFrame, keys: list[str], tokens: str, orders: range = range(1, 7), prose: bool = False) -> DataFrame:
    """Distinct of all n-grams of a group; null if it has at most one.

    Counted in two steps, by gram and then by group, so that repeats are added up before the shuffle; grams
    are told apart by 64 bits of hash. With prose, whose long n-grams hardly repeat, n-grams are shuffled as bytes, many in one row.
    """
    if prose:
        agg = places.distinct(frame, keys, tokens, orders)
    else:
        per = gram_hashes(frame, keys, tokens, orders).groupBy(*keys, "n", "h").agg(F.count("*").alias("c"))
        agg = per.groupBy(*keys, "n").agg(F.count("*").alias("n_distinct"), F.sum("c").alias("n_total"))
    return agg.withColumn("distinct_n", F.when(F.col("n_total") > 1, F.col("n_distinct") / F.col("n_total")))


def gram_sketches(frame: DataFrame, keys: list[str], tokens: str, orders: range = range(1, 7), lg_k: int = 12) -> DataFrame:
    """Rows (keys, n, sketch, n_total): a sketch of each group's distinct n-grams, of 2 ** lg_k bytes at most, and their number.

    A task keeps the sketches of all orders of a group and only sketches are shuffled, whatever the number of n-grams; they can be
    stored and merged.
    """
    rows = places.side_by_side(frame, keys, tokens, orders)
    sketches = rows.groupBy(*keys).agg(*(c for n in orders for c in (F.hll_sketch_agg(f"_h{n}", lg_k).alias(f"_s{n}"), F.sum(f"_c{n}").alias(f"_n{n}"))))
    each = F.array(*(F.struct(F.lit(n).alias("n"), F.col(f"_s{n}").alias("sketch"), F.col(f"_n{n}").alias("n_total")) for n in orders))
    return sketches.select(*keys, F.explode(each).alias("_x")).select(*keys, "_x.*").where("n_total > 0")


def rolled_up(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of coarser groups from those of finer ones."""
    return sketches.groupBy(*keys, "n").agg(F.hll_union_agg("sketch").alias("sketch"), F.sum("n_total").alias("n_total"))


def sketched_distinct_n(sketches: DataFrame) -> DataFrame:
    """Estimates from sketches: n_distinct has a standard error of 1.04 / sqrt(2 ** lg_k), 1.6 % by default; null for at most one."""
    keys = [c for c in sketches.columns if c not in ("n", "sketch", "n_total")]
    n_distinct = F.least(F.hll_sketch_estimate("sketch"), F.col("n_total"))
    return sketches.select(*keys, "n", n_distinct.alias("n_distinct"), "n_total", F.when(F.col("n_total") > 1, n_distinct / F.col("n_total")).alias("distinct_n"))


def gram_sets(frame: DataFrame, keys: list[str], member: str, tokens: str, n: int) -> DataFrame:
    """Distinct n-grams of members that have any, hashed to 64 bits, with the member's own total."""
    grams = ngrams(frame.where(F.size(tokens) >= n), keys, member, tokens, range(n, n + 1))
    return grams.groupBy(*keys, member, F.xxhash64("gram").alias("g")).agg(F.count("*").alias("c"))


def jaccard(frame: DataFrame, keys: list[str], member: str, tokens: str, n: int) -> DataFrame:
    """Mean over pairs of a group of 1 - shared / all n-grams; null for fewer than two members with any."""
    return mean_pair_distance(gram_sets(frame, keys, member, tokens, n), keys, member)


def uniforms(iterations: int, k: int, seed: int = 42) -> list[tuple[int, int, float]]:
    r = random.Random(seed)
    return [(i, j, r.random()) for i in range(iterations) for j in range(k)]


def bootstrap_distinct_n(frame: DataFrame, keys: list[str], member: str, tokens: str, n: int, iterations: int = 300, seed: int = 42) -> DataFrame:
    """Mean distinct share over iterations of two members drawn with replacement."""
    return bootstrap_pairs(gram_sets(frame, keys, member, tokens, n), keys, member, uniforms(iterations, 2, seed))


def sampled_jaccard(frame: DataFrame, keys: list[str], member: str, tokens: str, n: int, iterations: int = 300, seed: int = 42) -> DataFrame:
    """Mean Jaccard distance over iterations of two members drawn with replacement."""
    return sampled_pairs(gram_sets(frame, keys, member, tokens, n), keys, member, uniforms(iterations, 2, seed))


def with_counted_grams(frame: DataFrame, tokens: str, orders: range) -> DataFrame:
    """Adds of each order n from 1 g<n>, the distinct n-grams of a row as 64-bit hashes, and r<n>, hashes of n-gram and k for the
    k-th time that it is there, from the second on. What two rows have in common of both is what their counts have, the smaller
    one of each n-gram. Time grows with the square of the number of n-grams in rows in which some repeat."""
    kept = frame.columns
    df = frame.withColumn("_w", F.transform(F.coalesce(tokens, F.array().cast("array<string>")), lambda w: F.xxhash64(w))).withColumn("_h1", F.col("_w"))
    for n in range(2, orders.stop):
        left = F.size("_w") - (n - 1)
        made = F.when(left > 0, F.zip_with(F.slice(f"_h{n - 1}", F.lit(1), left), F.slice("_w", F.lit(n), left), lambda g, w: F.xxhash64(g, w)))
        df = df.withColumn(f"_h{n}", F.coalesce(made, F.array().cast("array<bigint>")))
    df = df.withColumns({f"g{n}": F.array_distinct(f"_h{n}") for n in orders} | {f"_s{n}": F.array_sort(f"_h{n}") for n in orders})
    none = F.array().cast("array<bigint>")

    def again(n: int) -> Column:
        times = F.transform(f"_s{n}", lambda x, i: F.struct(x.alias("h"), (i + 2 - F.array_position(f"_s{n}", x)).alias("k")))
        return F.transform(F.filter(times, lambda x: x["k"] > 1), lambda x: F.xxhash64(x["h"], x["k"]))

    return df.select(*kept, *(f"g{n}" for n in orders), *(F.when(F.size(f"g{n}") < F.size(f"_s{n}"), again(n)).otherwise(none).alias(f"r{n}") for n in orders))


def bleu_distance(la: Column, lb: Column, hits: list[Column]) -> Column:
    """100 - BLEU of a text of la tokens against one of lb, of which so many n-grams of each order are in common; effective order,
    exponential smoothing."""
    log_sum, eff, smooth, open_ = F.lit(0.0), F.lit(0), F.lit(1.0), F.lit(True)
    for k, hit in enumerate(hits, 1):
        total = F.greatest(la - (k - 1), F.lit(0))
        hit = F.coalesce(hit, F.lit(0))
        open_ = open_ & (total > 0)
        smooth = F.when(open_ & (hit == 0), smooth * 2).otherwise(smooth)
        p = F.when(hit == 0, 100.0 / (smooth * total)).otherwise(100.0 * hit / total)
        log_sum = F.when(open_, log_sum + F.ln(p)).otherwise(log_sum)
        eff = F.when(open_, F.lit(k)).otherwise(eff)
    short = F.when((la < lb) & (la > 0), F.exp(1 - lb / la)).otherwise(1.0)
    any_hit = reduce(Column.__or__, (F.coalesce(hit, F.lit(0)) > 0 for hit in hits))
    return 100 - F.when(any_hit & (eff > 0), short * F.exp(log_sum / eff)).otherwise(0.0)


def bleu_pairs(frame: DataFrame, keys: list[str], member: str, tokens: str, order: int = 4) -> DataFrame:
    """Rows (keys, a, b, distance) for members a < b of a group: 100 - BLEU of a against b.

    Clipped counts come from an n-gram join; effective order, exponential smoothing. Null tokens are none.
    """
    sized = frame.select(*keys, member, F.coalesce(F.size(tokens), F.lit(0)).alias("len"))
    counts = ngrams(frame, keys, member, tokens, range(1, order + 1)).groupBy(*keys, member, "n", F.xxhash64("gram").alias("g")).agg(F.count("*").alias("c"))
    a = counts.withColumnsRenamed({member: "a", "c": "ca"})
    b = counts.withColumnsRenamed({member: "b", "c": "cb"})
    both = a.join(b, [*keys, "n", "g"]).where("a < b").groupBy(*keys, "a", "b").agg(*(F.sum(F.when(F.col("n") == k, F.least("ca", "cb"))).alias(f"m{k}") for k in range(1, order + 1)))
    left, right = sized.withColumnsRenamed({member: "a", "len": "la"}), sized.withColumnsRenamed({member: "b", "len": "lb"})
    pairs = left.join(right, keys).where("a < b").join(both, [*keys, "a", "b"], "left")
    distance = bleu_distance(F.col("la"), F.col("lb"), [F.col(f"m{k}") for k in range(1, order + 1)])
    return pairs.select(*keys, "a", "b", distance.alias("distance"))


def corpus_self_bleu(frame: DataFrame, keys: list[str], member: str, tokens: str, normalize: bool = True) -> DataFrame:
    pairs = bleu_pairs(frame, keys, member, tokens)
    return pairs.groupBy(*keys).agg((F.avg("distance") if normalize else F.sum("distance")).alias("self_bleu"))


def generation_order(frame: DataFrame, keys: list[str], member: str) -> DataFrame:
    return frame.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy(member)) - 1)
