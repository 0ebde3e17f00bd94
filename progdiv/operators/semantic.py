"""Correctness and semantic diversity from per-generation rows (operators.records.per_generation)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from progdiv.operators.dataset import unmatched_cases

from progdiv.operators.records import per_generation, with_every_type


def string_key(generations: DataFrame) -> str:
    """The column to tell semantic strings of a problem apart by: semantic_key where there is one."""
    return "semantic_key" if "semantic_key" in generations.columns else "semantic"


def clusters(generations: DataFrame, keys: list[str]) -> DataFrame:
    """Generations of one group with one semantic string: size and members."""
    return generations.groupBy(*keys, "semantic").agg(F.count("*").alias("size"), F.sort_array(F.collect_list("generation_id")).alias("members"))


def semantic_metrics(generations: DataFrame, keys: list[str]) -> DataFrame:
    """n, semantic_count, semantic_proportion, pairwise_semantic by group, in closed form over cluster sizes.

    The share of unequal pairs is 1 - sum c(c-1) / n(n-1); it and the proportion are null for fewer than two.
    """
    sizes = generations.groupBy(*keys, string_key(generations)).agg(F.count("*").alias("c"))
    agg = sizes.groupBy(*keys).agg(F.sum("c").alias("n"), F.count("*").alias("semantic_count"), F.sum(F.col("c") * (F.col("c") - 1)).alias("equal"))
    n = F.col("n")
    return agg.select(
        *keys, "n", "semantic_count",
        F.when(n > 1, F.col("semantic_count") / n).alias("semantic_proportion"),
        F.when(n > 1, 1 - F.try_divide("equal", n * (n - 1))).alias("pairwise_semantic"),
    )


def record_type_report(generations: DataFrame) -> DataFrame:
    """Coherence, accuracy and semantic metrics by problem and record type, all six types: counts are 0 and metrics null where no
    record is of the type.

    Every generation has a row for each type that tells whether it holds, so strings are grouped once and nothing is joined."""
    keys = ["problem_id", "recordtype"]
    whole = lambda c: (F.col(c) == 1.0).cast("long")
    sizes = with_every_type(generations).groupBy(*keys, "holds", F.when(F.col("holds"), F.col(string_key(generations))).alias("semantic")).agg(
        F.count("*").alias("c"),
        *(f(whole(m)).alias(f"{m}_{n}") for m in ("coherence", "accuracy") for n, f in (("sum", F.sum), ("of", F.count))),
    )
    held = lambda c: F.sum(F.when(F.col("holds"), c))
    c = F.col("c")
    agg = sizes.groupBy(*keys).agg(
        F.coalesce(held(c), F.lit(0)).alias("n"), F.count_if("holds").alias("semantic_count"), held(c * (c - 1)).alias("equal"),
        *(F.try_divide(held(F.col(f"{m}_sum")), held(F.col(f"{m}_of"))).alias(f"avg_{m}") for m in ("coherence", "accuracy")),
    )
    n = F.col("n")
    return agg.select(
        *keys, "n", "semantic_count",
        F.when(n > 1, F.col("semantic_count") / n).alias("semantic_proportion"),
        F.when(n > 1, 1 - F.try_divide("equal", n * (n - 1))).alias("pairwise_semantic"),
        "avg_coherence", "avg_accuracy",
    )


#: Nested filters: name of the metrics' suffix and the condition on a generation.
FILTERS = (
    ("wcoh", "coherent"),
    ("wcoh_nonempty", "coherent AND length(coalesce(program, '')) > 0"),
    ("wcoh_nonempty_woutput", "coherent AND length(coalesce(program, '')) > 0 AND n_without = 0"),
)


def filtered_semantics(generations: DataFrame) -> DataFrame:
    """Semantic metrics by problem under each of FILTERS. Needs a program column."""
    names = F.array_compact(F.array(*(F.when(F.expr(c), F.lit(name)) for name, c in FILTERS)))
    return semantic_metrics(generations.withColumn("filter", F.explode(names)), ["problem_id", "filter"])


def coherent_share_of_all(generations: DataFrame) -> DataFrame:
    """Distinct coherent strings of all generations, by problem."""
    n = F.count("*")
    return generations.groupBy("problem_id").agg(F.when(n > 1, F.count_distinct(F.when(F.col("coherent"), F.col(string_key(generations)))) / n).alias("coh_semantic_proportion_of_all"))


def make_clusters(executions: DataFrame, cases: DataFrame | None = None) -> dict[str, DataFrame]:
    """What the clustering run writes: program to string, string to programs, and counts and shares a program.

    cases (problem_id, kind, testcase_id): accuracies need an output for each input; ValueError names problems without."""
    if cases is not None and (wrong := unmatched_cases(cases).orderBy("problem_id").limit(5).collect()):
        raise ValueError("inputs and outputs do not match in " + "; ".join(f"{r.problem_id}: {r.n_inputs} and {r.n_outputs}, {', '.join(map(str, r.without))}" for r in wrong))
    gen = per_generation(executions)
    keys = ["problem_id", "generation_id"]
    return {
        "program_2_semantic_string": gen.select(*keys, "semantic"),
        "semantic_strings_2_programs": clusters(gen, ["problem_id"]),
        "program_2_coherence": gen.select(*keys, "coherence"),
        "program_2_n_outputs": gen.select(*keys, "n_outputs"),
        "program_2_n_coherent": gen.select(*keys, "n_coherent"),
        "program_2_accuracy": gen.select(*keys, "accuracy"),
    }
