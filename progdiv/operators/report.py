"""All metric families of a problem by record type, as one long table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from progdiv.operators import problems
from progdiv.operators.overlap import dealt
from progdiv.operators.records import type_mask
from progdiv.operators.semantic import record_type_report
from progdiv.operators.summary import to_long
from progdiv.schemas import RECORD_TYPES

KEYS = ["problem_id", "recordtype"]
SEMANTIC = ("semantic_count", "semantic_proportion", "pairwise_semantic", "avg_coherence", "avg_accuracy")
#: Highest order of n-grams in BLEU.
BLEU = 4


def metric_names(orders: range = range(1, 7)) -> list[str]:
    return [*SEMANTIC, *(f"distinct_{n}" for n in orders), "jaccard", "self_bleu", "cosine_distance"]


def _each(value) -> list[Column]:
    """value(i, holds) of every type: its place in RECORD_TYPES, and of a mask whether it has the type."""
    return [value(i, lambda mask, i=i: F.col(mask).bitwiseAND(F.lit(1 << i)) > 0) for i in range(len(RECORD_TYPES))]


def metric_report(generations: DataFrame, programs: DataFrame, vectors: DataFrame, orders: range = range(1, 7), gram: int = 2, more_than: int = 2) -> DataFrame:
    """Rows (problem_id, recordtype, metric, value) of every metric for all six types, null where it is undefined.

    generations: what records.per_generation gives; programs: problem_id, generation_id, program, tokens and vector_id; vectors:
    vector_id, each once, and vector. Semantic metrics are of all generations of a type, the others of those with a program, if more
    than more_than have one.

    A generation's types are bits of one number, so that n-grams are counted and pairs are met once a problem and not once a type.
    Generations are dealt by problem once for the semantic metrics and once for all others, and both have rows for every problem, so
    nothing is joined at the end.
    """
    typed = members(generations, programs, more_than)
    return to_long(record_type_report(generations), KEYS, list(SEMANTIC)).unionByName(_measured(typed, vectors, orders, gram))


def members(generations: DataFrame, programs: DataFrame, more_than: int) -> DataFrame:
    """A row a generation: problem_id, generation_id, mask of the types that it counts for, tokens and vector_id, which are null if
    it counts for none."""
    key = ["problem_id", "generation_id"]
    own = F.when(F.length(F.coalesce("program", F.lit(""))) > 0, F.col("mask")).otherwise(0)
    rows = generations.select(*key, type_mask().alias("mask")).join(programs, key, "left").select(*key, own.alias("mask"), "tokens", "vector_id")
    problem = Window.partitionBy("problem_id")
    enough = reduce(Column.bitwiseOR, _each(lambda i, holds: F.when(F.count_if(holds("mask")).over(problem) > more_than, F.lit(1 << i)).otherwise(0)))
    rows = rows.withColumn("mask", F.col("mask").bitwiseAND(enough))
    return rows.select(*key, "mask", *(F.when(F.col("mask") > 0, F.col(c)).alias(c) for c in ("tokens", "vector_id")))


def _measured(typed: DataFrame, vectors: DataFrame, orders: range, gram: int) -> DataFrame:
    """Rows of the lexical metrics and of cosine distance: problems are dealt into all parts, and a task counts whole problems at once."""
    v = vectors.select("vector_id", F.transform("vector", lambda x: x.cast("double")).alias("vector"))
    rows = typed.join(v, "vector_id", "left").select("problem_id", "generation_id", "mask", "tokens", "vector")
    rows = dealt(rows, "problem_id").sortWithinPartitions("problem_id", "generation_id")
    schema = StructType([rows.schema["problem_id"], StructField("found", ArrayType(DoubleType()))])
    types = len(RECORD_TYPES)
    found = rows.mapInArrow(lambda batches: problems.measured(batches, orders, gram, BLEU, types), schema)
    names = [(metric, t) for metric in metric_names(orders)[len(SEMANTIC) :] for t in RECORD_TYPES]
    each = F.array(*(F.struct(F.lit(t).alias("recordtype"), F.lit(metric).alias("metric"), F.get("found", F.lit(i)).alias("value")) for i, (metric, t) in enumerate(names)))
    return found.select("problem_id", F.explode(each).alias("_x")).select("problem_id", "_x.*")
