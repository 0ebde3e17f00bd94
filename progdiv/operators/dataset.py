"""Building data sets: validity, splits, samples, merges and generated test cases."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid_problems(problems: DataFrame, tests: Column, description: Column, least: int = 100) -> DataFrame:
    return problems.where((tests >= 1) & (F.length(description) >= least))


def hash_order(key: Column) -> Column:
    """An order that looks random and is the same in every engine."""
    return F.md5(key.cast("string"))


#: About so many rows of the hash order are ranked in one slice.
_SLICE = 100_000


def split(frame: DataFrame, key: str, train: float = 0.7) -> DataFrame:
    """Adds part: the first int(train * n) rows by hash are train, half of the rest test, what remains val.

    Places come from ranks within slices of the hash and running counts of the slices, not from one sort. Slices are as many as the
    rows ask for; rows without a key come first.
    """
    h = F.coalesce(hash_order(F.col(key)), F.lit(""))
    digits = max(1, math.ceil(math.log(max(frame.count(), 1) / _SLICE, 16)))
    rows = frame.withColumn("_h", h).withColumn("_s", F.substring("_h", 1, digits))
    counts = rows.groupBy("_s").count()
    before = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_s", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"), F.sum("count").over(Window.partitionBy()).alias("_n"))
    rows = rows.withColumn("_own", F.row_number().over(Window.partitionBy("_s").orderBy("_h", key))).join(counts, "_s")
    place, first = F.col("_before") + F.col("_own"), F.floor(F.col("_n") * train)
    second = first + F.floor((F.col("_n") - first) / 2)
    part = F.when(place <= first, "train").when(place <= second, "test").otherwise("val")
    return rows.withColumn("part", part).drop("_h", "_s", "_before", "_n", "_own")


def sample_per_group(frame: DataFrame, keys: list[str], key: str, n: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(hash_order(F.col(key)), key)
    return frame.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= n).drop("_k")


def latest(frame: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each key the row that is largest by order; an aggregate, not a window, so rows combine before the shuffle."""
    rest = [c for c in frame.columns if c not in keys]
    return frame.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def latest_folder(folders: DataFrame, keys: list[str], path: str) -> DataFrame:
    """Of each key the folder whose name ends in the latest time, as in run_2024-01-31_23-59-59; ties by name. A folder whose name ends
    in no time is an error, as it can't be told apart from a newer one."""
    stamp = F.right(F.rtrim(F.col(path), F.lit("/")), F.lit(19))
    at = F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd_HH-mm-ss"))
    timed = folders.withColumn("_time", F.when(at.isNotNull(), at).otherwise(F.raise_error(F.concat(F.lit("no time at the end of "), F.coalesce(path, F.lit("null")))).cast("timestamp")))
    return latest(timed, keys, ["_time", path]).drop("_time")


def unmatched_cases(cases: DataFrame) -> DataFrame:
    """Problems whose test cases have not as many inputs as outputs, or not the same: problem_id, n_inputs, n_outputs, without (sorted
    testcase_ids that lack one). cases: problem_id, kind (input or output), testcase_id."""
    sides = cases.groupBy("problem_id", "testcase_id").agg(F.bool_or(F.col("kind") == "input").alias("i"), F.bool_or(F.col("kind") == "output").alias("o"))
    lone = F.when(~(F.col("i") & F.col("o")), F.col("testcase_id"))
    per = sides.groupBy("problem_id").agg(F.count_if("i").alias("n_inputs"), F.count_if("o").alias("n_outputs"), F.sort_array(F.collect_list(lone)).alias("without"))
    return per.where(F.size("without") > 0)


def merge_first(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of all frames, the earliest frame winning on a key."""
    tagged = [f.withColumn("_at", F.lit(i)) for i, f in enumerate(frames)]
    out = tagged[0]
    for f in tagged[1:]:
        out = out.unionByName(f)
    rest = [c for c in frames[0].columns if c not in keys]
    return out.groupBy(*keys).agg(F.min_by(F.struct(*rest), "_at").alias("_r")).select(*keys, "_r.*")


def unexpected(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, with which side they are on."""
    return expected.exceptAll(found).withColumn("side", F.lit("missing")).unionByName(found.exceptAll(expected).withColumn("side", F.lit("extra")))


def testcase_maps(inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Maps of test cases by problem from rows (problem_id, testcase_id, content); an input without output fails."""
    both = inputs.withColumnRenamed("content", "input").join(outputs.withColumnRenamed("content", "output"), ["problem_id", "testcase_id"], "left")
    both = both.withColumn("output", F.when(F.assert_true(F.col("output").isNotNull(), "input without output").isNull(), F.col("output")))
    entries = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("testcase_id", c))))
    return both.groupBy("problem_id").agg(entries("input").alias("input_testcases"), entries("output").alias("output_testcases"))


def random_testcases(spark, n: int, low: int, high: int, size: int, seed: int = 42) -> DataFrame:
    """Seeded generated cases: a count and that many integers, serialised line by line."""
    u = lambda i: F.floor(F.pmod(F.xxhash64("id", F.lit(seed), i), F.lit(high - low + 1)) + low)
    items = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: u(i).cast("string"))
    return spark.range(n).select(F.col("id").cast("string").alias("testcase_id"), F.concat(F.lit(f"{size}\n"), F.array_join(items, " ")).alias("input"))


def duplicated(frame: DataFrame, keys: list[str]) -> DataFrame:
    return frame.groupBy(*keys).count().where("count > 1")


def first_rows(frame: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first rows in an order if most is positive, else all."""
    return frame.orderBy(*order).limit(most) if most > 0 else frame


def typed_configs(rows: DataFrame, column: str, fields: list[tuple[str, str]], required: int) -> DataFrame:
    """Configurations from JSON arrays: a column for each of fields (name, string, int or double), null where an element is of
    another type, and problems: too few or too many elements, and elements of another type, in order.

    A whole number is no double and 1.0 no int, as elements are written on purpose."""
    kinds = {"string": r'^".*"$', "int": r"^-?\d+$", "double": r"^-?\d+(\.\d+([eE][-+]?\d+)?|[eE][-+]?\d+)$"}
    n = F.json_array_length(column)
    quoted = F.from_json(column, "array<string>")
    # Parsed elements have lost their quotes, so what is a string shows in the array as it is written.
    parts = F.regexp_extract_all(column, F.lit(r'"(?:[^"\\]|\\.)*"|[^,\[\]"\s]+'), F.lit(0))
    wrong = [F.when(F.coalesce(n, F.lit(0)) < required, F.lit("too few elements")), F.when(n > len(fields), F.lit("too many elements")), F.when(n.isNull(), F.lit("no array"))]
    out = rows
    for i, (name, kind) in enumerate(fields):
        right = F.coalesce(F.get(parts, F.lit(i)).rlike(kinds[kind]), F.lit(False))
        wrong.append(F.when((n > i) & ~right, F.lit(f"{name} is no {kind}")))
        out = out.withColumn(name, F.when(right, F.get(quoted, F.lit(i))).try_cast(kind) if kind != "string" else F.when(right, F.get(quoted, F.lit(i))))
    return out.withColumn("problems", F.array_compact(F.array(*wrong)))


def config_problems(configs: DataFrame, positive: list[str], allowed: dict[str, list[str]]) -> DataFrame:
    """What is wrong with each configuration: numbers that are not above 0 and names that are not allowed, in order."""
    wrong = [F.when(~F.coalesce(F.col(c) > 0, F.lit(False)), F.lit(f"{c} is not positive")) for c in positive]
    wrong += [F.when(~F.coalesce(F.col(c).isin(values), F.lit(False)), F.lit(f"{c} is unknown")) for c, values in allowed.items()]
    return configs.withColumn("problems", F.array_compact(F.array(*wrong)))


def to_reevaluate(experiments: DataFrame, results: DataFrame, existing: DataFrame, key: str, folder: str, root: str) -> DataFrame:
    """Experiments with results that are not there yet; fails if one lies outside of its root."""
    inside = F.assert_true(F.startswith(F.col(folder), F.col(root)), F.concat(F.lit("not below its root: "), F.col(folder)))
    checked = experiments.where(inside.isNull())
    return checked.join(results.select(key).distinct(), key, "left_semi").join(existing.select(key).distinct(), key, "left_anti")


def final_choices(annotations: DataFrame, candidates: dict[str, DataFrame], existing: DataFrame, key: str) -> DataFrame:
    """Annotated problems with the candidate files that they name, where no final version exists yet.

    candidates: by number column of the annotations, the files as (key, number, content); the result has a column for each."""
    out = annotations.join(existing.select(key).distinct(), key, "left_anti")
    for column, files in candidates.items():
        chosen = files.select(key, F.col("number").alias(column), F.col("content").alias(f"{column}_content"))
        out = out.join(chosen, [key, column])
    return out
