"""Tables to files."""

from __future__ import annotations

import traceback
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from progdiv.functions.text import left_justify, short_template


def write_jsonl(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").json(path)


def write_tsv(frame: DataFrame, path: str, header: bool = True) -> None:
    frame.write.mode("overwrite").option("sep", "\t").option("header", header).csv(path)


def write_problem_stats(long: DataFrame, path: str) -> None:
    """Lines of metric, tab, value in a folder for each problem, ordered by key_pos."""
    rows = long.repartition("problem_id").sortWithinPartitions("problem_id", "key_pos")
    rows.select("problem_id", "metric", "value").write.mode("overwrite").partitionBy("problem_id").option("sep", "\t").csv(path)


def write_records(frame: DataFrame, path: str) -> None:
    frame.repartition("problem_id").write.mode("overwrite").partitionBy("problem_id").json(path)


def append_leaderboard(frame: DataFrame, path: str, width: int | None = None) -> None:
    """As TSV, template names shortened; with width columns are padded to it, never cut."""
    out = frame.withColumn("template", short_template(F.col("template"))) if "template" in frame.columns else frame
    if width:
        out = out.select(*(left_justify(F.col(c).cast("string"), width).alias(c) for c in out.columns))
    out.write.mode("append").option("sep", "\t").option("header", True).csv(path)


def review_pages(frame: DataFrame, template: str, columns: list[str]) -> DataFrame:
    """One page a row from a format template; nothing is escaped."""
    return frame.select(F.format_string(template, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)).alias("value"))


def write_file(spark: SparkSession, path: str, text: str) -> None:
    """One small file of exactly that name, on whatever file system the path is of."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def marked_on_failure(spark: SparkSession, folder: str, work: Callable[[], None]) -> bool:
    """Does an experiment's work; if that fails, error.txt in its folder has the trace, for the leaderboard's ERROR, and the result
    is false."""
    try:
        work()
    except Exception:
        write_file(spark, f"{folder}/error.txt", traceback.format_exc())
        return False
    return True
