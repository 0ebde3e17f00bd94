"""Tables from files: JSON lines, CSV and TSV, test-case and HTML folders, output records, configurations."""

from __future__ import annotations

import dataclasses
import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from progdiv.functions.text import strip
from progdiv.schemas import OUTPUT_RECORD, STATS


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """With header and quoted line breaks; a byte-order mark is dropped and names are stripped."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    frame = (reader.schema(schema) if schema else reader).csv(path)
    return frame.toDF(*(c.lstrip("﻿").strip() for c in frame.columns))


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Every column a string; numbers by try_cast where they are used."""
    return spark.read.option("header", True).option("sep", "\t").csv(path)


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """Lines of key, tab, value; values that are no numbers are null."""
    return spark.read.option("sep", "\t").schema(STATS).csv(path)


def read_testcases(spark: SparkSession, path: str) -> DataFrame:
    """problem_id, kind (input or output), testcase_id, content of <problem>/<kind>.<n>.txt files."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("p"))
    pattern = r"([^/]+)/(input|output)\.(\d+)\.txt$"
    part = lambda i: F.regexp_extract("p", pattern, i)
    return files.where(F.col("p").rlike(pattern)).select(part(1).alias("problem_id"), part(2).alias("kind"), part(3).alias("testcase_id"), strip(F.col("value")).alias("content"))


def read_html(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True)
    return files.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.html$", 1).alias("problem_id"), F.col("value").alias("html"))


def read_sources(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Source files by submission_id (the file's base name); rows of wanted without a file are skipped."""
    files = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    files = files.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.[^./]+$", 1).alias("submission_id"), F.col("value").alias("code"))
    return wanted.join(files, "submission_id")


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """template_name and content of every .txt file, and None with the bare placeholder."""
    files = spark.read.text(path, wholetext=True)
    named = files.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.txt$", 1).alias("template_name"), F.col("value").alias("content"))
    return named.union(spark.createDataFrame([("None", "## DESCRIPTION\n")], named.schema))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(strip(F.col("value")).alias("line")).where("line <> ''")


def read_paths(spark: SparkSession, path: str) -> list[str]:
    """The paths that the lines of a small file name, in order; FileNotFoundError with those that don't exist."""
    conf, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    named = [r["line"] for r in read_lines(spark, path).collect()]  # a list of configurations, written by hand
    missing = [n for n in named if not (p := jvm.org.apache.hadoop.fs.Path(n)).getFileSystem(conf).exists(p)]
    if missing:
        raise FileNotFoundError(f"not there: {', '.join(missing)}")
    return named


def read_output_records(spark: SparkSession, path: str, n: int) -> DataFrame:
    """Saved records of generations 0..n-1: of several for one generation the one of the largest path."""
    rows = spark.read.schema(OUTPUT_RECORD).option("recursiveFileLookup", True).json(path)
    rows = rows.select(F.struct("*").alias("r"), F.col("_metadata.file_path").alias("p"))
    best = rows.groupBy(F.col("r.problem_id").alias("p_id"), F.col("r.generation_id").alias("g_id")).agg(F.max_by("r", "p").alias("r"))
    return best.where((F.col("g_id") >= 0) & (F.col("g_id") < n)).select("r.*")


def record_faults(found: DataFrame, n: int) -> DataFrame:
    """Problems whose records are not exactly generations 0..n-1: how many of these there are, and the sorted ids outside.

    found: problem_id and generation_id of what was saved, repeats counted once."""
    g = F.col("generation_id")
    inside = (g >= 0) & (g < n)
    per = found.groupBy("problem_id").agg(F.count_distinct(F.when(inside, g)).alias("n_found"), F.sort_array(F.collect_set(F.when(~inside, g))).alias("outside"))
    return per.where((F.col("n_found") != n) | (F.size("outside") > 0))


def _scalar(value: str) -> str:
    """A value without quotes, or without the remark that may follow it."""
    value = value.strip()
    if value[:1] in ("'", '"') and value[:1] in value[1:]:
        return value[1 : value.index(value[0], 1)]
    return f" {value}".partition(" #")[0].strip()


def load_config(path: str, kind: type) -> Any:
    """A dataclass from lines of `key: value`; a key it lacks is an error."""
    values: dict[str, Any] = {}
    fields = {f.name: f.type for f in dataclasses.fields(kind)}
    for line in open(path):
        key, sep, value = line.partition(":")
        if not sep or line.lstrip().startswith("#"):
            continue
        key, value = key.strip(), _scalar(value)
        if key not in fields:
            raise TypeError(f"unknown key {key!r}")
        plain = {"true": True, "false": False, "null": None, "": None}.get(value.lower(), value)
        if isinstance(plain, str):
            for cast in (int, float):
                try:
                    plain = cast(value)
                    break
                except ValueError:
                    continue
        values[key] = plain
    return kind(**values)


def _tried(call, tries: int, wait: float):
    """What call gives, tried again with doubling waits while it fails; the last failure is raised."""
    for k in range(tries):
        try:
            return call()
        except Exception:
            if k == tries - 1:
                raise
            time.sleep(wait * 2**k)


def generate_with(prompts: DataFrame, generate, n: int, batch_size: int = 32, tries: int = 4, wait: float = 0.3, **sampling) -> DataFrame:
    """raw_generations: n texts for each formatted_prompt from a callable (prompt, how many, **sampling) -> list of texts.

    At most batch_size texts are asked for at once; fewer are asked for again, none at all count as a failure. Services stay outside
    of the engine."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema)

    def some(prompt: str, most: int) -> list[str]:
        texts = generate(prompt, most, **sampling)
        if not texts:
            raise ValueError("no text generated")
        return list(texts)

    def all_of(prompt: str) -> list[str]:
        texts: list[str] = []
        while len(texts) < n:
            most = min(batch_size, n - len(texts))
            texts += _tried(lambda: some(prompt, most), tries, wait)[:most]
        return texts

    def run(batches):
        for b in batches:
            yield b.assign(raw_generations=[all_of(p) for p in b["formatted_prompt"]])

    return prompts.mapInPandas(run, f"{ddl}, raw_generations array<string>")


def embed_with(texts: DataFrame, column: str, embed, out: str = "embedding", batch_size: int = 32, tries: int = 4, wait: float = 0.3) -> DataFrame:
    """Vectors from a callable (list of texts) -> list of vectors, asked for by batches of texts; null and blank texts have none."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema)

    def run(batches):
        for b in batches:
            said = [(i, t) for i, t in enumerate(b[column]) if isinstance(t, str) and t.strip()]
            vectors: list = [None] * len(b)
            for k in range(0, len(said), batch_size):
                part = said[k : k + batch_size]
                found = _tried(lambda part=part: embed([t for _, t in part]), tries, wait)
                for (i, _), v in zip(part, found, strict=True):
                    vectors[i] = [float(x) for x in v]
            yield b.assign(**{out: vectors})

    return texts.mapInPandas(run, f"{ddl}, `{out}` array<double>")
