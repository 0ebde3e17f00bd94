"""Sources, sinks and streams."""

import dataclasses
import json

import pytest
from pyspark.sql import functions as F

from progdiv.sources import readers, sinks
from progdiv.streaming import monitor


def test_testcases(spark, tmp_path):
    d = tmp_path / "problem_1"
    d.mkdir()
    for n, (i, o) in {"2": (" 1 \n", "2"), "10": ("3", "4\n")}.items():
        (d / f"input.{n}.txt").write_text(i)
        (d / f"output.{n}.txt").write_text(o)
    rows = readers.read_testcases(spark, str(tmp_path))
    from progdiv.operators.dataset import testcase_maps

    got = testcase_maps(rows.where("kind = 'input'").drop("kind"), rows.where("kind = 'output'").drop("kind")).first()
    assert got["input_testcases"] == {"2": "1", "10": "3"} and got["output_testcases"] == {"2": "2", "10": "4"}
    (d / "output.2.txt").unlink()
    rows = readers.read_testcases(spark, str(tmp_path))
    with pytest.raises(Exception, match="input without output"):
        testcase_maps(rows.where("kind = 'input'").drop("kind"), rows.where("kind = 'output'").drop("kind")).collect()


def test_output_records_latest(spark, tmp_path):
    for name, g, code in (("generation_0_a", 0, "old"), ("generation_0_b", 0, "new"), ("generation_7", 7, "out")):
        d = tmp_path / "problem_p" / name
        d.mkdir(parents=True)
        (d / "output_record.json").write_text(json.dumps({"problem_id": "p", "generation_id": g, "code": code, "testcase_outputs": {"0": "x"}}))
    got = readers.read_output_records(spark, str(tmp_path), 5).collect()
    assert [(r["generation_id"], r["code"]) for r in got] == [(0, "new")]


def test_csv_with_mark_and_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿id,Use? ,text\n1,y,"a\nb"\n')
    df = readers.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["id", "Use?", "text"] and df.first()["text"] == "a\nb"


def test_config(tmp_path):
    @dataclasses.dataclass
    class C:
        a: int
        b: bool = False
        c: str = ""

    (tmp_path / "c.yaml").write_text("a: 3\nb: true\nc: 'x'\n# no\n")
    assert readers.load_config(str(tmp_path / "c.yaml"), C) == C(3, True, "x")
    (tmp_path / "c.yaml").write_text("z: 3\n")
    with pytest.raises(TypeError):
        readers.load_config(str(tmp_path / "c.yaml"), C)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("p", 1, "m", 0.5), ("p", 0, "k", 1.0)], "problem_id string, key_pos int, metric string, value double")
    sinks.write_problem_stats(df, str(tmp_path / "s"))
    lines = [x for f in (tmp_path / "s" / "problem_id=p").glob("*.csv") for x in f.read_text().split("\n") if x]
    assert lines == ["k\t1.0", "m\t0.5"]
    assert {r["k"]: r["v"] for r in readers.read_stats(spark, str(tmp_path / "s" / "problem_id=p")).collect()} == {"k": 1.0, "m": 0.5}
    sinks.append_leaderboard(spark.createDataFrame([("open_ended_x", 1)], "template string, n int"), str(tmp_path / "l"))
    assert readers.read_tsv(spark, str(tmp_path / "l")).first()["template"] == "x"
    assert sinks.review_pages(df, "<b>%s</b>", ["metric"]).first()[0] == "<b>m</b>"


def test_status_stream_sees_files_once(spark, tmp_path):
    for name, file in (("a", "results.jsonl"), ("b", "error.txt")):
        d = tmp_path / "in" / name
        d.mkdir(parents=True)
        (d / file).write_text("x")
    seen = []
    handle = lambda df, _: seen.extend((r["experiment_id"], r["status"]) for r in df.collect())
    for _ in range(2):
        monitor.each_once(monitor.status_stream(spark, str(tmp_path / "in")), handle, str(tmp_path / "ck")).awaitTermination()
    assert sorted(seen) == [("a", "success"), ("b", "failure")]


def test_windows_of_a_stream(spark, sf, tmp_path):
    table = spark.read.parquet(f"{sf}/events.parquet")
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    batch = monitor.windowed_counts(table.withColumn("ts", F.col("ts").cast("timestamp")), "1 hour")
    got = monitor.run_to_table(monitor.windowed_counts(stream, "1 hour"), str(tmp_path / "out"), str(tmp_path / "ck"), batch.schema)
    late = batch.agg(F.max("start")).first()[0]
    want = batch.where(F.col("start") < F.lit(late) - F.expr("INTERVAL 2 HOURS")).count()
    assert got.count() >= want > 0
    assert got.join(batch, ["start", "event_type", "n"], "left_anti").count() == 0


def test_html_sources_templates_and_lines(spark, tmp_path):
    for name, text in (("h/p1.html", "<p>x</p>"), ("s/a/7.py", "print(1)"), ("s/b/8.py", "print(2)"), ("t/one.txt", "Do ## DESCRIPTION"), ("lines.txt", " a.yaml \n\nb.yaml\n")):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    assert [tuple(r) for r in readers.read_html(spark, str(tmp_path / "h")).collect()] == [("p1", "<p>x</p>")]
    wanted = spark.createDataFrame([("7",), ("9",)], "submission_id string")
    assert [tuple(r) for r in readers.read_sources(spark, str(tmp_path / "s"), wanted).collect()] == [("7", "print(1)")]
    assert dict(map(tuple, readers.read_templates(spark, str(tmp_path / "t")).collect())) == {"one": "Do ## DESCRIPTION", "None": "## DESCRIPTION\n"}
    assert [r["line"] for r in readers.read_lines(spark, str(tmp_path / "lines.txt")).collect()] == ["a.yaml", "b.yaml"]


def test_generators_and_records(spark, tmp_path):
    prompts = spark.createDataFrame([(1, "a"), (2, "b")], "problem_id int, formatted_prompt string")
    made = readers.generate_with(prompts, lambda p, n: [f"{p}{i}" for i in range(n)], 2)
    assert {r["problem_id"]: r["raw_generations"] for r in made.collect()} == {1: ["a0", "a1"], 2: ["b0", "b1"]}
    sinks.write_records(made, str(tmp_path / "r"))
    assert {r["problem_id"]: r["raw_generations"] for r in spark.read.json(str(tmp_path / "r")).collect()} == {1: ["a0", "a1"], 2: ["b0", "b1"]}


def test_generators_are_tried_again(spark, tmp_path):
    prompts = spark.createDataFrame([("a",)], "formatted_prompt string")
    seen = tmp_path / "seen"

    def shaky(prompt, most, mark):
        with open(seen, "a") as f:
            f.write("x")
        if len(open(seen).read()) % 2:
            raise ConnectionError
        return [prompt + mark] * (most + 3)

    made = readers.generate_with(prompts, shaky, 5, batch_size=2, wait=0.0, mark="!").collect()
    assert made[0]["raw_generations"] == ["a!"] * 5 and len(open(seen).read()) == 6

    with pytest.raises(Exception, match="no text generated"):
        readers.generate_with(prompts, lambda p, n: [], 1, tries=2, wait=0.0).collect()


def test_embeddings_from_a_callable(spark):
    texts = spark.createDataFrame([(i, None if i == 3 else " " if i == 4 else "t" * i) for i in range(9)], "id int, text string").coalesce(1)

    def embed(some):
        assert len(some) <= 2
        return [[len(t), len(some)] for t in some]

    got = {r["id"]: r["v"] for r in readers.embed_with(texts, "text", embed, out="v", batch_size=2).collect()}
    assert {i for i, v in got.items() if v is None} == {0, 3, 4}
    assert all(v[0] == i for i, v in got.items() if v)


def test_failures_leave_a_mark_that_the_stream_sees(spark, tmp_path):
    def fails():
        raise RuntimeError("no é here")

    assert sinks.marked_on_failure(spark, str(tmp_path / "e1"), lambda: sinks.write_file(spark, str(tmp_path / "e1" / "results.jsonl"), "{}"))
    assert not sinks.marked_on_failure(spark, str(tmp_path / "e2"), fails)
    assert "RuntimeError: no é here" in (tmp_path / "e2" / "error.txt").read_text()
    rows = spark.read.option("recursiveFileLookup", True).text(str(tmp_path), wholetext=True).count()
    assert rows == 2
    seen = []
    monitor.each_once(monitor.status_stream(spark, str(tmp_path)), lambda b, i: seen.extend(b.collect()), str(tmp_path.parent / f"{tmp_path.name}_c")).awaitTermination()
    assert {(r["experiment_id"], r["status"]) for r in seen} == {("e1", "success"), ("e2", "failure")}


def test_record_faults(spark):
    rows = [("a", 0), ("a", 1), ("b", 0), ("b", 0), ("c", 0), ("c", 1), ("c", 7), ("c", -1), ("c", None)]
    got = {r["problem_id"]: (r["n_found"], r["outside"]) for r in readers.record_faults(spark.createDataFrame(rows, "problem_id string, generation_id int"), 2).collect()}
    assert got == {"b": (1, []), "c": (2, [-1, 7])}
