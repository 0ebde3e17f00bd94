"""Embedding texts within a budget, folders by time, test cases and configurations that are checked."""

import pytest
from pyspark.sql import functions as F

from progdiv.functions.subwords import Merges, default_vocabulary, with_embedding_text
from progdiv.operators import dataset, semantic
from progdiv.sources import readers


def test_embedding_texts_keep_the_budget(spark):
    merges = Merges(default_vocabulary())
    texts = [None, "", " \n\t", "  a\n\n\nb  ", "word " * 3000, "日" * 900, "é\x1c"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r.cut for r in with_embedding_text(frame, "text", "cut").collect()}
    assert sorted(got) == [3, 4, 5, 6] and got[3] == "a\nb" and got[6] == "é"
    assert len(merges(got[4])) <= 504 and ("word " * 3000).startswith(got[4]) and got[4].count("word") == 504
    assert all(len(merges(t)) <= 512 for t in got.values())
    short = {r.id: r.cut for r in with_embedding_text(frame.where("id = 4"), "text", "cut", most=20, spare=10).collect()}
    assert short[4] == " ".join(["word"] * 10)


def test_first_subwords_are_the_texts_first():
    merges = Merges(default_vocabulary())
    text = "def f(x):\n    return x ** 2 # gives squares\n"
    for n in (0, 1, 5, 100):
        assert merges(text, n) == merges(text)[: max(n, 0)] if n else merges(text, n) in ([], merges(text)[:0])
    assert merges.text_of(merges(text)) == text and merges.text_of(merges("日é😀")) == "日é😀"


def test_latest_folder(spark):
    rows = [("a", "x_2024-01-31_23-59-59"), ("a", "w_2024-02-01_00-00-00/"), ("b", "p/q_2023-05-05_05-05-05"), ("b", "p/r_2023-05-05_05-05-05")]
    frame = spark.createDataFrame(rows, "k string, path string")
    assert {r.k: r.path for r in dataset.latest_folder(frame, ["k"], "path").collect()} == {"a": rows[1][1], "b": rows[3][1]}
    assert dataset.latest_folder(frame.limit(0), ["k"], "path").collect() == []
    for bad in ("notime", "x_2024-13-31_23-59-59", None):
        with pytest.raises(Exception, match="no time at the end"):
            dataset.latest_folder(frame.union(spark.createDataFrame([("c", bad)], frame.schema)), ["k"], "path").collect()


def test_unmatched_cases_stop_the_clusters(spark):
    rows = [("p", "input", "1"), ("p", "output", "1"), ("q", "input", "1"), ("q", "input", "2"), ("q", "output", "2"), ("q", "output", "3"), ("q", "input", "1")]
    cases = spark.createDataFrame(rows, "problem_id string, kind string, testcase_id string")
    assert [tuple(r) for r in dataset.unmatched_cases(cases).collect()] == [("q", 2, 2, ["1", "3"])]
    with pytest.raises(ValueError, match="do not match in q: 2 and 2, 1, 3"):
        semantic.make_clusters(None, cases)
    assert dataset.unmatched_cases(cases.where("problem_id = 'p'")).collect() == []


def test_typed_configs(spark):
    rows = ['["m", 1.0, 2.5e-1, 3, "t, [x] \\"y\\""]', '["m",1,0.5,3,"t",7]', '["m", 1.0, 0.5, 3.0]', "[1, 2, 3, 4, 5, 6, 7]", "{}", None, '[null, "1.0", true, "3", null]']
    fields = [("model", "string"), ("temperature", "double"), ("top_p", "double"), ("n", "int"), ("template", "string"), ("batch", "int")]
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, config string")
    got = {r.id: r for r in dataset.typed_configs(frame, "config", fields, 5).collect()}
    assert (got[0].model, got[0].temperature, got[0].top_p, got[0].n, got[0].template, got[0].batch, got[0].problems) == ("m", 1.0, 0.25, 3, 't, [x] "y"', None, [])
    assert got[1].problems == ["temperature is no double"] and got[1].batch == 7
    assert got[2].problems == ["too few elements", "n is no int"] and got[2].n is None
    assert got[3].problems == ["too many elements", "model is no string", "temperature is no double", "top_p is no double", "template is no string"]
    assert got[4].problems == got[5].problems == ["too few elements", "no array"]
    assert len(got[6].problems) == 5


def test_read_paths(spark, tmp_path):
    there = tmp_path / "a.yaml"
    there.write_text("x")
    listed = tmp_path / "list.txt"
    listed.write_text(f"{there}\n\n{there}\n")
    assert readers.read_paths(spark, str(listed)) == [str(there)] * 2
    listed.write_text(f"{there}\n{tmp_path}/b.yaml\n")
    with pytest.raises(FileNotFoundError, match="b.yaml"):
        readers.read_paths(spark, str(listed))


def test_embedding_texts_of_no_rows(spark):
    assert with_embedding_text(spark.createDataFrame([], "id int, text string"), "text", "cut").select(F.count("*")).first()[0] == 0


def test_embedding_texts_are_in_python_by_parts(spark, monkeypatch):
    import pyarrow as pa

    from progdiv.functions import subwords

    made = []
    monkeypatch.setattr(subwords.DataFrame, "mapInArrow", lambda self, run, ddl: made.append(run) or self, raising=False)
    monkeypatch.setattr(type(frame := spark.createDataFrame([(0, "a")], "id int, text string")), "mapInArrow", lambda self, run, ddl: made.append(run) or self)
    with_embedding_text(frame, "text", "cut")
    batch = pa.RecordBatch.from_pydict({"id": list(range(600)), "text": [f"text {i}" for i in range(600)]})
    out = list(made[0](iter([batch])))
    assert max(b.num_rows for b in out) <= 256 and [x for b in out for x in b.column(2).to_pylist()] == [f"text {i}" for i in range(600)]
