"""Record trees, running diversity of streams, registered functions and sketches."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from progdiv.functions import pyast, registered
from progdiv.operators import lexical
from progdiv.sources import record_tree
from progdiv.streaming import monitor, running

SCHEMA = record_tree.SCHEMA


def generations(spark):
    rows = [("p1", 0, 0.5, 1.0, "gen é\n", "x = 1\n", "x = 1", "{}", "- a\n+ b"), ("p1", 1, 1.0, None, "", None, None, "{}", None), ("p2", 0, 0.0, 0.25, "g", "y", "y", None, "d")]
    return spark.createDataFrame(rows, SCHEMA)


def test_record_tree_round_trip(spark, tmp_path):
    path = str(tmp_path / "tree")
    frame = generations(spark)
    record_tree.write_tree(frame.repartition(2), path)
    assert sorted(os.listdir(path)) == ["p1", "p2"]
    assert sorted(os.listdir(f"{path}/p1")) == ["generation_0_coh_0.5_acc_1.0", "generation_1_coh_1.0_acc_None"]
    with open(f"{path}/p1/generation_0_coh_0.5_acc_1.0/diff.txt") as f:
        assert f.read() == "Accuracy: 1.0\n- a\n+ b"
    want = {(r.problem_id, r.generation_id): r.asDict() | {"diff": r.diff and f"Accuracy: {r.accuracy}\n{r.diff}"} for r in frame.collect()}
    got = {(r.problem_id, r.generation_id): r.asDict() for r in record_tree.read_tree(spark, path).collect()}
    assert got == want
    record_tree.write_tree(frame.where("problem_id = 'p2'").withColumn("program", F.lit("z")), path)  # once more: replaced
    assert {r.problem_id: r.program for r in record_tree.read_tree(spark, f"file://{path}", "problem_id string, program string").where("program IS NOT NULL").collect()} == {"p1": "x = 1\n", "p2": "z"}
    record_tree.write_tree(frame.where("problem_id = 'p2'"), path, mode="overwrite")
    assert os.listdir(path) == ["p2"]


def test_record_tree_undirected(spark, tmp_path):
    path = str(tmp_path / "tree")
    record_tree.write_tree(generations(spark).select("problem_id", "generation_id", "coherence", "program", "diff"), path, directed=False)
    assert sorted(os.listdir(f"{path}/p1")) == ["generation_0_coh_0.5", "generation_1_coh_1.0"]
    rows = record_tree.read_tree(spark, path).collect()
    assert len(rows) == 3 and all(r.accuracy is None and r.diff is None and r.generation is None for r in rows)


def test_record_tree_prunes_problems(spark, tmp_path):
    path = str(tmp_path / "tree")
    frame = spark.range(40).select(F.format_string("p%d", F.col("id") % 20).alias("problem_id"), F.col("id").cast("int").alias("generation_id"), F.lit(1.0).alias("coherence"), F.lit("x").alias("program"))
    record_tree.write_tree(frame, path, directed=False)
    for name in os.listdir(path):
        if name != "p3":
            for folder in os.listdir(f"{path}/{name}"):
                os.chmod(f"{path}/{name}/{folder}/prog.txt", 0)
    read = record_tree.read_tree(spark, path).where("problem_id = 'p3'")
    assert sorted(r.generation_id for r in read.collect()) == [3, 23]
    assert read.rdd.getNumPartitions() == 1  # of 2 for all problems
    assert record_tree.read_tree(spark, path, "problem_id string, generation_id int").where("problem_id IN ('p3', 'p4', 'none')").count() == 4


def test_record_tree_failure_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "tree")
    bad = generations(spark).union(spark.createDataFrame([("../up", 0, 0.0, 0.0, "", "", "", "", "")], SCHEMA))
    with pytest.raises(Exception, match="no folder can have the name"):
        record_tree.write_tree(bad.coalesce(1), path)
    assert not [f for _, _, files in os.walk(path) for f in files]


def test_record_tree_empty_and_strange(spark, tmp_path):
    path = str(tmp_path / "tree")
    record_tree.write_tree(generations(spark).limit(0), path)
    os.makedirs(f"{path}/p/notes")
    os.makedirs(f"{path}/p/generation_7_coh_True_acc_x")
    rows = record_tree.read_tree(spark, path).collect()
    assert [(r.generation_id, r.coherence, r.accuracy, r.program) for r in rows] == [(7, 1.0, None, None)]
    with pytest.raises(Exception, match="no such columns"):
        record_tree.read_tree(spark, path, "problem_id string, other string").collect()


def test_running_distinct_n(spark, tmp_path):
    """Four batches, the second repeating rows of the first and the last with a row that is later than the watermark lets (which
    holds for rows one batch after it moved)."""
    schema = "problem_id string, generation_id int, ts timestamp, tokens array<string>"
    t = lambda text: text.split()
    batches = [
        [("p", 0, "2024-01-01 00:00:00", t("a b c")), ("p", 1, "2024-01-01 00:01:00", t("a b d")), ("q", 0, "2024-01-01 00:00:00", [])],
        [("p", 0, "2024-01-01 00:02:00", t("a b c")), ("p", 2, "2024-01-01 02:00:00", t("x y")), ("p", 2, "2024-01-01 02:00:00", t("x y")), ("r", 5, "2024-01-01 02:00:00", None)],
        [("p", 4, "2024-01-01 02:30:00", t("b c"))],
        [("p", 3, "2024-01-01 00:30:00", t("too late now")), ("q", 1, "2024-01-01 02:31:00", t("m n o"))],
    ]
    for i, rows in enumerate(batches):
        made = spark.createDataFrame(rows, "problem_id string, generation_id int, ts string, tokens array<string>").withColumn("ts", F.col("ts").cast("timestamp"))
        made.coalesce(1).write.parquet(f"{tmp_path}/{i}")
        name = next(f for f in os.listdir(f"{tmp_path}/{i}") if f.endswith(".parquet"))
        os.makedirs(f"{tmp_path}/in", exist_ok=True)
        os.rename(f"{tmp_path}/{i}/{name}", f"{tmp_path}/in/{i}.parquet")
        os.utime(f"{tmp_path}/in/{i}.parquet", (1700000000 + i, 1700000000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    once = running.first_arrivals(stream, ["problem_id", "generation_id"], "ts", "1 hour")
    updates = running.running_distinct_n(once, "problem_id", "tokens", 2)
    table = monitor.run_to_table(updates, f"{tmp_path}/out", f"{tmp_path}/offsets", updates.schema)
    got = sorted((r.problem_id, r.members, r.n_distinct, r.n_total) for r in table.collect())
    assert got == [("p", 2, 3, 4), ("p", 3, 4, 5), ("p", 4, 4, 6), ("q", 1, 0, 0), ("q", 2, 2, 2), ("r", 1, 0, 0)]
    last = {r.problem_id: r.distinct_n for r in running.latest(table, "problem_id").collect()}
    # The same as of a table of what came in time, each once.
    rows = {(p, g): w for b in batches for p, g, _, w in b if (p, g) != ("p", 3)}
    frame = spark.createDataFrame([(p, g, w) for (p, g), w in rows.items()], "problem_id string, generation_id int, tokens array<string>")
    batch = {r.problem_id: r.distinct_n for r in lexical.distinct_n(frame, ["problem_id"], "tokens", range(2, 3)).collect()}
    assert last == {"p": pytest.approx(batch["p"]), "q": 1.0, "r": None}


def test_registered_functions(spark):
    registered.register(spark)
    spark.createDataFrame([(1, "x = 1 # a b\n"), (2, None), (3, "f(")], "id int, code string").createOrReplaceTempView("programs")
    got = spark.sql("SELECT id, t.* FROM programs, LATERAL python_tokens(code, comments => false, kinds => true) t ORDER BY id, at").collect()
    assert [(r.id, r.at, r.token, r.kind) for r in got] == [(1, 0, "x", "code"), (1, 1, "=", "code"), (1, 2, "1", "code"), (1, 3, "\n", "newline"), (3, 0, "f", "code"), (3, 1, "(", "code"), (3, 2, "", "newline")]
    assert spark.sql("SELECT * FROM programs, LATERAL python_tokens(code)").columns == ["id", "code", "at", "token"]
    assert [r[0] for r in spark.sql("SELECT parses(code) FROM programs ORDER BY id").collect()] == [True, None, False]
    assert spark.sql("SELECT renamed_program('def f(a):\n    return a') AS x").first().x == "def FUNC_0(VAR_0):\n    return VAR_0"
    heights = spark.sql("SELECT height, sum(t.count) AS n FROM programs, LATERAL subtrees(code, 'plain', lowest => 2, highest => 4) t GROUP BY 1").collect()
    want = Counter()
    for (height, _), n in pyast.subtrees("x = 1 # a b\n", "plain", (2, 3, 4)).items():
        want[height] += n
    assert {r.height: r.n for r in heights} == want
    for bad in ("python_tokens(id)", "python_tokens(code, kinds => id > 0)", "subtrees(code, 'other')", "subtrees(code, 'plain', lowest => 5, highest => 4)"):
        with pytest.raises(Exception, match="has to be|none of|above"):
            spark.sql(f"SELECT * FROM programs, LATERAL {bad}").collect()


def test_sketches_are_near_and_merge(spark):
    frame = spark.range(4000).select((F.col("id") % 2).alias("a"), (F.col("id") % 5).alias("b"), F.array(*((F.xxhash64("id", F.lit(i)) % 3000).cast("string") for i in range(12))).alias("tokens"))
    finer = lexical.gram_sketches(frame, ["a", "b"], "tokens", range(1, 4))
    for keys in (["a"], ["b"]):
        exact = {tuple(r[k] for k in [*keys, "n"]): r for r in lexical.distinct_n(frame, keys, "tokens", range(1, 4)).collect()}
        got = lexical.sketched_distinct_n(lexical.rolled_up(finer, keys)).collect()
        assert len(got) == len(exact)
        for r in got:
            want = exact[tuple(r[k] for k in [*keys, "n"])]
            assert r.n_total == want.n_total and abs(r.n_distinct / want.n_distinct - 1) < 0.05
    one = lexical.sketched_distinct_n(lexical.gram_sketches(spark.createDataFrame([(1, ["a"])], "k int, tokens array<string>"), ["k"], "tokens", range(1, 2)))
    assert [(r.n_distinct, r.n_total, r.distinct_n) for r in one.collect()] == [(1, 1, None)]
