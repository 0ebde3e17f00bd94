"""Hand-made cases and brute force."""

import hashlib
import html
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from progdiv.functions import text as T
from progdiv.operators import dataset, embedding, estimators, lexical, records, semantic, summary, syntactic
from progdiv.schemas import EXECUTIONS


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def executions(spark, rows):
    return spark.createDataFrame(rows, EXECUTIONS)


def test_semantic_example(spark):
    rows = [("p", g, str(i), i, x, str(int(x) ** (g + 1)), str(int(x) ** 2)) for g in (0, 1) for i, x in enumerate(("3", "4"))]
    gen = records.per_generation(executions(spark, rows))
    found = {r["generation_id"]: r for r in gen.collect()}
    assert found[0]["semantic"] == "testcase_input: 3, output: 3\ntestcase_input: 4, output: 4\n"
    assert found[1]["semantic"] == "testcase_input: 3, output: 9\ntestcase_input: 4, output: 16\n"
    assert (found[0]["accuracy"], found[1]["accuracy"]) == (0.0, 1.0)
    m = semantic.semantic_metrics(gen, ["problem_id"]).first()
    assert (m["semantic_count"], m["semantic_proportion"], m["pairwise_semantic"]) == (2, 1.0, 1.0)


def test_arrays_of_outputs_against_rows(spark):
    r = random.Random(9)
    words = ["a", "a ", "\ta", "b", "", " ", "ab", "Error", "Syntax Error", "Unknown Error", "x\ntestcase_input: 2, output: y", "y", "x", "y\ntestcase_input: 3, output: y"]
    runs = [(f"p{p}", g, [r.choice(words[:4] if p % 2 else words) for _ in range(1 + p % 3)], r.choice(["a", " a", "", None])) for p in range(40) for g in range(6)]
    runs += [("q", 0, ["x\ntestcase_input: 2, output: y", "z"], "z"), ("q", 1, ["x", "y\ntestcase_input: 2, output: z"], None), ("q", 2, ["x", "y"], "y")]
    again = runs + [x[:3] + (e,) for x, e in zip(runs[::5], itertools.cycle(["b", "a", None]))]
    rows = [(p, g, str(i + 1), i, str(i + 1), o, e) for p, g, outputs, e in again for i, o in enumerate(outputs)]
    want = records.per_generation(executions(spark, rows))
    have = records.per_generation_of_arrays(spark.createDataFrame(again, "problem_id string, generation_id int, outputs array<string>, expected string"))
    assert have.drop("semantic_key").columns == want.columns
    assert sorted(map(repr, have.drop("semantic_key").collect())) == sorted(map(repr, want.collect()))
    strings = have.select("problem_id", "semantic", "semantic_key").distinct().collect()
    assert len(strings) == len({(x[0], x[1]) for x in strings}) == len({(x[0], x[2]) for x in strings})
    for f in (lambda g: semantic.semantic_metrics(g, ["problem_id"]), semantic.record_type_report, semantic.coherent_share_of_all):
        assert sorted(map(repr, f(have).collect())) == sorted(map(repr, f(want).collect()))


def test_null_below_two(spark):
    gen = records.per_generation(executions(spark, [("p", 0, "0", 0, "1", "Timeout", None)]))
    m = semantic.semantic_metrics(gen, ["problem_id"]).first()
    assert m["semantic_proportion"] is None and m["pairwise_semantic"] is None
    report = {r["recordtype"]: r for r in semantic.record_type_report(gen).collect()}
    assert len(report) == 6 and report["acc"]["n"] == 0 and report["err"]["n"] == 1 and report["all"]["avg_accuracy"] is None


def test_pairwise_against_loops(spark):
    r = random.Random(3)
    rows = [(f"p{p}", g, "0", 0, "1", r.choice("abc"), "a") for p in range(5) for g in range(r.randint(1, 9))]
    got = {x["problem_id"]: x["pairwise_semantic"] for x in semantic.semantic_metrics(records.per_generation(executions(spark, rows)), ["problem_id"]).collect()}
    for p in got:
        out = [x[5] for x in rows if x[0] == p]
        pairs = list(itertools.combinations(out, 2))
        assert got[p] == (pytest.approx(sum(a != b for a, b in pairs) / len(pairs)) if pairs else None)


def test_fail_fast_is_lexicographic(spark):
    df = spark.createDataFrame([("g", "2", "ok"), ("g", "10", "Timeout"), ("g", "3", "ok")], "k string, tc string, output string")
    got = {r["tc"]: r["output"] for r in records.fail_fast(df, ["k"], ["tc"]).collect()}
    assert got == {"10": "Timeout", "2": "Error", "3": "Error"}


def test_map_predicates(spark):
    df = spark.sql("SELECT map('0', 'Error', '1', 'x') AS o, map('0', 'Error ', '1', 'x') AS e UNION ALL SELECT map(), map()")
    got = df.select(records.is_coherent(F.col("o")), records.is_syntactically_correct(F.col("o")), records.is_accurate(F.col("o"), F.col("e")), records.has_output(F.col("o"))).collect()
    assert [tuple(r) for r in got] == [(False, True, True, True), (True, True, True, True)]


def test_text(spark):
    assert one(spark, T.clean_output(F.col("t")), t="\n\t" + "x" * 6000 + " ") == "x" * 5000
    assert one(spark, T.confidence(F.col("t")), t="Confidence:  80% Confidence: 1%") == 0.8
    assert one(spark, T.confidence(F.col("t")), t="none") is None
    assert one(spark, T.format_prompt(F.col("t"), F.col("d")), t="a ## DESCRIPTION b ## DESCRIPTION", d="X") == "a X b X"
    assert one(spark, T.html_to_text(F.col("t")), t="<p>a &lt;b<!-- x\ny --></p>&amp;c") == "a <b&c"
    assert one(spark, T.left_justify(F.col("t"), 5), t="abc") == "abc  " and one(spark, T.left_justify(F.col("t"), 2), t="abc") == "abc"
    assert one(spark, T.hoist_docstrings(F.col("t")), t='a """x""" b \'\'\'y\'\'\'') == '"""\nx\ny\n"""'
    with pytest.raises(Exception, match="placeholder"):
        one(spark, T.format_prompt(F.col("t"), F.col("d")), t="## DESCRIPTION", d="## DESCRIPTION")


def grams(tokens, n):
    return [tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1)]


def test_lexical_against_loops(spark):
    r = random.Random(5)
    rows = [(k, i, [r.choice("abcd") for _ in range(r.randint(0, 9))]) for k in range(3) for i in range(6)]
    df = spark.createDataFrame(rows, "k int, m int, tokens array<string>")
    for n in (1, 2, 3):
        distinct = {x["k"]: x["distinct_n"] for x in lexical.distinct_n(df, ["k"], "tokens", range(n, n + 1)).collect()}
        jac = {x["k"]: x["jaccard"] for x in lexical.jaccard(df, ["k"], "m", "tokens", n).collect()}
        boot = {x["k"]: x["bootstrap_distinct"] for x in lexical.bootstrap_distinct_n(df, ["k"], "m", "tokens", n, 50).collect()}
        for k in range(3):
            all_ = [grams(t, n) for kk, _, t in rows if kk == k]
            flat = [g for x in all_ for g in x]
            assert distinct.get(k) == (pytest.approx(len(set(flat)) / len(flat)) if len(flat) > 1 else None)
            full = [x for x in all_ if x]
            pairs = [1 - len(set(a) & set(b)) / len(set(a) | set(b)) for a, b in itertools.combinations(full, 2)]
            assert jac[k] == pytest.approx(sum(pairs) / len(pairs))
            rr, values = random.Random(42), []
            for _ in range(50):
                a, b = rr.choices(full, k=2)
                if len(a) + len(b) > 1:
                    values.append(len(set(a) | set(b)) / (len(a) + len(b)))
            assert boot[k] == pytest.approx(sum(values) / len(values))


def bleu(h, ref):
    total, hit = [], []
    for n in range(1, 5):
        a, b = grams(h, n), grams(ref, n)
        total.append(max(len(h) - n + 1, 0))
        hit.append(sum(min(a.count(g), b.count(g)) for g in set(a)))
    if not any(hit):
        return 0.0
    s, logs = 1.0, []
    for t, m in zip(total, hit, strict=True):
        if not t:
            break
        if m == 0:
            s *= 2
        logs.append(math.log(100 / (s * t) if m == 0 else 100 * m / t))
    return (math.exp(1 - len(ref) / len(h)) if len(h) < len(ref) else 1.0) * math.exp(sum(logs) / len(logs))


def test_bleu_against_loops(spark):
    r = random.Random(6)
    rows = [(0, i, [r.choice("abc") for _ in range(r.randint(0, 8))]) for i in range(9)]
    got = {(x["a"], x["b"]): x["distance"] for x in lexical.bleu_pairs(spark.createDataFrame(rows, "k int, m int, tokens array<string>"), ["k"], "m", "tokens").collect()}
    for a, b in itertools.combinations(range(9), 2):
        assert got[a, b] == pytest.approx(100 - bleu(rows[a][2], rows[b][2])), (a, b)


def test_cosine(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 2.0]), (1, [1.0, 1.0]), (2, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [-3.0, 0.0])], "k int, embedding array<double>")
    got = {r["k"]: r["cosine_distance"] for r in embedding.cosine_distance(df, ["k"]).collect()}
    assert got[0] == pytest.approx(1.0) and got[1] is None and got[2] is None and got[3] == pytest.approx(2.0)


def test_describe_drops_undefined(spark):
    df = spark.createDataFrame([("m", 1.0), ("m", None), ("m", float("nan")), ("m", 3.0)], "metric string, value double")
    r = summary.describe(df, ["metric"]).first()
    assert (r["count"], r["mean"], r["q50"], r["max"]) == (2, 2.0, 2.0, 3.0)


def test_leaderboard(spark):
    ex = spark.createDataFrame([("a", False), ("b", True)], "experiment_id string, failed boolean")
    stats = spark.createDataFrame([("a", "semantic_count", 2.345), ("a", "share", 0.5)], "experiment_id string, metric string, value double")
    got = {r["experiment_id"]: r for r in summary.leaderboard(ex, stats, ["semantic_count", "share", "gone"]).collect()}
    assert got["a"]["share"] == "50.0" and got["a"]["gone"] == "NOT_FOUND" and got["b"]["share"] == "ERROR"


def test_entropy_and_degree(spark):
    df = spark.createDataFrame([(0, "a", 1.0), (0, "a", 2.0), (0, "b", 0.5)], "k int, o string, nll double")
    want = -(math.log(math.exp(1) + math.exp(2)) + 0.5) / 2
    assert estimators.semantic_entropy(df, ["k"], "o", "nll").first()["semantic_entropy"] == pytest.approx(want)
    sims = spark.createDataFrame([(0, i, j, 1.0) for i in range(3) for j in range(3)], "k int, i bigint, j bigint, sim double")
    assert estimators.degree(sims, ["k"])[1].first()["uncertainty"] == pytest.approx(1 / 3 - 1)
    assert estimators.spectral_eigenvalues(sims, ["k"], "k int").first()["spectral_eigv"] == pytest.approx(1.0)


def test_splits_and_merges(spark):
    df = spark.range(40).withColumnRenamed("id", "x")
    parts = {r["part"]: r["count"] for r in dataset.split(df, "x").groupBy("part").count().collect()}
    assert parts == {"train": 28, "test": 6, "val": 6}
    a, b = spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(1, "b"), (2, "b")], "k int, v string")
    assert sorted(map(tuple, dataset.merge_first([a, b], ["k"]).collect())) == [(1, "a"), (2, "b")]


def test_syntactic(spark):
    from progdiv.functions.pyast import subtree_rows

    rows = [("p", 0, "x = 1\nprint(x)"), ("p", 1, "y = 2\nprint(y)"), ("p", 2, "def ("), ("p", 3, "")]
    subs = subtree_rows(spark.createDataFrame(rows, "k string, m int, code string"), ["k"], "m", "code")
    found = {(r["variant"], r["height"]): r for r in syntactic.distinct_subtrees(subs, ["k"]).collect()}
    assert found["plain", 3]["prop_distinct"] == 1.0 and found["stripped", 3]["prop_distinct"] < 1.0
    jac = {(r["variant"], r["height"]): r for r in syntactic.jaccard_subtrees(subs, ["k"], "m").collect()}
    assert jac["plain", 3]["n"] == 3 and 0 <= jac["stripped", 3]["jaccard"] < jac["plain", 3]["jaccard"]


def test_execution(spark):
    from progdiv.operators.execution import execute, local_runner

    progs = {0: "print(int(input()) * 2)", 1: "print(", 2: "x = input()\nif x == '1':\n    raise ValueError\nprint(x)", 3: "while True: pass"}
    rows = [("p", g, t, k, code, i, "2") for g, code in progs.items() for k, (t, i) in enumerate((("2", "3"), ("10", "1")))]
    cases = spark.createDataFrame(rows, "problem_id string, generation_id int, testcase_id string, pos int, program string, input string, expected string")
    got = {(r["generation_id"], r["testcase_id"]): r["output"] for r in execute(cases, local_runner(timeout=2)).collect()}
    assert [got[g, t] for g in range(4) for t in ("10", "2")] == ["2", "6", "Syntax Error", "Error", "Runtime Error", "Error", "Timeout", "Error"]


def test_make_clusters(spark):
    out = semantic.make_clusters(executions(spark, [("p", g, "0", 0, "1", "x", "x") for g in range(2)]))
    assert out["semantic_strings_2_programs"].first()["members"] == [0, 1] and out["program_2_accuracy"].first()["accuracy"] == 1.0


def test_tokens_13a(spark):
    assert one(spark, T.tokens_13a(F.col("t")), t='Hello, world! 3.5 (a-b) 7-8 "q" &amp; x.') == ["Hello", ",", "world", "!", "3.5", "(", "a-b", ")", "7", "-", "8", '"', "q", '"', "&", "x", "."]


def test_syntactic_against_loops(spark):
    """Distinct shares, Jaccard and bootstrap of several program shapes from the programs' own subtree counts."""
    from progdiv.functions.pyast import subtree_rows, subtrees

    progs = ["x = 1\nprint(x)", "def f(a):\n    return [a + i for i in range(a)]", "y = 2\nprint(y)", "class A:\n    def g(self):\n        return self.v if self.v else None", "def (", "x = 1\nprint(x)", "for k in z:\n    if k:\n        print(k * 2)", ""]
    rows = [("p", i, c) for i, c in enumerate(progs)]
    subs = subtree_rows(spark.createDataFrame(rows, "k string, m int, code string"), ["k"], "m", "code")
    distinct = {(r["variant"], r["height"]): (r["n_distinct"], r["n_total"]) for r in syntactic.distinct_subtrees(subs, ["k"]).collect()}
    jac = {(r["variant"], r["height"]): r["jaccard"] for r in syntactic.jaccard_subtrees(subs, ["k"], "m").collect()}
    boot = {(r["variant"], r["height"]): r["bootstrap_distinct"] for r in syntactic.bootstrap_subtrees(subs, ["k"], "m").collect()}
    assert {v for v, _ in distinct} >= {"plain", "stripped", "obfuscated"}
    for variant, h in distinct:
        each = [{g: n for (k, g), n in found.items() if k == h} for c in progs if (found := subtrees(c, variant, (3, 4, 5, 6))) is not None]
        assert distinct[variant, h] == (len(set().union(*each)), sum(sum(x.values()) for x in each)), (variant, h)
        pairs = [1 - len(set(a) & set(b)) / len(set(a) | set(b)) for a, b in itertools.combinations(each, 2) if set(a) | set(b)]
        assert jac[variant, h] == (pytest.approx(sum(pairs) / len(pairs)) if pairs else None), (variant, h)
        full, r, values = [x for x in each if x], random.Random(42), []
        for _ in range(300) if len(full) > 1 else ():
            a, b = r.choices(full, k=2)
            if (total := sum(a.values()) + sum(b.values())) > 1:
                values.append(len(set(a) | set(b)) / total)
        assert boot.get((variant, h)) == (pytest.approx(sum(values) / len(values)) if values else None), (variant, h)


def test_spectral_estimates_of_known_graphs(spark):
    """Two cliques without a link are two meanings, and each place is as far from the centre as the projection says."""
    import numpy as np

    w = np.zeros((5, 5))
    w[:2, :2] = w[2:, 2:] = 1
    sims = spark.createDataFrame([(0, i, j, float(w[i, j])) for i in range(5) for j in range(5)], "k int, i bigint, j bigint, sim double")
    assert estimators.spectral_eigenvalues(sims, ["k"], "k int").first()["spectral_eigv"] == pytest.approx(2.0)
    got = {r["i"]: r for r in estimators.eccentricity(sims, ["k"], "k int").collect()}
    # The span of both cliques' own vectors: distances to its centre don't depend on the basis.
    v = np.array([[0.5**0.5, 0], [0.5**0.5, 0], [0, 3**-0.5], [0, 3**-0.5], [0, 3**-0.5]])
    off = np.linalg.norm(v - v.mean(axis=0), axis=1)
    assert [got[i]["confidence"] for i in range(5)] == pytest.approx((-off).tolist())
    assert got[0]["uncertainty"] == pytest.approx(min(1.0, np.linalg.norm(v - v.mean(axis=0), 2)))


def test_generated_cases(spark):
    rows = dataset.random_testcases(spark, 20, -3, 9, 4).collect()
    again = dataset.random_testcases(spark, 20, -3, 9, 4).collect()
    assert rows == again and len({r["input"] for r in rows}) > 10
    for r in rows:
        n, items = r["input"].split("\n")
        assert n == "4" and len(items.split()) == 4 and all(-3 <= int(x) <= 9 for x in items.split())


def test_marks_left_in_wrappers_fail(spark):
    with pytest.raises(Exception, match="mark left"):
        one(spark, T.wrap_open_ended(F.col("w"), F.col("p"), F.lit("e")), w="## REPLACE F", p="## REPLACE EXTRACT ## REPLACE F")


def test_experiments_outside_of_their_root_fail(spark):
    e = spark.createDataFrame([(1, "other/x", "root/")], "id int, folder string, root string")
    with pytest.raises(Exception, match="not below its root"):
        dataset.to_reevaluate(e, e, e.where("false"), "id", "folder", "root").collect()


def test_character_references_against_the_standard(spark):
    texts = ["&amp;lt; &#38;amp; &a&#109;p;", "&eacute;&euro;&nbsp;&#x41;&#X1f600;&#9731;", "a & b &; &nope; &#; &#xZ;", "", None, "none", "&apos;&quot;" * 50]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["x"] for r in df.select("i", T.decode_references(F.col("t")).alias("x")).collect()}
    assert [got[i] for i in range(len(texts))] == [None if t is None else html.unescape(t) for t in texts]
    odd = spark.createDataFrame([("&#0;&#55296;&#99999999999;&#xFFFFFFFFFF;",)], "t string").select(T.decode_references(F.col("t"))).first()[0]
    assert odd == "\ufffd" * 4


def test_maps_of_names(spark):
    maps = spark.createDataFrame([({"a": "x"}, {"b": "y"}, {"a": "z"})], "a map<string,string>, b map<string,string>, c map<string,string>")
    got = maps.select(T.merged_names(F.col("a"), F.col("b")).alias("m"), T.inverse_names(F.col("b")).alias("i")).first()
    assert got["m"] == {"a": "x", "b": "y"} and got["i"] == {"y": "b"}
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        maps.select(T.merged_names(F.col("a"), F.col("c"))).collect()


@pytest.mark.parametrize("size", [1, 100_000])
def test_split_does_not_depend_on_slices(spark, monkeypatch, size):
    monkeypatch.setattr(dataset, "_SLICE", size)
    rows = spark.createDataFrame([(str(i),) for i in range(300)] + [(None,)], "k string")
    got = {r["k"]: r["part"] for r in dataset.split(rows, "k").collect()}
    order = sorted(got, key=lambda k: ("" if k is None else hashlib.md5(k.encode()).hexdigest(), k or ""))
    assert [got[k] for k in order] == ["train"] * 210 + ["test"] * 45 + ["val"] * 46


def test_configuration_values():
    from progdiv.sources.readers import _scalar

    assert [_scalar(v) for v in (" a # why", "'a # b' # c", '"x"', "a#b", " # none", "")] == ["a", "a # b", "x", "a#b", "", ""]


def test_significance_against_integration(spark):
    def tail(r, f):
        x = (np.arange(400_000) + 0.5) / 400_000 * math.acos(abs(r))  # the density of t after t = sqrt(f) tan(pi / 2 - x)
        return float(np.sum(np.sin(x) ** (f - 1)) / 400_000 * math.acos(abs(r)) * 2 * math.exp(math.lgamma((f + 1) / 2) - math.lgamma(f / 2)) / math.sqrt(math.pi))

    rows = [(r, f) for r in (0.0, 0.01, -0.05, 0.3, -0.9, 0.999) for f in (1, 2, 3, 4, 7, 30, 1999, 2000, 2001, 5000)]
    df = spark.createDataFrame(rows + [(1.0, 5), (-1.0, 9000), (None, 5), (0.5, 0)], "r double, f bigint")
    got = {(x["r"], x["f"]): x["p"] for x in df.select("r", "f", summary.correlation_p(F.col("r"), F.col("f")).alias("p")).collect()}
    for r, f in rows:
        assert got[r, f] == pytest.approx(tail(r, f), abs=2e-6), (r, f)
    assert got[1.0, 5] == got[-1.0, 9000] == 0 and got[None, 5] is None and got[0.5, 0] is None


def test_report_deals_generations_and_not_types_or_pairs(spark, sf):
    """A problem's n-grams and pairs stay where its generations are: nothing is dealt by record type, n-gram or pair."""
    import re

    from progdiv.plans.catalogue import QUERIES

    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"]
    old = [spark.conf.get(n) for n in names]
    try:
        for n, v in zip(names, ["-1", "false"], strict=True):
            spark.conf.set(n, v)
        plan = QUERIES["metrics_by_recordtype"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        for n, v in zip(names, old, strict=True):
            spark.conf.set(n, v)
    dealt = {re.sub(r"#\d+L?", "", k) for k in re.findall(r"Exchange hashpartitioning\(([^)]*?), \d+\)", plan)}
    assert dealt <= {"l_orderkey", "problem_id", "problem_id, generation_id", "vector_id"}


def test_counted_grams_meet_as_counts_do(spark):
    from collections import Counter

    a, b = ["x", "y", "x", "y", "x", "x"], ["x", "y", "x", "z", "x"]
    rows = lexical.with_counted_grams(spark.createDataFrame([(0, a), (1, b), (2, None)], "m int, tokens array<string>"), "tokens", range(1, 4)).collect()
    for n in range(1, 4):
        both = Counter(zip(*(a[i:] for i in range(n)), strict=False)) & Counter(zip(*(b[i:] for i in range(n)), strict=False))
        assert sum(len(set(rows[0][c]) & set(rows[1][c])) for c in (f"g{n}", f"r{n}")) == sum(both.values())
        assert rows[2][f"g{n}"] == rows[2][f"r{n}"] == []


def test_prose_is_shuffled_once_a_place(spark):
    words = [["a", "b", "a", "b", "a", "b", "c"], ["a", "b"], ["a"], [], None, ["a", "b", "a", "c"], ["c"] * 9]
    frame = spark.createDataFrame([(i % 2, w) for i, w in enumerate(words)] + [(None, ["a", "b", "a"])], "k int, tokens array<string>")
    for orders in (range(1, 7), range(2, 4), range(1, 2), range(3, 5), range(2, 3)):
        rows = [sorted(map(str, lexical.distinct_n(frame, ["k"], "tokens", orders, prose=p).select("k", "n", "n_distinct", "n_total", "distinct_n").collect())) for p in (False, True)]
        assert rows[0] == rows[1]
    plan = lexical.distinct_n(frame, ["k"], "tokens", range(2, 7), prose=True)._jdf.queryExecution().executedPlan().toString()
    assert "_w1#" in plan.split("hashpartitioning(k#", 2)[2] and ", h#" not in plan


def test_sketches_of_all_orders_are_of_one_group(spark):
    """A group for every order would pass the number of groups above which Spark sorts all n-grams."""
    frame = spark.createDataFrame([(0, ["a", "b", "a"]), (1, ["a"])], "k int, tokens array<string>")
    out = lexical.gram_sketches(frame, ["k"], "tokens", range(1, 3))
    assert {(r.k, r.n): r.n_total for r in out.collect()} == {(0, 1): 3, (0, 2): 2, (1, 1): 1}
    assert "keys=[k#" in (plan := out._jdf.queryExecution().executedPlan().toString()) and ", n#" not in "".join(x.split("]")[0] for x in plan.split("keys=[")[1:])


def test_semantic_entropy_without_a_join_of_scores(spark):
    rows = [(0, "x", -700.0), (0, "x", 700.0), (0, "y", -1.0), (0, "y", -2.5), (1, "x", -1e5), (1, "x", -1e5), (1, "y", None), (2, "x", None)]
    out = estimators.semantic_entropy(spark.createDataFrame(rows, "k int, o string, nll double"), ["k"], "o", "nll")
    got = {r.k: r.semantic_entropy for r in out.collect()}
    assert got[0] == pytest.approx(-(700 + math.log(math.exp(-1) + math.exp(-2.5))) / 2)
    assert got[1] == pytest.approx(1e5 - math.log(2)) and got[2] is None
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
