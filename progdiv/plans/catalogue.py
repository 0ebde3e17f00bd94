"""The query catalogue on the standard tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from progdiv.functions import text as T
from progdiv.functions.extract import FENCE, extract_python_code
from progdiv.functions.pyast import subtree_rows
from progdiv.operators import dataset, embedding, estimators, lexical, records, report, semantic, summary, syntactic
from progdiv.sources import readers, sinks
from progdiv.streaming import monitor

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# ---------------------------------------------------------------------------------------------------
# Executions from orders (generations of a customer's problem) and their lines (test cases).

EXEC = """WITH ranked AS (
    SELECT l_orderkey, l_returnflag, l_quantity, l_linestatus, row_number() OVER (PARTITION BY l_orderkey
        ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS tc FROM lineitem),
cases AS (SELECT o_custkey AS c, coalesce(max(tc), 1) AS n FROM orders LEFT JOIN ranked ON l_orderkey = o_orderkey GROUP BY 1),
g AS (SELECT o_custkey, o_orderkey, o_orderstatus, unnest(range(1, n + 1)) AS tc FROM orders JOIN cases ON c = o_custkey),
ex AS (
    SELECT o_custkey AS problem_id, o_orderkey AS generation_id, CAST(g.tc AS VARCHAR) AS testcase_id, g.tc - 1 AS pos, CAST(g.tc AS VARCHAR) AS input,
        CASE WHEN l_orderkey IS NULL THEN 'Unknown Error' WHEN l_returnflag = 'R' AND l_quantity > 40 THEN 'Runtime Error'
            WHEN l_returnflag = 'A' AND l_quantity < 6 THEN 'Syntax Error' ELSE l_linestatus END AS output, o_orderstatus AS expected
    FROM g LEFT JOIN ranked r ON r.l_orderkey = o_orderkey AND r.tc = g.tc),
gen AS (
    SELECT problem_id, generation_id, count(*) AS n_outputs, count(*) FILTER (WHERE output NOT IN ('Syntax Error', 'Runtime Error', 'Timeout', 'Error', 'Unknown Error')) AS n_coherent,
        count(*) FILTER (WHERE output = 'Syntax Error') AS n_syntax, count(*) FILTER (WHERE output = expected) AS n_correct,
        string_agg('testcase_input: ' || input || ', output: ' || output || chr(10), '' ORDER BY pos) AS semantic
    FROM ex GROUP BY ALL),
flags AS (SELECT *, n_coherent = n_outputs AS coherent, n_syntax = 0 AS syntactic, n_correct = n_outputs AS accurate FROM gen),
typed AS (SELECT *, unnest(list_filter(['all', CASE WHEN coherent THEN 'coh' END, CASE WHEN syntactic THEN 'syn' END, CASE WHEN NOT coherent THEN 'err' END,
        CASE WHEN accurate THEN 'acc' END, CASE WHEN NOT accurate THEN 'inacc' END], lambda x: x IS NOT NULL)) AS recordtype FROM flags)
"""


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    """Every line of an order is a test case; a problem has as many as its longest order, and an order lacks the others.

    An order's outputs are one array and are dealt by problem, so that grouping them by problem or generation shuffles nothing more.
    Lines are dealt before they are collected, as a task has few of one order."""
    output = F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 40), "Runtime Error").when((F.col("l_returnflag") == "A") & (F.col("l_quantity") < 6), "Syntax Error").otherwise(F.col("l_linestatus"))
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", F.coalesce(output, F.lit("Unknown Error")).alias("output"))
    lines = table(spark, sf, "lineitem").select("l_orderkey", line.alias("line")).repartition("l_orderkey").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    lines = lines.select("l_orderkey", F.col("lines.output").alias("outputs"))
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("problem_id"), F.col("o_orderkey").alias("generation_id"), F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("expected"))
    orders = orders.join(lines, "l_orderkey", "left").drop("l_orderkey").withColumn("outputs", F.coalesce("outputs", F.array().cast("array<string>")))
    # In order of generations, so that their runs are added up as they come.
    problem = Window.partitionBy("problem_id").orderBy("generation_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    orders = orders.withColumn("cases", F.greatest(F.max(F.size("outputs")).over(problem), F.lit(1)))
    missing = F.array_repeat(F.lit("Unknown Error"), F.col("cases") - F.size("outputs"))
    return orders.select("problem_id", "generation_id", F.concat("outputs", missing).alias("outputs"), "expected")


def executions(spark: SparkSession, sf: str) -> DataFrame:
    rows = _runs(spark, sf).select("problem_id", "generation_id", F.posexplode("outputs").alias("pos", "output"), "expected")
    tc = (F.col("pos") + 1).cast("string")
    return rows.select("problem_id", "generation_id", tc.alias("testcase_id"), "pos", tc.alias("input"), "output", "expected")


def generations(spark: SparkSession, sf: str) -> DataFrame:
    return records.per_generation_of_arrays(_runs(spark, sf))


@query(EXEC + "SELECT problem_id, count(*) AS n, count(DISTINCT semantic) AS semantic_count, round(CASE WHEN count(*) > 1 THEN count(DISTINCT semantic) / count(*) END, 6) AS semantic_proportion, "
    "(SELECT round(avg(CASE WHEN a.semantic <> b.semantic THEN 1.0 ELSE 0.0 END), 6) FROM gen a JOIN gen b ON a.problem_id = b.problem_id AND a.generation_id < b.generation_id WHERE a.problem_id = g.problem_id) AS pairwise_semantic "
    "FROM gen g GROUP BY problem_id")  # fmt: skip
def pairwise_semantic_diversity(spark, sf):
    m = semantic.semantic_metrics(generations(spark, sf), ["problem_id"])
    return m.select("problem_id", "n", "semantic_count", r6("semantic_proportion").alias("semantic_proportion"), r6("pairwise_semantic").alias("pairwise_semantic"))


@query(EXEC + "SELECT problem_id, generation_id, n_outputs, n_coherent, round(n_coherent / n_outputs, 6) AS coherence FROM gen")
def coherence_by_generation(spark, sf):
    return generations(spark, sf).select("problem_id", "generation_id", "n_outputs", "n_coherent", r6("coherence").alias("coherence"))


@query(EXEC + "SELECT problem_id, round(avg(CAST(coherent AS INT)), 6) AS avg_coherence FROM flags GROUP BY 1")
def coherence_by_problem(spark, sf):
    return generations(spark, sf).groupBy("problem_id").agg(r6(F.avg((F.col("coherence") == 1.0).cast("double"))).alias("avg_coherence"))


@query(EXEC + "SELECT problem_id, generation_id FROM flags WHERE coherent")
def strict_coherence(spark, sf):
    return generations(spark, sf).where("coherence = 1.0").select("problem_id", "generation_id")


@query(EXEC + "SELECT problem_id, generation_id, n_correct, round(n_correct / n_outputs, 6) AS accuracy FROM gen")
def accuracy_by_generation(spark, sf):
    return generations(spark, sf).select("problem_id", "generation_id", "n_correct", r6("accuracy").alias("accuracy"))


@query(EXEC + "SELECT problem_id, round(avg(CAST(accurate AS INT)), 6) AS avg_accuracy FROM flags GROUP BY 1")
def accuracy_by_problem(spark, sf):
    return generations(spark, sf).groupBy("problem_id").agg(r6(F.avg((F.col("accuracy") == 1.0).cast("double"))).alias("avg_accuracy"))


@query(EXEC + "SELECT problem_id, generation_id, string_agg('testcase_id: ' || testcase_id || ', output: ' || output || ', expected_output: ' || expected, chr(10) ORDER BY pos) AS differing FROM ex WHERE output <> expected GROUP BY 1, 2")
def differing_outputs(spark, sf):
    return records.differing_outputs(executions(spark, sf))


@query(EXEC + "SELECT problem_id, generation_id, semantic FROM gen")
def semantic_strings(spark, sf):
    return generations(spark, sf).select("problem_id", "generation_id", "semantic")


@query(EXEC + "SELECT problem_id, semantic, count(*) AS size, string_agg(CAST(generation_id AS VARCHAR), ',' ORDER BY generation_id) AS members FROM gen GROUP BY 1, 2")
def semantic_clusters(spark, sf):
    c = semantic.clusters(generations(spark, sf), ["problem_id"])
    return c.withColumn("members", F.array_join(F.transform("members", lambda m: m.cast("string")), ","))


@query(EXEC + "SELECT problem_id, round(CASE WHEN count(*) > 1 THEN count(DISTINCT CASE WHEN coherent THEN semantic END) / count(*) END, 6) AS coh_semantic_proportion_of_all FROM flags GROUP BY 1")
def coherent_share_of_all(spark, sf):
    out = semantic.coherent_share_of_all(generations(spark, sf))
    return out.select("problem_id", r6("coh_semantic_proportion_of_all").alias("coh_semantic_proportion_of_all"))


_FILTERED = """, prog AS (SELECT f.*, CASE WHEN o.o_orderpriority LIKE '1%' THEN '' ELSE o.o_orderpriority END AS program FROM flags f JOIN orders o ON o.o_orderkey = generation_id),
sel AS (SELECT problem_id, semantic, unnest(list_filter([CASE WHEN coherent THEN 'wcoh' END, CASE WHEN coherent AND program <> '' THEN 'wcoh_nonempty' END, CASE WHEN coherent AND program <> '' THEN 'wcoh_nonempty_woutput' END], lambda x: x IS NOT NULL)) AS filter FROM prog)
SELECT problem_id, filter, count(*) AS n, count(DISTINCT semantic) AS semantic_count, round(CASE WHEN count(*) > 1 THEN count(DISTINCT semantic) / count(*) END, 6) AS semantic_proportion FROM sel GROUP BY 1, 2"""


@query(EXEC + _FILTERED)
def semantic_filters(spark, sf):
    program = F.when(F.col("o_orderpriority").startswith("1"), "").otherwise(F.col("o_orderpriority"))
    progs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("generation_id"), program.alias("program"))
    m = semantic.filtered_semantics(generations(spark, sf).join(progs, "generation_id"))
    return m.select("problem_id", "filter", "n", "semantic_count", r6("semantic_proportion").alias("semantic_proportion"))


@query(EXEC + """, grid AS (SELECT DISTINCT problem_id, t.recordtype FROM gen CROSS JOIN (VALUES ('all'), ('coh'), ('syn'), ('err'), ('acc'), ('inacc')) t(recordtype)),
sizes AS (SELECT problem_id, recordtype, semantic, count(*) AS c FROM typed GROUP BY ALL),
pw AS (SELECT problem_id, recordtype, sum(c) AS n, count(*) AS k, sum(c * (c - 1)) AS eq FROM sizes GROUP BY ALL),
sh AS (SELECT problem_id, recordtype, avg(CAST(coherent AS INT)) AS coh, avg(CAST(accurate AS INT)) AS acc FROM typed GROUP BY ALL)
SELECT g.problem_id, g.recordtype, CAST(coalesce(n, 0) AS BIGINT) AS n, coalesce(k, 0) AS semantic_count, round(CASE WHEN n > 1 THEN k / n END, 6) AS semantic_proportion,
    round(CASE WHEN n > 1 THEN 1 - eq / (n * (n - 1)) END, 6) AS pairwise_semantic, round(coh, 6) AS avg_coherence, round(acc, 6) AS avg_accuracy
FROM grid g LEFT JOIN pw USING (problem_id, recordtype) LEFT JOIN sh USING (problem_id, recordtype)""")
def recordtype_report(spark, sf):
    names = ["semantic_proportion", "pairwise_semantic", "avg_coherence", "avg_accuracy"]
    out = semantic.record_type_report(generations(spark, sf))
    return out.select("problem_id", "recordtype", "n", "semantic_count", *(r6(n).alias(n) for n in names))


@query(EXEC + ", m AS (SELECT problem_id, count(DISTINCT semantic) AS semantic_count, avg(CAST(coherent AS INT)) AS avg_coherence, avg(CAST(accurate AS INT)) AS avg_accuracy FROM flags GROUP BY 1), "
    "long AS (SELECT 'semantic_count' AS metric, CAST(semantic_count AS DOUBLE) AS v FROM m UNION ALL SELECT 'avg_coherence', avg_coherence FROM m UNION ALL SELECT 'avg_accuracy', avg_accuracy FROM m) "
    "SELECT metric, count(v) AS count, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min, round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS q50, round(quantile_cont(v, 0.75), 6) AS q75, round(max(v), 6) AS max FROM long GROUP BY 1")  # fmt: skip
def summary_describe(spark, sf):
    out = summary.describe(_problem_metrics(spark, sf), ["metric"])
    return out.select("metric", "count", *(r6(c).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")))


def _problem_metrics(spark, sf):
    gen = generations(spark, sf)
    m = gen.groupBy("problem_id").agg(F.count_distinct(semantic.string_key(gen)).alias("semantic_count"), F.avg((F.col("coherence") == 1.0).cast("double")).alias("avg_coherence"), F.avg((F.col("accuracy") == 1.0).cast("double")).alias("avg_accuracy"))
    return summary.to_long(m, ["problem_id"], ["semantic_count", "avg_coherence", "avg_accuracy"])


@query(EXEC + ", m AS (SELECT problem_id, count(DISTINCT semantic) AS s, avg(CAST(coherent AS INT)) AS c FROM flags GROUP BY 1) SELECT round(avg(s), 2) AS semantic_count, round(avg(c) * 100, 2) AS avg_coherence FROM m")
def leaderboard_scaled(spark, sf):
    stats = _problem_metrics(spark, sf).groupBy("metric").agg(F.avg("value").alias("value"))
    one = lambda m: F.max(F.when(F.col("metric") == m, summary.scaled(F.col("metric"), F.col("value")))).alias(m)
    return stats.agg(one("semantic_count"), one("avg_coherence"))


@query("""WITH e AS (SELECT user_id, event_id, ts, CASE WHEN event_type = 'error' THEN 'Runtime Error' ELSE event_type END AS output FROM events)
SELECT user_id, event_id, CASE WHEN coalesce(max(CASE WHEN output = 'Runtime Error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 THEN 'Error' ELSE output END AS output FROM e""")
def failfast_status(spark, sf):
    e = table(spark, sf, "events").withColumn("output", F.when(F.col("event_type") == "error", "Runtime Error").otherwise(F.col("event_type")))
    return records.fail_fast(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "output")


@query("SELECT event_id, CASE WHEN value > 95 THEN 'Timeout' WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'Syntax Error' WHEN event_type = 'error' THEN 'Runtime Error' ELSE event_type END AS output FROM events")
def status_mapping(spark, sf):
    e = table(spark, sf, "events")
    rc = F.when(F.col("event_type") == "error", 1).otherwise(0)
    err = F.when(F.col("event_id") % 2 == 0, "File x: SyntaxError: bad").otherwise("Traceback")
    return e.select("event_id", records.map_status(rc, err, F.col("value") > 95, F.col("event_type")).alias("output"))


@query("SELECT o_orderkey, coalesce(l.output, 'Unknown Error') AS output FROM orders LEFT JOIN (SELECT l_orderkey, max(l_linestatus) AS output FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey")
def missing_output_default(spark, sf):
    out = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linestatus").alias("output"))
    return records.with_missing_outputs(table(spark, sf, "orders").select("o_orderkey"), out, ["o_orderkey"])


@query("SELECT l_orderkey, count(DISTINCT l_linenumber) FILTER (WHERE l_linenumber BETWEEN 0 AND 3) AS n_found, count(DISTINCT l_linenumber) FILTER (WHERE l_linenumber BETWEEN 0 AND 3) = 4 AS complete FROM lineitem GROUP BY 1")
def completeness_probe(spark, sf):
    found = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("problem_id"), F.col("l_linenumber").alias("generation_id"))
    return records.complete_problems(found, 4).withColumnRenamed("problem_id", "l_orderkey")


@query("""SELECT l_orderkey, count(DISTINCT l_linenumber) FILTER (WHERE l_linenumber < 5) AS n_found, coalesce(array_to_string(list_sort(list_distinct(list(l_linenumber) FILTER (WHERE l_linenumber >= 5))), ','), '') AS outside
FROM lineitem GROUP BY 1 HAVING n_found <> 5 OR count(*) FILTER (WHERE l_linenumber >= 5) > 0""")
def saved_record_faults(spark, sf):
    found = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("problem_id"), F.col("l_linenumber").alias("generation_id"))
    out = readers.record_faults(found, 5)
    return out.select(F.col("problem_id").alias("l_orderkey"), "n_found", F.array_join(F.transform("outside", lambda x: x.cast("string")), ",").alias("outside"))


# ---------------------------------------------------------------------------------------------------
# Lexical diversity.

_WORDS = "list_filter(string_split(text, ' '), lambda x: x <> '')"
_GRAMS = f"""WITH d AS (SELECT %(key)s AS k, {_WORDS} AS t FROM %(table)s),
g AS (SELECT k, n, t[i : i + n - 1] AS gram FROM d, range(1, 7) r(n), range(1, len(t) + 1) s(i) WHERE i + n - 1 <= len(t))
SELECT k AS %(key)s, CAST(n AS INT) AS n, count(DISTINCT gram) AS n_distinct, count(*) AS n_total, round(CASE WHEN count(*) > 1 THEN count(DISTINCT gram) / count(*) END, 6) AS distinct_n FROM g GROUP BY k, n"""


def _benchmark(spark, sf):
    """All items are one group, so all pairs are compared."""
    return _tokens(spark, sf, "benchmark").withColumn("grp", F.lit(0).cast("long"))


def _tokens(spark, sf, name):
    return table(spark, sf, name).withColumn("tokens", lexical.word_tokens(F.col("text")))


@query(_GRAMS % {"key": "lang", "table": "documents"})
def distinct_n_by_lang(spark, sf):
    return lexical.distinct_n(_tokens(spark, sf, "documents"), ["lang"], "tokens", prose=True).withColumn("distinct_n", r6("distinct_n"))


@query(_GRAMS % {"key": "source", "table": "documents"})
def distinct_n_by_source(spark, sf):
    return lexical.distinct_n(_tokens(spark, sf, "documents"), ["source"], "tokens", prose=True).withColumn("distinct_n", r6("distinct_n"))


_DRAWS = ", ".join(f"({i}, {a!r}, {b!r})" for i, a, b in [(d[0], d[2], e[2]) for d, e in zip(lexical.uniforms(300, 2)[::2], lexical.uniforms(300, 2)[1::2], strict=True)])


@query(f"""WITH d AS (SELECT item_id, {_WORDS} AS t FROM benchmark), g AS (SELECT item_id, t[i : i + 1] AS gram FROM d, range(1, len(t)) s(i)),
m AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS pos, count(*) OVER () AS n FROM d WHERE len(t) >= 2),
u(it, u0, u1) AS (VALUES {_DRAWS}), p AS (SELECT it, a.item_id AS a, b.item_id AS b FROM u JOIN m a ON a.pos = floor(u0 * a.n) JOIN m b ON b.pos = floor(u1 * b.n)),
s AS (SELECT it, gram FROM p JOIN g ON g.item_id = p.a UNION ALL SELECT it, gram FROM p JOIN g ON g.item_id = p.b)
SELECT round(avg(x), 6) AS bootstrap_distinct FROM (SELECT it, count(DISTINCT gram) / count(*) AS x FROM s GROUP BY it)""")
def distinct_n_bootstrap(spark, sf):
    out = lexical.bootstrap_distinct_n(_tokens(spark, sf, "benchmark").withColumn("k", F.lit(0)), ["k"], "item_id", "tokens", 2)
    return out.select(r6("bootstrap_distinct").alias("bootstrap_distinct"))


_JACCARD = f"""WITH d AS (SELECT %(k)s AS k, %(m)s AS m, {_WORDS} AS t FROM %(table)s), g AS (SELECT DISTINCT k, m, t[i : i + 1] AS gram FROM d, range(1, len(t)) s(i)),
z AS (SELECT k, m, count(*) AS c FROM g GROUP BY 1, 2), i AS (SELECT a.k, a.m AS a, b.m AS b, count(*) AS s FROM g a JOIN g b ON a.k = b.k AND a.gram = b.gram AND a.m < b.m GROUP BY ALL)
SELECT x.k AS %(name)s, count(*) AS pairs, round(avg(1 - coalesce(s, 0) / (x.c + y.c - coalesce(s, 0))), 6) AS jaccard FROM z x JOIN z y ON x.k = y.k AND x.m < y.m LEFT JOIN i ON i.k = x.k AND i.a = x.m AND i.b = y.m GROUP BY 1"""


def _jaccard(frame, key, member, name):
    out = lexical.jaccard(frame, [key], member, "tokens", 2).where("n > 1")
    return out.select(F.col(key).alias(name), (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("pairs"), r6("jaccard").alias("jaccard"))


@query(_JACCARD % {"k": "CAST(0 AS BIGINT)", "m": "item_id", "table": "benchmark", "name": "grp"})
def jaccard_benchmark(spark, sf):
    return _jaccard(_benchmark(spark, sf), "grp", "item_id", "grp")


@query(_JACCARD % {"k": "conv_id", "m": "turn", "table": "conversations", "name": "conv_id"})
def jaccard_conversations(spark, sf):
    return _jaccard(_tokens(spark, sf, "conversations"), "conv_id", "turn", "conv_id")


_BLEU = f"""WITH d AS (SELECT item_id AS m, CAST(0 AS BIGINT) AS k, {_WORDS} AS t FROM benchmark),
c AS (SELECT k, m, n, t[i : i + n - 1] AS gram, count(*) AS c FROM d, range(1, 5) r(n), range(1, len(t) + 1) s(i) WHERE i + n - 1 <= len(t) GROUP BY ALL),
h AS (SELECT a.k, a.m AS a, b.m AS b, a.n, sum(least(a.c, b.c)) AS hit FROM c a JOIN c b ON a.k = b.k AND a.n = b.n AND a.gram = b.gram AND a.m < b.m GROUP BY ALL),
p AS (SELECT a.k, a.m AS a, b.m AS b, len(a.t) AS la, len(b.t) AS lb, r.n AS n, len(a.t) - r.n + 1 AS total, coalesce(hit, 0) AS hit FROM d a JOIN d b ON a.k = b.k AND a.m < b.m, range(1, 5) r(n) LEFT JOIN h ON h.k = a.k AND h.a = a.m AND h.b = b.m AND h.n = r.n),
q AS (SELECT *, count(*) FILTER (WHERE hit = 0) OVER (PARTITION BY k, a, b ORDER BY n) AS misses FROM p WHERE total > 0),
f AS (SELECT k, a, b, CASE WHEN sum(hit) = 0 THEN 0.0 ELSE any_value(CASE WHEN la < lb THEN exp(1 - lb / la) ELSE 1.0 END) * exp(avg(ln(CASE WHEN hit = 0 THEN 100.0 / (pow(2, misses) * total) ELSE 100.0 * hit / total END))) END AS bleu FROM q GROUP BY ALL)
"""


@query(_BLEU + "SELECT k AS grp, a, b, round(100 - bleu, 4) AS distance FROM f")
def self_bleu_pairs(spark, sf):
    out = lexical.bleu_pairs(_benchmark(spark, sf), ["grp"], "item_id", "tokens")
    return out.withColumn("distance", F.round("distance", 4))


@query(_BLEU + "SELECT k AS grp, round(avg(100 - bleu), 4) AS self_bleu FROM f GROUP BY 1")
def corpus_self_bleu(spark, sf):
    out = lexical.corpus_self_bleu(_benchmark(spark, sf), ["grp"], "item_id", "tokens")
    return out.withColumn("self_bleu", F.round("self_bleu", 4))


# ---------------------------------------------------------------------------------------------------
# Embedding diversity and estimators.

_COS = """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT a.label, round(%s, 6) AS cosine_distance FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1"""


@query(_COS % "avg(1 - list_cosine_similarity(a.v, b.v))")
def cosine_distance_by_label(spark, sf):
    return embedding.cosine_distance(table(spark, sf, "embeddings"), ["label"]).select("label", r6("cosine_distance").alias("cosine_distance"))


def _cosine_null(spark, sf, value):
    e = table(spark, sf, "embeddings").withColumn("dropped", F.lit(3))
    return embedding.cosine_distance(e, ["label"], dropped="dropped", null_value=value).select("label", r6("cosine_distance").alias("cosine_distance"))


@query(_COS % "sum(1 - list_cosine_similarity(a.v, b.v)) / (count(*) + 3)")
def cosine_distance_zero_null(spark, sf):
    return _cosine_null(spark, sf, 0.0)


@query(_COS % "(sum(1 - list_cosine_similarity(a.v, b.v)) + 3) / (count(*) + 3)")
def cosine_distance_one_null(spark, sf):
    return _cosine_null(spark, sf, 1.0)


@query("""WITH s AS (SELECT l_orderkey, l_returnflag, ln(sum(exp(-l_quantity / 10))) AS x FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, round(-avg(x), 6) AS semantic_entropy FROM s GROUP BY 1""")
def semantic_entropy(spark, sf):
    s = table(spark, sf, "lineitem").withColumn("nll", -F.col("l_quantity") / 10)
    return estimators.semantic_entropy(s, ["l_orderkey"], "l_returnflag", "nll").withColumn("semantic_entropy", r6("semantic_entropy"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_discount * l_quantity, 6) AS nll, round(l_tax * l_quantity - l_discount * l_quantity, 6) AS pmi FROM lineitem")
def nll_pmi(spark, sf):
    nll = estimators.sequence_nll(F.col("l_discount"), F.col("l_quantity"))
    free = estimators.sequence_nll(F.col("l_tax"), F.col("l_quantity"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6(nll).alias("nll"), r6(estimators.pointwise_information(nll, free)).alias("pmi"))


def _similarities(spark, sf):
    return estimators.jaccard_similarities(_benchmark(spark, sf), ["grp"], "item_id", "tokens")


_SIM = f"""WITH d AS (SELECT item_id AS m, CAST(0 AS BIGINT) AS k, list_distinct({_WORDS}) AS t FROM benchmark),
w AS (SELECT a.k, a.m AS i, b.m AS j, len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) AS sim FROM d a JOIN d b ON a.k = b.k)
"""


@query(_SIM + "SELECT k AS grp, i, round(avg(sim), 6) AS confidence FROM w GROUP BY 1, 2")
def degree_confidence(spark, sf):
    return estimators.degree(_similarities(spark, sf), ["grp"])[0].withColumn("confidence", r6("confidence"))


@query(_SIM + "SELECT k AS grp, round(1 / count(DISTINCT i) - sum(sim) / pow(count(DISTINCT i), 2), 6) AS uncertainty FROM w GROUP BY 1")
def degree_uncertainty(spark, sf):
    return estimators.degree(_similarities(spark, sf), ["grp"])[1].withColumn("uncertainty", r6("uncertainty"))


@query()
def eccentricity(spark, sf):
    return estimators.eccentricity(_similarities(spark, sf), ["grp"], "grp bigint")


@query(_SIM + "SELECT grp, round(sum(1 / d), 6) AS spectral_eigv FROM (SELECT k AS grp, i, sum(sim) AS d FROM w GROUP BY 1, 2) GROUP BY 1")
def spectral_eigv(spark, sf):
    """Jaccard similarities have no negative eigenvalue, so the clipped sum is the trace, in SQL too."""
    return estimators.spectral_trace(_similarities(spark, sf), ["grp"]).withColumn("spectral_eigv", r6("spectral_eigv"))


# ---------------------------------------------------------------------------------------------------
# Roll-ups and data sets.

_RATE = "SELECT o_custkey, count(*) AS n, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS solve_rate FROM orders GROUP BY 1"


def _rates(spark, sf):
    return summary.solve_rate(table(spark, sf, "orders"), ["o_custkey"], F.col("o_orderstatus") == "F")


@query(f"SELECT o_custkey, n, round(solve_rate, 6) AS solve_rate FROM ({_RATE})")
def solve_rate(spark, sf):
    return _rates(spark, sf).withColumn("solve_rate", r6("solve_rate"))


@query(f"WITH r AS ({_RATE}) SELECT CAST(t AS INT) AS threshold, count(*) FILTER (WHERE solve_rate > t / 100) AS n_above, round(count(*) FILTER (WHERE solve_rate > t / 100) / count(*), 6) AS share_above FROM r, range(0, 101, 5) s(t) GROUP BY t")
def solve_rate_thresholds(spark, sf):
    return summary.threshold_survival(_rates(spark, sf)).withColumn("share_above", r6("share_above"))


@query("WITH s AS (SELECT count(*) AS n FROM orders GROUP BY o_custkey) SELECT count(n) AS count, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS std, CAST(min(n) AS DOUBLE) AS min, CAST(max(n) AS DOUBLE) AS max, round(quantile_cont(n, 0.25), 6) AS q25, round(quantile_cont(n, 0.5), 6) AS q50, round(quantile_cont(n, 0.75), 6) AS q75 FROM s")
def submissions_describe(spark, sf):
    long = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").cast("double").alias("value"))
    return summary.describe(long, []).select("count", *(r6(c).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")))


@query("SELECT l_partkey, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(corr(l_extendedprice, l_quantity), 6) AS r, round(sqrt(greatest(regr_syy(l_extendedprice, l_quantity) - regr_slope(l_extendedprice, l_quantity) * regr_sxy(l_extendedprice, l_quantity), 0) / (count(*) - 2) / regr_sxx(l_extendedprice, l_quantity)), 2) AS stderr FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_quantity) > 2")
def metric_regression(spark, sf):
    lines = table(spark, sf, "lineitem")
    some = lines.groupBy("l_partkey").agg(F.count_distinct("l_quantity").alias("k")).where("k > 2")
    out = summary.regression(lines.join(some, "l_partkey", "left_semi"), ["l_partkey"], "l_extendedprice", "l_quantity")
    return out.select("l_partkey", "n", F.round("slope", 4).alias("slope"), F.round("intercept", 2).alias("intercept"), r6("r").alias("r"), F.round("stderr", 2).alias("stderr"))


@query("""WITH g AS (SELECT l_suppkey, count(*) - 2 AS f, abs(corr(l_extendedprice, l_discount)) AS r FROM lineitem GROUP BY 1),
w AS (SELECT l_suppkey, f, r, 1 - r * r AS c, CASE WHEN f % 2 = 0 THEN r * list_sum(list_transform(range(0, f // 2), lambda j: exp(lgamma(2 * j + 1) - 2 * lgamma(j + 1) - j * ln(4)) * pow(1 - r * r, j)))
    ELSE 2 / pi() * (asin(r) + r * sqrt(1 - r * r) * coalesce(list_sum(list_transform(range(0, (f - 1) // 2), lambda j: exp(j * ln(4) + 2 * lgamma(j + 1) - lgamma(2 * j + 2)) * pow(1 - r * r, j))), 0)) END AS a FROM g WHERE f > 0)
SELECT l_suppkey, f + 2 AS n, round(1 - a, 5) AS p FROM w""")
def regression_significance(spark, sf):
    """SQL has the sums by gamma functions; groups of up to 2,002 points, as all suppliers' are."""
    out = summary.regression(table(spark, sf, "lineitem"), ["l_suppkey"], "l_extendedprice", "l_discount")
    return out.where("n > 2").select("l_suppkey", "n", F.round("p", 5).alias("p"))


@query("SELECT CAST(least(floor((l_quantity - 0) / 5), 9) AS INT) AS bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 GROUP BY 1")
def histogram(spark, sf):
    return summary.histogram(table(spark, sf, "lineitem"), "l_quantity", 0.0, 50.0)


@query("SELECT p_brand, " + ", ".join(f"round(quantile_cont(p_retailprice, {q}), 6) AS {n}" for q, n in ((0, "low"), (0.25, "q25"), (0.5, "median"), (0.75, "q75"), (1, "high"))) + " FROM part GROUP BY 1")
def box_stats(spark, sf):
    out = summary.box_stats(table(spark, sf, "part"), ["p_brand"], "p_retailprice")
    return out.select("p_brand", *(r6(c).alias(c) for c in ("low", "q25", "median", "q75", "high")))


@query("SELECT doc_id, CASE WHEN r <= f THEN 'train' WHEN r <= f + floor((n - f) / 2) THEN 'test' ELSE 'val' END AS part FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS r, count(*) OVER () AS n, floor(count(*) OVER () * 0.7) AS f FROM documents)")
def train_test_val_split(spark, sf):
    return dataset.split(table(spark, sf, "documents").select("doc_id"), "doc_id")


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS k FROM documents) WHERE k <= 5")
def sample_per_group(spark, sf):
    return dataset.sample_per_group(table(spark, sf, "documents").select("source", "doc_id"), ["source"], "doc_id", 5)


@query("SELECT d.doc_id FROM documents d JOIN (SELECT doc_id, count(*) FILTER (WHERE quality = 1) AS tests FROM labels GROUP BY 1) l USING (doc_id) WHERE length(text) >= 100 AND tests >= 1")
def valid_problem_filter(spark, sf):
    tests = table(spark, sf, "labels").groupBy("doc_id").agg(F.count_if(F.col("quality") == 1).alias("tests"))
    docs = table(spark, sf, "documents").join(tests, "doc_id")
    return dataset.valid_problems(docs, F.col("tests"), F.col("text")).select("doc_id")


@query("SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 END NULLS LAST, ts DESC, event_id) AS place FROM events")
def custom_sort(spark, sf):
    rank = summary.custom_rank(F.col("event_type"), ["view", "click", "purchase"])
    order = Window.partitionBy("user_id").orderBy(rank.asc_nulls_last(), F.col("ts").desc_nulls_last(), "event_id")
    return table(spark, sf, "events").select("user_id", "event_id", "event_type", F.row_number().over(order).alias("place"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def latest_per_key(spark, sf):
    return dataset.latest(table(spark, sf, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("SELECT p_partkey, min(origin) AS origin FROM (SELECT p_partkey, 1 AS origin FROM part WHERE p_size > 25 UNION ALL SELECT p_partkey, 2 FROM part) GROUP BY 1")
def union_splits(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_size")
    frames = [part.where("p_size > 25").select("p_partkey", F.lit(1).alias("origin")), part.select("p_partkey", F.lit(2).alias("origin"))]
    return dataset.merge_first(frames, ["p_partkey"])


@query("SELECT k, 'missing' AS side FROM (SELECT o_orderkey AS k FROM orders EXCEPT ALL SELECT DISTINCT l_orderkey FROM lineitem) UNION ALL SELECT k, 'extra' FROM (SELECT DISTINCT l_partkey AS k FROM lineitem EXCEPT ALL SELECT o_orderkey FROM orders WHERE o_orderkey > 5) UNION ALL SELECT k, 'missing' FROM (SELECT o_orderkey AS k FROM orders WHERE o_orderkey > 5 EXCEPT ALL SELECT DISTINCT l_partkey FROM lineitem)")
def expected_vs_found(spark, sf):
    orders, lines = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")), table(spark, sf, "lineitem")
    first = dataset.unexpected(orders, lines.select(F.col("l_orderkey").alias("k")).distinct()).where("side = 'missing'")
    return first.union(dataset.unexpected(orders.where("k > 5"), lines.select(F.col("l_partkey").alias("k")).distinct()))


@query("SELECT o_custkey, o_orderdate, count(*) AS count FROM orders GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return dataset.duplicated(table(spark, sf, "orders"), ["o_custkey", "o_orderdate"])


# ---------------------------------------------------------------------------------------------------
# Text transforms.

@query(r"""SELECT page_id, replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', chr(160)), '&amp;', '&') AS text FROM pages""")
def html_to_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


@query(r"SELECT doc_id, regexp_replace(text, '\n+', chr(10), 'g') AS text FROM documents")
def newline_canonicalise(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.squeeze_newlines(F.col("text")).alias("text"))


@query(r"SELECT doc_id, substring(regexp_replace(text, '^\s+|\s+$', '', 'g'), 1, 5000) AS text FROM documents")
def strip_truncate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.clean_output(F.col("text")).alias("text"))


@query("SELECT p_partkey, 'Solve:' || chr(10) || p_name || chr(10) || 'in Python' AS prompt FROM part")
def prompt_format(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.format_prompt(F.lit("Solve:\n## DESCRIPTION\nin Python"), F.col("p_name")).alias("prompt"))


@query("SELECT l_orderkey, count(*) || chr(10) || string_agg(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), ' ' ORDER BY l_quantity) AS input FROM lineitem GROUP BY 1")
def serialize_testcases(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("string").alias("n"), F.sort_array(F.collect_list(F.col("l_quantity").cast("long"))).alias("q"))
    return g.select("l_orderkey", T.serialize_arguments(F.col("n"), F.array_join(F.transform("q", lambda x: x.cast("string")), " ")).alias("input"))


@query("SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE round(p_size / 100, 6) END AS confidence FROM part")
def confidence_extract(spark, sf):
    said = F.when(F.col("p_size") % 5 == 0, "no idea").otherwise(F.concat(F.lit("Answer. Confidence: "), F.col("p_size").cast("string"), F.lit("% or Confidence: 1%")))
    return table(spark, sf, "part").select("p_partkey", r6(T.confidence(said)).alias("confidence"))


@query("SELECT p_partkey, CASE WHEN p_brand LIKE '%1' THEN least(2000 - 40 * p_size, 1500) WHEN p_brand LIKE '%2' THEN least(4000 - 100 * p_size, 1500) ELSE 1500 END AS budget FROM part")
def token_budget(spark, sf):
    model = F.when(F.col("p_brand").endswith("1"), "tatsu-lab").when(F.col("p_brand").endswith("2"), "CodeLlama-7b").otherwise("other")
    used = F.when(F.col("p_brand").endswith("1"), 40 * F.col("p_size")).otherwise(100 * F.col("p_size"))
    return table(spark, sf, "part").select("p_partkey", T.token_budget(model, used, F.lit(1500)).alias("budget"))


_BODY = "'def f(x):' || chr(10) || '    return x * ' || p_size"


@query(f"""SELECT p_partkey, CASE p_partkey % 8 WHEN 1 THEN {_BODY} || chr(10) || chr(10) || 'print(f(2))' WHEN 2 THEN '@cache' || chr(10) || {_BODY} WHEN 3 THEN ''
    WHEN 4 THEN repeat('"', 3) || chr(10) || p_name || chr(10) || repeat('"', 3) || chr(10) || chr(10) || {_BODY} WHEN 5 THEN 'import os' || chr(10) || 'if f:print(' || p_size || ')'
    WHEN 6 THEN 'if x:' || chr(10) || '    y = ' || p_size || chr(10) || chr(10) || 'else:' || chr(10) || '    y = 0' WHEN 7 THEN 'x = ' || p_size || ' # ' || p_name ELSE {_BODY} END AS code FROM part""")
def extract_python(spark, sf):
    """Texts of eight kinds: fences of both cases, prose around code, decorators, prose alone, docstrings, one-liners, split branches, remarks."""
    size = F.col("p_size").cast("string")
    code = F.concat(F.lit("def f(x):\n    return x * "), size)
    kinds = [
        F.concat(F.lit(f"Here is what you asked\n{FENCE}python\n"), code, F.lit(f"\n{FENCE}\nIt works well.")),
        F.concat(F.lit("Sure, try this:\n"), code, F.lit("\nThen call it\nprint(f(2))")),
        F.concat(F.lit(f"{FENCE}Python\n@cache\n"), code, F.lit(f"\n{FENCE}")),
        F.concat(F.lit("There is no good answer to "), "p_name"),
        F.concat(F.lit('"""'), "p_name", F.lit('"""\n'), code),
        F.concat(F.lit("import os\nif f:print("), size, F.lit(")\nand so on")),
        F.concat(F.lit("if x:\n    y = "), size, F.lit("\nIn the other case we write\nelse:\n    y = 0")),
        F.concat(F.lit("x = "), size, F.lit(" # "), "p_name"),
    ]
    said = F.element_at(F.array(*kinds), (F.col("p_partkey") % 8 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", extract_python_code(said).alias("code"))


# ---------------------------------------------------------------------------------------------------
# Syntax trees of synthesised programs.

def _programs(spark, sf):
    part = table(spark, sf, "part").where("p_size > 0")
    size, name = F.col("p_size").cast("string"), F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]", "")
    code = F.concat(F.lit("def f_"), name, F.lit("(x):\n    return x * "), size)
    return part.select((F.col("p_partkey") % 50).alias("problem_id"), F.col("p_partkey").alias("generation_id"), code.alias("code"))


def _subtrees(spark, sf):
    return subtree_rows(_programs(spark, sf), ["problem_id"], "generation_id", "code")


_PROG = "WITH p AS (SELECT p_partkey % 50 AS problem_id, p_partkey AS m, p_size AS s, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS b FROM part WHERE p_size > 0) "


@query(_PROG + "SELECT problem_id, 2 * count(DISTINCT s) + 2 * count(DISTINCT b) AS n_distinct, 4 * count(*) AS n_total FROM p GROUP BY 1")
def ast_distinct_plain(spark, sf):
    out = syntactic.distinct_subtrees(_subtrees(spark, sf).where("variant = 'plain' AND height = 3"), ["problem_id"])
    return out.select("problem_id", "n_distinct", "n_total")


def _varied_subtrees(spark, sf):
    """Programs of four shapes in turn: a product, a sum by way of a name, a lone number (too low for most heights) and one that
    doesn't parse."""
    size, name = F.col("p_size").cast("string"), F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]", "")
    head = F.concat(F.lit("def f_"), name)
    shapes = [
        F.concat(head, F.lit("(x):\n    return x * "), size),
        F.concat(head, F.lit("(x):\n    y = x + "), size, F.lit("\n    return y")),
        size,
        F.concat(head, F.lit("(x:")),
    ]
    code = F.element_at(F.array(*shapes), (F.floor(F.col("p_partkey") / 50) % 4 + 1).cast("int"))
    part = table(spark, sf, "part").select((F.col("p_partkey") % 50).alias("problem_id"), F.col("p_partkey").alias("generation_id"), code.alias("code"))
    return subtree_rows(part, ["problem_id"], "generation_id", "code")


#: Of each shape the nodes that are as high as a height, and whether their trees cut there show the function's name and the number.
_NODES = [
    *((0, 3, "BinOp", 0, 1), (0, 3, "Return", 0, 1), (0, 3, "FunctionDef", 1, 0), (0, 3, "Module", 1, 0)),
    *((0, 4, "Return", 0, 1), (0, 4, "FunctionDef", 1, 1), (0, 4, "Module", 1, 0)),
    *((0, 5, "FunctionDef", 1, 1), (0, 5, "Module", 1, 1), (0, 6, "Module", 1, 1)),
    *((1, 3, "BinOp", 0, 1), (1, 3, "Assign", 0, 1), (1, 3, "Return", 0, 0), (1, 3, "FunctionDef", 1, 0), (1, 3, "Module", 1, 0)),
    *((1, 4, "Assign", 0, 1), (1, 4, "FunctionDef", 1, 1), (1, 4, "Module", 1, 0)),
    *((1, 5, "FunctionDef", 1, 1), (1, 5, "Module", 1, 1), (1, 6, "Module", 1, 1)),
    (2, 3, "Module", 0, 1),
]
_TREES = f"""WITH p AS (SELECT p_partkey % 50 AS problem_id, p_partkey AS m, p_partkey // 50 % 4 AS shape, p_size AS s, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS b FROM part),
nodes(shape, height, node, named, sized) AS (VALUES {", ".join(map(str, _NODES))}), variants(variant) AS (VALUES ('plain'), ('stripped'), ('obfuscated')),
g AS (SELECT problem_id, variant, height, m, concat_ws('|', shape, node, CASE WHEN named = 1 AND variant = 'plain' THEN b END, CASE WHEN sized = 1 AND variant <> 'stripped' THEN s END) AS g FROM p JOIN nodes USING (shape), variants),
members AS (SELECT problem_id, variant, height, m FROM p, variants, (VALUES (3), (4), (5), (6)) h(height) WHERE shape < 3)
"""


@query(_TREES + """SELECT problem_id, variant, height, count(DISTINCT g) AS n_distinct, count(g) AS n_total, round(CASE WHEN count(g) > 1 THEN count(DISTINCT g) / count(g) END, 6) AS prop_distinct
FROM members LEFT JOIN g USING (problem_id, variant, height, m) GROUP BY 1, 2, 3""")
def ast_distinct(spark, sf):
    return syntactic.distinct_subtrees(_varied_subtrees(spark, sf), ["problem_id"]).withColumn("prop_distinct", r6("prop_distinct"))


@query(_TREES + """, z AS (SELECT problem_id, variant, height, m, count(g) AS c FROM members LEFT JOIN g USING (problem_id, variant, height, m) GROUP BY ALL),
i AS (SELECT a.problem_id, a.variant, a.height, a.m AS a, b.m AS b, count(*) AS s FROM g a JOIN g b ON a.problem_id = b.problem_id AND a.variant = b.variant AND a.height = b.height AND a.g = b.g AND a.m < b.m GROUP BY ALL),
d AS (SELECT x.problem_id, x.variant, x.height, avg(1 - coalesce(s, 0) / (x.c + y.c - coalesce(s, 0))) AS jaccard FROM z x JOIN z y ON x.problem_id = y.problem_id AND x.variant = y.variant AND x.height = y.height AND x.m < y.m
    LEFT JOIN i ON i.problem_id = x.problem_id AND i.variant = x.variant AND i.height = x.height AND i.a = x.m AND i.b = y.m WHERE x.c + y.c > 0 GROUP BY 1, 2, 3)
SELECT problem_id, variant, height, n, round(jaccard, 6) AS jaccard FROM (SELECT problem_id, variant, height, count(*) AS n FROM members GROUP BY 1, 2, 3) LEFT JOIN d USING (problem_id, variant, height)""")
def ast_jaccard(spark, sf):
    return syntactic.jaccard_subtrees(_varied_subtrees(spark, sf), ["problem_id"], "generation_id").withColumn("jaccard", r6("jaccard"))


@query(_TREES + f""", r AS (SELECT *, row_number() OVER (PARTITION BY problem_id, variant, height ORDER BY m) - 1 AS pos, count(*) OVER (PARTITION BY problem_id, variant, height) AS n FROM (SELECT DISTINCT problem_id, variant, height, m FROM g)),
u(it, u0, u1) AS (VALUES {_DRAWS}), q AS (SELECT it, problem_id, variant, height, m FROM u JOIN r ON pos = floor(u0 * n) UNION ALL SELECT it, problem_id, variant, height, m FROM u JOIN r ON pos = floor(u1 * n)),
x AS (SELECT it, problem_id, variant, height, count(DISTINCT g) / count(*) AS x FROM q JOIN g USING (problem_id, variant, height, m) GROUP BY ALL)
SELECT problem_id, variant, height, round(avg(x), 6) AS bootstrap_distinct FROM x GROUP BY 1, 2, 3""")
def ast_bootstrap(spark, sf):
    out = syntactic.bootstrap_subtrees(_varied_subtrees(spark, sf), ["problem_id"], "generation_id")
    return out.withColumn("bootstrap_distinct", r6("bootstrap_distinct"))


# ---------------------------------------------------------------------------------------------------
# Text transforms of code, prompts and names.

_CODE = "p_name || ' # ' || p_type || chr(10) || 'x = ''#' || p_brand || '''' || chr(10)"


def _code_column():
    return F.concat("p_name", F.lit(" # "), "p_type", F.lit("\nx = '#"), "p_brand", F.lit("'\n"))


@query(f"SELECT p_partkey, regexp_replace({_CODE}, '#[^\\n]*', '', 'g') AS code FROM part")
def comment_strip(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.strip_comments(_code_column()).alias("code"))


@query("SELECT doc_id, replace(text, chr(10), 'NEWLINE') AS text FROM documents")
def newline_mapping(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.newline_tokens(F.split("text", " ", -1)).alias("text"))


@query("SELECT doc_id, replace(replace(text, repeat(chr(10), 3), chr(10)), repeat(chr(10), 2), chr(10)) || ' END' AS text FROM documents")
def blank_line_squeeze(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.squeeze_blank_lines(F.col("text"), " END").alias("text"))


@query(r"SELECT page_id, regexp_replace(replace(html, '&amp;', ''), '^\s+|\s+$', '', 'g') AS text FROM pages")
def nbsp_cleanup(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.clean_nbsp(F.replace("html", F.lit("&amp;"), F.lit(" "))).alias("text"))


@query("SELECT p_partkey, 'import sys' || chr(10) || 'def f(): ' || p_name || chr(10) || 'def arguments(): ' || p_type AS wrapped, 'import sys' || chr(10) || chr(10) || p_name AS directed FROM part")
def program_wrappers(spark, sf):
    wrapper = F.lit("import sys\ndef f(): ## REPLACE F\ndef arguments(): ## REPLACE EXTRACT_ARGUMENTS")
    return table(spark, sf, "part").select("p_partkey", T.wrap_open_ended(wrapper, F.col("p_name"), F.col("p_type")).alias("wrapped"), T.wrap_directed(F.lit("import sys"), F.col("p_name")).alias("directed"))


@query("""SELECT p_partkey, 'Generate a program completion in python for the given function description: ' || p_name AS verbalised,
    concat_ws(chr(10) || chr(10), 'Write tests.', 'Description:' || chr(10) || 'add', 'Answer:' || chr(10) || '1 2', 'Description:' || chr(10) || p_name, 'Answer:') AS prompt FROM part""")
def prompts_with_example(spark, sf):
    prompt = T.example_prompt(F.lit("Write tests."), F.lit("add"), F.lit("1 2"), F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", T.verbalised_prompt(F.col("p_name")).alias("verbalised"), prompt.alias("prompt"))


@query("SELECT p_partkey, replace(p_type || '/' || p_brand, '/', '-') AS name, p_type AS template, rpad(p_type, greatest(length(p_type), 10)::INT, ' ') AS padded FROM part")
def name_cleanup(spark, sf):
    name, template = F.concat("p_type", F.lit("/"), "p_brand"), F.concat(F.lit("open_ended_directed_"), "p_type")
    return table(spark, sf, "part").select("p_partkey", T.clean_name(name).alias("name"), T.short_template(template).alias("template"), T.left_justify(F.col("p_type"), 10).alias("padded"))


@query("SELECT o_orderkey, CAST(o_custkey AS INT) AS generation, CASE WHEN o_orderstatus = 'F' THEN 99 ELSE CAST(o_custkey AS INT) END AS number, CASE WHEN o_orderstatus = 'F' THEN 'coh_99' ELSE 'coh_' || o_orderstatus END AS label FROM orders")
def record_names(spark, sf):
    path = F.concat(F.lit("a/generation_"), F.col("o_custkey").cast("string"), F.lit("/x"))
    name = F.when(F.col("o_orderstatus") == "F", "output_record").otherwise(F.concat(F.lit("output_record_"), F.col("o_custkey").cast("string"), F.lit("_coh_"), "o_orderstatus"))
    parsed = T.parse_record_name(name)
    return table(spark, sf, "orders").select("o_orderkey", T.generation_index(path).alias("generation"), parsed["number"].alias("number"), parsed["label"].alias("label"))


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN 'completion' WHEN 'HOUSEHOLD' THEN 'message' ELSE 'local' END AS backend FROM customer")
def backend_routing(spark, sf):
    model = F.when(F.col("c_mktsegment") == "MACHINERY", "gpt-4").when(F.col("c_mktsegment") == "HOUSEHOLD", "OPUS").otherwise(F.col("c_mktsegment"))
    return table(spark, sf, "customer").select("c_custkey", T.route_backend(model).alias("backend"))


@query("WITH b AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part) SELECT p_partkey, round((p_retailprice - lo) * 100 / (hi - lo), 6) AS scaled FROM part, b")
def min_max_scaling(spark, sf):
    part = table(spark, sf, "part")
    ends = part.agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi")).first()
    return part.select("p_partkey", r6(T.min_max_scaled(F.col("p_retailprice"), F.lit(ends["lo"]), F.lit(ends["hi"]))).alias("scaled"))


@query("SELECT o_custkey, string_agg('k' || o_orderkey || ' ' || o_orderstatus, ' | ' ORDER BY 'k' || o_orderkey) AS names FROM orders GROUP BY 1")
def rename_maps(spark, sf):
    entries = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("k"), F.col("o_orderkey").cast("string")).alias("k"), "o_orderstatus")))
    return table(spark, sf, "orders").groupBy("o_custkey").agg(entries.alias("m")).select("o_custkey", T.rename_map_string(F.col("m")).alias("names"))


@query(rf"SELECT doc_id, regexp_replace(regexp_replace(array_to_string(list_slice({_WORDS}, 1, 504), ' '), '^\s+|\s+$', '', 'g'), '\n+', chr(10), 'g') AS text FROM documents WHERE regexp_replace(text, '^\s+|\s+$', '', 'g') <> ''")
def embedding_preparation(spark, sf):
    docs = _tokens(spark, sf, "documents").where(T.strip(F.col("text")) != "")
    return docs.select("doc_id", T.preprocess_for_embedding(F.col("tokens")).alias("text"))


@query("""SELECT p_partkey, repeat('"', 3) || chr(10) || p_name || chr(10) || p_type || chr(10) || repeat('"', 3) AS hoisted, 'def f():' || chr(10) || '  ' || chr(10) || '   return 1' AS code FROM part""")
def docstring_hoisting(spark, sf):
    double, single = '"' * 3, "'" * 3
    code = F.concat(F.lit(f"def f():\n  {double}"), "p_name", F.lit(f"{double}\n  {single}"), "p_type", F.lit(f"{single} return 1"))
    return table(spark, sf, "part").select("p_partkey", T.hoist_docstrings(code).alias("hoisted"), T.without_docstrings(code).alias("code"))


@query("SELECT o_custkey, string_agg('k' || o_orderkey || ' ' || o_orderstatus, ' | ' ORDER BY 'k' || o_orderkey) AS merged, string_agg('p' || o_orderkey || ' ' || 'k' || o_orderkey, ' | ' ORDER BY 'p' || o_orderkey) AS inverse FROM orders GROUP BY 1")
def name_maps(spark, sf):
    key = F.col("o_orderkey").cast("string")
    entries = lambda kept, value: F.map_from_entries(F.collect_list(F.when(kept, F.struct(F.concat(F.lit("k"), key).alias("k"), value.alias("v")))))
    even = F.col("o_orderkey") % 2 == 0
    maps = table(spark, sf, "orders").groupBy("o_custkey").agg(entries(even, F.col("o_orderstatus")).alias("a"), entries(~even, F.col("o_orderstatus")).alias("b"), entries(F.lit(True), F.concat(F.lit("p"), key)).alias("c"))
    return maps.select("o_custkey", T.rename_map_string(T.merged_names(F.col("a"), F.col("b"))).alias("merged"), T.rename_map_string(T.inverse_names(F.col("c"))).alias("inverse"))


@query("SELECT p_partkey, p_name || ' 2' || '|' || p_name || ' 2' || '|' || p_name || ' 1' AS texts FROM part")
def generated_texts(spark, sf):
    """Three texts a prompt, two at once at most, from a generator that says how many it was asked for."""
    prompts = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("formatted_prompt"))
    said = readers.generate_with(prompts, lambda prompt, most, end: [f"{prompt}{end}{most}"] * most, 3, batch_size=2, end=" ")
    return said.select("p_partkey", F.array_join("raw_generations", "|").alias("texts"))


@query("SELECT p_partkey, CASE WHEN p_size % 7 > 0 THEN CAST(length(p_name) AS DOUBLE) END AS length, CASE WHEN p_size % 7 > 0 THEN CAST(length(p_name) - length(replace(p_name, ' ', '')) AS DOUBLE) END AS blanks FROM part")
def embedded_texts(spark, sf):
    texts = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 7 > 0, F.col("p_name")).otherwise(" ").alias("text"))
    found = readers.embed_with(texts, "text", lambda some: [[len(t), t.count(" ")] for t in some])
    return found.select("p_partkey", F.get("embedding", F.lit(0)).alias("length"), F.get("embedding", F.lit(1)).alias("blanks"))


@query("SELECT p_partkey, p_type || chr(62) || chr(9731) || chr(233) || '&lt;&nope;' || chr(128512) || chr(CAST(p_size + 64 AS INT)) || chr(CAST(p_size + 64 AS INT)) AS text FROM part")
def character_references(spark, sf):
    size = F.col("p_size") + 64
    html = F.concat(F.lit("<p>"), "p_type", F.lit("&gt;</p>&#9731;&eacute;<!-- & -->&amp;lt;&nope;&#x1F600;&#"), size.cast("string"), F.lit(";&#X"), F.hex(size), F.lit(";"))
    return table(spark, sf, "part").select("p_partkey", T.decoded_html(html).alias("text"))


@query(r"""SELECT page_id, replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g'),
    '&copy;', chr(169)), '&middot;', chr(183)), '&quot;', '"'), '&amp;', '&') AS text FROM pages""")
def html_decoded(spark, sf):
    """SQL has the references that occur in the pages."""
    return table(spark, sf, "pages").select("page_id", T.decoded_html(F.col("html")).alias("text"))


# ---------------------------------------------------------------------------------------------------
# Records, generations and configurations.

@query(EXEC + "SELECT problem_id, generation_id, NOT regexp_matches(semantic, 'Syntax Error|Runtime Error|Timeout|Error') AS coherent FROM gen")
def semantic_string_coherence(spark, sf):
    return generations(spark, sf).select("problem_id", "generation_id", records.string_is_coherent(F.col("semantic")).alias("coherent"))


@query("SELECT o_custkey, count(*) FILTER (WHERE o_orderpriority NOT LIKE '1%') AS n FROM orders GROUP BY 1 HAVING count(*) FILTER (WHERE o_orderpriority NOT LIKE '1%') > 2")
def non_empty_gate(spark, sf):
    program = F.when(F.col("o_orderpriority").startswith("1"), "").otherwise(F.col("o_orderpriority"))
    return records.enough_programs(table(spark, sf, "orders").select("o_custkey", program.alias("program")), ["o_custkey"], "program")


@query("SELECT conv_id AS problem_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS INT) AS generation_id, text AS formatted_code, role AS extracted_code, upper(role) AS raw_generation FROM conversations")
def parallel_arrays(spark, sf):
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    g = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("problem_id")).agg(rows.alias("r"))
    g = g.select("problem_id", F.col("r.text").alias("formatted_programs"), F.col("r.role").alias("programs"), F.transform("r.role", F.upper).alias("raw_generations"))
    return records.submit_rows(g)


@query("SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS generation_id, CAST(o_orderkey AS VARCHAR) AS generated_code FROM orders")
def program_lists(spark, sf):
    lists = table(spark, sf, "orders").groupBy("o_custkey").agg(F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda x: x.cast("string")).alias("generated_code"))
    return records.explode_programs(lists)


@query("""WITH l AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS INT) AS tc FROM lineitem)
SELECT CAST(l_orderkey AS VARCHAR) AS problem_id, 0 AS generation_id, CAST(tc AS VARCHAR) AS testcase_id, CAST(l_quantity AS VARCHAR) AS input, CASE WHEN l_returnflag = 'R' THEN 'Unknown Error' ELSE l_returnflag END AS output, l_linestatus AS expected FROM l""")
def records_to_executions(spark, sf):
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    lines = table(spark, sf, "lineitem").withColumn("tc", F.row_number().over(order).cast("string"))
    maps = lambda value: F.map_from_entries(F.collect_list(F.struct("tc", value.alias("v"))))
    outputs = F.map_from_entries(F.collect_list(F.when(F.col("l_returnflag") != "R", F.struct("tc", F.col("l_returnflag").alias("v")))))
    made = lines.groupBy(F.col("l_orderkey").cast("string").alias("problem_id")).agg(F.lit(0).alias("generation_id"), maps(F.col("l_quantity").cast("string")).alias("testcase_inputs"), outputs.alias("testcase_outputs"), maps(F.col("l_linestatus")).alias("orig_testcase_outputs"))
    return records.executions_of(made).drop("pos")


@query("SELECT c_custkey, concat_ws('; ', CASE WHEN c_acctbal > 0 THEN NULL ELSE 'c_acctbal is not positive' END, CASE WHEN c_mktsegment IN ('MACHINERY', 'HOUSEHOLD') THEN NULL ELSE 'c_mktsegment is unknown' END) AS problems FROM customer")
def config_validation(spark, sf):
    out = dataset.config_problems(table(spark, sf, "customer"), ["c_acctbal"], {"c_mktsegment": ["MACHINERY", "HOUSEHOLD"]})
    return out.select("c_custkey", F.array_join("problems", "; ").alias("problems"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def reevaluation_candidates(spark, sf):
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    experiments = table(spark, sf, "customer").withColumns({"folder": F.concat(F.lit("root/"), "c_name"), "root": F.lit("root/")})
    return dataset.to_reevaluate(experiments, orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus = 'P'"), "c_custkey", "folder", "root").select("c_custkey")


@query("""WITH f AS (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS number, o_orderpriority AS content FROM orders)
SELECT c_custkey, c_nationkey % 3 + 1 AS spec_no, s.content AS spec_no_content, 1 AS tcgen_no, t.content AS tcgen_no_content FROM customer JOIN f s ON s.k = c_custkey AND s.number = c_nationkey % 3 + 1 JOIN f t ON t.k = c_custkey AND t.number = 1
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def annotated_choices(spark, sf):
    orders = table(spark, sf, "orders")
    number = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    files = orders.select(F.col("o_custkey").alias("c_custkey"), number.alias("number"), F.col("o_orderpriority").alias("content"))
    notes = table(spark, sf, "customer").select("c_custkey", (F.col("c_nationkey") % 3 + 1).alias("spec_no"), F.lit(1).alias("tcgen_no"))
    final = orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return dataset.final_choices(notes, {"spec_no": files, "tcgen_no": files}, final, "c_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 101")
def program_limit(spark, sf):
    return dataset.first_rows(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], 101)


@query("WITH s AS (SELECT p_brand, avg(p_retailprice) AS cos, avg(p_size) AS coh, count(*) AS k FROM part GROUP BY 1) SELECT p_brand, round(cos * (coh / 100), 6) AS heuristic_cosine, round(round(k / 30, 4) * 100, 6) AS semantic_share FROM s")
def derived_ratios(spark, sf):
    stats = table(spark, sf, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("cos"), F.avg("p_size").alias("coh"), F.count("*").alias("k"))
    return summary.derived_ratios(stats, "cos", "coh", "k").select("p_brand", r6("heuristic_cosine").alias("heuristic_cosine"), r6("semantic_share").alias("semantic_share"))


@query("SELECT conv_id, turn, role, text, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, text) <> role, true) AS border, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations")
def borders_and_order(spark, sf):
    c = table(spark, sf, "conversations")
    return lexical.generation_order(summary.group_borders(c, ["conv_id"], ["turn", "text"], "role"), ["conv_id"], "turn")


_TOKEN = r"""("[^"\n]*"|''[^''\n]*''|#[^\n]*|[0-9]+\.?[0-9]*|[A-Za-z_][A-Za-z0-9_]*|[-+*/%&|^<>=!:]=|\*\*|//|->|\n|[^\sA-Za-z0-9_])"""


@query(f"""WITH d AS (SELECT p_brand AS k, regexp_extract_all({_CODE}, '{_TOKEN}', 1) AS t FROM part),
g AS (SELECT k, n, t[i : i + n - 1] AS gram FROM d, range(1, 4) r(n), range(1, len(t) + 1) s(i) WHERE i + n - 1 <= len(t))
SELECT k AS p_brand, CAST(n AS INT) AS n, count(DISTINCT gram) AS n_distinct, count(*) AS n_total, round(CASE WHEN count(*) > 1 THEN count(DISTINCT gram) / count(*) END, 6) AS distinct_n FROM g GROUP BY k, n""")
def distinct_code_tokens(spark, sf):
    code = table(spark, sf, "part").select("p_brand", lexical.code_tokens(_code_column()).alias("tokens"))
    return lexical.distinct_n(code, ["p_brand"], "tokens", range(1, 4)).withColumn("distinct_n", r6("distinct_n"))


@query(f"""WITH d AS (SELECT item_id, {_WORDS} AS t FROM benchmark), g AS (SELECT DISTINCT item_id, t[i : i + 1] AS gram FROM d, range(1, len(t)) s(i)),
m AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS pos, count(*) OVER () AS n FROM d WHERE len(t) >= 2),
u(it, u0, u1) AS (VALUES {_DRAWS}), p AS (SELECT it, a.item_id AS a, b.item_id AS b FROM u JOIN m a ON a.pos = floor(u0 * a.n) JOIN m b ON b.pos = floor(u1 * b.n)),
s AS (SELECT it, gram, count(DISTINCT side) AS sides FROM (SELECT it, gram, 0 AS side FROM p JOIN g ON g.item_id = p.a UNION ALL SELECT it, gram, 1 FROM p JOIN g ON g.item_id = p.b) GROUP BY 1, 2)
SELECT round(avg(x), 6) AS sampled_jaccard FROM (SELECT it, 1 - count(*) FILTER (WHERE sides = 2) / count(*) AS x FROM s GROUP BY it)""")
def jaccard_sampled(spark, sf):
    out = lexical.sampled_jaccard(_tokens(spark, sf, "benchmark").withColumn("k", F.lit(0)), ["k"], "item_id", "tokens", 2)
    return out.select(r6("sampled_jaccard").alias("sampled_jaccard"))


# ---------------------------------------------------------------------------------------------------
# All metric families by record type.

_REPORT = EXEC + """, p AS (SELECT problem_id, recordtype, generation_id AS m, list_filter(string_split(o_orderpriority || ' price ' || CAST(round(o_totalprice) AS BIGINT) % 7 || ' of ' || o_orderstatus, ' '), lambda x: x <> '') AS t,
    CAST(embedding AS DOUBLE[]) AS v FROM typed JOIN orders ON o_orderkey = generation_id LEFT JOIN embeddings ON vec_id = o_orderkey % 500 WHERE o_orderpriority NOT LIKE '1%'),
d AS (SELECT * FROM p WHERE (problem_id, recordtype) IN (SELECT (problem_id, recordtype) FROM p GROUP BY problem_id, recordtype HAVING count(*) > 2)),
c AS (SELECT problem_id, recordtype, m, n, t[i : i + n - 1] AS gram, count(*) AS c FROM d, range(1, 7) r(n), range(1, len(t) + 1) s(i) WHERE i + n - 1 <= len(t) GROUP BY ALL),
pairs AS (SELECT a.problem_id, a.recordtype, a.m AS a, b.m AS b, len(a.t) AS la, len(b.t) AS lb, a.v AS va, b.v AS vb FROM d a JOIN d b ON a.problem_id = b.problem_id AND a.recordtype = b.recordtype AND a.m < b.m),
hits AS (SELECT a.problem_id, a.recordtype, a.m AS a, b.m AS b, a.n, sum(least(a.c, b.c)) AS hit, count(*) AS s FROM c a JOIN c b ON a.problem_id = b.problem_id AND a.recordtype = b.recordtype AND a.n = b.n AND a.gram = b.gram AND a.m < b.m GROUP BY ALL),
sizes AS (SELECT problem_id, recordtype, m, count(*) AS z FROM c WHERE n = 2 GROUP BY ALL),
bleu AS (SELECT p.problem_id, p.recordtype, p.a, p.b, la, lb, r.n, la - r.n + 1 AS total, coalesce(hit, 0) AS hit FROM pairs p, range(1, 5) r(n) LEFT JOIN hits h ON h.problem_id = p.problem_id AND h.recordtype = p.recordtype AND h.a = p.a AND h.b = p.b AND h.n = r.n),
q AS (SELECT *, count(*) FILTER (WHERE hit = 0) OVER (PARTITION BY problem_id, recordtype, a, b ORDER BY n) AS misses FROM bleu WHERE total > 0),
f AS (SELECT problem_id, recordtype, a, b, CASE WHEN sum(hit) = 0 THEN 0.0 ELSE any_value(CASE WHEN la < lb THEN exp(1 - lb / la) ELSE 1.0 END) * exp(avg(ln(CASE WHEN hit = 0 THEN 100.0 / (pow(2, misses) * total) ELSE 100.0 * hit / total END))) END AS bleu FROM q GROUP BY ALL),
sem AS (SELECT problem_id, recordtype, count(*) AS n, count(DISTINCT semantic) AS k, avg(CAST(coherent AS INT)) AS coh, avg(CAST(accurate AS INT)) AS acc FROM typed GROUP BY ALL),
eq AS (SELECT problem_id, recordtype, sum(x * (x - 1)) AS eq FROM (SELECT problem_id, recordtype, semantic, count(*) AS x FROM typed GROUP BY ALL) GROUP BY ALL),
long AS (SELECT problem_id, recordtype, 'semantic_count' AS metric, CAST(k AS DOUBLE) AS value FROM sem UNION ALL SELECT problem_id, recordtype, 'semantic_proportion', k / n FROM sem WHERE n > 1
    UNION ALL SELECT problem_id, recordtype, 'pairwise_semantic', 1 - eq / (n * (n - 1)) FROM sem JOIN eq USING (problem_id, recordtype) WHERE n > 1
    UNION ALL SELECT problem_id, recordtype, 'avg_coherence', coh FROM sem UNION ALL SELECT problem_id, recordtype, 'avg_accuracy', acc FROM sem
    UNION ALL SELECT problem_id, recordtype, 'distinct_' || n, count(DISTINCT gram) / sum(c) FROM c GROUP BY problem_id, recordtype, n HAVING sum(c) > 1
    UNION ALL SELECT p.problem_id, p.recordtype, 'jaccard', avg(1 - coalesce(h.s, 0) / (x.z + y.z - coalesce(h.s, 0))) FROM pairs p JOIN sizes x ON x.problem_id = p.problem_id AND x.recordtype = p.recordtype AND x.m = p.a
        JOIN sizes y ON y.problem_id = p.problem_id AND y.recordtype = p.recordtype AND y.m = p.b LEFT JOIN hits h ON h.problem_id = p.problem_id AND h.recordtype = p.recordtype AND h.a = p.a AND h.b = p.b AND h.n = 2 GROUP BY 1, 2
    UNION ALL SELECT problem_id, recordtype, 'self_bleu', avg(100 - bleu) FROM f GROUP BY 1, 2
    UNION ALL SELECT problem_id, recordtype, 'cosine_distance', avg(1 - list_cosine_similarity(va, vb)) FROM pairs WHERE va IS NOT NULL AND vb IS NOT NULL GROUP BY 1, 2),
grid AS (SELECT DISTINCT problem_id, t.recordtype, m.metric FROM gen, (VALUES ('all'), ('coh'), ('syn'), ('err'), ('acc'), ('inacc')) t(recordtype),
    (VALUES ('semantic_count'), ('semantic_proportion'), ('pairwise_semantic'), ('avg_coherence'), ('avg_accuracy'), ('distinct_1'), ('distinct_2'), ('distinct_3'), ('distinct_4'), ('distinct_5'), ('distinct_6'), ('jaccard'), ('self_bleu'), ('cosine_distance')) m(metric))
"""


def _full_report(spark, sf):
    orders = table(spark, sf, "orders").withColumn("program", F.when(F.col("o_orderpriority").startswith("1"), "").otherwise(F.col("o_orderpriority")))
    said = F.concat("o_orderpriority", F.lit(" price "), (F.round("o_totalprice").cast("long") % 7).cast("string"), F.lit(" of "), "o_orderstatus")
    programs = orders.select(F.col("o_custkey").alias("problem_id"), F.col("o_orderkey").alias("generation_id"), "program", lexical.word_tokens(said).alias("tokens"), (F.col("o_orderkey") % 500).alias("vector_id"))
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("vector_id"), F.col("embedding").alias("vector"))
    return report.metric_report(generations(spark, sf), programs, vectors)


@query(_REPORT + "SELECT problem_id, recordtype, metric, round(coalesce(value, CASE WHEN metric = 'semantic_count' THEN 0 END), 4) AS value FROM grid LEFT JOIN long USING (problem_id, recordtype, metric)")
def metrics_by_recordtype(spark, sf):
    return _full_report(spark, sf).withColumn("value", F.round("value", 4))


@query(_REPORT + "SELECT recordtype, metric, count(coalesce(value, CASE WHEN metric = 'semantic_count' THEN 0 END)) AS count, round(avg(coalesce(value, CASE WHEN metric = 'semantic_count' THEN 0 END)), 4) AS mean FROM grid LEFT JOIN long USING (problem_id, recordtype, metric) GROUP BY 1, 2")
def summary_by_recordtype(spark, sf):
    return summary.describe(_full_report(spark, sf), ["recordtype", "metric"]).select("recordtype", "metric", "count", F.round("mean", 4).alias("mean"))


# ---------------------------------------------------------------------------------------------------
# Written and read again.

@query("SELECT p_partkey, p_name, p_size FROM part")
def jsonl_round_trip(spark, sf):
    path = f"{monitor.work_dir(spark)}/jsonl"
    sinks.write_jsonl(table(spark, sf, "part").select("p_partkey", "p_name", "p_size"), path)
    return readers.read_jsonl(spark, path, "p_partkey bigint, p_name string, p_size int")


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, CAST(p_size AS VARCHAR) AS p_size FROM part")
def tsv_round_trip(spark, sf):
    path = f"{monitor.work_dir(spark)}/tsv"
    sinks.write_tsv(table(spark, sf, "part").select("p_partkey", "p_name", "p_size"), path)
    return readers.read_tsv(spark, path)


@query("SELECT CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS status, count(*) AS n FROM events GROUP BY 1")
def stream_status_monitor(spark, sf):
    """Events as a stream, each handled once, into a table of states."""
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    states = stream.select("event_id", F.when(F.col("event_type") == "error", "failure").otherwise("success").alias("status"))
    base = monitor.work_dir(spark)
    return monitor.run_to_table(states, f"{base}/states", f"{base}/offsets", states.schema).groupBy("status").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------------------------------------------
# Windowed events; the streams of streaming.monitor over the same transformations.

@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark, sf):
    return monitor.windowed_counts(table(spark, sf, "events"), "1 hour").withColumn("total", F.round("total", 4))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) - k * INTERVAL 1 HOUR AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, range(0, 2) r(k) GROUP BY 1, 2")
def events_sliding(spark, sf):
    return monitor.windowed_counts(table(spark, sf, "events"), "2 hours", "1 hour").withColumn("total", F.round("total", 4))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def events_session(spark, sf):
    return monitor.sessions(table(spark, sf, "events"), "6 hours")
