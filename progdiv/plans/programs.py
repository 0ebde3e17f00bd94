"""More queries of the catalogue: tokens of programs that need not parse, subwords, sampled pairs, sketches."""

from __future__ import annotations

from pyspark.sql import functions as F

from progdiv.functions import registered
from progdiv.functions.pytokens import with_tokens
from progdiv.functions.subwords import with_embedding_text, with_subwords
from progdiv.functions.text import strip_comments, tokens_13a
from progdiv.operators import dataset, lexical, syntactic
from progdiv.plans.catalogue import _BLEU, _DRAWS, _GRAMS, _TREES, _WORDS, _benchmark, _tokens, _varied_subtrees, query, r6, table
from progdiv.sources import record_tree
from progdiv.streaming import monitor, running

# ---------------------------------------------------------------------------------------------------
# Programs of which some don't parse, and their tokens.


def _shaped_programs(spark, sf):
    """Six shapes in turn: a comment in a block, a string with a field, brackets left open before a new statement, a string
    left open, a block less indented than any before, and brackets that close nothing."""
    size, name = F.col("p_size").cast("string"), F.regexp_replace(F.lower("p_brand"), "[^a-z0-9]", "")
    shapes = [
        F.concat(F.lit("def f_"), name, F.lit("(x):\n    # "), "p_type", F.lit("\n    return x * "), size, F.lit("\n")),
        F.concat(F.lit('x = f"'), "p_name", F.lit(" {{{s!r:>"), size, F.lit('}"\n')),
        F.concat(F.lit("print("), size, F.lit(", [1\ndef g():\n  pass")),
        F.concat(F.lit("y = 'it"), "p_brand", F.lit("\n")),
        F.concat(F.lit("if x:\n    a\n  b = $"), size),
        F.concat(F.lit("z = ) + "), size, F.lit("] # "), "p_name"),
    ]
    code = F.element_at(F.array(*shapes), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf, "part").select("p_brand", "p_partkey", code.alias("code"))


#: The tokens of each shape, by hand.
_SHAPED = """WITH p AS (SELECT p_brand AS k, p_partkey % 6 AS shape, CAST(p_size AS VARCHAR) AS s, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS b, p_name, p_type, p_brand, chr(10) AS nl FROM part),
v(variant, kept) AS (VALUES ('plain', true), ('no_comments', false)),
d AS (SELECT k, variant, CASE shape
    WHEN 0 THEN ['def', 'f_' || b, '(', 'x', ')', ':', nl] || CASE WHEN kept THEN string_split('# ' || p_type, ' ') ELSE [] END || ['return', 'x', '*', s, nl, 'DEDENT']
    WHEN 1 THEN ['x', '=', 'f"', p_name || ' {', '{', 's', '!', 'r', ':', '>' || s, '}', '"', nl]
    WHEN 2 THEN ['print', '(', s, ',', '[', '1', nl, 'def', 'g', '(', ')', ':', nl, 'pass', '', 'DEDENT']
    WHEN 3 THEN ['y', '=', '''', 'it' || regexp_extract(p_brand, '^[^#]*')] || CASE WHEN kept THEN [regexp_extract(p_brand, '#.*$')] ELSE [] END || [nl]
    WHEN 4 THEN ['if', 'x', ':', nl, 'a', nl, 'DEDENT', 'b', '=', '$', s, '', 'DEDENT']
    ELSE ['z', '=', ')', '+', s, ']'] || CASE WHEN kept THEN string_split('# ' || p_name, ' ') ELSE [] END || [''] END AS t FROM p, v),
"""


@query(_SHAPED + """g AS (SELECT k, variant, n, t[i : i + n - 1] AS gram FROM d, range(1, 7) r(n), range(1, len(t) + 1) s(i) WHERE i + n - 1 <= len(t))
SELECT k AS p_brand, variant, CAST(n AS INT) AS n, count(DISTINCT gram) AS n_distinct, count(*) AS n_total, round(CASE WHEN count(*) > 1 THEN count(DISTINCT gram) / count(*) END, 6) AS distinct_n FROM g GROUP BY k, variant, n""")
def distinct_n_programs(spark, sf):
    """Distinct n-grams of tolerant tokens, with comments and without."""
    code = _shaped_programs(spark, sf)
    each = [with_tokens(code, "code", "tokens", comments).withColumn("variant", F.lit(v)) for v, comments in (("plain", True), ("no_comments", False))]
    out = lexical.distinct_n(each[0].union(each[1]), ["p_brand", "variant"], "tokens")
    return out.withColumn("distinct_n", r6("distinct_n"))


#: The start and the end token around the subwords of a program.
ENDS = ("<s>", "</s>")


@query()
def distinct_n_subwords(spark, sf):
    """Distinct n-grams of the subwords of programs, with comments and without; vocabularies have no SQL."""
    code = _shaped_programs(spark, sf)
    both = code.withColumn("variant", F.lit("raw")).union(code.withColumn("code", strip_comments(F.col("code"))).withColumn("variant", F.lit("raw_no_comments")))
    out = lexical.distinct_n(with_subwords(both, "code", "tokens", ends=ENDS), ["p_brand", "variant"], "tokens")
    return out.withColumn("distinct_n", r6("distinct_n"))


# ---------------------------------------------------------------------------------------------------
# BLEU on the tokens of machine-translation scores.

_CLEAN = "replace(replace(replace(text, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
for _name, _value in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
    _CLEAN = f"replace({_CLEAN}, '{_name}', '{_value}')"
_CLEAN = f"' ' || {_CLEAN} || ' '"
for _pattern, _new in ((r"([\{-~\[-` -&(-+:-@/])", r" \1 "), (r"([^0-9])([.,])", r"\1 \2 "), (r"([.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
    _CLEAN = f"regexp_replace({_CLEAN}, '{_pattern}', '{_new}', 'g')"
_BLEU_13A = _BLEU.replace(_WORDS, f"list_filter(string_split_regex({_CLEAN}, ' +'), lambda x: x <> '')")


@query(_BLEU_13A + "SELECT k AS grp, a, b, round(100 - bleu, 4) AS distance FROM f")
def self_bleu_pairs_13a(spark, sf):
    out = lexical.bleu_pairs(_benchmark(spark, sf).withColumn("tokens", tokens_13a(F.col("text"))), ["grp"], "item_id", "tokens")
    return out.withColumn("distance", F.round("distance", 4))


@query(_BLEU_13A + "SELECT k AS grp, round(avg(100 - bleu), 4) AS self_bleu FROM f GROUP BY 1")
def corpus_self_bleu_13a(spark, sf):
    out = lexical.corpus_self_bleu(_benchmark(spark, sf).withColumn("tokens", tokens_13a(F.col("text"))), ["grp"], "item_id", "tokens")
    return out.withColumn("self_bleu", F.round("self_bleu", 4))


# ---------------------------------------------------------------------------------------------------
# Pairs drawn with replacement.


@query(_TREES + f""", r AS (SELECT *, row_number() OVER (PARTITION BY problem_id, variant, height ORDER BY m) - 1 AS pos, count(*) OVER (PARTITION BY problem_id, variant, height) AS n FROM members),
u(it, u0, u1) AS (VALUES {_DRAWS}), q AS (SELECT it, 0 AS side, problem_id, variant, height, m FROM u JOIN r ON pos = floor(u0 * n) UNION ALL SELECT it, 1, problem_id, variant, height, m FROM u JOIN r ON pos = floor(u1 * n)),
x AS (SELECT it, problem_id, variant, height, g, count(DISTINCT side) AS sides FROM q JOIN g USING (problem_id, variant, height, m) GROUP BY ALL),
j AS (SELECT it, problem_id, variant, height, 1 - count(*) FILTER (WHERE sides = 2) / count(*) AS j FROM x GROUP BY ALL)
SELECT problem_id, variant, height, round(j, 6) AS sampled_jaccard FROM (SELECT DISTINCT problem_id, variant, height FROM r WHERE n > 1) LEFT JOIN (SELECT problem_id, variant, height, avg(j) AS j FROM j GROUP BY 1, 2, 3) USING (problem_id, variant, height)""")
def ast_jaccard_sampled(spark, sf):
    out = syntactic.sampled_jaccard_subtrees(_varied_subtrees(spark, sf), ["problem_id"], "generation_id")
    return out.withColumn("sampled_jaccard", r6("sampled_jaccard"))


# ---------------------------------------------------------------------------------------------------
# Sketches of distinct shares.


@query("SELECT lang, n, n_distinct, n_total, true AS near FROM (" + _GRAMS % {"key": "lang", "table": "documents"} + ")")
def distinct_n_sketched(spark, sf):
    """Exact counts by language, and whether estimates from sketches by language and source, rolled up, are within 5 %, three
    standard errors."""
    docs = _tokens(spark, sf, "documents")
    finer = lexical.gram_sketches(docs, ["lang", "source"], "tokens")
    coarse = lexical.sketched_distinct_n(lexical.rolled_up(finer, ["lang"])).withColumnsRenamed({"n_distinct": "estimate", "lang": "k", "n": "order"})
    exact = lexical.distinct_n(docs, ["lang"], "tokens", prose=True).join(coarse.select("k", "order", "estimate"), F.col("lang").eqNullSafe(F.col("k")) & (F.col("n") == F.col("order")))
    return exact.select("lang", "n", "n_distinct", "n_total", (F.abs(F.col("estimate") - F.col("n_distinct")) <= 0.05 * F.col("n_distinct")).alias("near"))


# ---------------------------------------------------------------------------------------------------
# Written in SQL alone, with the registered functions.

_SHAPED_PROGRAMS = """SELECT p_brand, p_partkey, p_size, CASE p_partkey % 3
    WHEN 0 THEN 'def f_' || regexp_replace(lower(p_brand), '[^a-z0-9]', '') || '(x):\n    return x * ' || p_size
    WHEN 1 THEN 'y = 1 # ' || p_type || '\n' ELSE 'print(' || p_size || ' [' END AS code FROM part"""


@query("""WITH v AS (SELECT p_brand, p_partkey % 3 AS shape, CAST(p_size AS VARCHAR) AS s, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS b, p_type FROM part),
t AS (SELECT p_brand, shape, unnest(CASE shape WHEN 0 THEN ['def', 'f_' || b, '(', 'x', ')', ':', chr(10), 'return', 'x', '*', s, '', 'DEDENT'] WHEN 1 THEN ['y', '=', '1'] || string_split('# ' || p_type, ' ') || [chr(10)] ELSE ['print', '(', s, '[', ''] END) AS token FROM v)
SELECT p_brand, token, count(*) AS n, count(*) FILTER (WHERE shape < 2) AS n_parsing FROM t GROUP BY 1, 2""")
def sql_python_tokens(spark, sf):
    registered.register(spark)
    table(spark, sf, "part").createOrReplaceTempView("part")
    return spark.sql(f"SELECT p_brand, token, count(*) AS n, count_if(ok) AS n_parsing FROM (SELECT *, parses(code) AS ok FROM ({_SHAPED_PROGRAMS})), LATERAL python_tokens(code) GROUP BY 1, 2")


@query("""WITH v AS (SELECT p_brand, p_size AS s FROM part WHERE p_partkey % 3 = 0), n(height, named, sized) AS (VALUES (3, 0, 1), (3, 0, 1), (3, 1, 0), (3, 1, 0), (4, 0, 1), (4, 1, 1), (4, 1, 0), (5, 1, 1), (5, 1, 1), (6, 1, 1))
SELECT p_brand, height, CAST(count(*) AS BIGINT) AS n_total, CAST(count(DISTINCT s) AS BIGINT) AS sizes FROM v, n GROUP BY 1, 2""")
def sql_subtrees(spark, sf):
    registered.register(spark)
    table(spark, sf, "part").createOrReplaceTempView("part")
    return spark.sql(f"""SELECT p_brand, height, sum(t.count) AS n_total, count(DISTINCT p_size) AS sizes FROM ({_SHAPED_PROGRAMS} WHERE p_partkey % 3 = 0), LATERAL subtrees(code, 'obfuscated', highest => 6) t GROUP BY 1, 2""")


# ---------------------------------------------------------------------------------------------------
# Folders of generations, and generations as a stream.


@query("""SELECT s_nationkey AS problem_id, CAST(s_suppkey AS INT) AS generation_id, CASE WHEN s_acctbal < 0 THEN 0.0 ELSE 0.5 END AS coherence, 1.0 AS accuracy,
    'g ' || s_name AS generation, s_name AS program, CASE WHEN s_acctbal >= 0 THEN '{"k": ' || s_suppkey || '}' END AS output_record, 'Accuracy: 1.0' || chr(10) || s_name AS diff FROM supplier""")
def record_tree_round_trip(spark, sf):
    """Suppliers of a nation as folders of a problem's generations, written and read again."""
    fine = F.col("s_acctbal") >= 0
    made = table(spark, sf, "supplier").select(
        F.col("s_nationkey").cast("string").alias("problem_id"), F.col("s_suppkey").cast("int").alias("generation_id"), F.when(fine, 0.5).otherwise(0.0).alias("coherence"), F.lit(1.0).alias("accuracy"),
        F.concat(F.lit("g "), "s_name").alias("generation"), F.col("s_name").alias("program"),
        F.when(fine, F.concat(F.lit('{"k": '), F.col("s_suppkey").cast("string"), F.lit("}"))).alias("output_record"), F.col("s_name").alias("diff"),
    )
    path = f"{monitor.work_dir(spark)}/tree"
    record_tree.write_tree(made.repartition("problem_id"), path)
    read = record_tree.read_tree(spark, path).drop("formatted_program")
    return read.withColumn("problem_id", F.col("problem_id").cast("long"))


@query("""WITH d AS (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY 1, 2), t AS (SELECT conv_id, turn, """ + _WORDS + """ AS t FROM d),
g AS (SELECT conv_id, t[i : i + 1] AS gram FROM t, range(1, len(t)) s(i)), m AS (SELECT conv_id, count(*) AS members FROM d GROUP BY 1),
c AS (SELECT conv_id, count(DISTINCT gram) AS n_distinct, count(*) AS n_total FROM g GROUP BY 1)
SELECT conv_id, members, coalesce(n_distinct, 0) AS n_distinct, coalesce(n_total, 0) AS n_total, round(CASE WHEN n_total > 1 THEN n_distinct / n_total END, 6) AS distinct_n FROM m LEFT JOIN c USING (conv_id)""")
def stream_running_distinct(spark, sf):
    """Turns of conversations as generations that arrive in several batches, each twice, and the running share of distinct 2-grams
    after the last one."""
    base = monitor.work_dir(spark)
    turns = table(spark, sf, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text")).withColumn("ts", F.to_timestamp(F.lit("2024-01-01")) + F.make_interval(secs=F.pmod(F.xxhash64("conv_id", "turn"), F.lit(60)).cast("double")))
    turns.union(turns).repartition(3, F.rand(1)).write.parquet(f"{base}/arrived")
    stream = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/arrived").withColumn("tokens", lexical.word_tokens(F.col("text")))
    once = running.first_arrivals(stream, ["conv_id", "turn"], "ts", "1 hour")
    updates = running.running_distinct_n(once.select("conv_id", "tokens"), "conv_id", "tokens", 2)
    out = running.latest(monitor.run_to_table(updates, f"{base}/updates", f"{base}/offsets", updates.schema), "conv_id")
    return out.withColumn("distinct_n", r6("distinct_n"))


# ---------------------------------------------------------------------------------------------------
# Preparation and validation.


@query()
def embedding_budget(spark, sf):
    """Every document cut to what an embedder of 512 subwords takes; vocabularies have no SQL."""
    return with_embedding_text(table(spark, sf, "documents").select("doc_id", "text"), "text", "cut").select("doc_id", "cut")


@query("""SELECT o_custkey, max(o_orderpriority || '_' || strftime(CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 SECOND * (o_orderkey % 86400), '%Y-%m-%d_%H-%M-%S')) FILTER (WHERE k = 1) AS folder
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS TIMESTAMP) + INTERVAL 1 SECOND * (o_orderkey % 86400) DESC, o_orderpriority DESC) AS k FROM orders) GROUP BY 1""")
def latest_folder(spark, sf):
    """Of each customer the order whose name ends in the latest time."""
    at = F.col("o_orderdate").cast("timestamp") + F.make_interval(secs=(F.col("o_orderkey") % 86400).cast("double"))
    named = table(spark, sf, "orders").select("o_custkey", F.concat("o_orderpriority", F.lit("_"), F.date_format(at, "yyyy-MM-dd_HH-mm-ss")).alias("folder"))
    return dataset.latest_folder(named, ["o_custkey"], "folder")


@query("""WITH c AS (SELECT l_orderkey AS problem_id, l_linenumber AS testcase_id, bool_or(l_returnflag <> 'R') AS i, bool_or(l_linestatus = 'F') AS o FROM lineitem GROUP BY 1, 2 HAVING i OR o)
SELECT problem_id, count(*) FILTER (WHERE i) AS n_inputs, count(*) FILTER (WHERE o) AS n_outputs, string_agg(CAST(testcase_id AS VARCHAR), ',' ORDER BY testcase_id) FILTER (WHERE NOT (i AND o)) AS without FROM c GROUP BY 1 HAVING count(*) FILTER (WHERE NOT (i AND o)) > 0""")
def unmatched_cases(spark, sf):
    """Lines as test cases: an input unless returned, an output if finished."""
    lines = table(spark, sf, "lineitem")
    kinds = F.array_compact(F.array(F.when(F.col("l_returnflag") != "R", F.lit("input")), F.when(F.col("l_linestatus") == "F", F.lit("output"))))
    cases = lines.select(F.col("l_orderkey").alias("problem_id"), F.explode(kinds).alias("kind"), F.col("l_linenumber").alias("testcase_id"))
    return dataset.unmatched_cases(cases).withColumn("without", F.array_join(F.transform("without", lambda x: x.cast("string")), ","))


@query("""SELECT p_partkey, CASE WHEN p_size % 4 <> 1 THEN p_brand END AS model, CASE WHEN p_size % 4 <> 2 THEN p_retailprice END AS temperature, CAST(CASE WHEN p_size % 4 <> 3 THEN p_size END AS INT) AS n,
    concat_ws('; ', CASE WHEN p_size % 4 = 3 THEN 'too few elements' END, CASE WHEN p_size % 4 = 1 THEN 'model is no string' END, CASE WHEN p_size % 4 = 2 THEN 'temperature is no double' END) AS problems FROM part""")
def config_types(spark, sf):
    """Configurations as JSON arrays of which some have elements of other types or lack one."""
    kind = F.col("p_size") % 4
    model = F.when(kind == 1, F.col("p_size").cast("string")).otherwise(F.concat(F.lit('"'), "p_brand", F.lit('"')))
    price = F.when(kind == 2, F.lit("7")).otherwise(F.col("p_retailprice").cast("string"))
    row = F.concat(F.lit("["), model, F.lit(", "), price, F.when(kind == 3, F.lit("")).otherwise(F.concat(F.lit(", "), F.col("p_size").cast("string"))), F.lit("]"))
    out = dataset.typed_configs(table(spark, sf, "part").select("p_partkey", row.alias("row")), "row", [("model", "string"), ("temperature", "double"), ("n", "int")], 3)
    return out.select("p_partkey", "model", "temperature", "n", F.array_join("problems", "; ").alias("problems"))
