"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from progdiv.llm import bestfit, centroids, chat, langid, lm, minhash, mixing, packing, repeats, runs, secrets, vectors, winnowing
from progdiv.llm.common import table


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"), 0.93)


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"), secrets.joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs).select("doc_id", "held_out", "lang_pred", "score")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = winnowing.fingerprints(table(spark, sf_dir, "documents"))
    out = out.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        winnowing.digest("fingerprint").alias("fingerprint"), winnowing.digest("edited_fingerprint").alias("edited_fingerprint"),
        F.array_join(F.transform(winnowing.positions("fingerprint"), lambda p: p.cast("string")), ",").alias("positions"),
        winnowing.gram_hashes("fingerprint").alias("own"), winnowing.gram_hashes("edited_fingerprint").alias("new"), winnowing.gram_hashes("next_fingerprint").alias("next"),
    )
    near = {"near_edited": winnowing.likeness("own", "new"), "near_next": winnowing.likeness("own", "next")}
    return out.withColumns(near).drop("own", "new", "next")


#: Schemas of the tools that with_calls has the assistant call.
TOOLS = {
    "measure": {"type": "object", "required": ["chars"], "properties": {"chars": {"type": "integer", "maximum": 1000}, "after": {"type": "object"}}, "additionalProperties": False},
    "store": {"type": "object", "required": ["value"], "properties": {"value": {"type": "integer"}}},
}


def with_calls(messages: DataFrame) -> DataFrame:
    """The messages with tool calls made of them, as the table itself has none.

    Every assistant message with a turn calls two tools: store, which needs the result of measure, which needs that of the
    assistant's turn before. Two tool messages follow it with the results, the latter first; measure has none
    for texts whose length 5 divides.
    """
    turn, n = F.col("turn").cast("string"), F.length("text")
    calls = F.col("role").eqNullSafe("assistant") & F.col("turn").isNotNull() & F.col("text").isNotNull()
    needs = F.when(F.col("turn") >= 3, F.struct(F.concat(F.lit("a"), (F.col("turn") - 2).cast("string")).alias("$result")))
    store = F.struct(F.concat(F.lit("b"), turn).alias("id"), F.lit("store").alias("name"), F.to_json(F.struct(F.struct(F.concat(F.lit("a"), turn).alias("$result")).alias("value"))).alias("arguments"))
    measure = F.struct(F.concat(F.lit("a"), turn).alias("id"), F.lit("measure").alias("name"), F.to_json(F.struct(n.alias("chars"), needs.alias("after"))).alias("arguments"))
    text = F.when(calls, F.to_json(F.struct(F.col("text").alias("content"), F.array(store, measure).alias("tool_calls")))).otherwise(F.col("text"))
    result = lambda name, value: F.to_json(F.struct(F.concat(F.lit(name), turn).alias("tool_call_id"), value.alias("content")))
    results = F.array(result("b", F.lit("stored")), F.when(n % 5 != 0, result("a", n.cast("string"))))
    rows = messages.select("conv_id", "turn", "role", text.alias("text"))
    return rows.union(messages.where(calls).select("conv_id", "turn", F.lit("tool"), F.explode(F.array_compact(results))))


def op10_chat(spark: SparkSession, sf_dir: str, schemas: dict[str, dict] | None = None) -> DataFrame:
    """Every message of the table, and those that with_calls adds, against TOOLS; with schemas (JSON Schema of the arguments by
    tool name) the messages as they are."""
    messages = table(spark, sf_dir, "conversations")
    out = chat.format_chats(messages, schemas) if schemas is not None else chat.format_chats(with_calls(messages), TOOLS)
    return out.withColumn("problems", F.array_join("problems", "; "))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.collapse_runs(table(spark, sf_dir, "documents"), edit=True)


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))


def op13_bestfit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.pack(table(spark, sf_dir, "documents"))


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op3_secrets returns that SQL can express: the base spans."""
    return op3_secrets(spark, sf_dir).drop("spans")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op5_mixing returns that SQL can express: sizes and targets, and whether a document is taken at most twice."""
    out = op5_mixing(spark, sf_dir)
    return out.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), (F.col("taken") <= 2 * F.col("size")).alias("within"))


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op6_lm returns but for the model's own score."""
    out = op6_lm(spark, sf_dir)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def fingerprint_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op9_fingerprints returns that SQL can express: the edited texts."""
    return op9_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


QUERIES = {"op1_embeddings": op1_embeddings, "op2_repeats": op2_repeats, "op3_secrets": op3_secrets, "op4_minhash": op4_minhash, "op5_mixing": op5_mixing, "op6_lm": op6_lm, "op7_language": op7_language, "op8_packing": op8_packing, "op9_fingerprints": op9_fingerprints, "op10_chat": op10_chat, "op11_runs": op11_runs, "op12_centroids": op12_centroids, "op13_bestfit": op13_bestfit}
QUERIES |= {"secrets_base": secrets_base, "mixing_targets": mixing_targets, "lm_base": lm_base, "fingerprint_edits": fingerprint_edits}

#: Ends of both similarity queries: what each row reaches by links.
_REACH = """reach(id, other) AS (SELECT id, id FROM n UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a),
least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY 1)"""

_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"


def _repeats_sql(width: int = 200) -> str:
    """Keys of width bytes from those of half as many, doubled by lead(); covered bytes from the starts before them."""
    steps, have = ["k1 AS (SELECT doc_id, n, b, i, hash(b) AS k FROM bytes)"], 1
    while have < width:
        by, to = min(have, width - have), min(2 * have, width)
        steps.append(f"k{to} AS (SELECT doc_id, n, b, i, hash(k, lead(k, {by}) OVER w) AS k FROM k{have} WINDOW w AS (PARTITION BY doc_id ORDER BY i))")
        have = to
    return f"""WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS b FROM documents),
        bytes AS (SELECT doc_id, n, unnest(b) AS b, unnest(range(len(b))) AS i FROM d), {", ".join(steps)},
        starts AS (SELECT doc_id, b, i, i + {width} <= n AND count(*) OVER (PARTITION BY CASE WHEN i + {width} <= n THEN k ELSE -1 END) > 1 AS again FROM k{width}),
        covered AS (SELECT doc_id, b, i, max(CAST(again AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {width - 1} PRECEDING AND CURRENT ROW) = 1 AS gone FROM starts),
        runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM covered),
        found AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE begins) AS n_spans, string_agg(b, '' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM runs GROUP BY 1)
        SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN found USING (doc_id)"""


def _secrets_sql() -> str:
    """Matches of each kind, and their starts from the lengths of what is between them."""
    kinds = (("assign", secrets.ASSIGN.replace("'", "''"), 2, 6), ("access", "(AKIA[A-Z0-9]+)", 1, 20), ("hex", "([0-9a-f]+)", 1, 24))
    found = " UNION ALL ".join(
        f"""SELECT doc_id, {i} AS kind, '{name}' AS name, unnest(regexp_extract_all(t, '{pattern}', 0)) AS hit, unnest(regexp_extract_all(t, '{pattern}', {group})) AS part, {least} AS least,
            unnest(string_split_regex(t, '{pattern}')) AS gap, generate_subscripts(string_split_regex(t, '{pattern}'), 1) AS j FROM d"""
        for i, (name, pattern, group, least) in enumerate(kinds)
    )
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({found}),
        p AS (SELECT *, sum(length(gap) + coalesce(length(hit), 0)) OVER (PARTITION BY doc_id, kind ORDER BY j) AS upto FROM m),
        s AS (SELECT doc_id, kind, name, upto - length(hit) AS start, upto AS stop FROM p WHERE length(part) >= least)
        SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
            sha256(coalesce(string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind), '')) AS base_sha256 FROM d LEFT JOIN s USING (doc_id) GROUP BY 1"""


#: Of the number as text: bytes run through the reflected polynomial, eight steps (-1) after each.
_CRC32 = """xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: [CAST(ord(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"""



def _runs_sql() -> str:
    """Where four points of a period's grid hold one word, the period's matches of the whole text, in islands."""
    return f"""WITH h AS (SELECT doc_id, coalesce({_CRC32}, 1) AS h, {_WORDS} AS w FROM documents),
        d AS (SELECT doc_id, h, w, len(w) AS n, h // 10 % greatest(len(w), 1) AS a FROM h),
        e AS (SELECT *, h % 10 = 0 AND n > 0 AS made, 1 + (n - a) // (3 + h // 10 % 8) AS p FROM d),
        o AS (SELECT doc_id, unnest(w) AS w, unnest(range(n)) AS i FROM d),
        j AS (SELECT doc_id, i, CASE WHEN made AND i >= a THEN a + (i - a) % p ELSE i END AS k FROM (SELECT doc_id, made, a, p, unnest(range(n)) AS i FROM e)),
        t AS MATERIALIZED (SELECT j.doc_id, j.i, o.w FROM j JOIN o ON o.doc_id = j.doc_id AND o.i = j.k),
        g AS (SELECT doc_id, p, unnest(range((n - 1) // p - 2)) * p AS i FROM (SELECT doc_id, n, unnest(range(1, n // 4 + 1)) AS p FROM d)),
        g0 AS MATERIALIZED (SELECT g.doc_id, p, g.i, w FROM g JOIN t ON t.doc_id = g.doc_id AND t.i = g.i),
        g1 AS MATERIALIZED (SELECT g.* FROM g0 g JOIN t ON t.doc_id = g.doc_id AND t.i = g.i + p AND t.w = g.w),
        g2 AS MATERIALIZED (SELECT g.* FROM g1 g JOIN t ON t.doc_id = g.doc_id AND t.i = g.i + 2 * p AND t.w = g.w),
        c AS MATERIALIZED (SELECT DISTINCT g.doc_id, p FROM g2 g JOIN t ON t.doc_id = g.doc_id AND t.i = g.i + 3 * p AND t.w = g.w),
        x AS MATERIALIZED (SELECT c.doc_id, p, i, w FROM c JOIN t USING (doc_id)),
        m AS (SELECT x.doc_id, p, x.i, x.i - row_number() OVER (PARTITION BY x.doc_id, p ORDER BY x.i) AS island FROM x JOIN t ON t.doc_id = x.doc_id AND t.i = x.i + p AND t.w = x.w),
        s AS (SELECT doc_id, p, min(i) AS start, count(*) + p AS length FROM m GROUP BY doc_id, p, island HAVING count(*) + p >= greatest(6, 4 * p)),
        r AS (SELECT doc_id, start, length, min(p) AS period FROM s GROUP BY ALL),
        b AS (SELECT doc_id, count(*) AS n_runs, arg_min({{'s': start, 'l': length, 'p': period}}, (-length, start, period)) AS x, sha256(string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period)) AS runs_sha256 FROM r GROUP BY 1),
        k AS (SELECT doc_id, sha256(string_agg(w, ' ' ORDER BY i)) AS collapsed_sha256 FROM t WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = t.doc_id AND t.i >= start + period AND t.i < start + length) GROUP BY 1)
        SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(x.s AS BIGINT) AS start, CAST(x.l AS BIGINT) AS length, CAST(x.p AS BIGINT) AS period, CAST(1000 * x.l // x.p AS BIGINT) AS exponent_milli,
            coalesce(runs_sha256, sha256('')) AS runs_sha256, coalesce(collapsed_sha256, sha256('')) AS collapsed_sha256 FROM d LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)"""


def _centroids_sql(rounds: int = 3) -> str:
    """Rounds one after another, with squared distances from inner products of whole numbers, which doubles hold exactly."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS (SELECT id, v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT n.id, n.v, k.c, list_inner_product(n.v, n.v) - 2 * list_inner_product(n.v, k.v) + list_inner_product(k.v, k.v) AS d FROM n, c{r} k) GROUP BY 1, 2)""")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT c, list(m ORDER BY i) AS v FROM (SELECT c, i, floor(sum(x) / count(*)) AS m FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS i FROM a{r}) GROUP BY 1, 2) GROUP BY 1),
        c{r + 1} AS (SELECT k.c, coalesce(m.v, k.v) AS v FROM c{r} k LEFT JOIN m{r} m ON m.c = k.c)""")
    return f"""WITH n AS (SELECT vec_id AS id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(64 * x)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64),
        c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || id)) - 1 AS c, v FROM n QUALIFY c < 16), {", ".join(steps)},
        i AS (SELECT c, CAST(sum(d) AS BIGINT) AS inertia FROM a{rounds} GROUP BY 1)
        SELECT id AS vec_id, CAST(a.c AS INT) AS cluster, CAST(d AS BIGINT) AS distance, i.inertia AS cluster_inertia, CAST((SELECT sum(inertia) FROM i) AS BIGINT) AS inertia,
            sha256(array_to_string(list_transform(k.v, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256 FROM a{rounds} a JOIN i USING (c) JOIN c{rounds} k USING (c)"""


SQL: dict[str, str] = {
    "op11_runs": _runs_sql(),
    "op12_centroids": _centroids_sql(),
    "op2_repeats": _repeats_sql(),
    "secrets_base": _secrets_sql(),
    "mixing_targets": f"""WITH d AS (SELECT doc_id, source, len({_WORDS}) AS size FROM documents),
        s AS (SELECT source, sum(size) AS size, [2, 3, 1][row_number() OVER (ORDER BY source NULLS LAST) % 3 + 1] AS w FROM d GROUP BY 1),
        o AS (SELECT *, 2 * size / w AS full_at, 1.5 * sum(size) OVER () - coalesce(sum(2 * size) OVER (ORDER BY 2 * size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
            sum(w) OVER (ORDER BY 2 * size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws,
            row_number() OVER (ORDER BY 2 * size / w, source) AS k FROM s),
        l AS (SELECT arg_min(rest / ws, k) FILTER (WHERE rest / ws <= full_at) AS level FROM o)
        SELECT doc_id, CAST(d.size AS BIGINT) AS size, CAST(o.size AS BIGINT) AS source_size, round(least(2.0 * o.size, w * level), 4) AS target, true AS within FROM d JOIN o ON d.source IS NOT DISTINCT FROM o.source, l""",
    "lm_base": f"""WITH d AS (SELECT doc_id, {_CRC32} % 10 = 0 AS held_out, list_concat({_WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}, ['\x20end']) AS t FROM documents),
        w AS (SELECT doc_id, held_out, unnest(t) AS w FROM d), c AS (SELECT w, count(*) AS c FROM w WHERE NOT held_out GROUP BY 1), n AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM c),
        x AS (SELECT doc_id, held_out, w.w, coalesce(c, 0) AS c FROM w LEFT JOIN c ON c.w = w.w)
        SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (WHERE c > 0) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens, round(sum(log10((c + 0.1) / (n + 0.1 * (v + 1)))), 4) AS base_score FROM x, n GROUP BY 1, 2""",
    "fingerprint_edits": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id) AS r, count(*) OVER () AS n FROM documents)
        SELECT a.doc_id, length(a.t) AS n_chars, sha256(substring(a.t, 1, length(a.t) - length(a.t) // 4) || substring(b.t, 1, length(a.t) // 4)) AS edited_sha256 FROM d a JOIN d b ON b.r = a.r % a.n + 1""",
    "op1_embeddings": f"""WITH RECURSIVE n AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        links AS (SELECT x.id AS a, y.id AS b FROM n x JOIN n y ON x.label = y.label AND x.id <> y.id WHERE list_cosine_similarity(x.v, y.v) >= 0.93),
        {_REACH}
        SELECT id AS vec_id, (SELECT count(*) FROM links WHERE a = id) AS n_links, component_id, id = component_id AS kept FROM least""",
    "op4_minhash": f"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS t FROM documents),
        s AS (SELECT doc_id AS id, unnest(CASE WHEN len(t) >= 4 THEN list_distinct(list_transform(range(1, len(t) - 2), lambda i: array_to_string(t[i : i + 3], ' '))) WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END) AS g FROM d),
        n AS (SELECT doc_id AS id, (SELECT count(*) FROM s WHERE s.id = doc_id) AS k FROM d),
        i AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.id <> b.id GROUP BY ALL),
        links AS (SELECT a, b FROM i JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 100 * i.k >= 80 * (x.k + y.k - i.k)),
        {_REACH}
        SELECT id AS doc_id, k AS n_shingles, component_id, id = component_id AS kept FROM least JOIN n USING (id)""",
    "op10_chat": """
        WITH m AS (SELECT *, length(text) AS n, role = 'assistant' AS calls, 'a' || turn AS a, 'b' || turn AS b, coalesce(CAST(to_json(text) AS VARCHAR), 'null') AS body FROM conversations),
        r AS (SELECT conv_id, turn, role, 0 AS phase, 0 AS depth, text,
                '{"content":' || body || ',"role":' || to_json(role) || CASE WHEN calls THEN ',"tool_calls":[{"arguments":{' || CASE WHEN turn >= 3 THEN '"after":{"$result":"a' || (turn - 2) || '"},' ELSE '' END
                    || '"chars":' || n || '},"id":"' || a || '","name":"measure"},{"arguments":{"value":{"$result":"' || a || '"}},"id":"' || b || '","name":"store"}]' ELSE '' END || '}' AS json,
                CASE WHEN calls THEN 2 ELSE 0 END AS n_calls, CASE WHEN calls THEN 1 + CAST(n % 5 <> 0 AS INT) ELSE 0 END AS n_linked, CASE WHEN calls THEN 1 + CAST(n <= 1000 AS INT) ELSE 0 END AS n_valid,
                CASE WHEN calls THEN concat_ws('; ', CASE WHEN n > 1000 THEN a || ': $.chars: above maximum' END, CASE WHEN n % 5 = 0 THEN a || ': no result' END) ELSE '' END AS problems FROM m
            UNION ALL SELECT conv_id, turn, 'tool', 1, 1, 'stored', '{"content":"stored","role":"tool","tool_call_id":"' || b || '"}', 0, 0, 0, '' FROM m WHERE calls
            UNION ALL SELECT conv_id, turn, 'tool', 1, 0, CAST(n AS VARCHAR), '{"content":"' || n || '","role":"tool","tool_call_id":"' || a || '"}', 0, 0, 0, '' FROM m WHERE calls AND n % 5 <> 0)
        SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, phase, depth, role, text) - 1 AS position, json,
            CAST(n_calls AS BIGINT) AS n_calls, CAST(n_linked AS BIGINT) AS n_linked, CAST(n_valid AS BIGINT) AS n_valid, problems FROM r""",
}
