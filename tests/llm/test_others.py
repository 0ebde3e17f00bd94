"""Embeddings, components, chats and the pipeline."""

import itertools
import json
import random

import numpy as np
import pytest

from progdiv.llm import chat, graph, vectors

SCHEMA = "vec_id bigint, embedding array<float>, label int, rep int, component string, n int, block int"


def make():
    r = np.random.default_rng(3)
    rows = []
    centre = r.normal(size=32)
    for i in range(120):
        v = r.normal(size=32) if i < 60 else centre + r.normal(size=32) * r.choice([0.1, 0.3, 0.4])
        rows.append([i, [float(x) for x in v.astype(np.float32)], i % 2])
    rows += [[200, rows[70][1], 0], [201, rows[70][1], 0], [202, rows[70][1], None], [203, None, 0], [204, [0.0] * 32, 0], [205, [float("nan")] * 32, 0], [206, [None] * 32, 0], [207, [1.0, 2.0], 0], [208, [2.0, 4.0], 0], [209, [], 0], [210, [float("inf"), 1.0], 0]]
    return [(*x, 1, "x", 2, 3) for x in rows]


@pytest.mark.parametrize("chunk", [4096, 10])
def test_vectors(spark, monkeypatch, chunk):
    monkeypatch.setattr(vectors, "CHUNK", chunk)
    rows = make()
    ok = [x for x in rows if x[1] and x[2] is not None and all(v is not None and np.isfinite(v) for v in x[1]) and any(x[1])]
    links = {x[0]: set() for x in rows}
    for a, b in itertools.combinations(ok, 2):
        if a[2] == b[2] and len(a[1]) == len(b[1]):
            u, v = np.array(a[1]), np.array(b[1])
            if u @ v / np.sqrt(u @ u) / np.sqrt(v @ v) >= 0.93:
                links[a[0]].add(b[0])
                links[b[0]].add(a[0])
    root = {i: i for i in links}
    for _ in rows:
        for i, others in links.items():
            root[i] = min([root[i], *(root[j] for j in others)])
    got = {r["vec_id"]: r for r in vectors.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {i: (r["n_links"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(links[i]), root[i], root[i] == i) for i in links}
    assert max(map(len, links.values())) > 5


def test_vectors_of_one_id(spark):
    """Rows that share a vec_id are vectors of their own; only wholly equal rows are one."""
    r = np.random.default_rng(5)
    a, b = ([float(x) for x in r.normal(size=16).astype(np.float32)] for _ in range(2))
    near = [float(np.float32(x * 1.01 + 0.001)) for x in b]
    rows = [(5, a, 0), (5, b, 1), (9, b, 1), (10, near, 1), (7, a, 0), (8, b, 2), (8, b, 2), (11, a, 3), (4, a, 3)]
    got = sorted(map(tuple, vectors.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect()))
    assert got == sorted([(5, 1, 5, True), (5, 2, 5, True), (9, 2, 5, False), (10, 2, 5, False), (7, 1, 5, False), (8, 0, 8, True), (8, 0, 8, True), (11, 1, 4, False), (4, 1, 4, True)])


def test_no_vectors(spark):
    assert vectors.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 40)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(40)] + [(300, 300)]
    root = {v: v for e in edges for v in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {x["id"]: x["component"] for x in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {v: c for v, c in root.items() if any(a != b and v in (a, b) for a, b in edges)}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


SCHEMAS = {"add": {"type": "object", "required": ["x", "y"], "properties": {"x": {"type": "integer"}, "y": {"type": "integer", "minimum": 0}}, "additionalProperties": False}}


def call(i, name="add", **arguments):
    return {"id": i, "name": name, "arguments": arguments}


def test_chat_links_and_orders(spark):
    rows = [
        (1, 0, "user", "é\n\"q\""),
        (1, 1, "assistant", json.dumps({"content": None, "tool_calls": [call("b", x={"$result": "a"}, y=1), call("a", x=1, y=2), call("c", x="no", y=-1), call("d", "sub")]})),
        (1, 2, "tool", json.dumps({"tool_call_id": "b", "content": "4"})),
        (1, 3, "tool", json.dumps({"tool_call_id": "a", "content": {"z": 1, "a": 2}})),
        (1, 4, "tool", json.dumps({"tool_call_id": "zz", "content": "orphan"})),
        (1, 5, "assistant", "{not json"),
        (2, 0, "assistant", json.dumps({"tool_calls": [call("p", x={"$result": "q"}, y=1), call("q", x={"$result": "p"}, y=1)]})),
        (3, None, None, None),
        (None, 1, "user", "x"),
        (3, 1, "user", "same"),
        (3, 1, "user", "same"),
    ]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), SCHEMAS).collect()
    assert len(out) == len(rows)
    one = {r["position"]: r for r in out if r["conv_id"] == 1}
    assert [one[k]["turn"] for k in range(6)] == [0, 1, 3, 2, 4, 5]
    assert one[0]["json"] == '{"content":"é\\n\\"q\\"","role":"user"}'
    made = json.loads(one[1]["json"])["tool_calls"]
    assert [c["id"] for c in made] == ["a", "c", "d", "b"] and (one[1]["n_calls"], one[1]["n_linked"], one[1]["n_valid"]) == (4, 2, 2)
    assert set(one[1]["problems"]) == {"c: $.x: not integer", "c: $.y: below minimum", "c: no result", "d: unknown tool", "d: no result"}
    assert json.loads(one[2]["json"]) == {"content": '{"a":2,"z":1}', "role": "tool", "tool_call_id": "a"}
    assert one[4]["problems"] == ["zz: no call"] and one[5]["json"] == '{"content":"{not json","role":"assistant"}'
    assert [p for r in out if r["conv_id"] == 2 for p in r["problems"] if "cycle" in p] == ["p: cycle", "q: cycle"]
    assert sorted(r["position"] for r in out if r["conv_id"] == 3) == [0, 1, 2]


def test_long_chains_of_calls(spark):
    n = 40
    made = [call(f"k{i}", x={"$result": f"k{i - 1}"} if i else 1, y=1) for i in range(n)]
    looped = [call("p", x={"$result": "q"}, y=1), call("q", x={"$result": "p"}, y=1), call("r", x={"$result": "q"}, y=1)]
    rows = [(1, 0, "assistant", json.dumps({"tool_calls": made[::-1]}))]
    rows += [(1, 1 + i, "tool", json.dumps({"tool_call_id": f"k{n - 1 - i}", "content": "1"})) for i in range(n)]
    rows += [(2, 0, "assistant", json.dumps({"tool_calls": [*made[:3], *looped]}))]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), SCHEMAS).collect()
    one = sorted((r for r in out if r["conv_id"] == 1), key=lambda r: r["position"])
    assert [c["id"] for c in json.loads(one[0]["json"])["tool_calls"]] == [f"k{i}" for i in range(n)]
    assert [json.loads(r["json"])["tool_call_id"] for r in one[1:]] == [f"k{i}" for i in range(n)]
    assert not any(r["problems"] for r in one)
    two = next(r for r in out if r["conv_id"] == 2)
    assert [p for p in two["problems"] if "cycle" in p] == ["p: cycle", "q: cycle", "r: cycle"]


def test_chat_query_takes_schemas(spark, tmp_path):
    from progdiv.llm.queries import op10_chat

    rows = [(1, 0, "assistant", json.dumps({"tool_calls": [call("a", x=1, y=2), call("b", x=1, y=-2)]})), (1, 1, "tool", json.dumps({"tool_call_id": "a", "content": "3"}))]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    for schemas, n_valid, problems in ((SCHEMAS, 1, "b: $.y: below minimum; b: no result"), ({}, 0, "a: unknown tool; b: unknown tool; b: no result")):
        r = op10_chat(spark, str(tmp_path), schemas).where("turn = 0").first()
        assert (r["n_calls"], r["n_linked"], r["n_valid"], r["problems"]) == (2, 1, n_valid, problems)


def test_chat_of_hostile_json(spark):
    deep = "[" * 200_000 + "]" * 200_000
    texts = ['{"tool_calls": ' + deep + "}", '{"tool_calls": [{"id": "a", "name": "add", "arguments": {"x": ' + deep + "}}]}", json.dumps({"tool_calls": [call("a", x=1, y=2)], "content": "\ud800"}), '{"tool_calls": [], "content": NaN}', '{"tool_calls": [], "content": 1e999}', "{", "{}", '{"tool_calls": 3}', '{"a": ' + "9" * 5000 + "}"]
    inside = ['"' + "\\ud800" + '"', "NaN", "1e999", deep, "{"]
    rows = [(1, i, "assistant", t) for i, t in enumerate(texts)] + [(2, i, "assistant", json.dumps({"tool_calls": [{"id": "a", "name": "add", "arguments": t}]})) for i, t in enumerate(inside)]
    rows += [(3, 0, "assistant", json.dumps({"tool_calls": [{"name": 3}, 7, {"id": "x", "name": "add", "arguments": [1]}], "content": [True]})), (3, 1, "tool", json.dumps({"tool_call_id": 5})), (3, 2, "tool", "x" * 5_000_000)]
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), SCHEMAS).collect()
    for r in out:
        found = json.loads(r["json"])
        if r["conv_id"] == 1:
            assert found == {"content": texts[r["turn"]], "role": "assistant"} and not r["problems"]
        if r["conv_id"] == 2:
            assert "a: arguments are not JSON" in r["problems"] and (r["n_calls"], r["n_valid"]) == (1, 0)
    assert {r["turn"]: r["n_calls"] for r in out if r["conv_id"] == 3} == {0: 3, 1: 0, 2: 0}


@pytest.mark.parametrize("small", [1 << 16, 1])
def test_chains_of_calls_by_task_and_by_rounds(spark, monkeypatch, small):
    monkeypatch.setattr(chat, "_SMALL", small)
    rows = [(c, f"k{i}", [f"k{i - 1}", f"k{i // 2}"] if i else []) for c in (1, 2) for i in range(4)] + [(2, "p", ["q"]), (2, "q", ["p", "k1"]), (2, "r", ["q"]), (3, "z", ["gone"]), (3, "s", ["s"])]
    calls = spark.createDataFrame(rows, "conv_id bigint, id string, needs array<string>")
    got = {(r["conv_id"], r["id"]): r["depth"] for r in chat._depths(calls).collect()}
    assert got == {(c, f"k{i}"): i for c in (1, 2) for i in range(4)} | {(3, "z"): 0}


def test_no_chats(spark):
    assert chat.format_chats(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string, message int, span int")).count() == 0


def test_violations():
    schema = {"type": ["object", "null"], "properties": {"a": {"type": "array", "items": {"enum": [1, 2]}, "maxItems": 2}}, "additionalProperties": {"type": "string"}}
    assert chat.violations(None, schema) == [] and chat.violations({"a": [1, 2], "k": "s"}, schema) == []
    assert chat.violations({"a": [1, 3, 2], "k": 4}, schema) == ["$.a[1]: not in enum", "$.a: above maxItems", "$.k: not string"]
    assert chat.violations(True, {"type": "integer"}) and not chat.violations(2.0, {"type": "integer"})


def test_pipeline_keeps_mixed_languages(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {}
    for r in docs.where("lang IS NOT NULL AND length(text) > 400").orderBy("doc_id").collect():
        texts.setdefault(r["lang"], r["text"].split())
    assert len(texts) >= 3
    mixed = " ".join(w for words in texts.values() for w in words[:60])
    extra = spark.createDataFrame([(9000, mixed, None, "s", len(mixed)), (9001, "1234", None, "s", 4)], docs.schema)
    kept = {r["doc_id"] for r in p.language(spark, docs.unionByName(extra), sf).where("doc_id >= 9000").collect()}
    assert kept == {9000}


def test_pipeline(spark, sf):
    """Stages against their operators' meaning, on the whole small table."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(9000, None, "en", "s", 0), (9001, "1234", "en", "s", 4), (9002, "token=abcdef1234 is the key of the house", "en", "s", 40)], docs.schema)
    docs = docs.unionByName(extra)
    n = docs.count()
    stages = dict(p.STAGES)
    assert [k for k, _ in p.STAGES] == ["language", "near_dedup", "secrets", "mix", "pack"]
    one = stages["language"](spark, docs, sf).cache()
    gone = {r["doc_id"] for r in docs.join(one, "doc_id", "left_anti").collect()}
    assert one.columns == docs.columns and {9000, 9001} <= gone and len(gone) <= 0.02 * n + 2
    two = stages["near_dedup"](spark, one, sf).cache()
    assert two.count() == two.select("text").distinct().count() <= one.select("text").distinct().count()
    three = {r["doc_id"]: r for r in stages["secrets"](spark, two, sf).collect()}
    assert set(three) == {r["doc_id"] for r in two.collect()}
    assert three[9002]["text"] == "[secret] is the key of the house" and three[9002]["n_chars"] == len(three[9002]["text"])
    four = stages["mix"](spark, two, sf)
    words = lambda df: sum(len(r["text"].split()) for r in df.collect())
    assert four.columns == docs.columns and words(four) == pytest.approx(1.5 * words(two), rel=0.1)
    assert stages["pack"](spark, two, sf).count() >= two.count()
