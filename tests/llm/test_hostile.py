"""Inputs made to break hashes, to be slow, or to lack keys."""

import hashlib
import math
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from progdiv.llm import chat, common, lm, minhash, repeats, secrets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, first=1):
    return spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts, first)], SCHEMA)


def thue_morse(n, one="a", other="b"):
    """A word whose polynomial modulo a power of two is that of its complement, for any odd base."""
    return "".join((one, other)[i.bit_count() % 2] for i in range(n))


SIZES = (64, 256, 512, 1024, 2048, 4096)


def test_hashes_tell_such_words_apart():
    for n in SIZES:
        data = np.frombuffer((thue_morse(n) + " " + thue_morse(n, "b", "a")).encode(), np.uint8)
        at, ends = np.array([0, n + 1]), np.array([n, 2 * n + 1])
        assert len(set(common.word_hashes(data, at, ends).tolist())) == 2
        for base in (repeats._BASE, repeats._OTHER_BASE):
            assert len(set(common.Rolling(data, base)(at, ends).tolist())) == 2


def test_substring_hashes_depend_on_the_bytes_alone():
    data = np.frombuffer(b"x" * 700 + b"AbC" + b"x" * 700 + b"aBc" + b"\0\0", np.uint8)
    low = common.word_hashes(data, np.array([700, 1403, 0, 703]), np.array([703, 1406, 700, 1403]))
    assert low[0] == low[1] and low[2] == low[3] and low[0] != low[2]
    exact = common.substring_hashes(data, np.array([700, 1403, 1406, 1406]), np.array([703, 1406, 1407, 1408]))
    assert len(set(exact.tolist())) == 4
    rolling = common.Rolling(data, repeats._BASE)
    want = sum((int(data[5 + k]) + 1) * pow(repeats._BASE, k, common.PRIME) for k in range(900)) % common.PRIME
    assert rolling(np.array([5]), np.array([905]))[0] == common.mix(np.array([want], np.uint64))[0]


def test_op4_such_words(spark):
    a, b = thue_morse(1024), thue_morse(1024, "b", "a")
    texts = [f"one two three {a} five six", f"one two three {b} five six", f"{a} x y z {b} x y z {a} x y z"]
    got = {r.doc_id: r for r in minhash.near_duplicates(documents(spark, texts), k=4, percent=80).collect()}
    assert [got[i].component_id for i in (1, 2, 3)] == [1, 2, 3]
    sets = [{tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)} for t in texts]
    assert [got[i].n_shingles for i in (1, 2, 3)] == [len(s) for s in sets]


def test_op6_such_words(spark):
    import zlib

    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10]
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = [(ids[0], thue_morse(2048)), (held, thue_morse(2048, "b", "a"))]
    got = {r.doc_id: r for r in lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[held].n_known == 1 and got[ids[0]].n_known == 2


def test_op2_such_windows(spark):
    a, b = thue_morse(2048), thue_morse(2048, "b", "a")
    texts = [a, "-" + b, "x" * 150 + a[:250], "é" + a[:199], "é" + a[300:498] + "!"]
    rows = {r.doc_id: r for r in repeats.remove_repeats(documents(spark, texts)).collect()}
    raw = [t.encode() for t in texts]
    seen = {}
    for t in raw:
        for i in range(len(t) - 199):
            seen[t[i : i + 200]] = seen.get(t[i : i + 200], 0) + 1
    for k, t in enumerate(raw, 1):
        gone = {j for i in range(len(t) - 199) if seen[t[i : i + 200]] > 1 for j in range(i, i + 200)}
        assert rows[k].kept_sha256 == hashlib.sha256(bytes(c for j, c in enumerate(t) if j not in gone)).hexdigest()


def hashes(n):
    return "\n".join(hashlib.sha1(str(i).encode()).hexdigest() for i in range(n))


def test_op3_many_matches(spark):
    texts = [hashes(3000), "é " * 500 + hashes(700) + ' password="' + "abc12345" * 3 + '"', "0" * 30, ""]
    docs = documents(spark, texts)
    rows = {r.doc_id: r for r in secrets.scan_secrets(docs, keep=("doc_id", "text")).withColumn("rest", secrets.redact(F.col("text"), F.array_sort(F.concat("base", "added")))).collect()}
    for k, t in enumerate(texts, 1):
        assert [(s.start, s.end) for s in rows[k].base if s.kind == 2] == [m.span() for m in re.finditer("[0-9a-f]{24,}", t)]
    assert rows[1].rest == "\n".join(["[secret]"] * 3000)
    assert rows[2].rest == "é " * 500 + "\n".join(["[secret]"] * 700) + ' [secret]"'
    assert (rows[3].rest, rows[4].rest) == ("[secret]", "")


def test_op3_added_spans_leave_base_alone(spark):
    """Tokens that overlap a base span on either side are not added, all others are."""
    key = hashlib.sha256(b"k").digest().hex().upper()
    texts = [f"{key} {hashes(1)} {key}", f"token={key}", f"{key}{hashes(1)} {key}"]
    texts += [f"words {i} only" for i in range(20)]
    rows = {r.doc_id: r for r in secrets.scan_secrets(documents(spark, texts)).collect()}
    assert [(s.start, s.end) for s in rows[1].added] == [(0, 64), (106, 170)]
    assert rows[2].added == [] and [s.start for s in rows[3].added] == [105]


def test_redact_overlaps(spark):
    """One mark for spans that overlap, also inside an earlier, longer one; two for those that touch."""
    spans = [(0, 2), (1, 9), (3, 4), (8, 10), (10, 12), (15, 16)]
    row = spark.createDataFrame([("0123456789éé2345678", [{"start": a, "kind": 0, "end": b} for a, b in spans])], "t string, s array<struct<start:int,kind:int,end:int>>")
    assert row.select(secrets.redact(F.col("t"), F.col("s"))).first()[0] == "[secret][secret]234[secret]678"
    assert row.select(secrets.redact(F.col("t"), F.array().cast("array<struct<start:int,kind:int,end:int>>"))).first()[0] == "0123456789éé2345678"


def test_op3_time_follows_the_text(spark):
    took = []
    for n in (2000, 8000):
        began = time.time()
        secrets.scan_secrets(documents(spark, [hashes(n)])).collect()
        took.append(time.time() - began)
    assert took[1] < 8 * took[0] + 5  # quadratic time would be sixteen times as much


def test_op10_rows_without_conversation(spark):
    call = '{"content":"c","tool_calls":[{"id":"a","name":"f","arguments":{}},{"id":"b","name":"f","arguments":{"x":{"$result":"a"}}}]}'
    result = lambda k: f'{{"tool_call_id":"{k}","content":"done"}}'
    rows = [(c, 1, "assistant", call) for c in (None, 0, 1)] + [(c, t, "tool", result(k)) for c in (None, 1) for t, k in ((2, "b"), (3, "a"))]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.position): r for r in chat.format_chats(messages, {"f": {}}).collect()}
    for conv in (None, 1):
        assert (got[conv, 0].n_calls, got[conv, 0].n_linked, got[conv, 0].problems) == (2, 2, [])
        assert '"tool_call_id":"a"' in got[conv, 1].json and '"tool_call_id":"b"' in got[conv, 2].json
        assert got[conv, 1].problems == got[conv, 2].problems == []
    assert got[0, 0].n_linked == 0 and len(got[0, 0].problems) == 2


@pytest.mark.parametrize(
    ("schema", "good", "bad"),
    [
        ({"const": 4}, [4, 4.0], [3, "4", None]),
        ({"enum": [True, "x", [1]]}, [True, "x", [1.0]], [1, False, [True]]),
        ({"type": "string", "pattern": "^x+$"}, ["xx"], ["ab", ""]),
        ({"type": "string", "minLength": 2, "maxLength": 3}, ["ab", "abc"], ["a", "abcd"]),
        ({"minimum": 1, "exclusiveMaximum": 3}, [1, 2.9, "z"], [0, 3, 3.0]),
        ({"exclusiveMinimum": 1}, [1.1], [1, 0]),
        ({"multipleOf": 0.1}, [0.3, 7, "a"], [0.35]),
        ({"type": "array", "uniqueItems": True, "minItems": 1, "items": {"type": "integer"}}, [[1, 2]], [[1, 1.0], [], [1.5]]),
        ({"anyOf": [{"type": "null"}, {"minimum": 5}]}, [None, 5], [4]),
        ({"oneOf": [{"type": "integer"}, {"minimum": 5}]}, [3, 5.5], [7, 1.5]),
        ({"allOf": [{"minimum": 1}, {"maximum": 2}], "not": {"const": 2}}, [1], [0, 2, 3]),
        ({"$ref": "#/$defs/n", "$defs": {"n": {"type": "object", "properties": {"next": {"$ref": "#/$defs/n"}, "v": {"type": "integer"}}, "required": ["v"]}}}, [{"v": 1, "next": {"v": 2}}], [{"v": 1, "next": {}}, 3]),
        ({"type": "object", "minProperties": 1, "maxProperties": 2, "additionalProperties": {"type": "integer"}}, [{"a": 1}], [{}, {"a": "x"}, {"a": 1, "b": 1, "c": 1}]),
        (False, [], [1, None]),
        (True, [1, None], []),
    ],
)
def test_schema_keywords(schema, good, bad):
    for value in good:
        assert chat.violations(value, schema) == []
    for value in bad:
        assert chat.violations(value, schema)


def test_schema_keywords_that_are_not_checked():
    assert chat.violations(1, {"if": {}, "contains": {}, "title": "t"}) == ["$: unsupported keyword contains", "$: unsupported keyword if"]
    assert chat.violations(1, {"$ref": "other.json"}) == ["$: unsupported $ref"]
    assert chat.violations(1, {"$ref": "#"}) == ["$: unsupported $ref"]
    assert chat.violations("a", {"pattern": "("}) == ["$: unsupported pattern"]
    assert chat.violations(math.inf, {"multipleOf": 2}) == ["$: not a multiple"]
