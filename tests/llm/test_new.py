"""Runs, centroids and best-fit packing against brute force, and what they do with odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from progdiv.llm import bestfit, centroids, runs

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, first=1):
    return spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in enumerate(texts, first)], SCHEMA)


def brute_runs(words):
    """By definition: for each period the maximal stretches, each with its smallest period."""
    found = {}
    for p in range(1, len(words) // 4 + 1):
        i = 0
        while i + p < len(words):
            if words[i] != words[i + p]:
                i += 1
                continue
            start = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i - start + p >= max(6, 4 * p):
                found.setdefault((start, i + p), p)
    return sorted((s, e, p) for (s, e), p in found.items())


def periodic(r, alphabet, n):
    words = []
    while len(words) < n:
        unit = [r.choice(alphabet) for _ in range(r.randint(1, 7))]
        words += (unit * r.randint(1, 9))[: r.randint(1, 30)]
    return words


@pytest.mark.parametrize("block", [1 << 17, 64])
def test_runs_equal_brute_force(monkeypatch, block):
    monkeypatch.setattr(runs, "BLOCK", block)
    r = random.Random(block)
    texts = [periodic(r, "abc"[: r.randint(1, 3)], r.randint(0, 400)) for _ in range(60)] + [["a"] * n for n in (0, 5, 6, 7, 300)] + [(["a"] * 3 + ["b"]) * 40 + ["c"], list("ab") * 200]
    got = runs.runs_of_texts([np.array([ord(w) for w in t], np.int64) for t in texts])
    for words, (s, e, p) in zip(texts, got, strict=True):
        assert list(zip(s.tolist(), e.tolist(), p.tolist(), strict=True)) == brute_runs(words)


def test_extensions_equal_brute_force():
    r = np.random.default_rng(1)
    for n in (2, 3, 17, 64, 100):
        words = r.integers(0, 2, n)
        i, j = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(n)))
        i, j = i[i != j], j[i != j]
        want = [next((k for k in range(n) if a + k >= n or b + k >= n or words[a + k] != words[b + k]), n) for a, b in zip(i, j, strict=True)]
        assert runs.Extensions(words)(i, j).tolist() == want


def test_op11_rows(spark):
    r = random.Random(5)
    # Words that only look alike, spaces of other kinds, and a word of hostile bytes for polynomial hashes.
    texts = [None, "", " \t\n", "a " * 10, "x y x y x y x y", "x y x y x y x y x", "é é é é é é", "A a A a A a A a A a", "a b c " * 4 + "tail", "the end"]
    texts += [" ".join(periodic(r, ["a", "b", "cc"], 300)) for _ in range(20)] + ["w " * 5000 + "v " * 5000]
    docs = documents(spark, texts)
    docs = docs.union(docs.where("doc_id = 4")).union(spark.createDataFrame([(None, "a " * 10, None, None, None)], SCHEMA))
    docs = docs.withColumns({"n_runs": F.lit("x"), "start": F.lit(1), "runs": F.lit(0)})
    got = runs.collapse_runs(docs, edit=True, with_text=True).collect()
    assert len(got) == len(texts) + 2
    for row in got:
        words = (texts[row.doc_id - 1] if row.doc_id else "a " * 10) or ""
        words = words.encode().split()
        h, n = zlib.crc32(str(row.doc_id).encode()), len(words)
        if row.doc_id and h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        want = brute_runs(words) if n < 2000 else [(0, 5000, 1), (5000, 10000, 1)]
        gone = {i for s, e, p in want for i in range(s + p, e)}
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        assert [(x["start"], x["start"] + x["length"], x["period"]) for x in row.runs] == want
        assert (row.n_runs, row.collapsed) == (len(want), kept.decode())
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{e - s},{p}\n" for s, e, p in want).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(kept).hexdigest()
        best = min(((s - e, s, p) for s, e, p in want), default=None)
        have = (row.start, row.length, row.period, row.exponent_milli)
        assert have == ((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4)
    assert runs.collapse_runs(docs.limit(0)).collect() == []


def brute_clusters(rows, k=16, rounds=3):
    kept = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    c = [v for _, v in first]
    for step in range(rounds + 1):
        near = [min((sum((x - y) ** 2 for x, y in zip(v, m, strict=True)), j) for j, m in enumerate(c)) for _, v in kept]
        if step < rounds:
            for j in range(len(c)):
                own = [v for (_, v), (_, n) in zip(kept, near, strict=True) if n == j]
                if own:
                    c[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    inertia = {j: sum(d for d, n in near if n == j) for _, j in near}
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), sha[n]) for (i, _), (d, n) in zip(kept, near, strict=True)), key=repr)


VECTORS = "vec_id long, embedding array<double>, label int"


def test_clusters_equal_brute_force(spark):
    r = np.random.default_rng(3)
    centres = r.integers(-3, 4, (9, 64)) / 8
    rows = [(i, (centres[i % 9] + r.integers(-1, 2, 64) / 64).tolist()) for i in range(400)]
    rows += [(i, rows[0][1]) for i in range(400, 600)] + [rows[5], (7, rows[1][1]), (None, rows[2][1]), (None, rows[2][1])]
    odd = [(1000, None), (1001, [0.5] * 63), (1002, [None] + [0.5] * 63), (1003, [float("nan")] + [0.5] * 63), (1004, [float("inf")] * 64), (1005, []), (1006, [0.0] * 64), (1007, [-3e4] * 64)]
    vectors = spark.createDataFrame([(i, v, None) for i, v in rows + odd], VECTORS).withColumns({"cluster": F.lit("x"), "v": F.lit(0), "n": F.lit(1)})
    got = sorted((tuple(x) for x in centroids.cluster_vectors(vectors).collect()), key=repr)
    assert got == brute_clusters(rows + odd)


def test_clusters_few_and_none(spark):
    rows = [(i, [float(i)] + [0.0] * 63) for i in range(5)]
    vectors = spark.createDataFrame([(i, v, None) for i, v in rows], VECTORS)
    assert sorted((tuple(x) for x in centroids.cluster_vectors(vectors).collect()), key=repr) == brute_clusters(rows)
    same = spark.createDataFrame([(i, [0.25] * 64, None) for i in range(40)], VECTORS)
    assert {(x.cluster, x.distance) for x in centroids.cluster_vectors(same).collect()} == {(0, 0)}
    assert centroids.cluster_vectors(vectors.limit(0)).collect() == []
    far = spark.createDataFrame([(1, [1e300] * 64, None), (2, [2e6] * 64, None)], VECTORS)
    assert [x.vec_id for x in centroids.cluster_vectors(far).collect()] == [2]


def test_scan_finds_the_nearest():
    """From any start, with ties at exactly twice the distance."""
    r = np.random.default_rng(4)
    for _ in range(50):
        c = r.integers(-2, 3, (7, 2))
        x = r.integers(-2, 3, (60, 2))
        d = ((x[:, None] - c) ** 2).sum(axis=2)
        cluster, distance = centroids.nearest(x, c, r.integers(0, 7, 60))
        assert cluster.tolist() == d.argmin(axis=1).tolist() and distance.tolist() == d.min(axis=1).tolist()
    big = np.array([[centroids.LARGEST] * 64, [-centroids.LARGEST - 1] * 64])
    cluster, distance = centroids.nearest(big, big, np.array([1, 1]))
    assert cluster.tolist() == [0, 1] and distance.tolist() == [0, 0]


def tokens(texts, end=1):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bestfit.default_tokenizer())
    return [[*t.encode(x or "", add_special_tokens=False).ids, end] for x in texts]


def test_encoder_equals_the_tokenizer():
    r = random.Random(1)
    alphabet = "ab'sS tTreveMll1²½ªé\x85\xa0  ​日本語ä́ \n\t\x1c\x00!?-_😀٣ͅ ǅ"
    texts = ["", "<|endoftext|>x", "  ", "\n\n a", "it's 'll", "a" * 3000] + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 30))) for _ in range(2000)]
    encode = bestfit.ByteEncoder(bestfit.default_tokenizer(), most=50)
    for text, ids in zip(texts, tokens(texts), strict=True):
        assert np.frombuffer(encode(text), encode.code).tolist() == ids[:-1], text


def test_best_fit_takes_the_tightest():
    r = random.Random(2)
    for _ in range(30):
        lengths = [r.randint(1, 64) for _ in range(r.randint(0, 60))]
        rooms, windows = [], []
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            fits = [w for w in range(len(rooms)) if rooms[w] >= lengths[i]]
            if not fits:
                rooms.append(64), windows.append([])
                fits = [len(rooms) - 1]
            w = min(fits, key=lambda w: rooms[w])
            rooms[w] -= lengths[i]
            windows[w].append(i)
        got = bestfit.best_fit(lengths, 64)
        assert sorted(sum(lengths[i] for i in w) for w in got) == sorted(64 - x for x in rooms)
        assert sorted(i for w in got for i in w) == list(range(len(lengths)))
        closed = bestfit.close(got, lengths, 64)
        parts = sorted(p for w in closed for p in w)
        assert all(sum(b - a for _, a, b in w) in (1, 2, 4, 8, 16, 32, 64) for w in closed)
        for i, n in enumerate(lengths):
            own = [(a, b) for j, a, b in parts if j == i]
            assert own[0][0] == 0 and own[-1][1] == n and all(x[1] == y[0] for x, y in zip(own, own[1:], strict=False))


@pytest.mark.parametrize("group", [2048, 7])
def test_packing_round_trip(spark, group):
    r = random.Random(3)
    texts = [None, "", " ", "<|endoftext|>", "word " * 9000] + [" ".join(r.choice(["alpha", "é", "x1", "\n"]) for _ in range(r.randint(0, 400))) for _ in range(60)]
    docs = documents(spark, texts).withColumns({"place": F.lit(1), "ids": F.lit("x"), "part": F.lit(0), "length": F.lit(2)})
    ids = tokens(texts)
    rows = bestfit.pack(docs, with_ids=True, group=group).collect()
    for k, want in enumerate(ids, 1):
        own = sorted((x for x in rows if x.doc_id == k), key=lambda x: x.start)
        assert [i for x in own for i in np.frombuffer(x.ids, "<u4")] == want
        assert [x.start for x in own] == [sum(y.length for y in own[:j]) for j in range(len(own))]
        assert all(x.doc_tokens == len(want) and x.ids_crc32 == zlib.crc32(x.ids) and x.length * 4 == len(x.ids) for x in own)
    sequences = {}
    for x in rows:
        sequences.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:j]) for j in range(len(parts))]
        assert sum(n for _, n in parts) in [1 << k for k in range(12)]
    plain = bestfit.pack(docs, group=group)
    assert sorted((x.doc_id, x.start, x.length, x.ids_crc32) for x in plain.collect()) == sorted((x.doc_id, x.start, x.length, x.ids_crc32) for x in rows)


def test_packing_odd_rows(spark):
    docs = documents(spark, ["one two"] * 3, 5)
    docs = docs.union(docs.limit(1)).union(spark.createDataFrame([(None, "one two", None, None, None)] * 2, SCHEMA))
    rows = bestfit.pack(docs).collect()
    assert sum(x.length for x in rows) == 6 * len(tokens(["one two"])[0])
    assert sum(x.length for x in rows if x.doc_id is None) == 2 * len(tokens(["one two"])[0])
    assert bestfit.pack(docs.limit(0)).collect() == []
    with pytest.raises(ValueError, match="power of two"):
        bestfit.pack(docs, capacity=100)


def test_packing_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = bestfit.pack(docs).collect()
    want = {r.doc_id: ids for r, ids in zip(docs.collect(), tokens([r.text for r in docs.collect()]), strict=True)}
    got = {}
    for x in rows:
        part = want[x.doc_id][x.start : x.start + x.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == x.ids_crc32 and x.doc_tokens == len(want[x.doc_id])
        got[x.doc_id] = got.get(x.doc_id, 0) + x.length
    assert got == {k: len(v) for k, v in want.items()}
    total = sum(got.values())
    assert len({x.sequence_id for x in rows}) <= -(-total // 2048) + 11
