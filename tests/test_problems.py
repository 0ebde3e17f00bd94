"""Metrics of whole problems on Arrow batches against brute force."""

import math
import random
from collections import Counter
from itertools import combinations

import pyarrow as pa
import pytest

from progdiv.operators import problems


def _counts(tokens, n):
    return Counter(tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1))


def _bleu_distance(a, b):
    logs, misses = [], 0
    for n in range(1, 5):
        if len(a) < n:
            break
        hit = sum((_counts(a, n) & _counts(b, n)).values())
        misses += hit == 0
        logs.append(math.log(100 * hit / (len(a) - n + 1) if hit else 100 / (2**misses * (len(a) - n + 1))))
    if not set(a) & set(b):
        return 100.0
    return 100 - min(1.0, math.exp(1 - len(b) / len(a))) * math.exp(sum(logs) / len(logs))


def _mean(values):
    values = [v for v in values if v is not None]
    return sum(values) / len(values) if values else None


def _expected(rows, types, orders, gram):
    out = []
    held = [[r for r in rows if r["mask"] >> i & 1] for i in range(types)]
    texts = [[(r["generation_id"], r["tokens"] or []) for r in h] for h in held]
    for n in orders:
        for t in texts:
            all_ = sum((_counts(w, n) for _, w in t), Counter())
            out.append(len(all_) / sum(all_.values()) if sum(all_.values()) > 1 else None)
    pairs = [[(a, b) for x, y in combinations(t, 2) for a, b in ((x, y),) if a[0] != b[0]] for t in texts]
    sets = lambda w: set(_counts(w, gram))
    out += [_mean(1 - len(sets(a[1]) & sets(b[1])) / len(sets(a[1]) | sets(b[1])) if sets(a[1]) and sets(b[1]) else None for a, b in p) for p in pairs]
    out += [_mean(_bleu_distance(a[1], b[1]) for a, b in p) for p in pairs]
    for h in held:
        v = [r["vector"] for r in h if r["vector"] is not None and None not in r["vector"]]
        norm = [math.sqrt(sum(x * x for x in u)) for u in v]
        out.append(None if 0 in norm else _mean(1 - sum(x * y for x, y in zip(v[i], v[j], strict=False)) / norm[i] / norm[j] for i, j in combinations(range(len(v)), 2)))
    return out


@pytest.mark.parametrize("rows, looked_up, batch", [(1, 1, 3), (5, 7, 4), (40, 100, 1), (1 << 15, 1 << 21, 1000)])
def test_problems_over_batches_are_as_by_hand(monkeypatch, rows, looked_up, batch):
    monkeypatch.setattr(problems, "ROWS", rows)
    monkeypatch.setattr(problems, "LOOKED_UP", looked_up)
    r = random.Random(7)
    given = [{"problem_id": None, "generation_id": None, "mask": 0, "tokens": None, "vector": None}] * 2
    for p in range(25):
        for g in sorted(r.randrange(60) for _ in range(r.choice((1, 2, 3, 9, 30)))):  # some are there twice and make no pair
            mask = r.choice((0, 1, 3, 5, 7))
            tokens = [r.choice(["a", "b", "c", None, "b"]) for _ in range(r.choice((0, 1, 2, 5, 12)))]
            vector = r.choice([None, [1.0, None], [0.0, 0.0] if p % 5 == 0 else [1.0, 0.0], *([r.uniform(-1, 1) for _ in range(3)] for _ in range(4))])
            given.append({"problem_id": p, "generation_id": g, "mask": mask, "tokens": tokens if mask else None, "vector": vector if mask else None})
    schema = pa.schema([("problem_id", pa.int64()), ("generation_id", pa.int64()), ("mask", pa.int32()), ("tokens", pa.list_(pa.string())), ("vector", pa.list_(pa.float64()))])
    batches = [b for i in range(0, len(given), batch) for b in pa.Table.from_pylist(given[i : i + batch], schema).to_batches()]
    got = {x["problem_id"]: x["found"] for b in problems.measured(iter(batches), range(1, 7), 2, 4, 3) for x in b.to_pylist()}
    assert set(got) == {None, *range(25)}
    for p, found in got.items():
        want = _expected([x for x in given if x["problem_id"] == p], 3, range(1, 7), 2)
        assert [v is None for v in found] == [v is None for v in want]
        assert [v for v in found if v is not None] == pytest.approx([v for v in want if v is not None])


def test_report_makes_no_rows_of_pairs_or_components(spark, sf):
    """Pairs and components of vectors are counted in blocks of problems; only records of types and metrics are made into rows."""
    from progdiv.plans.catalogue import QUERIES

    plan = QUERIES["metrics_by_recordtype"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "id_a" not in plan and "dim" not in plan
    assert plan.count("Generate explode") == 2
