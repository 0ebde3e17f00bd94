"""N-grams on Arrow batches against counting."""

import random
from collections import Counter

import pyarrow as pa
import pytest

from progdiv.operators import places


def _grams(words, n):
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]


@pytest.mark.parametrize("words, bits, batch", [(1, 1, 3), (3, 2, 4), (64, 3, 1), (1 << 20, 10, 100)])
def test_grams_are_counted_as_by_hand(monkeypatch, words, bits, batch):
    monkeypatch.setattr(places, "WORDS", words)
    monkeypatch.setattr(places, "BITS", bits)
    r = random.Random(3)
    texts = [(r.choice(("x", "y", None)), r.randrange(2), None if i == 5 else [r.choice(["a", "b", "ab", "", None]) for _ in range(r.choice((0, 1, 2, 3, 9, 40)))]) for i in range(60)]
    given = pa.table({"k": pa.array([t[0] for t in texts]), "j": pa.array([t[1] for t in texts]), "t": pa.array([t[2] for t in texts], pa.list_(pa.string()))})
    batches = [b for i in range(0, 60, batch) for b in given.slice(i, batch).to_batches()]
    kinds = pa.schema([("k", pa.string()), ("j", pa.int64()), ("n", pa.int32()), ("n_distinct", pa.int64()), ("n_total", pa.int64())])
    for orders in (range(1, 7), range(2, 4)):
        want = {}
        for k, j in {t[:2] for t in texts}:
            for n in orders:
                if found := Counter(g for t in texts if t[:2] == (k, j) for g in _grams(t[2] or [], n)):
                    want[k, j, n] = len(found), sum(found.values())
        made = pa.Table.from_batches(places.packed(iter(batches), 2, orders)).sort_by([(c, "ascending") for c in ("k", "j", "n", "_w1")])
        distinct, total = Counter(), Counter()
        for b in places.counted(iter(made.to_batches(max_chunksize=7)), ["k", "j"], kinds):
            for x in b.to_pylist():
                distinct[x["k"], x["j"], x["n"]] += x["n_distinct"]
                total[x["k"], x["j"], x["n"]] += x["n_total"]
        assert {g: (distinct[g], total[g]) for g in total} == want
        rows = pa.Table.from_batches(places.aside(iter(batches), 2, orders)).to_pylist()
        for (k, j, n), (d, t) in want.items():
            own = [x for x in rows if (x["k"], x["j"]) == (k, j)]
            assert len({x[f"_h{n}"] for x in own} - {None}) == d and sum(x[f"_c{n}"] or 0 for x in own) == t


def test_no_row_an_ngram_and_no_window(spark, sf):
    """Neither sketches nor exact counts make a row an n-gram or sort them in Spark."""
    from progdiv.plans.catalogue import QUERIES

    plan = QUERIES["distinct_n_sketched"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("MapInArrow") == 3 and plan.count("Generate explode") == 1
