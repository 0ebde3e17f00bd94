"""Overlap joins against brute force, with elements that nearly every member holds."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from progdiv.operators import lexical, overlap, syntactic


def frame(spark, groups):
    rows = [(k, m, g, c) for k, members in groups.items() for m, sets in members.items() for g, c in (sets.items() or [])]
    return spark.createDataFrame(rows, "k int, m long, g long, c long")


def made(seed, n=40, hot=0.9):
    r = random.Random(seed)
    groups = {}
    for k in range(3):
        groups[k] = {}
        for m in range(n):
            some = {g: r.randint(1, 3) for g in r.sample(range(30), r.randint(1, 6))}
            if r.random() < hot:
                some[100] = 1
            if k > 0:
                some |= {200: 2, 201: 1}  # in every member
            groups[k][m * 7 % 1000] = some
    groups[2][5000] = dict(groups[2][0])  # equal sets
    groups[3] = {1: {5: 1}}
    groups[4] = {1: {5: 1}, 2: {6: 1}}
    return groups


@pytest.mark.parametrize("hot", [1024, 4])
def test_shared_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(overlap, "HOT", hot)
    groups = made(1)
    got = {(r.k, r.a, r.b): r.shared for r in overlap.shared(frame(spark, groups), ["k"], "m").collect()}
    want = {(k, *sorted((a, b))): len(x.keys() & y.keys()) for k, members in groups.items() for (a, x), (b, y) in combinations(members.items(), 2) if x.keys() & y.keys()}
    assert got == want


def test_mean_distance_equals_brute_force(spark):
    groups = made(2, hot=1.0)
    got = {r.k: r.jaccard for r in overlap.mean_pair_distance(frame(spark, groups), ["k"], "m").collect()}
    for k, members in groups.items():
        d = [1 - len(x.keys() & y.keys()) / len(x.keys() | y.keys()) for x, y in combinations(members.values(), 2)]
        assert got[k] == (pytest.approx(sum(d) / len(d)) if d else None)


def test_an_element_in_every_member_makes_no_pairs(spark):
    """20,000 members share one element and nothing else: 2 * 10^8 pairs that are never made."""
    sets = spark.range(20000).select(F.lit(0).alias("k"), F.col("id").alias("m"), F.explode(F.array(F.lit(-1).cast("long"), F.col("id"))).alias("g"), F.lit(1).cast("long").alias("c"))
    assert overlap.mean_pair_distance(sets, ["k"], "m").first().jaccard == pytest.approx(2 / 3)


def test_a_frequent_element_meets_in_many_tasks(spark, monkeypatch):
    """Most members hold it; their pairs are dealt over chunks, each met once."""
    monkeypatch.setattr(overlap, "HOT", 100)
    sets = spark.range(1500).select(F.lit(0).alias("k"), F.col("id").alias("m"), F.when(F.col("id") % 10 > 0, F.lit(-1).cast("long")).otherwise(F.col("id")).alias("g"), F.lit(1).cast("long").alias("c"))
    row = overlap.shared(sets, ["k"], "m").agg(F.count("*").alias("n"), F.min("shared").alias("lo"), F.max("shared").alias("hi")).first()
    assert (row.n, row.lo, row.hi) == (1350 * 1349 // 2, 1, 1)


@pytest.mark.parametrize("ranked", [1 << 16, 8])
def test_positions(spark, monkeypatch, ranked):
    monkeypatch.setattr(overlap, "RANKED", ranked)
    r = random.Random(4)
    rows = [(k, m) for k in range(3) for m in r.sample(range(-1000, 1000), 50 * k + 1)]
    got = overlap.positions(spark.createDataFrame(rows, "k int, m long"), ["k"], "m").collect()
    for k in range(3):
        own = sorted(m for x, m in rows if x == k)
        assert [(x.m, x.n) for x in sorted((x for x in got if x.k == k), key=lambda x: x.pos)] == [(m, len(own)) for m in own]
        assert sorted(x.pos for x in got if x.k == k) == list(range(len(own)))
    names = overlap.positions(spark.createDataFrame([(0, "b"), (0, "a")], "k int, m string"), ["k"], "m").collect()
    assert {x.m: x.pos for x in names} == {"a": 0, "b": 1}


def brute_draws(members, draws):
    order = sorted(members)
    out = []
    for i in range(len(draws) // 2):
        x, y = (members[order[int(draws[2 * i + s][2] * len(order))]] for s in range(2))
        out.append((sum(x.values()) + sum(y.values()), len(x.keys() | y.keys()), len(x.keys() & y.keys())))
    return out


def test_drawn_pairs_equal_brute_force(spark):
    groups = made(3)
    groups[5] = {1: {}, 2: {7: 2}, 3: {}}
    sets = frame(spark, groups).union(spark.createDataFrame([(5, 1, None, 0), (5, 3, None, 0)], "k int, m long, g long, c long"))
    draws = lexical.uniforms(60, 2)
    got = {(r.k, r.it): (r.total, r.distinct, r.common) for r in overlap.drawn_pairs(sets, ["k"], "m", draws).collect()}
    for k, members in groups.items():
        if len(members) < 2:
            assert not any(x == k for x, _ in got)
            continue
        assert [got[k, i] for i in range(60)] == brute_draws(members, draws)
    shares = {r.k: r.sampled_jaccard for r in overlap.sampled_pairs(sets, ["k"], "m", draws).collect()}
    for k, members in groups.items():
        if len(members) > 1:
            d = [1 - c / u for _, u, c in brute_draws(members, draws) if u]
            assert shares[k] == pytest.approx(sum(d) / len(d))


def test_draws_make_no_pair_table(spark):
    """Elements join drawn members, never one another."""
    sets = frame(spark, made(3))
    plan = overlap.drawn_pairs(sets, ["k"], "m", lexical.uniforms(10, 2))._jdf.queryExecution().optimizedPlan().toString()
    assert "a#" not in plan and "shared" not in plan


def test_sampled_subtrees(spark):
    rows = [("p", 3, 1, 10, 1), ("p", 3, 1, 11, 2), ("p", 3, 2, 10, 1), ("p", 4, 1, None, 0), ("p", 4, 2, None, 0)]
    trees = spark.createDataFrame([(0, *r) for r in rows], "problem int, variant string, height int, member long, g long, c long")
    got = {r.height: r.sampled_jaccard for r in syntactic.sampled_jaccard_subtrees(trees, ["problem"], "member", 50).collect()}
    draws = lexical.uniforms(50, 2)
    d = [0.5 if (draws[2 * i][2] < 0.5) != (draws[2 * i + 1][2] < 0.5) else 0.0 for i in range(50)]
    assert got == {3: pytest.approx(sum(d) / 50), 4: None}


def test_members_are_dealt_and_not_sorted_for_small_tables(spark):
    """Ranks are sorted within as many parts as a shuffle has, and groups, cuts and picks are hashed."""
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"]
    old = [spark.conf.get(n) for n in names]
    try:
        for n, v in zip(names, ["-1", "false"], strict=True):
            spark.conf.set(n, v)
        sets = spark.createDataFrame([(0, m, m % 3, 1) for m in range(20)], "k int, m long, g long, c long")
        plan = overlap.drawn_pairs(sets, ["k"], "m", lexical.uniforms(10, 2))._jdf.queryExecution().executedPlan().toString()
    finally:
        for n, v in zip(names, old, strict=True):
            spark.conf.set(n, v)
    assert "SortMergeJoin" not in plan and "REPARTITION_BY_NUM" in plan
