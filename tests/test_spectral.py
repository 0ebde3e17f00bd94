"""Spectral estimates from edges against dense matrices and known graphs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from progdiv.operators import estimators, spectral


def rows_of(k, w):
    return [(k, int(i), int(j), float(w[i, j])) for i, j in zip(*np.nonzero(w), strict=True)]


def graph(seed, n, groups, alone):
    """Groups of members that are alike, a few links between the first two of them, and members alike with nothing."""
    r = np.random.default_rng(seed)
    w = np.zeros((n, n))
    part = np.arange(n) % groups
    alike = (part[:, None] == part) & (r.random((n, n)) < 0.7)
    w[alike] = r.random(alike.sum())
    w[0, 1] = 0.01
    w[-alone:, :] = w[:, -alone:] = 0
    np.fill_diagonal(w, 1)
    return w  # the two directions differ


def dense(w, threshold=0.1):
    w = (w + w.T) / 2
    d = w.sum(axis=1)
    values, vectors = np.linalg.eigh(np.eye(len(w)) - w / np.sqrt(np.outer(d, d)))
    off = vectors[:, values < threshold]
    off = off - off.mean(axis=0)
    return -np.linalg.norm(off, axis=1), float(np.clip(np.linalg.norm(off, 2), -1, 1)), values


def test_edges_give_what_matrices_give(spark):
    graphs = {0: graph(1, 60, 9, 4), 1: graph(2, 40, 1, 1), 2: np.eye(5)}  # the first has more equal values than a block shows
    sims = spark.createDataFrame([x for k, w in graphs.items() for x in rows_of(k, w)], "k long, i long, j long, sim double")
    got = {(r.k, r.i): r for r in estimators.eccentricity(sims, ["k"], "k bigint", dense=0).collect()}
    also = {(r.k, r.i): r for r in estimators.eccentricity(sims, ["k"], "k bigint").collect()}
    assert len(got) == sum(map(len, graphs.values())) == len(also)
    for k, w in graphs.items():
        confidence, uncertainty, _ = dense(w)
        for i in range(len(w)):
            assert got[k, i].confidence == pytest.approx(confidence[i], abs=1e-5)
            assert got[k, i].uncertainty == pytest.approx(uncertainty, abs=1e-5)
            assert also[k, i].confidence == pytest.approx(confidence[i], abs=1e-9)


def test_too_many_leading_eigenvalues_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(spectral, "BLOCK", 2)
    monkeypatch.setattr(spectral, "STEPS", 1)
    monkeypatch.setattr(spectral, "ROUNDS", 2)
    w = np.kron(np.eye(20), np.ones((3, 3)))  # twenty components: twenty eigenvalues of 1
    sims = spark.createDataFrame(rows_of(0, w), "k long, i long, j long, sim double")
    with pytest.raises(ValueError, match="too many"):
        estimators.eccentricity(sims, ["k"], "k bigint", dense=0)


def test_a_group_beyond_a_dense_matrix(spark):
    """Each is alike with forty others by chance: one eigenvalue is above 0.9, whose vector is the root of the degrees."""
    n = 1200
    near = spark.range(n).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(1), F.lit(20))).alias("q")).select("i", F.pmod(F.xxhash64("i", "q"), F.lit(n)).alias("j")).where("i <> j").distinct()
    sims = near.select(F.lit(0).cast("long").alias("k"), "i", "j", F.lit(1.0).alias("sim")).union(spark.range(n).select(F.lit(0).cast("long"), "id", "id", F.lit(1.0)))
    got = estimators.eccentricity(sims, ["k"], "k bigint", dense=1000).toPandas().set_index("i")
    edges = sims.toPandas()
    d = (np.bincount(edges.i, edges.sim, n) + np.bincount(edges.j, edges.sim, n)) / 2
    v = np.sqrt(d / d.sum())
    assert np.allclose(got.confidence.sort_index().to_numpy(), -np.abs(v - v.mean()), atol=1e-7)
    assert np.allclose(got.uncertainty, np.sqrt(1 - n * v.mean() ** 2), atol=1e-7)


def test_trace_is_the_clipped_sum_where_no_eigenvalue_is_negative(spark):
    words = [{"a", "b", "c"}, {"a", "b"}, {"x"}, {"c", "d"}, {"a", "b", "c"}]
    frame = spark.createDataFrame([(0, i, sorted(w)) for i, w in enumerate(words)], "k long, m long, tokens array<string>")
    sims = estimators.jaccard_similarities(frame, ["k"], "m", "tokens")
    w = np.array([[len(a & b) / len(a | b) for b in words] for a in words])
    assert {(r.i, r.j): r.sim for r in sims.collect()} == {(i, j): pytest.approx(w[i, j]) for i, j in zip(*np.nonzero(w), strict=True)}
    _, _, values = dense(w)
    want = np.maximum(1 - values, 0).sum()
    assert estimators.spectral_trace(sims, ["k"]).first().spectral_eigv == pytest.approx(want)
    assert estimators.spectral_eigenvalues(sims, ["k"], "k bigint").first().spectral_eigv == pytest.approx(want)
    each, group = estimators.degree(sims, ["k"])
    assert {r.i: r.confidence for r in each.collect()} == {i: pytest.approx(x) for i, x in enumerate(w.mean(axis=1))}
    assert group.first().uncertainty == pytest.approx(1 / 5 - w.sum() / 25)
