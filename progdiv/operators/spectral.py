"""Leading eigenvectors of large similarity graphs from their edges, by joins and sums.

A block of vectors is multiplied by the normalised matrix again and again (a join of edges with the vectors of their ends and a
sum), each product made orthogonal to all before. The span of all holds the leading eigenvectors (block Lanczos); small matrices
of sums over members, one a group, are all that meets the driver. Where the residual is not small enough, the best vectors found
begin anew.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from progdiv.streaming.monitor import work_dir

#: Members of a group whose matrix one task may hold: 32 MB.
DENSE = 2048
#: Vectors multiplied at once, products of a round, rounds at most, and the residual at which an eigenvector is found.
BLOCK, STEPS, ROUNDS, TOLERANCE = 6, 5, 12, 1e-6


def _written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: a long chain of rounds starts from files, whoever is lost."""
    path = f"{work_dir(df.sparkSession)}/vectors"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def normalised(similarities: DataFrame, keys: list[str]) -> DataFrame:
    """Edges (keys, i, j, w) of D^-1/2 W D^-1/2, where W is the mean of both directions and D its row sums."""
    ways = similarities.select(*keys, "i", "j", (F.col("sim") / 2).alias("w")).union(similarities.select(*keys, F.col("j"), F.col("i"), F.col("sim") / 2))
    edges = ways.groupBy(*keys, "i", "j").agg(F.sum("w").alias("w")).where("w <> 0")
    d = edges.groupBy(*keys, "i").agg(F.greatest(F.sum("w"), F.lit(1e-12)).alias("d"))
    out = edges.join(d, [*keys, "i"]).join(d.withColumnsRenamed({"i": "j", "d": "e"}), [*keys, "j"])
    return out.select(*keys, "i", "j", (F.col("w") / F.sqrt(F.col("d") * F.col("e"))).alias("w"))


class _Space:
    """Rows (keys, i, x): of each member its entries in the vectors found so far, and w, in products not yet among them."""

    def __init__(self, edges: DataFrame, keys: list[str]) -> None:
        self.edges, self.keys = edges, keys
        self.names = [*keys, "i"]

    def sums(self, rows: DataFrame, left: str, right: str) -> dict[tuple, np.ndarray]:
        """left^T right of every group: each task adds up its own members'."""
        keys = self.keys

        def run(batches):
            found: dict[tuple, np.ndarray] = {}
            for b in batches:
                for key, (x, y) in _by_group(b, keys, left, right):
                    found[key] = found.get(key, 0) + x.T @ y
            if found:
                cols = [pa.array([k[p] for k in found], b.schema.field(n).type) for p, n in enumerate(keys)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([m.ravel() for m in found.values()], pa.list_(pa.float64())), pa.array([m.shape[1] for m in found.values()], pa.int32())], names=[*keys, "m", "width"])

        key_ddl = "".join(f"`{n}` {rows.schema[n].dataType.simpleString()}, " for n in keys)
        parts = rows.select(*dict.fromkeys([*keys, left, right])).mapInArrow(run, f"{key_ddl}m array<double>, width int")
        each = parts.select(*keys, "width", F.posexplode("m").alias("p", "v")).groupBy(*keys, "width", "p").agg(F.sum("v").alias("v"))
        out: dict[tuple, np.ndarray] = {}
        for r in each.collect():  # the numbers of a small matrix a group
            key, width = tuple(r[n] for n in keys), r["width"]
            out.setdefault(key, {})[divmod(r["p"], width)] = r["v"]
        return {key: np.array([[m[i, j] for j in range(1 + max(q for _, q in m))] for i in range(1 + max(q for q, _ in m))]) for key, m in out.items()}

    def changed(self, rows: DataFrame, made: Callable[[tuple, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
        """x and w of every member anew, from its group's key and both."""
        keys, names = self.keys, self.names

        def run(batches):
            for b in batches:
                for key, (x, w), part in _by_group(b, keys, "x", "w", True):
                    x, w = made(key, x, w)
                    yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), _lists(x), _lists(w)], names=[*names, "x", "w"])

        return rows.select(*names, "x", "w").mapInArrow(run, ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names) + ", x array<double>, w array<double>")

    def product(self, rows: DataFrame, column: str, width: int) -> DataFrame:
        """rows with w, the edges' matrix times a column."""
        ends = rows.select(*self.keys, F.col("i").alias("j"), F.col(column).alias("_v"))
        met = self.edges.join(ends, [*self.keys, "j"]).groupBy(*self.names)
        sums = met.agg(*(F.sum(F.col("w") * F.get("_v", F.lit(q))).alias(f"_{q}") for q in range(width)))
        return rows.drop("w").join(sums.select(*self.names, F.array(*(F.col(f"_{q}") for q in range(width))).alias("w")), self.names)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, x.size + 1, max(1, x.shape[1]), dtype=np.int32) if x.shape[1] else np.zeros(len(x) + 1, np.int32), pa.array(x.ravel(), pa.float64()))


def _by_group(batch: pa.RecordBatch, keys: list[str], left: str, right: str, parts: bool = False):
    values = list(zip(*(batch.column(n).to_pylist() for n in keys), strict=True))
    groups: dict[tuple, list[int]] = {}
    for p, k in enumerate(values):
        groups.setdefault(k, []).append(p)
    for key, at in groups.items():
        part = batch.take(pa.array(at))
        x, y = (part.column(c).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1) for c in (left, right))
        yield (key, (x, y), part) if parts else (key, (x, y))


def _orthonormal(gram: np.ndarray) -> np.ndarray:
    """T for which w T has orthonormal columns; directions that vanish become zero columns."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    scale = np.where(values > max(1e-24, 1e-13 * values.max(initial=0)), 1 / np.sqrt(np.maximum(values, 1e-300)), 0)
    return vectors * scale


def _extended(space: _Space, rows: DataFrame) -> DataFrame:
    """The products w made orthogonal to x and to each other, twice as rounding asks for, and put behind x."""
    for _ in range(2):
        made = {}
        for key, m in space.sums(rows.withColumn("xw", F.concat("x", "w")), "xw", "w").items():
            c = m[: len(m) - m.shape[1]]
            made[key] = c, _orthonormal(m[len(c) :] - c.T @ c)
        rows = space.changed(rows, lambda key, x, w, made=made: (x, (w - x @ made[key][0]) @ made[key][1]))
    return space.changed(rows, lambda key, x, w: (np.column_stack([x, w]), w[:, :0]))


def _random(seed: int) -> Column:
    """Entries of a member in a block of vectors by chance, the same whenever they are made."""
    return F.array(*(F.pmod(F.xxhash64("i", F.lit(seed), F.lit(q)), F.lit(1 << 20)) / float(1 << 19) - 1 for q in range(BLOCK)))


def top_space(edges: DataFrame, keys: list[str], threshold: float) -> tuple[DataFrame, dict[tuple, np.ndarray]]:
    """Rows (keys, i, x) of orthonormal eigenvectors of the edges' matrix with values above 1 - threshold, the largest first, or
    of the leading one alone; and those values by group.

    Each round starts from the best vectors so far and what they miss, their residuals. A block shows at most so many vectors of one
    repeated value, so once all residuals are small a round with a new block by chance has to find no more. ValueError if
    ROUNDS are not enough, as with more than about ROUNDS * BLOCK such values.
    """
    space = _Space(edges, keys)
    rows = edges.select(*space.names).distinct().withColumns({"x": F.array().cast("array<double>"), "w": _random(0)})
    width, found = 0, None
    for r in range(ROUNDS):
        rows = _written(_extended(space, rows))
        width += BLOCK
        for _ in range(STEPS):
            last = rows.withColumn("_last", F.slice("x", width - BLOCK + 1, F.lit(BLOCK)))
            rows = _written(_extended(space, _written(space.product(last, "_last", BLOCK).select(*space.names, "x", "w"))))
            width += BLOCK
        rows = _written(space.product(rows, "x", width))
        values, turn = {}, {}
        for key, h in space.sums(rows, "x", "w").items():
            mu, vectors = np.linalg.eigh((h + h.T) / 2)
            order = np.argsort(-mu)
            values[key], turn[key] = mu[order], vectors[:, order]
        kept = {key: max(1, int((mu > 1 - threshold).sum())) for key, mu in values.items()}
        part = lambda key, x, w, n: (x @ turn[key][:, :n], w @ turn[key][:, :n] - (x @ turn[key][:, :n]) * values[key][:n])
        off = space.sums(space.changed(rows, lambda key, x, w: (part(key, x, w, kept[key])[1], w[:, :0])), "x", "x")
        small = all(np.sqrt(np.diag(m)).max() <= TOLERANCE for m in off.values())
        if small and kept == found:
            return space.changed(rows, lambda key, x, w: (part(key, x, w, kept[key])[0], w[:, :0])).drop("w"), {key: mu[: kept[key]] for key, mu in values.items()}
        found, width = kept if small else None, max(kept.values()) + BLOCK
        rows = space.changed(rows, lambda key, x, w, n=width: (part(key, x, w, n)[0], part(key, x, w, BLOCK)[1]))
        rows = _written(rows.withColumn("w", _random(r + 1)) if small else rows)
    raise ValueError(f"no convergence after {ROUNDS} rounds: a group may have too many eigenvalues above {1 - threshold}")


def eccentricity_of_edges(similarities: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """keys, i, confidence, uncertainty, as of the dense way, for groups too large for it.

    A member with no similarity to others is an eigenvector by itself, so these are counted and not iterated on. With s and t the
    sums over eigenvectors of a member's squared entries and of its entries times the vector's mean, and M the sum of
    squared means, its squared distance from the centre is s - 2t + M; all distances have the 2-norm 1 if there are
    two eigenvectors, and else the square root of 1 - nM."""
    edges = _written(normalised(similarities, keys))
    alone = _written(edges.groupBy(*keys, "i").agg(F.max((F.col("i") != F.col("j")).cast("int")).alias("linked")).where("linked = 0").select(*keys, "i"))
    linked = edges.join(alone, [*keys, "i"], "left_anti")
    n = {tuple(r[k] for k in keys): r["n"] for r in edges.groupBy(*keys).agg(F.count_distinct("i").alias("n")).collect()}  # a row a large group
    lone = {tuple(r[k] for k in keys): r["n"] for r in alone.groupBy(*keys).agg(F.count("*").alias("n")).collect()}
    spark, fields = edges.sparkSession, ", ".join(f"`{k}` {edges.schema[k].dataType.simpleString()}" for k in keys)
    found, values = top_space(linked, keys, threshold) if not linked.isEmpty() else (None, {})
    found = _written(found.withColumn("one", F.array(F.lit(1.0)))) if found else None
    totals = {}
    if found:
        space = _Space(linked, keys)
        totals = {k: m[:, 0] / n[k] for k, m in space.sums(found, "x", "one").items()}
    facts = []
    for key, size in n.items():
        means = totals.get(key, np.zeros(0))
        k, m = len(means) + lone.get(key, 0), float(means @ means) + lone.get(key, 0) / size**2
        facts.append((*key, float(size), m, 1.0 if k > 1 else float(np.sqrt(max(0.0, 1 - size * m))), [float(v) for v in means]))
    facts = F.broadcast(spark.createDataFrame(facts, f"{fields}, n double, m double, uncertainty double, means array<double>"))  # a row a large group
    distance = lambda s, t: -F.sqrt(F.greatest(s - 2 * t + F.col("m"), F.lit(0.0)))
    out = alone.join(facts, keys).select(*keys, "i", distance(F.lit(1.0), 1 / F.col("n")).alias("confidence"), "uncertainty")
    if not found:
        return out
    x = F.slice("x", F.lit(1), F.size("means"))
    s = F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)
    t = F.aggregate(F.zip_with(x, "means", lambda v, m: v * m), F.lit(0.0), lambda a, v: a + v)
    return out.union(found.join(facts, keys).select(*keys, "i", distance(s, t).alias("confidence"), "uncertainty"))
