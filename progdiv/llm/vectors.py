"""Near-duplicates of embeddings by a subspace pigeonhole join.

Unit vectors are rotated and cut into BLOCKS low-dimensional blocks. If two vectors are within a squared distance,
then in some block they are within that block's proportional share of it. So every block is range-joined under
its share: a vector goes to the cell of a grid over the block's first coordinates and to later cells within
reach. Pairs found are verified exactly, by cosine in double precision, and counted in the first block that
finds them, so that no pair is emitted or deduplicated: a cell returns counts and a spanning forest of its links.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from progdiv.llm.common import materialize
from progdiv.llm.graph import components

BLOCKS, GRID = 8, 2
#: Members of a cell above which it is dealt out to tasks of pairs of chunks.
CHUNK = 4096
_TILE = 512


def rotation(dim: int) -> np.ndarray:
    """An orthogonal matrix that depends on dim alone."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _bounds(dim: int) -> np.ndarray:
    return np.linspace(0, dim, min(BLOCKS, dim) + 1).astype(int)


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), -1).astype(np.float64)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _cells(classes: DataFrame, kind: str, threshold: float, with_vectors: bool) -> DataFrame:
    """Rows (label, dim, block, c0, c1, probe, rep, n, vector) of every class for its cell in every block, and for
    each cell that follows it in order and begins within reach."""
    budget = 2 - 2 * threshold
    names = ["label", "dim", "block", "c0", "c1"] + ["probe", "rep", "n", "vector"] * with_vectors

    def run(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                here = np.flatnonzero(dims == dim)
                part = batch.take(pa.array(here))
                y = _unit(part.column("vector").to_pylist(), kind) @ rotation(dim)
                edges = _bounds(dim)
                reach = np.sqrt(budget / (len(edges) - 1)) * (1 + 1e-6)
                width = 2 * reach
                for b, (lo, hi) in enumerate(itertools.pairwise(edges)):
                    z = y[:, lo : min(hi, lo + GRID)]
                    if z.shape[1] < 2:
                        z = np.column_stack([z, np.zeros(len(z))])
                    home = np.floor(z / width).astype(int)
                    for step in itertools.product((-1, 0, 1), repeat=2):
                        if step < (0, 0):
                            continue
                        near = home + step
                        gap = np.maximum(np.maximum(near * width - z, z - (near + 1) * width), 0)
                        i = np.flatnonzero((gap * gap).sum(axis=1) <= reach * reach)
                        out = part.take(pa.array(i))
                        cols = [out.column("label"), out.column("dim"), pa.array(np.full(len(i), b), pa.int32()), pa.array(near[i, 0], pa.int32()), pa.array(near[i, 1], pa.int32())]
                        if with_vectors:
                            cols += [pa.array(np.full(len(i), step != (0, 0))), out.column("rep"), out.column("n"), out.column("vector")]
                        yield pa.RecordBatch.from_arrays(cols, names=names)

    ddl = "label bigint, dim int, block int, c0 int, c1 int" + ", probe boolean, rep bigint, n bigint, vector binary" * with_vectors
    return classes.select("label", "dim", "rep", "n", "vector").mapInArrow(run, ddl)


def _join_cell(table: pa.Table, kind: str, threshold: float) -> pa.Table:
    """Counts of links and a spanning forest of one cell (or of two chunks of it)."""
    raw = table.column("vector").to_pylist()
    x = _unit(raw, kind)
    dim = x.shape[1]
    y = x @ rotation(dim)
    edges = _bounds(dim)
    share = (2 - 2 * threshold) / (len(edges) - 1)
    b = table.column("block")[0].as_py()
    z = y[:, edges[b] : edges[b + 1]]
    zz = np.einsum("ij,ij->i", z, z)
    probe, n, rep = table.column("probe").to_numpy(), table.column("n").to_numpy(), table.column("rep").to_numpy()
    chunk, i, j = table.column("chunk").to_numpy(), table.column("i")[0].as_py(), table.column("j")[0].as_py()
    order = np.argsort(chunk != i, kind="stable")
    left, right = order[: int((chunk == i).sum())], np.flatnonzero(chunk == j)
    links, root = np.zeros(len(x), np.int64), np.arange(len(x))

    def find(v: np.ndarray) -> np.ndarray:
        while (root[v] != v).any():
            root[v] = root[root[v]]
            v = root[v]
        return v

    def verified(p: np.ndarray, q: np.ndarray) -> None:
        good = np.einsum("ij,ij->i", x[p], x[q]) >= threshold
        p, q = p[good], q[good]
        first = np.full(len(p), -1)
        for k, (lo, hi) in enumerate(itertools.pairwise(edges)):
            d = y[p, lo:hi] - y[q, lo:hi]
            first[(first < 0) & (np.einsum("ij,ij->i", d, d) <= share * (1 + 1e-9))] = k
        p, q = p[first == b], q[first == b]
        np.add.at(links, p, n[q])
        np.add.at(links, q, n[p])
        while len(p):
            p, q = find(p), find(q)
            apart = p != q
            p, q = p[apart], q[apart]
            np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))

    for s in range(0, len(left), _TILE):
        u = left[s : s + _TILE]
        for r in range(s if i == j else 0, len(right), _TILE):
            v = right[r : r + _TILE]
            close = zz[u][:, None] + zz[v] - 2 * z[u] @ z[v].T <= share * (1 + 1e-6)
            close &= ~(probe[u][:, None] & probe[v])
            if i == j and r == s:
                close &= np.arange(len(u))[:, None] < np.arange(len(v))
            close &= x[u] @ x[v].T >= threshold - 1e-9
            p, q = np.nonzero(close)
            for at in range(0, len(p), 65536):
                verified(u[p[at : at + 65536]], v[q[at : at + 65536]])
    root = find(np.arange(len(x)))
    out = np.flatnonzero(links)
    return pa.table([pa.array(rep[out]), pa.array(links[out]), pa.array(rep[root[out]])], names=["rep", "links", "root"])


def near_vectors(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding, label).

    Vectors are compared where labels are equal and not null and lengths are equal. Rows whose vector is null, empty,
    zero or holds a null or non-finite component, or whose label or vec_id is null, link with nothing and are
    their own component. Equal vectors of a label are one class, its members linked with each other and
    with whatever the class is. Rows equal in vec_id, vector and label are one vector, which is not another to itself; rows
    that share only a vec_id are vectors of their own, each counted. Other columns don't matter; an empty table gives no rows.
    """
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = "<f4" if element == "float" else "<f8"
    e = F.col("embedding")
    if element not in ("float", "double"):
        e = e.cast("array<double>")
    fine = F.coalesce(F.size(e) > 0, F.lit(False)) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0)
    fine = F.coalesce(fine & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(fine, F.col("label").cast("long")).alias("label"), F.when(fine, e).alias("e"))
    rows = rows.select("vec_id", "label", "e", F.when(F.col("e").isNotNull(), F.xxhash64("e")).alias("h1"), F.when(F.col("e").isNotNull(), F.hash("e", F.lit(3))).alias("h2"))
    key = ["label", "h1", "h2"]
    once = rows.where("e IS NOT NULL").groupBy(*key, "vec_id").agg(F.first("e").alias("e"))
    classes = once.groupBy(*key).agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("e").alias("e"))

    def to_bytes(batches):
        for batch in batches:
            lists = batch.column("e")
            raw = [v.values.to_numpy(zero_copy_only=False).astype(kind).tobytes() for v in lists]
            cols = [batch.column(k) for k in ("label", "h1", "h2", "least", "n")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([len(r) // int(kind[2]) for r in raw], pa.int32()), pa.array(raw, pa.binary())], names=["label", "h1", "h2", "least", "n", "dim", "vector"])

    classes = classes.mapInArrow(to_bytes, "label bigint, h1 bigint, h2 int, least bigint, n bigint, dim int, vector binary")
    # rep: the class's own number, since several classes can have the same smallest vec_id.
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    cell = ["label", "dim", "block", "c0", "c1"]
    full = _cells(classes, kind, threshold, False).groupBy(*cell).count().where(F.col("count") > CHUNK)
    full = materialize(full.select(*cell, F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks")), "hot")
    placed = _cells(classes, kind, threshold, True).join(full, cell, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    placed = placed.withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")}).drop("other", "chunks")
    found = placed.groupBy(*cell, "i", "j").applyInArrow(lambda t: _join_cell(t, kind, threshold), "rep bigint, links bigint, root bigint")
    found = materialize(found, "links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    classes = classes.select("label", "h1", "h2", "least", "n", "rep").join(counts, "rep", "left").join(groups.withColumnRenamed("id", "rep"), "rep", "left")
    classes = materialize(classes.select(*key, "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")), "classes")
    smallest = classes.groupBy("component").agg(F.min("least").alias("smallest"))
    classes = materialize(classes.join(smallest, "component").select(*key, "n_links", "smallest"), "classes")
    out = rows.join(classes, key, "left")
    component = F.coalesce("smallest", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
