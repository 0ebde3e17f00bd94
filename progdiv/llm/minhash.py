"""Near-duplicates of texts by one-permutation MinHash.

Every text's distinct word shingles are hashed once; each of BINS ranges of the hash keeps its least value and empty
ranges borrow from one picked at random for that range (optimal densification). Bands of bins make buckets.
Within a bucket candidates form a star about its smallest document, so pairs stay fewer than members. What the
stars of a bucket leave apart is compared within groups that share some of their rarest shingles, which
loses no pair of similar sets and emits none that is not linked. All links are confirmed on full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from progdiv.llm.common import HOT, drop_table, give_back, join_by_count, materialize, mix, pieces_of, release, text_buffer, word_bounds, word_hashes
from progdiv.llm.graph import components

BINS, ROWS = 256, 6
BANDS = BINS // ROWS
_TOP = np.uint64(64 - BINS.bit_length() + 1)


def _probes() -> np.ndarray:
    """For each bin the bins it borrows from, in order: all of them, ranked by a hash of both numbers."""
    own, other = np.meshgrid(np.arange(BINS, dtype=np.uint64), np.arange(BINS, dtype=np.uint64), indexing="ij")
    return np.argsort(mix(own * np.uint64(0x9E3779B97F4A7C15) + mix(other + np.uint64(1))), axis=1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct hashes of k words in a row; all its words as one if there are fewer."""
    starts, ends = word_bounds(data, offsets)
    words = word_hashes(data, starts, ends)
    first = np.searchsorted(starts, offsets[:-1])
    last = np.append(first[1:], len(starts))
    acc = np.full(max(len(words) - k + 1, 0), k, dtype=np.uint64)
    for j in range(k):
        acc = mix(acc * np.uint64(0xD6E8FEB86659FD93) + words[j : len(words) - k + 1 + j])
    for lo, hi in zip(first, last, strict=True):
        if hi - lo >= k:
            yield np.unique(acc[lo : hi - k + 1])
        elif hi > lo:
            one = np.uint64(hi - lo)
            for w in words[lo:hi]:
                one = mix(np.array([one], dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + w)[0]
            yield np.array([one], dtype=np.uint64)
        else:
            yield np.zeros(0, dtype=np.uint64)


def signature(shingles: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """The least hash of each bin of sorted distinct hashes, empty bins filled."""
    edges = np.arange(BINS, dtype=np.uint64) << _TOP
    at = np.searchsorted(shingles, edges)
    least = shingles[np.minimum(at, len(shingles) - 1)]
    full = (at < len(shingles)) & ((least >> _TOP) == np.arange(BINS, dtype=np.uint64))
    empty = np.flatnonzero(~full)
    if len(empty):
        least = least.copy()
        least[empty] = least[probes[empty, np.argmax(full[probes[empty]], axis=1)]]
    return least


def _bands(sig: np.ndarray) -> np.ndarray:
    rows = sig[: BANDS * ROWS].reshape(BANDS, ROWS)
    acc = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        acc = mix(acc * np.uint64(0xD6E8FEB86659FD93) + rows[:, j])
    return acc


def _set_key(s: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """128 bits that stand for a set."""
    return mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text_hash, n (shingles), hi and lo (hash of the set), bands."""

    def run(batches):
        probes = _probes()
        schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("bands", pa.list_(pa.int64()))])
        for batch in batches:
            for piece in pieces_of(batch, "text"):
                n, keys, bands = [], [], []
                for s in shingle_sets(*text_buffer(piece.column("text")), k):
                    n.append(len(s))
                    keys.append(_set_key(s))
                    bands.append(_bands(signature(s, probes)).view(np.int64) if len(s) else np.zeros(0, np.int64))
                key = np.array(keys, dtype=np.uint64).reshape(-1, 2).view(np.int64)
                lengths = np.cumsum([0, *map(len, bands)])
                lists = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.concatenate(bands)))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("text_hash"), pa.array(n, pa.int64()), pa.array(key[:, 0]), pa.array(key[:, 1]), lists], schema=schema)
        give_back()

    return docs.mapInArrow(run, "doc_id bigint, text_hash bigint, n bigint, hi bigint, lo bigint, bands array<bigint>")


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id (here the number of a class) and shingles (their hashes) of the texts whose set has the class's key."""

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("shingles", pa.list_(pa.int64()))])
        for batch in batches:
            for piece in pieces_of(batch, "text", 1 << 20):
                sets = list(shingle_sets(*text_buffer(piece.column("text")), k))
                wanted = np.stack([piece.column(c).to_numpy().view(np.uint64) for c in ("hi", "lo")], axis=1)
                on = [i for i, s in enumerate(sets) if _set_key(s) == tuple(wanted[i])]
                sets = [sets[i] for i in on]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([piece.column("rep").take(pa.array(on, pa.int64())), lists], schema=schema)
        give_back()

    return docs.select("text", "rep", "hi", "lo").mapInArrow(run, "doc_id bigint, shingles array<bigint>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those with 100 * shared >= percent * all on full shingle sets."""
    sets = sets.hint("merge")
    a = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(a, "a").join(b, "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    ok = 100 * shared >= percent * (F.size("sa") + F.size("sb") - shared)
    found = materialize(both.where(ok).select("a", "b"), "links")
    release(pairs.sparkSession)
    return found


def _open_buckets(spokes: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (key, x, n, component, main) of buckets with pairs across components that no star has compared:
    x is any member but the centre, main the centre's component."""
    label = found.select(F.col("id").alias("b"), "component")
    placed = spokes.join(label, "b", "left").withColumn("component", F.coalesce("component", "b"))
    centre = F.col("a") == F.col("b")
    main = F.max(F.when(centre, F.col("component"))).alias("main")
    low, high = F.min(F.when(~centre, F.col("component"))), F.max(F.when(~centre, F.col("component")))
    keys = placed.groupBy("key").agg(main, low.alias("low"), high.alias("high")).where("low <> high")
    placed = placed.where(~centre).join(keys.select("key", "main"), "key")
    return materialize(placed.select("key", F.col("b").alias("x"), "n", "component", "main"), "open")


def _fronts(buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """doc_id and s: of every set in open buckets, ordered by rarity (then value), the first shingles that others have.

    Two similar sets share one of the first size - ceil(share * size) + 1, so sets without such a front are
    alone, and others are similar only to sets whose front they meet. Shingles that no other set has only count, and those
    of more than one row in HOT come last; these are fewer than HOT, so sets find them in a list and only the others are joined.
    """
    who = buckets.select(F.col("x").alias("doc_id")).distinct()
    rows = materialize(who.join(sets.hint("merge"), "doc_id").select("doc_id", "shingles"), "shingles")
    per = materialize(rows.select(F.explode("shingles").alias("s")).groupBy("s").count().where("count > 1"), "per")
    least = max(1, (rows.agg(F.sum(F.size("shingles"))).first()[0] or 0) // HOT)
    hot = [r.s for r in per.where(F.col("count") > least).orderBy("count", "s").select("s").collect()]
    hot = F.array(*map(F.lit, hot)).cast("array<bigint>")
    n = F.size("shingles")
    rows = rows.select("doc_id", (n - F.ceil(n * percent / 100) + 1).cast("int").alias("size"), F.array_except("shingles", hot).alias("rare"), F.array_intersect(hot, "shingles").alias("hot"))
    met = rows.select("doc_id", "size", F.size("rare").alias("n"), F.explode("rare").alias("s")).join(per.where(F.col("count") <= least), "s")
    met = met.groupBy("doc_id", "size", "n").agg(F.array_sort(F.collect_list(F.struct("count", "s"))).alias("o"))
    first = lambda column, length: F.explode(F.slice(column, F.lit(1), F.greatest(length, F.lit(0))))
    front = met.select("doc_id", first("o", F.col("size") - F.col("n") + F.size("o")).alias("f")).select("doc_id", "f.s")
    found = materialize(front.union(rows.select("doc_id", first("hot", F.col("size") - F.size("rare")))), "fronts")
    drop_table(rows)
    release(buckets.sparkSession)
    return found


def _compare(table: pa.Table, percent: int) -> pa.Table:
    """Links across components between two chunks of a group (or within one), by counts over postings."""
    chunk, i, j = table.column("chunk").to_numpy(), table.column("i")[0].as_py(), table.column("j")[0].as_py()
    ids, component = table.column("doc_id").to_numpy(), table.column("component").to_numpy()
    sets = [v.values.to_numpy() for v in table.column("shingles").combine_chunks()]
    left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(right)), sizes[right])
    posted = np.concatenate([sets[r] for r in right])
    order = np.argsort(posted, kind="stable")
    posted, owner = posted[order], owner[order]
    a, b = [], []
    for u in left:
        lo, hi = np.searchsorted(posted, sets[u], "left"), np.searchsorted(posted, sets[u], "right")
        n = hi - lo
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        shared = np.bincount(owner[at], minlength=len(right))
        good = (100 * shared >= percent * (sizes[u] + sizes[right] - shared)) & (component[right] != component[u])
        a += [ids[u]] * int(good.sum())
        b += ids[right[good]].tolist()
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _rest(buckets: DataFrame, sets: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Links across components among the members of open buckets, all of them.

    Members whose fronts meet make a group; a large group is dealt into chunks, each pair of chunks being a
    task of its own, so that no pair is emitted unless it is a link.
    """
    front = _fronts(buckets, sets, percent)
    per = materialize(front.groupBy("s").agg(F.min("doc_id").alias("a"), F.count("*").alias("count")), "per")
    near = join_by_count(front, per, "s").select("a", F.col("doc_id").alias("b")).distinct()
    groups = materialize(components(near).select(F.col("id").alias("doc_id"), F.col("component").alias("g")), "groups")
    rows = groups.join(sets.hint("merge"), "doc_id").join(found.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left")
    rows = materialize(rows.withColumn("component", F.coalesce("component", "doc_id")), "rows")
    sizes = rows.groupBy("g").agg(F.count("*").alias("count"), F.sum(F.size("shingles")).alias("w"))
    sizes = materialize(sizes.select("g", "count", F.greatest(F.least(F.ceil(F.col("count") / 48), F.lit(32)), F.ceil(F.col("count") / 1024), F.ceil(F.col("w") / 1_000_000)).cast("int").alias("chunks")), "sizes")
    rows = join_by_count(rows, sizes, "g").withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select("g", "doc_id", "component", "shingles", "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))
    return materialize(rows.groupBy("g", "i", "j").applyInArrow(lambda t: _compare(t, percent), "a bigint, b bigint"), "links")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash and component of every row of docs.

    Words are runs of other characters than white space, with A-Z lower-cased. Texts with equal sets are
    one class; classes are linked by candidates confirmed on full sets; component_id is the smallest
    doc_id reachable, kept tells whether it is the document's own. Texts that are null or without words have
    no shingles and link with nothing. Rows without doc_id link with nothing and are kept, with
    no component_id. Rows that repeat a doc_id are documents of their own, each with its own text's links. component is the
    linked group's number (null for rows that link with nothing), which tells apart groups of one smallest doc_id; text_hash
    is xxhash64 of the text. Other columns don't matter. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    sig = materialize(signatures(docs, k), "signatures")
    known = sig.where("n > 0 AND doc_id IS NOT NULL")
    row = F.struct("doc_id", "text_hash")
    classes = known.groupBy("hi", "lo", "n").agg(F.min_by("bands", row).alias("bands"), F.min(row).alias("row"))
    # rep: the class's own number, since several classes can have the same smallest doc_id.
    classes = materialize(classes.select("hi", "lo", "n", "bands", "row.doc_id", "row.text_hash", F.monotonically_increasing_id().alias("rep")), "classes")
    members = classes.select(F.explode("bands").alias("key"), "rep", "n")
    centres = members.groupBy("key").agg(F.min("rep").alias("a"), F.count("*").alias("size")).where("size > 1").select("key", "a")
    spokes = materialize(members.join(centres, "key").select("key", "a", F.col("rep").alias("b"), "n"), "spokes")
    needed = classes.select("doc_id", "text_hash", "hi", "lo", "rep").join(spokes.select(F.col("b").alias("rep")).distinct(), "rep", "left_semi")
    sets = full_sets(docs.join(needed.hint("merge"), ["doc_id", "text_hash"]), k).dropDuplicates(["doc_id"])
    sets = materialize(sets, "sets")
    release(docs.sparkSession)
    stars = materialize(spokes.where("a <> b").select("a", "b").distinct(), "stars")
    links = _confirmed(stars, sets, percent)
    found = materialize(components(links), "components")
    buckets = _open_buckets(spokes, found)
    if not buckets.isEmpty():
        more = _rest(buckets, sets, found, percent)
        if not more.isEmpty():
            found = materialize(components(links.union(more)), "components")

    classes = classes.select("hi", "lo", "n", "doc_id", "rep").join(found.withColumnRenamed("id", "rep"), "rep", "left")
    classes = materialize(classes.select("hi", "lo", "n", "doc_id", F.coalesce("component", "rep").alias("component")), "classes")
    smallest = classes.groupBy("component").agg(F.min("doc_id").alias("smallest"))
    classes = materialize(classes.join(smallest, "component").select("hi", "lo", "n", "smallest", "component"), "classes")
    out = sig.join(classes, ["hi", "lo", "n"], "left")
    has_id = F.col("doc_id").isNotNull()
    component = F.when(has_id, F.coalesce("smallest", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"), "text_hash", F.when(has_id, F.col("component")).alias("component"))
