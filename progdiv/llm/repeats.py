"""Exact substring deduplication: every string of THRESHOLD bytes that starts more than once.

A depth-limited radix sort of suffixes that stops at THRESHOLD bytes, most significant digit first: each pass parts
suffixes into groups by one digit and only groups of several go on. Digits are strings taken from the first THRESHOLD
bytes, compared by hash, since only equality of groups is asked for and not their order. A suffix's first digit is the
gram with the least hash in those bytes, which equal suffixes share at the same distance; neighbouring suffixes with
one such gram go through the passes as one run. The next digits are the strings around the gram: what all
suffixes of a run have in common (its core) and what they cover together (its hull). Runs whose core is
alone drop out; runs with an equal hull are repeats as a whole; the others are split, into runs of SPLIT
suffixes and then single ones, whose last digit is all of the THRESHOLD bytes. Each pass counts keys with
partial sums and joins rows back to their keys, so no group is ever gathered in one task.

A text is known by 96 bits of hash of its bytes, whatever its doc_id, so rows with equal texts are one text in all passes.
Such texts are removed whole, as each of their windows starts again in the other; they go through the passes once, for
what others share with them.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from progdiv.llm.common import PRIME, Rolling, drop_table, give_back, gram_hashes, materialize, release, substring_hashes

THRESHOLD, GRAM, SPLIT = 200, 40, 16
#: Starts handled at once, so that memory does not follow the length of a text.
_BLOCK = (1 << 20) - 1024
#: Pieces of runs handled at once.
_PIECES = 1 << 16
_BASE, _OTHER_BASE = 0x1B873593CC9E2D51 % PRIME, 0x16A09E667F3BCC90 % PRIME
_OTHER = 0xC2B2AE3D27D4EB4F
_ROW = [("core", pa.int64()), ("hull", pa.int64()), ("key", pa.int64()), ("th", pa.int32()), ("a", pa.int32()), ("s", pa.int32()), ("e", pa.int32()), ("done", pa.bool_())]
_DDL = "core bigint, hull bigint, key bigint, th int, a int, s int, e int, done boolean"


def _window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """For each w hashes in a row the index of the least, rightmost first."""
    mask = np.uint64((1 << 20) - 1)
    m = (h & ~mask) | (mask - np.arange(len(h), dtype=np.uint64))
    k = 1
    while 2 * k <= w:
        m = np.minimum(m[:-k], m[k:])
        k *= 2
    if k < w:
        m = np.minimum(m[: len(m) - (w - k)], m[w - k :])
    return (mask - (m & mask)).astype(np.int64)


def _runs(data: np.ndarray, t: int, g: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(core, hull, a, s, e): runs s..e of starts whose gram is at a. A block has the grams it owns, with all of their
    starts, so no run is cut at its edge."""
    starts, reach = len(data) - t + 1, t - g
    own = max(1, _BLOCK - reach)
    for at in range(0, starts + reach if starts > 0 else 0, own):
        low = max(0, at - reach)
        block = data[low : min(at + own, starts) + t - 1]
        grams = gram_hashes(block, g)
        least = _window_minima(grams, reach + 1)
        cut = np.flatnonzero(np.diff(least)) + 1
        s, e = np.append(0, cut), np.append(cut, len(least)) - 1
        a = least[s]
        mine = (a + low >= at) & (a + low < at + own)
        s, e, a = s[mine], e[mine], a[mine]
        yield grams[a], substring_hashes(block, s, e + t), a + low, s + low, e + low


def _split(data: np.ndarray, a: np.ndarray, s: np.ndarray, e: np.ndarray, t: int, width: int, salt: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(core, hull, s, e, index of the run): pieces of runs at fixed distances from the gram."""
    for at in range(0, len(data), _BLOCK):
        here = np.flatnonzero((s >= at) & (s < at + _BLOCK))
        if not len(here):
            continue
        low = max(0, at - 2 * t)
        roll = Rolling(data[low : at + _BLOCK + 4 * t], _BASE)
        other = Rolling(data[low : at + _BLOCK + 4 * t], _OTHER_BASE) if width == 1 else None
        first = (a[here] - e[here]) // width
        many = (a[here] - s[here]) // width - first + 1
        ends = np.cumsum(many)
        cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1], _PIECES), side="left"))
        for lo, hi in itertools.pairwise([*cuts.tolist(), len(here)]):
            n = many[lo:hi]
            i = np.repeat(here[lo:hi], n)
            k = np.arange(len(i)) - np.repeat(np.cumsum(n) - n - first[lo:hi], n)
            right = a[i] - width * k
            left = right - width + 1
            core = roll(right - low, left + t - low)
            if width == 1:
                hull = other(right - low, right + t - low)
            else:
                inside = (left >= 0) & (right + t <= len(data))
                hull = np.empty(len(i), dtype=np.uint64)
                hull[inside] = roll(left[inside] - low, right[inside] + t - low)
                hull[~inside] = (a[i[~inside]].astype(np.uint64) * np.uint64(_OTHER) + k[~inside].astype(np.uint64)) ^ np.uint64(salt)
                core = core + k.astype(np.uint64) * np.uint64(_OTHER)
            yield core, hull, np.maximum(left, s[i]), np.minimum(right, e[i]), i


def _batch(keys: list, ths: list, parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    cat = lambda k, kind: pa.array(np.concatenate([p[k] for p in parts]).view(kind) if kind == np.int64 else np.concatenate([p[k] for p in parts]).astype(kind))
    n = [len(p[0]) for p in parts]
    cols = [cat(0, np.int64), cat(1, np.int64), pa.array(np.repeat(keys, n), pa.int64()), pa.array(np.repeat(ths, n), pa.int32()), cat(2, np.int32), cat(3, np.int32), cat(4, np.int32), cat(5, bool)]
    return pa.RecordBatch.from_arrays(cols, schema=pa.schema(_ROW))


def _grouped(stream: Iterator, most: int = 200_000) -> Iterator[pa.RecordBatch]:
    ids, ths, parts, n = [], [], [], 0
    for key, th, part in stream:
        ids.append(key), ths.append(th), parts.append(part)
        n += len(part[0])
        if n >= most:
            yield _batch(ids, ths, parts)
            ids, ths, parts, n = [], [], [], 0
    if parts:
        yield _batch(ids, ths, parts)
    give_back()


def _texts(batch: pa.RecordBatch) -> Iterator[tuple]:
    rest = [n for n in batch.schema.names if n != "text"]
    for i, text in enumerate(batch.column("text")):
        yield np.frombuffer(text.as_py().encode(), dtype=np.uint8), *(batch.column(n)[i].as_py() for n in rest)


def first_rows(docs: DataFrame, t: int, g: int) -> DataFrame:
    def run(batches):
        def stream():
            for batch in batches:
                for data, key, th in _texts(batch):
                    for core, hull, a, s, e in _runs(data, t, g):
                        yield key, th, (core, hull, a, s, e, np.zeros(len(a), bool))

        yield from _grouped(stream())

    return docs.where(F.octet_length("text") >= t).select("text", "key", "th").mapInArrow(run, _DDL)


def split_rows(texts: DataFrame, runs: DataFrame, t: int, width: int) -> DataFrame:
    lists = runs.groupBy("key", "th").agg(F.collect_list(F.struct("a", "s", "e", "done")).alias("runs"))

    def run(batches):
        def stream():
            for batch in batches:
                lists = batch.column("runs")
                at, flat = lists.offsets.to_numpy(), lists.values
                fields = [flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)] + [flat.field(3).to_numpy(zero_copy_only=False)]
                for k, (data, key, th) in enumerate(_texts(batch.select(["text", "key", "th"]))):
                    a, s, e, done = (x[at[k] : at[k + 1]] for x in fields)
                    salt = (key * 0x9E3779B97F4A7C15 + th) & ((1 << 64) - 1)
                    for core, hull, lo, hi, i in _split(data, a, s, e, t, width, salt):
                        yield key, th, (core, hull, a[i], lo, hi, done[i])

        yield from _grouped(stream())

    return texts.join(lists, ["key", "th"]).select("text", "key", "th", "runs").mapInArrow(run, _DDL)


def _pass(rows: DataFrame, t: int, last: bool) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Spans found repeated, runs to split, and the rows whose core is not alone."""
    cores = materialize(rows.groupBy("core").agg(F.count("*").alias("n"), F.bool_or(~F.col("done")).alias("open")).where("n > 1 AND open").select("core"), "cores")
    kept = materialize(rows.join(cores, "core", "left_semi"), "kept")
    row = F.min(F.struct("key", "th", "a", "s", "e", "done")).alias("row")
    hulls = materialize(kept.groupBy("core", "hull").agg(F.count("*").alias("n"), row), "hulls")
    equal = materialize(hulls.where("n > 1").select("core", "hull"), "equal")
    spans = materialize(kept.where("NOT done").join(equal, ["core", "hull"], "left_semi").select("key", "th", "s", (F.col("e") + t).alias("e")), "spans")
    if last:
        return spans, None, kept
    open_cores = materialize(hulls.where("n = 1 AND NOT row.done").select("core").distinct(), "open")
    again = hulls.join(open_cores, "core", "left_semi").select("row.key", "row.th", "row.a", "row.s", "row.e", (F.col("row.done") | (F.col("n") > 1)).alias("done"))
    return spans, materialize(again, "runs"), kept


#: A text is set apart before any exchange if more than one row in so many holds it; there are fewer such texts.
_HOT = 1000


def _copies(docs: DataFrame, t: int) -> DataFrame:
    """key, th, rep, hot of texts of t bytes and more that several rows hold: their smallest doc_id, and whether more than
    one row in _HOT holds the text."""
    most = max(1, docs.count() // _HOT)
    found = docs.where(F.col("n_bytes") >= t).groupBy("key", "th").agg(F.count("*").alias("n"), F.min("doc_id").alias("rep")).where("n > 1")
    return materialize(found.select("key", "th", "rep", (F.col("n") > most).alias("hot")), "copies")


def remove_repeats(docs: DataFrame, threshold: int = THRESHOLD, gram: int = GRAM, split: int = SPLIT, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans and (with_text) kept_text of every row of docs.

    Texts are UTF-8 bytes; matches never cross texts. A null text is empty and has nothing to remove, as has
    any text shorter than threshold. Rows are texts of their own whether they repeat a doc_id or have none; if two are
    equal, they repeat each other. Other columns don't matter. Texts of any length are handled in blocks of about 1 MB. An
    empty table gives no rows. kept_text is null where the remaining bytes are not UTF-8. Substrings are compared by two
    hashes of 61 bits.
    """
    spark = docs.sparkSession
    t = threshold
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    docs = docs.withColumns({"key": F.xxhash64("text"), "th": F.hash("text", F.lit(1)), "n_bytes": F.octet_length("text").cast("long")})
    many = _copies(docs, t)
    hot = F.broadcast(many.where("hot"))  # fewer than _HOT rows
    hot_rows = docs.join(hot, ["key", "th"])
    one_each = hot_rows.where(F.col("doc_id").eqNullSafe(F.col("rep"))).dropDuplicates(["key", "th"])
    docs = docs.join(hot, ["key", "th"], "left_anti").unionByName(one_each.select(*docs.columns))
    first = materialize(first_rows(docs, t, gram), "suffixes")
    spans, runs, kept = _pass(first, t, False)
    drop_table(first)
    touched = materialize(kept.select("key", "th").distinct().withColumn("touched", F.lit(True)).join(many.withColumn("copied", F.lit(True)), ["key", "th"], "full"), "touched")
    drop_table(kept)
    release(spark)
    docs = docs.join(touched, ["key", "th"], "left")
    whole = F.when(F.col("touched").isNull() & F.col("copied").isNull(), F.sha2("text", 256))
    needed = F.col("touched").isNotNull() & (F.col("copied").isNull() | F.col("doc_id").eqNullSafe(F.col("rep")))
    docs = docs.select("doc_id", "key", "th", "n_bytes", "touched", "copied", "hot", needed.alias("needed"), whole.alias("whole"), (F.col("text") if with_text else F.when(needed, F.col("text"))).alias("text"))
    docs = materialize(docs, "texts")
    release(spark)
    alone = docs.where("touched AND copied IS NULL")
    texts = alone.select("text", "key", "th").union(docs.where("needed AND copied").select("text", "key", "th").dropDuplicates(["key", "th"]))
    for width in (split, 1):
        rows = materialize(split_rows(texts, runs, t, width), "suffixes")
        more, runs, kept = _pass(rows, t, width == 1)
        spans = spans.union(more)
        drop_table(rows)
        drop_table(kept)
    lists = spans.groupBy("key", "th").agg(F.collect_list(F.struct("s", "e")).alias("runs"))
    zero, spans_type = F.lit(0).cast("long"), "array<struct<s:int,e:int>>"
    untouched = docs.where("whole IS NOT NULL").select("doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.col("whole").alias("kept_sha256"), F.array().cast(spans_type).alias("spans"), F.col("text").alias("kept_text"))
    gone = docs.where("copied AND NOT hot").select("doc_id", "n_bytes").union(hot_rows.select("doc_id", "n_bytes"))
    entire = F.array(F.struct(F.lit(0).alias("s"), F.col("n_bytes").cast("int").alias("e"))).cast(spans_type)
    gone = gone.select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(hashlib.sha256().hexdigest()).alias("kept_sha256"), entire.alias("spans"), F.lit("").alias("kept_text"))
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))), ("kept_text", pa.string())]

    def cut(batches):
        for batch in batches:
            rows = []
            lists = batch.column("runs")
            ends, flat = lists.offsets.to_numpy(), lists.values
            lo, hi = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(2))
            for k, (data, doc_id) in enumerate(_texts(batch.select(["text", "doc_id"]))):
                s, e = lo[ends[k] : ends[k + 1]], hi[ends[k] : ends[k + 1]]
                order = np.argsort(s, kind="stable")
                s, e = s[order], np.maximum.accumulate(e[order]) if len(e) else e
                cut_at = np.flatnonzero(s[1:] > e[:-1]) + 1
                merged = list(zip(s[np.append(0, cut_at)].tolist(), e[np.append(cut_at, len(e)) - 1].tolist(), strict=True)) if len(s) else []
                raw, at, left = data.tobytes(), 0, []
                for s, e in merged:
                    left.append(raw[at:s])
                    at = e
                rest = b"".join([*left, raw[at:]])
                try:
                    kept = rest.decode() if with_text else None
                except UnicodeDecodeError:
                    kept = None
                rows.append((doc_id, len(raw), len(raw) - len(rest), len(merged), hashlib.sha256(rest).hexdigest(), [{"s": s, "e": e} for s, e in merged], kept))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(fields)], schema=pa.schema(fields))

    parts = alone.join(lists, ["key", "th"], "left").select("text", "doc_id", "runs").mapInArrow(cut, f"doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans {spans_type}, kept_text string")
    out = untouched.union(gone).union(parts)
    return out if with_text else out.drop("kept_text")
