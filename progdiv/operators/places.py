"""N-grams of texts as numbers, made and counted on Arrow batches: a task's repeats are left out before anything is dealt or sketched."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from progdiv.operators.overlap import dealt
from progdiv.operators.problems import lengths, numbers, starts

#: Words of one group that are looked at together, and bits of a number by which n-grams are dealt.
WORDS, BITS = 1 << 20, 10


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def different_of(x: np.ndarray) -> np.ndarray:
    """Each number once, in order. Sorting 64-bit numbers is many times faster than numpy's own unique, which hashes them."""
    x = np.sort(x)
    return x[starts(x)]


def word_hashes(words: pa.Array) -> np.ndarray:
    """64 bits a word; each different one is hashed once."""
    different = words.dictionary_encode()
    made = pd.util.hash_array(np.array(different.dictionary.to_pylist(), object), categorize=False)
    return np.concatenate([np.zeros(1, np.uint64), made])[numbers(different)]


def found_grams(batches: Iterable[pa.RecordBatch], keys: int, orders: range) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], list[int]]]:
    """For WORDS words of a group at a time: a row that has its keys, and of each order the different n-grams that start there, in order
    of their 64-bit numbers, and how many n-grams start there. Columns of batches: the keys, tokens."""
    highest = orders.stop - 1
    for batch in batches:
        codes = [numbers(batch.column(i)) for i in range(keys)] or [np.zeros(batch.num_rows, np.int64)]
        batch = batch.take(pa.array(np.lexsort(codes)))
        size = lengths(batch.column(keys))
        words, done = word_hashes(batch.column(keys).flatten()), np.cumsum(size)
        end = np.repeat(done, size)
        first = starts(*(numbers(batch.column(i)) for i in range(keys))) if keys else np.zeros(min(1, batch.num_rows), np.int64)
        for row, last in zip(first, np.append(first, batch.num_rows)[1:], strict=True):
            begin, stop = done[row] - size[row], done[last - 1]
            for low in range(begin, stop, WORDS):
                high = min(low + WORDS, stop)
                w, left = words[low : min(high + highest - 1, stop)], end[low:high] - np.arange(low, high)
                h, different, total = w, [], []
                for n in range(1, highest + 1):
                    h = mix(h if n == 1 else h[: max(0, len(w) - n + 1)] * np.uint64(0x9E3779B97F4A7C15) + w[n - 1 :])
                    if n in orders:
                        some = h[: high - low]
                        some = some[left[: len(some)] >= n]
                        different.append(different_of(some))
                        total.append(len(some))
                yield batch.slice(row, 1), different, total


def packed(batches: Iterable[pa.RecordBatch], keys: int, orders: range) -> Iterator[pa.RecordBatch]:
    """Rows (keys, n, _w1, _grams, _c): the first bits of n-grams, those n-grams as bytes, and in one row the number of all."""
    for key, different, total in found_grams(batches, keys, orders):
        for n, grams, c in zip(orders, different, total, strict=True):
            if not c:
                continue
            part = (grams >> np.uint64(64 - BITS)).astype(np.int32)
            first = starts(part)
            ends = np.append(first, len(grams)).astype(np.int32) * 8
            data = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(grams)])
            given = [key.column(i).take(pa.array(np.zeros(len(first), np.int64))) for i in range(keys)]
            counts = np.zeros(len(first), np.int64)
            counts[0] = c
            yield pa.RecordBatch.from_arrays([*given, pa.array(np.full(len(first), n, np.int32)), pa.array(part[first]), data, pa.array(counts)], [*key.schema.names[:keys], "n", "_w1", "_grams", "_c"])


def counted(batches: Iterable[pa.RecordBatch], keys: list[str], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows (keys, n, n_distinct, n_total) for adding up, of what packed gives in order of keys, n and _w1; numbers of one such group only
    are in memory, and each once if they are many."""
    now, held, many, total, out = None, [], 0, 0, []

    def flushed():
        return dict(zip([*keys, "n"], now, strict=False)) | {"n_distinct": len(different_of(np.concatenate(held))), "n_total": total}

    for batch in batches:
        by = [*keys, "n", "_w1"]
        first = starts(*(numbers(batch.column(c)) for c in by)) if batch.num_rows else []
        grams, counts = batch.column("_grams"), batch.column("_c").to_numpy()
        ends = np.append(first, batch.num_rows)[1:]
        for group, low, high in zip(zip(*(batch.column(c).take(pa.array(first)).to_pylist() for c in by), strict=True), first, ends, strict=True):
            if group != now and held:
                out.append(flushed())
                held, many, total = [], 0, 0
            now = group
            held += [np.frombuffer(g.as_buffer(), np.uint64) for g in grams.slice(low, high - low)]
            many, total = many + sum(map(len, held[-(high - low) :])), total + int(counts[low:high].sum())
            if many > 1 << 21:
                held, many = [different_of(np.concatenate(held))], 0
        if out:
            yield from pa.Table.from_pylist(out, schema).to_batches()
            out = []
    if held:
        yield from pa.Table.from_pylist([flushed()], schema).to_batches()


def distinct(frame: DataFrame, keys: list[str], tokens: str, orders: range) -> DataFrame:
    """Rows (keys, n, n_distinct, n_total). N-grams are dealt by their first bits, many in one row."""
    rows = frame.select(*keys, F.col(tokens).alias("_t"))
    own, count = [rows.schema[k] for k in keys], StructField("n", IntegerType())
    schema = StructType([*own, count, StructField("_w1", IntegerType()), StructField("_grams", BinaryType()), StructField("_c", LongType())])
    n_keys = len(keys)
    rows = rows.mapInArrow(lambda batches: packed(batches, n_keys, orders), schema)
    rows = dealt(rows, *keys, "_w1").sortWithinPartitions(*keys, "n", "_w1")
    schema = StructType([*own, count, StructField("n_distinct", LongType()), StructField("n_total", LongType())])

    def in_arrow(batches):
        for batch in batches:
            kinds = pa.schema([*(batch.schema.field(k) for k in keys), ("n", pa.int32()), ("n_distinct", pa.int64()), ("n_total", pa.int64())])
            yield from counted((b for part in ([batch], batches) for b in part), keys, kinds)

    found = rows.mapInArrow(in_arrow, schema)
    return found.groupBy(*keys, "n").agg(F.sum("n_distinct").alias("n_distinct"), F.sum("n_total").alias("n_total"))


def aside(batches: Iterable[pa.RecordBatch], keys: int, orders: range) -> Iterator[pa.RecordBatch]:
    """Rows (keys, _h<n>, _c<n> of each order n): n-grams of all orders side by side, each once for WORDS words, and in one row the number
    of all."""
    for key, different, total in found_grams(batches, keys, orders):
        most = max(map(len, different))
        for low in range(0, most, 1 << 14):
            size = min(1 << 14, most - low)
            columns = []
            for h, c in zip(different, total, strict=True):
                h = h[low : low + size].view(np.int64)
                columns += [pa.concat_arrays([pa.array(h), pa.nulls(size - len(h), pa.int64())]), pa.concat_arrays([pa.array([0 if low else c]), pa.nulls(size - 1, pa.int64())])]
            given = [key.column(i).take(pa.array(np.zeros(size, np.int64))) for i in range(keys)]
            yield pa.RecordBatch.from_arrays([*given, *columns], [*key.schema.names[:keys], *(f"{c}{n}" for n in orders for c in ("_h", "_c"))])


def side_by_side(frame: DataFrame, keys: list[str], tokens: str, orders: range) -> DataFrame:
    """What aside gives: each column has a group's n-grams of one order, whatever the others have in that row."""
    rows = frame.select(*keys, F.col(tokens).alias("_t"))
    schema = StructType([*(rows.schema[k] for k in keys), *(StructField(f"{c}{n}", LongType()) for n in orders for c in ("_h", "_c"))])
    n_keys = len(keys)
    return rows.mapInArrow(lambda batches: aside(batches, n_keys, orders), schema)
