"""Metrics of whole problems on Arrow batches: a task's rows come in order of problem, and all problems of a block are counted at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows of a block at least, but for the last one, and n-grams looked up at once.
ROWS, LOOKED_UP = 1 << 15, 1 << 21


def numbers(column: pa.Array) -> np.ndarray:
    """Numbers from 1 for the values of a column, equal where these are; 0 for null."""
    return pc.fill_null(column.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1


def lengths(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def starts(*values: np.ndarray) -> np.ndarray:
    """Places at which one of the values is not the one before."""
    new = np.ones(len(values[0]), bool)
    new[1:] = np.logical_or.reduce([v[1:] != v[:-1] for v in values])
    return np.flatnonzero(new)


def blocks(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Rows in order of key as tables of whole keys."""
    held, n, least = [], 0, ROWS
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last = int(starts(numbers(table[key].combine_chunks()))[-1])
        if last:
            yield table.slice(0, last)
        held, n = table.slice(last).to_batches(), n - last
        least = max(ROWS, 2 * n)  # a key of many rows is not looked at for every batch
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def grams(tokens: pa.Array, highest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of every order its number and of each n-gram the row and a number, equal where n-grams are: no hashes."""
    words, size = numbers(tokens.flatten()), lengths(tokens)
    row, end = np.repeat(np.arange(len(size)), size), np.repeat(np.cumsum(size), size)
    place, ids, most = np.arange(len(words)), words, int(words.max(initial=0)) + 1
    for n in range(1, highest + 1):
        if n > 1:
            more = place + n <= end[place]
            place = place[more]
            ids = np.unique(ids[more] * most + words[place + n - 1], return_inverse=True)[1].astype(np.int64)
        yield n, row[place], ids


def distinct_shares(problem: np.ndarray, has: np.ndarray, found: dict, orders: range, n_problems: int) -> list[np.ndarray]:
    """Of every order and type the distinct share of a problem's n-grams; NaN for at most one."""
    out = []
    for n in orders:
        row, ids = found[n]
        key = problem[row] * (int(ids.max(initial=0)) + 1) + ids
        order = np.argsort(key)
        first = starts(key[order])
        of = problem[row[order[first]]] if len(first) else np.zeros(0, np.int64)
        for h in has:
            distinct = np.bincount(of[np.logical_or.reduceat(h[row[order]], first)], minlength=n_problems) if len(first) else np.zeros(n_problems)
            total = np.bincount(problem[row[h[row]]], minlength=n_problems)
            out.append(np.where(total > 1, distinct / np.maximum(total, 1), np.nan))
    return out


class Counted:
    """N-grams of rows with their counts: of each row its elements, (order, n-gram, k) for the k-th time that it is there, in order.
    What two rows have in common is what their counts have, the smaller one of each n-gram."""

    def __init__(self, found: dict, highest: int, n_rows: int):
        parts, offset = [], 0
        for n in range(1, highest + 1):
            row, ids = found[n]
            order = np.lexsort((ids, row))
            row, ids = row[order], ids[order]
            first = starts(row, ids)
            k = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
            parts.append((row, np.full(len(row), n - 1), ids + offset, k))
            offset += int(ids.max(initial=0)) + 1
        row, order, ids, k = (np.concatenate(p) for p in zip(*parts, strict=True))
        element = np.unique(ids * (int(k.max(initial=0)) + 1) + k, return_inverse=True)[1].astype(np.int64)
        self.most = int(element.max(initial=0)) + 1
        key = row * self.most + element
        by = np.argsort(key)
        self.key, self.element, self.order, self.first = key[by], element[by], order[by], k[by] == 0
        self.size = np.bincount(row, minlength=n_rows)
        self.at = np.cumsum(self.size) - self.size
        self.highest = highest

    def common(self, a: np.ndarray, b: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs of rows the n-grams in common of each order, and the distinct ones of order gram."""
        size = self.size[a]
        pair = np.repeat(np.arange(len(a)), size)
        place = np.arange(len(pair)) + np.repeat(self.at[a] - (np.cumsum(size) - size), size)
        wanted = np.repeat(b * self.most, size) + self.element[place]
        hit = np.flatnonzero(self.key[np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)] == wanted) if len(self.key) else np.zeros(0, np.int64)
        pair, place = pair[hit], place[hit]
        hits = np.bincount(pair * self.highest + self.order[place], minlength=len(a) * self.highest).reshape(len(a), self.highest)
        once = self.first[place] & (self.order[place] == gram - 1)
        return hits, np.bincount(pair[once], minlength=len(a))


def bleu_distances(la: np.ndarray, lb: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """lexical.bleu_distance on arrays, hits having a column an order."""
    log_sum, eff, smooth, some = np.zeros(len(la)), np.zeros(len(la)), np.ones(len(la)), hits.any(axis=1)
    for k in range(hits.shape[1]):
        total, hit = la - k, hits[:, k]
        scored = total > 0
        smooth = np.where(scored & (hit == 0), smooth * 2, smooth)
        p = np.where(hit == 0, 100.0 / (smooth * np.maximum(total, 1)), 100.0 * hit / np.maximum(total, 1))
        log_sum = np.where(scored, log_sum + np.log(np.where(p > 0, p, 1.0)), log_sum)
        eff = np.where(scored, k + 1, eff)
    short = np.where((la < lb) & (la > 0), np.exp(np.minimum(1 - lb / np.maximum(la, 1), 0)), 1.0)
    return 100 - np.where(some & (eff > 0), short * np.exp(log_sum / np.maximum(eff, 1)), 0.0)


def pair_means(problem: np.ndarray, member: np.ndarray, has: np.ndarray, size: np.ndarray, found: dict, gram: int, bleu: int, n_problems: int) -> list[np.ndarray]:
    """Of every type the mean Jaccard distance of a problem's pairs, then the mean BLEU distance; each pair is met once for all types,
    and so many at a time that LOOKED_UP n-grams are in memory."""
    rows = len(problem)
    counted = Counted(found, max(bleu, gram), rows)
    sets = np.bincount(counted.key[counted.first & (counted.order == gram - 1)] // counted.most, minlength=rows)
    until = lambda *v: (lambda at: np.repeat(np.append(at, rows)[1:], np.diff(np.append(at, rows))))(starts(*v))
    after, end = until(problem, member), until(problem)  # a row meets those of greater numbers only
    pairs = end - after
    done, cost = np.cumsum(pairs), np.maximum(counted.size, 1)
    spent = np.cumsum(pairs * cost)
    marks = np.arange(LOOKED_UP, int(spent[-1]) if rows else 0, LOOKED_UP)
    at = np.searchsorted(spent, marks)
    cuts = np.unique(np.concatenate([[0], done[at] - (spent[at] - marks) // cost[at], done[-1:]])).astype(np.int64)
    sums = np.zeros((2, 2, len(has), n_problems))
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        p = np.arange(low, high)
        a = np.searchsorted(done, p, side="right")
        b = after[a] + p - (done[a] - pairs[a])
        hits, shared = counted.common(a, b, gram)
        distance = bleu_distances(size[a], size[b], hits[:, :bleu])
        some, every = (sets[a] > 0) & (sets[b] > 0), sets[a] + sets[b] - shared
        alike = shared / np.maximum(every, 1)
        for i, h in enumerate(has):
            both = h[a] & h[b]
            for m, (value, counts) in enumerate(((alike, both & some), (distance, both))):
                sums[m, 0, i] += np.bincount(problem[a[counts]], value[counts], n_problems)
                sums[m, 1, i] += np.bincount(problem[a[counts]], minlength=n_problems)
    with np.errstate(invalid="ignore"):
        alike, distance = ([s / n for s, n in zip(total, of, strict=True)] for total, of in sums)
    return [1 - a for a in alike] + distance


def cosine_distances(problem: np.ndarray, has: np.ndarray, vectors: pa.Array, n_problems: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of every type the mean cosine distance of a problem's pairs as in embedding.cosine_distance, and where it is undefined."""
    size, flat = lengths(vectors), vectors.flatten()
    row = np.repeat(np.arange(len(size)), size)
    unit = np.zeros((len(size), int(size.max(initial=0))))
    unit[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False)
    known = pc.is_valid(vectors).to_numpy(zero_copy_only=False)
    known[row[pc.is_null(flat).to_numpy(zero_copy_only=False)]] = False
    norm = np.sqrt((unit * unit).sum(axis=1))
    zero = known & (norm == 0)
    with np.errstate(invalid="ignore"):
        unit /= np.where(norm == 0, 1.0, norm)[:, None]
    first, out = starts(problem), []
    for h in has:
        counts = h & known
        own = np.where((counts & ~zero)[:, None], unit, 0.0)
        twice = np.zeros(n_problems)
        if len(first):
            twice[problem[first]] = (np.add.reduceat(own, first, axis=0) ** 2).sum(axis=1) - np.add.reduceat((own * own).sum(axis=1), first)
        n = np.bincount(problem[counts], minlength=n_problems)
        pairs = n * (n - 1) / 2
        none = (pairs == 0) | (np.bincount(problem[zero & h], minlength=n_problems) > 0)
        out.append(((pairs - twice / 2) / np.maximum(pairs, 1), none))
    return out


def measured(batches: Iterable[pa.RecordBatch], orders: range, gram: int, bleu: int, types: int) -> Iterator[pa.RecordBatch]:
    """A row a problem: problem_id and found, of each metric (distinct shares by order, Jaccard, BLEU and cosine distances) the values of
    all types, null where undefined. Rows: problem_id, generation_id, mask of types, tokens, vector, in order of the first two."""
    for table in blocks(batches, "problem_id"):
        column = lambda name, t=table: t[name].combine_chunks()
        first = starts(numbers(column("problem_id")))
        problem = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(table))))
        mask = column("mask").to_numpy(zero_copy_only=False)
        kept = np.flatnonzero(mask > 0)
        member, problem, mask = numbers(column("generation_id"))[kept], problem[kept], mask[kept]
        has = np.array([(mask >> i & 1).astype(bool) for i in range(types)])
        tokens = column("tokens").take(pa.array(kept))
        found = {n: (row, ids) for n, row, ids in grams(tokens, max(orders.stop - 1, bleu, gram))}
        values = distinct_shares(problem, has, found, orders, len(first)) + pair_means(problem, member, has, lengths(tokens), found, gram, bleu, len(first))
        cosine = cosine_distances(problem, has, column("vector").take(pa.array(kept)), len(first))
        flat = np.stack([*values, *(v for v, _ in cosine)], axis=1)
        none = np.stack([*(np.isnan(v) for v in values), *(n for _, n in cosine)], axis=1)
        ends = pa.array(np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32))
        yield pa.RecordBatch.from_arrays([column("problem_id").take(pa.array(first)), pa.ListArray.from_arrays(ends, pa.array(flat.ravel(), mask=none.ravel()))], ["problem_id", "found"])
