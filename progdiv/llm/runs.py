"""Maximal runs of repeated words: stretches of smallest period q that hold at least EXPONENT periods.

Harmonic grid: for each period p, words jp and (j+1)p are compared, and how far the text keeps period p before and after
them comes from the longest common extensions of both places, forward by the suffix array of the words with least
common prefixes and range minima, backward by those of the reversed words. A run of EXPONENT periods has as many points
of the grid in a row that hold one word, so only such places are asked for, and only texts with such a place get arrays.
Each period that a run has meets it as one stretch, so the first that is seen, the smallest, is kept.

A task handles the texts of about a megabyte together: their words, each text closed by a number of its own, are one sequence, longest
text first, so that a period concerns a prefix of it. A text of more than BLOCK words goes alone: small periods by blocks that
overlap, large ones, which have few points in the grid, by comparing words, so that memory stays in proportion to the text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from progdiv.llm.common import give_back

EXPONENT, LEAST = 4, 6
#: Words of which arrays are made at once.
BLOCK = 1 << 17
_BATCH = 1 << 20
_CHUNK = 1 << 16


class Extensions:
    """Longest common prefixes of any two suffixes of a sequence of numbers, by suffix array and range minima."""

    def __init__(self, words: np.ndarray) -> None:
        n = len(words)
        ranks = [np.unique(words, return_inverse=True)[1].astype(np.int32)]
        width = 1
        order = np.argsort(ranks[0], kind="stable")
        while int(ranks[-1].max()) + 1 < n and width < n:  # twice the width each time, until all suffixes differ
            rank = ranks[-1]
            after = np.zeros(n, np.int64)
            after[: n - width] = rank[width:] + 1
            both = rank.astype(np.int64) * (n + 1) + after
            order = np.argsort(both, kind="stable")
            new = np.empty(n, np.int32)
            new[order] = np.concatenate([[0], np.cumsum(both[order][1:] != both[order][:-1])])
            ranks.append(new)
            width *= 2
        self.n, self.place = n, ranks[-1]
        a, b = order[:-1].astype(np.int64), order[1:].astype(np.int64)
        least = np.zeros(n - 1, np.int32)
        for k in range(len(ranks) - 2, -1, -1):  # neighbours of the suffix array by halves: equal ranks are 2**k equal words
            inside = np.flatnonzero((a < n) & (b < n))
            inside = inside[ranks[k][a[inside]] == ranks[k][b[inside]]]
            least[inside] += 1 << k
            a[inside] += 1 << k
            b[inside] += 1 << k
            ranks[k] = ranks[k][:0].copy()
        self.minima = [least]
        while 2 << len(self.minima) - 1 < n:
            below, half = self.minima[-1], 1 << len(self.minima) - 1
            self.minima.append(np.minimum(below[:-half], below[half:]))

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For different places i and j; places at the end have nothing in common with others."""
        out = np.zeros(len(i), np.int64)
        inside = np.flatnonzero((i < self.n) & (j < self.n))
        x, y = self.place[i[inside]].astype(np.int64), self.place[j[inside]].astype(np.int64)
        lo, hi = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[inside[at]] = np.minimum(self.minima[k][lo[at]], self.minima[k][hi[at] - (1 << int(k))])
        return out


def _grid(words: np.ndarray, upto: np.ndarray, low: int = 1, exponent: int = EXPONENT) -> Iterator[tuple[int, np.ndarray]]:
    """(p, places jp) where exponent points of the grid of p in a row hold one word; upto[p - low]: words to look at."""
    for p, end in enumerate(upto.tolist(), low):
        points = words[:end:p]
        if len(points) < exponent:
            continue
        same = points[1:] == points[:-1]
        row = same[: len(same) - exponent + 2].copy()
        for k in range(1, exponent - 1):
            row &= same[k : len(same) - exponent + 2 + k]
        found = np.flatnonzero(row)
        if len(found):
            yield p, found * p


def _distinct(start: np.ndarray, end: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One run for each stretch, of the least period."""
    order = np.lexsort((p, end, start))
    start, end, p = start[order], end[order], p[order]
    first = np.ones(len(p), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[first], end[first], p[first]


def _by_arrays(words: np.ndarray, places: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches around candidates that keep period p for long enough: (start, end, p)."""
    found = Extensions(words)(places, places + p)
    reverse = Extensions(words[::-1])
    n = len(words)
    start = places - reverse(n - places, n - places - p)
    end = places + p + found
    long = end - start >= np.maximum(LEAST, EXPONENT * p)
    return _distinct(start[long], end[long], p[long])


def _candidates(grid: Iterator[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    got = list(grid)
    if not got:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([at for _, at in got]).astype(np.int64), np.repeat([p for p, _ in got], [len(at) for _, at in got]).astype(np.int64)


def runs_of_texts(texts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start, end, period) of the runs of every text, given as numbers of words from 0, ordered by start and period."""
    out = [(np.zeros(0, np.int64),) * 3 for _ in texts]
    for i, t in enumerate(texts):
        if len(t) > BLOCK:
            out[i] = _long(t)
    order = sorted((i for i, t in enumerate(texts) if LEAST <= len(t) <= BLOCK), key=lambda i: -len(texts[i]))
    if not order:
        return out
    sizes = np.array([len(texts[i]) + 1 for i in order])
    ends = np.cumsum(sizes)
    # Each text is closed by a number that no word has.
    words = np.concatenate([np.append(texts[i], -1 - k) for k, i in enumerate(order)])
    most = (sizes[0] - 1) // EXPONENT
    enough = np.searchsorted(-(sizes - 1), -np.maximum(LEAST, EXPONENT * np.arange(1, most + 1)), side="right")
    places, p = _candidates(_grid(words, ends[enough - 1]))
    if not len(p):
        return out
    # Only texts with a candidate get arrays.
    text = np.searchsorted(ends, places, side="right")
    some = np.unique(text)
    begins = ends - sizes
    at = np.cumsum(np.append(0, sizes[some]))
    words = np.concatenate([words[begins[k] : ends[k]] for k in some])
    places = places - begins[text] + at[np.searchsorted(some, text)]
    start, end, p = _by_arrays(words, places, p)
    text = np.searchsorted(at, start, side="right") - 1
    for k, (lo, hi) in enumerate(zip(np.searchsorted(text, np.arange(len(some))), np.searchsorted(text, np.arange(len(some)), side="right"), strict=True)):
        if hi > lo:
            out[order[some[k]]] = _sorted(start[lo:hi] - at[k], end[lo:hi] - at[k], p[lo:hi])
    return out


def _sorted(start: np.ndarray, end: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((p, start))
    return start[order], end[order], p[order]


def _matching(words: np.ndarray, i: int, p: int, step: int) -> int:
    """How many places in a row from i, forward (step 1) or backward (-1), hold the word that is p further on."""
    n, width = 0, 64
    while True:
        lo, hi = (i + n, min(i + n + width, len(words) - p)) if step > 0 else (max(i - n - width + 1, 0), i - n + 1)
        if lo >= hi:
            return n
        same = words[lo:hi] == words[lo + p : hi + p]
        if not same.all():
            return n + int(np.argmin(same if step > 0 else same[::-1]))
        n, width = n + hi - lo, min(2 * width, _CHUNK)


def _long(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of one text of more than BLOCK words. Blocks overlap by half, so a run of a period up to BLOCK / 8 has EXPONENT
    periods inside one; where it meets the block's edge its end is looked for in the text."""
    n, most = len(words), BLOCK // 8
    found: dict[tuple[int, int], int] = {}
    by_period: dict[int, list[tuple[int, int]]] = {}
    large: list[tuple[int, int, int]] = []

    def extend(start: int, end: int, p: int) -> None:
        known = by_period.get(p)
        if known and known[-1][0] <= start and end <= known[-1][1]:
            return
        start -= _matching(words, start - 1, p, -1) if start else 0
        end += _matching(words, end - p, p, 1)
        by_period.setdefault(p, []).append((start, end))
        if end - start >= max(LEAST, EXPONENT * p):
            found[start, end] = min(p, found.get((start, end), p))
            if end - start > (EXPONENT - 1) * most:
                large.append((start, end, p))

    for at in range(0, n, BLOCK // 2):
        block = words[at : at + BLOCK]
        upto = np.full(min(most, len(block) // EXPONENT), len(block))
        places, p = _candidates(_grid(block, upto))
        for lo in range(0, len(p), 1 << 22):
            for s, e, q in zip(*(x.tolist() for x in _by_arrays(np.append(block, -1), places[lo : lo + (1 << 22)], p[lo : lo + (1 << 22)])), strict=True):
                if s > 0 and e < len(block) or (s == 0 and at == 0 and e < len(block)):
                    found[s + at, e + at] = min(q, found.get((s + at, e + at), q))
                else:
                    extend(s + at, e + at, q)
        if at + BLOCK >= n:
            break
    for p, places in _grid(words, np.full(n // EXPONENT - most, n), most + 1):
        for i in places.tolist():
            last = i + (EXPONENT - 1) * p
            # Inside a known run whose period divides p the stretch of period p is that run.
            if not any(s <= i and last < e and p % q == 0 for s, e, q in large):
                extend(i, i + p, p)
    start, end = (np.array([k[x] for k in found], np.int64) for x in range(2))
    return _sorted(*_distinct(start, end, np.array(list(found.values()), np.int64)))


def edited(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, from a place on repeated with a period, both by a hash of doc_id, in one document of ten. Without doc_id as they are."""
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    unit = words[a : a + p]
    return words[:a] + (unit * (-(-(n - a) // p)))[: n - a]


def _rows(ids: list, texts: list[list[bytes]]) -> Iterator[tuple]:
    numbers: dict[bytes, int] = {}
    coded = [np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64) for words in texts]
    del numbers
    for doc_id, words, (start, end, p) in zip(ids, texts, runs_of_texts(coded), strict=True):
        lines, best, gone = [], (None,) * 4, None
        if len(p):
            length = end - start
            k = np.lexsort((p, start, -length))[0]
            best = (int(start[k]), int(length[k]), int(p[k]), int(1000 * length[k] // p[k]))
            steps = np.zeros(len(words) + 1, np.int64)
            np.add.at(steps, start + p, 1)
            np.add.at(steps, end, -1)
            gone = np.cumsum(steps[:-1]) > 0
            lines = [f"{s},{n},{q}\n" for s, n, q in zip(start.tolist(), length.tolist(), p.tolist(), strict=True)]
        kept = words if gone is None else [words[i] for i in np.flatnonzero(~gone)]
        yield doc_id, words, start, end, p, best, "".join(lines), b" ".join(kept)


def collapse_runs(docs: DataFrame, edit: bool = False, with_text: bool = False) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 (and runs, collapsed) of every row.

    Words are what white space of ASCII parts, compared exactly. A null or empty text, or one of white space, has no words and no
    runs. start, length, period and exponent_milli are those of the longest run, ties by start and then period, or null without
    one. collapsed: all words but those in a run after its first period, joined by one space. edit: of one document
    in ten, by doc_id, a part is made periodic first. Rows that repeat a doc_id or a text are handled each, as are those without
    doc_id; texts of any length are handled whole; other columns don't matter; an empty table gives no rows.
    """
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    numbers = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli"]
    fields = [(n, pa.int64()) for n in numbers] + [("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())] + [("runs", run_type), ("collapsed", pa.string())] * with_text

    def run(batches):
        for batch in batches:
            ids, texts, size, n = [], [], 0, 0
            out: list[tuple] = []
            for i, (doc_id, text) in enumerate(zip(batch.column("doc_id"), batch.column("text"), strict=True), 1):
                key, raw = doc_id.as_py(), text.as_py().encode()
                ids.append(key)
                texts.append(edited(raw.split(), key) if edit else raw.split())
                size, n = size + len(raw), n + len(texts[-1])
                if size < _BATCH and n < BLOCK and i < batch.num_rows:
                    continue
                for key, _, start, end, p, best, lines, rest in _rows(ids, texts):
                    row = (key, len(p), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(rest).hexdigest())
                    if with_text:
                        row += ([{"start": s, "length": e - s, "period": q} for s, e, q in zip(start.tolist(), end.tolist(), p.tolist(), strict=True)], rest.decode())
                    out.append(row)
                ids, texts, size, n = [], [], 0, 0
            cols = list(zip(*out, strict=True)) if out else [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True)], schema=pa.schema(fields))
        give_back()

    ddl = ", ".join(f"{n} bigint" for n in numbers) + ", runs_sha256 string, collapsed_sha256 string"
    ddl += ", runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string" * with_text
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return docs.mapInArrow(run, ddl)
