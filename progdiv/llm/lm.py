"""Language-model scores of texts by a weighted backoff automaton.

States are the contexts seen in training, of up to order - 1 tokens (the start of a text counts as one), above one
root. An arc of a state carries the smoothed probability of a token after that context; where a state has no arc for a
token, its failure arc leads to the state of the context without its first token, with a backoff weight. A context h
seen c(h) times gives token w the probability (c(hw) + m * p(w)) / (c(h) + m), p being that of the state its failure
arc leads to and m the number of different n-grams of hw's length for each one of h's; the failure weight is
m / (c(h) + m). At the root words are discounted absolutely, and what they give up goes to the unknown word.

Texts are dealt into batches. A batch sends each of its distinct n-grams once, with its count, to the bucket of the
n-gram's hash; buckets add up counts over all batches and answer with totals, so a batch gets the part of the
automaton that its own texts can reach. Every n-gram is a key of its own, so a common word's continuations are spread
over all buckets. No model is ever held whole by any process.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from progdiv.llm.common import give_back, materialize, mix, pieces_of, release, text_buffer, word_bounds, word_hashes

#: Tokens of an n-gram at most, and text bytes of a batch and a bucket.
ORDER, BATCH, BUCKET = 3, 6 << 20, 12 << 20
#: Tokens that no word's hash is likely to equal: the start of a text and its end.
START, END = np.uint64(0x5BD1E995A3C59AC3), np.uint64(0x1B873593CC9E2D51)
#: Bits of hash that tell words and longer n-grams of one bucket apart.
_WORD_BITS, _GRAM_BITS = 56, 44


class Grams:
    """The distinct n-grams of some texts: by length their sorted keys, counts in training and buckets' edges, and which
    of them ends at each place. Places are each text's START, words and END; -1 where no n-gram of the length ends."""

    def __init__(self, column, train: np.ndarray, buckets: int, order: int) -> None:
        data, offsets = text_buffer(column)
        starts, ends = word_bounds(data, offsets)
        at = np.searchsorted(starts, offsets)
        words = np.insert(word_hashes(data, starts, ends), np.stack([at[:-1], at[1:]], axis=1).ravel(), np.tile([START, END], len(offsets) - 1))
        self.lengths = np.diff(at) + 2
        self.first = np.cumsum(self.lengths) - self.lengths
        self.place = np.arange(len(words)) - np.repeat(self.first, self.lengths)
        learned = np.repeat(train, self.lengths)
        self.keys, self.counts, self.edges, self.ends_at = [], [], [], []
        h = words
        for k in range(order):
            if k:
                before = np.zeros_like(h)
                before[1:] = h[:-1]
                h = mix(before * np.uint64(0xD6E8FEB86659FD93) + words)
            on = np.flatnonzero(self.place >= max(k, 1))
            bits = min(64, (_GRAM_BITS if k else _WORD_BITS) + (buckets - 1).bit_length())
            keys, index = np.unique(h[on] >> np.uint64(64 - bits), return_inverse=True)
            ends_at = np.full(len(h), -1, dtype=np.int32)
            ends_at[on] = index
            bounds = np.array([-(-(b << bits) // buckets) for b in range(buckets)], dtype=np.uint64)
            self.keys.append(keys)
            self.counts.append(np.bincount(index, weights=learned[on], minlength=len(keys)).astype(np.int64))
            self.edges.append(np.append(np.searchsorted(keys, bounds), len(keys)))
            self.ends_at.append(ends_at)


def _packed(x: np.ndarray) -> bytes:
    """Numbers as planes of bytes, compressed."""
    planes = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    raw = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :planes].T)
    return bytes([planes]) + pa.compress(raw.tobytes(), codec="zstd", asbytes=True)


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    if n:
        planes = packed[0]
        raw = pa.decompress(packed[1:], decompressed_size=planes * n, codec="zstd", asbytes=True)
        out[:, :planes] = np.frombuffer(raw, dtype=np.uint8).reshape(planes, n).T
    return out.view("<u8")[:, 0]


def _dealt(docs: DataFrame, most: int) -> DataFrame:
    """Rows (batch, packed): texts of about most bytes in the order they are read, packed and compressed."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        rest: list[pa.RecordBatch] = []
        size = 0
        options = pa.ipc.IpcWriteOptions(compression="zstd")

        def packed() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rest[0].schema, options=options) as writer:
                for x in rest:
                    writer.write_batch(x)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["batch", "packed"])

        for batch in batches:
            for piece in pieces_of(batch, "text", most):
                rest.append(piece)
                size += int(text_buffer(piece.column("text"))[1][-1])
                if size >= most // 2:
                    yield packed()
                    number, rest, size = number + 1, [], 0
        if rest:
            yield packed()
        give_back()

    return docs.mapInArrow(run, "batch bigint, packed binary")


def _read(packed: bytes, buckets: int, order: int) -> tuple[pa.Table, Grams]:
    texts = pa.ipc.open_stream(packed).read_all()
    return texts, Grams(texts.column("text"), ~texts.column("held_out").to_numpy(), buckets, order)


def _send(batch: int, packed: bytes, buckets: int, order: int) -> pa.RecordBatch:
    """A row for each bucket: differences of the batch's sorted keys in it, and their counts, by length."""
    g = _read(packed, buckets, order)[1]
    rows = []
    for b in range(buckets):
        parts = [slice(*e[b : b + 2]) for e in g.edges]
        sizes = [p.stop - p.start for p in parts]
        if any(sizes):
            rows.append((batch, b, sizes, [_packed(np.diff(k[p], prepend=np.uint64(0))) for k, p in zip(g.keys, parts, strict=True)], [_packed(c[p]) for c, p in zip(g.counts, parts, strict=True)]))
    kinds = (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.list_(pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["batch", "bucket", "sizes", "keys", "counts"])


def _add_up(table: pa.Table, order: int) -> pa.Table:
    """One bucket: totals for every batch's n-grams, in the order sent, and the bucket's statistics."""
    batches, sizes = table.column("batch"), table.column("sizes").to_pylist()
    answers: list[list[bytes]] = [[] for _ in sizes]
    types = []
    for k in range(order):
        n = [s[k] for s in sizes]
        keys = np.concatenate([np.cumsum(_unpacked(x[k].as_py(), m), dtype=np.uint64) for x, m in zip(table.column("keys"), n, strict=True)])
        known, index = np.unique(keys, return_inverse=True)
        del keys
        counts = np.concatenate([_unpacked(x[k].as_py(), m) for x, m in zip(table.column("counts"), n, strict=True)])
        total = np.bincount(index, weights=counts, minlength=len(known)).astype(np.int64)
        types.append(int((total > 0).sum()))
        if not k:
            words, ones, twos = int(total.sum()), int((total == 1).sum()), int((total == 2).sum())
        ends = np.cumsum(n)
        for answer, end, m in zip(answers, ends, n, strict=True):
            answer.append(_packed(total[index[end - m : end]]))
        del known, index, counts, total
    give_back()
    nulls = [None] * (len(sizes) - 1)
    stats = [pa.array([x, *nulls], t) for x, t in ((types, pa.list_(pa.int64())), (words, pa.int64()), (ones, pa.int64()), (twos, pa.int64()))]
    return pa.table([batches, table.column("bucket"), table.column("sizes"), pa.array(answers, pa.list_(pa.binary())), *stats], names=["batch", "bucket", "sizes", "totals", "types", "words", "ones", "twos"])


def discount(ones: int, twos: int) -> float:
    return ones / (ones + 2 * twos) if ones else 0.5


def traverse(g: Grams, totals: list[np.ndarray], stats: dict) -> np.ndarray:
    """log10 probability of every place's token, from left to right in each text; 0 at its START.

    The state before a token is the longest context of known tokens before it, so all places take their state at once.
    From there they go down failure arcs together, each adding their weights until its state has an arc.
    """
    n, order = stats["words"], len(totals)
    c = [np.where(e >= 0, t[e], 0).astype(np.float64) if len(t) else np.zeros(len(e)) for t, e in zip(totals, g.ends_at, strict=True)]
    d = discount(stats["ones"], stats["twos"])
    arcs = [np.where(c[0] > 0, c[0] - d, max(d * stats["types"][0], 0.1)) / n if n else np.ones(len(g.place))]
    state = np.zeros(len(g.place), dtype=np.int8)
    failure = [np.ones(len(g.place))]
    for k in range(1, order):
        seen = np.zeros(len(g.place))
        seen[1:] = c[k - 1][:-1]
        if k == 1:
            seen[g.place == 1] = stats["texts"]
        seen[g.place < k] = 0
        m = stats["types"][k] / max(stats["types"][k - 1], 1)
        state[seen > 0] = k
        failure.append(m / (seen + m) if m else np.ones(len(seen)))
        arcs.append(np.where(seen > 0, (c[k] + m * arcs[-1]) / np.maximum(seen + m, 1e-300), arcs[-1]))
    weight = np.zeros(len(g.place))
    on = g.place > 0
    for k in range(order - 1, 0, -1):
        here = on & (state == k)
        arc = here & (c[k] > 0)
        weight[arc] = weight[arc] + np.log10(arcs[k][arc])
        on[arc] = False
        fails = here & ~arc
        weight[fails] += np.log10(failure[k][fails])
        state[fails] -= 1
    weight[on] += np.log10(arcs[0][on])
    return weight


def _scored(packed: pa.Table, answers: pa.Table, buckets: int, order: int, stats: dict) -> pa.Table:
    texts, g = _read(packed.column("packed")[0].as_py(), buckets, order)
    by_bucket = np.argsort(answers.column("bucket").to_numpy())
    sizes, found = answers.column("sizes").to_pylist(), answers.column("totals")
    totals = [np.concatenate([_unpacked(found[i][k].as_py(), sizes[i][k]) for i in by_bucket.tolist()]).astype(np.int64) for k in range(order)]
    n, v = stats["words"], stats["types"][0]
    on = g.place > 0
    count = np.where(on, totals[0][g.ends_at[0]], 0)
    base = np.where(on, np.log10((count + 0.1) / (n + 0.1 * (v + 1))), 0.0)
    # Every text learned from has one END, so the count of any END is their number.
    stats = stats | {"texts": int(count[g.lengths[0] - 1])}
    add = lambda x: np.add.reduceat(x, g.first)
    out = pa.table(
        [texts.column("doc_id"), texts.column("held_out"), pa.array(g.lengths - 1, pa.int64()), pa.array(add((count > 0).astype(np.int64))), pa.array(np.full(len(g.first), n), pa.int64()), pa.array(add(base)), pa.array(add(traverse(g, totals, stats)))],
        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    )
    give_back()
    return out


def score_texts(docs: DataFrame, fold: int = 10, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs.

    Learns from rows whose crc32 of doc_id as text is not divisible by fold. A null or empty text is one token, its
    end. Rows without doc_id are learned from and scored; rows that repeat a doc_id are texts of their own; other columns
    don't matter. A text longer than a batch is a batch of its own. If no row is left to learn from, every token has
    base probability 1 and score 0. An empty table gives no rows.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % fold == 0, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), held.alias("held_out"))
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    # Beyond some 0.6 TB batches grow with the root of the size, so that what a batch sends a bucket keeps 4 KB.
    batch = max(BATCH, math.isqrt(size * 4096))
    buckets = size // max(BUCKET, batch) + 1
    dealt = materialize(_dealt(docs, batch), "batches")

    def send(batches):
        for b in batches:
            for number, packed in zip(b.column("batch"), b.column("packed"), strict=True):
                yield _send(number.as_py(), packed.as_py(), buckets, order)
                give_back()

    sent = dealt.mapInArrow(send, "batch bigint, bucket int, sizes array<int>, keys array<binary>, counts array<binary>")
    ddl = "batch bigint, bucket int, sizes array<int>, totals array<binary>, types array<bigint>, words bigint, ones bigint, twos bigint"
    answers = materialize(sent.groupBy("bucket").applyInArrow(lambda t: _add_up(t, order), ddl), "totals")
    release(docs.sparkSession)
    row = answers.agg(*(F.sum(k).alias(k) for k in ("words", "ones", "twos")), *(F.sum(F.col("types")[k]).alias(f"t{k}") for k in range(order))).first()
    stats = {k: row[k] or 0 for k in ("words", "ones", "twos")} | {"types": [row[f"t{k}"] or 0 for k in range(order)]}
    answers = answers.select("batch", "bucket", "sizes", "totals")
    return dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(
        lambda packed, found: _scored(packed, found, buckets, order, stats),
        "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    )
