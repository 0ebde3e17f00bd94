"""Language identification by a linear-chain conditional random field over words.

A word's features are its affixes, its byte bigrams and trigrams (with marks at both ends) and its place in a lexicon of
training words; transitions between the labels of neighbouring words are learned too, from training chains
of which half switch language. Forward-backward gives every word's label probabilities; their mean
over the words of a text is the text's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from progdiv.llm.common import _IS_SPACE, _LOWER, give_back, hash_key, mix, pieces_of, text_buffer, word_bounds, word_hashes

#: Bounds of the fit: texts a language, code points a text, languages (the most frequent ones), words of the lexicon.
SAMPLE_DOCS, SAMPLE_CHARS, LABELS, LEXICON = 120, 1 << 15, 256, 8192
#: Code points of all texts of the fit together, which the driver holds: with many languages a text gets fewer.
FIT_CHARS = 1 << 25
#: Bytes of text and chains handled at once, so that memory does not follow the length of a text.
_SEGMENT, _CHAINS = 1 << 20, 4096
#: Words of a chain.
CHAIN = 64
_BIGRAMS, _TRIGRAMS, _AFFIXES = 1 << 14, 1 << 16, 1 << 15
UNKNOWN = "und"


class Words:
    """The words of some texts: distinct ones, and each word's index among them."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        starts, ends = word_bounds(data, offsets)
        self.first = np.searchsorted(starts, offsets)
        self.hashes, at, self.index = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        s, n = starts[at], ends[at] - starts[at]
        # Each distinct word between two marks (0), end to end.
        self.at = np.cumsum(n + 2) - (n + 2)
        self.length = n + 2
        body = np.ones(int(self.length.sum()), dtype=bool)
        body[self.at] = body[self.at + n + 1] = False
        self.bytes = np.zeros(len(body), dtype=np.uint64)
        take = np.repeat(s - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        self.bytes[body] = _LOWER[data[take]].astype(np.uint64) + np.uint64(1)


def _slot(x: np.ndarray, size: int) -> np.ndarray:
    return (mix(x) % np.uint64(size)).astype(np.int64)


def features(w: Words, lexicon: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(word, feature) index pairs, a block a kind of feature."""
    b, owner = w.bytes, np.repeat(np.arange(len(w.at)), w.length)
    two = b[:-1] * np.uint64(257) + b[1:]
    inside = owner[:-1] == owner[1:]
    out = [(owner[:-1][inside], _slot(two, _BIGRAMS)[inside])]
    three = two[:-1] * np.uint64(257) + b[2:]
    inside = owner[:-2] == owner[2:]
    base = _BIGRAMS
    out.append((owner[:-2][inside], base + _slot(three, _TRIGRAMS)[inside]))
    base += _TRIGRAMS
    for size in (2, 3, 4):
        long = np.flatnonzero(w.length - 2 >= size)
        for at, tag in ((w.at[long] + 1, 2 * size), (w.at[long] + w.length[long] - 1 - size, 2 * size + 1)):
            acc = np.full(len(long), tag, dtype=np.uint64)
            for j in range(size):
                acc = acc * np.uint64(257) + b[at + j]
            out.append((long, base + _slot(acc, _AFFIXES)))
    base += _AFFIXES
    if len(lexicon):
        i = np.minimum(np.searchsorted(lexicon, w.hashes), len(lexicon) - 1)
        known = np.flatnonzero(lexicon[i] == w.hashes)
        out.append((known, base + i[known]))
    return out


def emissions(w: Words, weights: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    score = np.zeros((len(w.at), weights.shape[1]))
    for word, feature in features(w, lexicon):
        for y in range(weights.shape[1]):
            score[:, y] += np.bincount(word, weights=weights[feature, y], minlength=len(w.at))
    return score


def chains(first: np.ndarray) -> np.ndarray:
    """Word positions in rows of CHAIN, texts cut into chains; -1 where a chain has ended."""
    lengths = np.diff(first)
    per = -(-lengths // CHAIN)
    text = np.repeat(np.arange(len(lengths)), per)
    start = first[:-1][text] + CHAIN * (np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per))
    grid = start[:, None] + np.arange(CHAIN)
    return np.where(grid < first[1:][text][:, None], grid, -1)


def forward_backward(score: np.ndarray, grid: np.ndarray, index: np.ndarray, transitions: np.ndarray, start: np.ndarray, pairs: bool = False):
    """Label probabilities of each place of grid (and expected transitions, log of the normaliser)."""
    live = grid >= 0
    e = score[index[grid]]
    top = e.max(axis=2, keepdims=True) if e.size else e
    e = np.where(live[:, :, None], np.exp(e - top), 1.0)
    t = np.exp(transitions)
    n, length, k = e.shape
    alpha, scale = np.empty_like(e), np.ones((n, length))
    a = np.exp(start) * e[:, 0]
    for i in range(length):
        if i:
            moved = np.where(live[:, i, None], (a @ t) * e[:, i], a)
            a = moved
        scale[:, i] = a.sum(axis=1)
        a = a / scale[:, i, None]
        alpha[:, i] = a
    beta = np.empty_like(e)
    b = np.ones((n, k))
    beta[:, -1] = b
    for i in range(length - 2, -1, -1):
        b = np.where(live[:, i + 1, None], (b * e[:, i + 1] / scale[:, i + 1, None]) @ t.T, b)
        beta[:, i] = b
    gamma = alpha * beta
    gamma /= np.maximum(gamma.sum(axis=2, keepdims=True), 1e-300)
    if not pairs:
        return gamma
    expected = np.zeros((k, k))
    for i in range(length - 1):
        on = live[:, i + 1]
        right = beta[on, i + 1] * e[on, i + 1] / scale[on, i + 1, None]
        expected += t * (alpha[on, i].T @ right)
    return gamma, expected


def fit(texts: list[str], labels: list[int], n_labels: int, steps: int = 30, rate: float = 0.15, seed: int = 7) -> dict:
    """Weights by Adam on the regularised likelihood of labelled chains, half of which switch language."""
    rng = np.random.default_rng(seed)
    data, offsets = text_buffer(pa.array(texts, pa.string()))
    w = Words(data, offsets)
    per_text = np.diff(w.first)
    truth = np.repeat(labels, per_text)
    common = np.argsort(-np.bincount(w.index, minlength=len(w.at)), kind="stable")[:LEXICON]
    lexicon = np.sort(w.hashes[common])
    plain = chains(w.first)
    mixed = plain[rng.permutation(len(plain))].copy()
    other = plain[rng.permutation(len(plain))]
    cut = rng.integers(1, CHAIN, len(plain))
    late = np.arange(CHAIN)[None, :] >= cut[:, None]
    mixed[late] = other[late]
    mixed[:, 0] = np.maximum(mixed[:, 0], 0)
    ended = np.cumsum(mixed < 0, axis=1) > 0
    mixed[ended] = -1
    grid = np.concatenate([plain, mixed])
    live = grid >= 0
    y = np.where(live, truth[grid], -1)
    size = _BIGRAMS + _TRIGRAMS + _AFFIXES + len(lexicon)
    blocks = features(w, lexicon)
    word, feature = np.concatenate([b[0] for b in blocks]), np.concatenate([b[1] for b in blocks])
    # Observed less expected counts reach the weights through the distinct words.
    places = w.index[grid[live]]
    seen = np.stack([np.bincount(places[y[live] == k], minlength=len(w.at)) for k in range(n_labels)], axis=1).astype(float)
    stay = live[:, 1:]
    moves = np.zeros((n_labels, n_labels))
    np.add.at(moves, (y[:, :-1][stay], y[:, 1:][stay]), 1)
    starts = np.bincount(y[:, 0], minlength=n_labels).astype(float)
    p = {"weights": np.zeros((size, n_labels)), "transitions": np.zeros((n_labels, n_labels)), "start": np.zeros(n_labels)}
    m = {k: np.zeros_like(v) for k, v in p.items()}
    s = {k: np.zeros_like(v) for k, v in p.items()}
    total = live.sum()
    for step in range(1, steps + 1):
        score = emissions(w, p["weights"], lexicon)
        gamma, expected = forward_backward(score, grid, w.index, p["transitions"], p["start"], pairs=True)
        guess = np.stack([np.bincount(places, weights=gamma[live][:, k], minlength=len(w.at)) for k in range(n_labels)], axis=1)
        off = (seen - guess) / total
        grad = {
            "weights": np.stack([np.bincount(feature, weights=off[word, k], minlength=size) for k in range(n_labels)], axis=1),
            "transitions": (moves - expected) / total,
            "start": (starts - gamma[:, 0].sum(axis=0)) / total,
        }
        for k, g in grad.items():
            g = g - 1e-6 * p[k]
            m[k] = 0.9 * m[k] + 0.1 * g
            s[k] = 0.99 * s[k] + 0.01 * g * g
            p[k] = p[k] + rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)
    return {"weights": p["weights"].astype(np.float32), "transitions": p["transitions"], "start": p["start"], "lexicon": lexicon}


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, labels: int = LABELS) -> dict | None:
    """Fits on a sample by hash of text: of each of the `labels` most frequent languages sample_docs different texts with a
    letter, and of a longer text than sample_chars so many code points from a place that its hash gives, or fewer where all of
    them would be over FIT_CHARS.

    None if there is no such text."""
    letter = r"\p{L}"
    docs = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(letter)).select("lang", "text", F.xxhash64("text").alias("h"))
    counts = docs.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("texts"))
    found = counts.orderBy(F.col("n").desc(), "lang").limit(labels).collect()
    if not found:
        return None
    names = sorted(r["lang"] for r in found)
    sample_chars = max(1, min(sample_chars, FIT_CHARS // (len(names) * sample_docs)))
    share = F.element_at(F.create_map(*(x for r in found for x in (F.lit(r["lang"]), F.lit(min(1.0, 2 * sample_docs / r["texts"]))))), F.col("lang"))
    spare = F.length("text") - sample_chars
    excerpt = F.when(spare > 0, F.substring("text", (F.pmod(F.xxhash64("h"), spare + 1) + 1).cast("int"), F.lit(sample_chars))).otherwise(F.col("text"))
    rows = docs.where(F.col("lang").isin(names)).withColumn("u", hash_key(F.col("h"), F.lit(11))).where(F.col("u") < share)
    rows = rows.select("lang", "h", "u", excerpt.alias("text")).groupBy("lang", "h", "u").agg(F.min("text").alias("text")).where(F.col("text").rlike(letter))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("u", "h"))).where(F.col("k") <= sample_docs)
    rows = sorted((r["lang"], r["k"], r["text"]) for r in rows.collect())
    if not rows:
        return None
    names = sorted({r[0] for r in rows})
    model = fit([r[2] for r in rows], [names.index(r[0]) for r in rows], len(names))
    return model | {"names": names}


def _segments(data: np.ndarray, offsets: np.ndarray, most: int = _SEGMENT):
    """The texts as they are or, if one is long, its pieces between white space, each with offsets."""
    if len(data) <= 2 * most:
        yield data, offsets, np.arange(len(offsets) - 1)
        return
    for row, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        while lo < hi:
            at = min(hi, lo + most)
            while at < hi and not _IS_SPACE[data[at]]:
                step = np.flatnonzero(_IS_SPACE[data[at : min(hi, at + 65536)]])
                at = at + int(step[0]) if len(step) else min(hi, at + 65536)
            yield data[lo:at], np.array([0, at - lo]), np.array([row])
            lo = at


def _label(piece: pa.Array, model: dict, with_runs: bool) -> tuple[np.ndarray, np.ndarray, list[list[np.ndarray]]]:
    """Mean label probabilities of each text, mean of its words' greatest ones, and its words' labels."""
    n, k = len(piece), len(model["names"])
    mean, sure, count = np.zeros((n, k)), np.zeros(n), np.zeros(n)
    labels: list[list[np.ndarray]] = [[] for _ in range(n)]
    for data, offsets, rows in _segments(*text_buffer(piece)):
        w = Words(data, offsets)
        grid = chains(w.first)
        score = emissions(w, model["weights"], model["lexicon"])
        words = np.zeros(len(w.index), dtype=np.int64)
        for at in range(0, len(grid), _CHAINS):
            part = grid[at : at + _CHAINS]
            gamma = forward_backward(score, part, w.index, model["transitions"], model["start"])
            live = part >= 0
            places, gamma = part[live], gamma[live]
            owner = rows[np.searchsorted(w.first, places, side="right") - 1]
            for y in range(k):
                mean[:, y] += np.bincount(owner, weights=gamma[:, y], minlength=n)
            sure += np.bincount(owner, weights=gamma.max(axis=1), minlength=n)
            if with_runs:
                words[places] = gamma.argmax(axis=1)
        count[rows] += np.diff(w.first)
        if with_runs:
            for row, lo, hi in zip(rows, w.first[:-1], w.first[1:], strict=True):
                labels[row].append(words[lo:hi])
    count = np.maximum(count, 1)
    return mean / count[:, None], sure / count, labels


def _runs(labels: list[np.ndarray], names: list[str]) -> list[dict]:
    y = np.concatenate([np.zeros(0, np.int64), *labels])
    cut = np.flatnonzero(np.diff(y)) + 1
    starts, ends = np.append(0, cut), np.append(cut, len(y))
    return [{"word": int(a), "words": int(b - a), "lang": names[y[a]]} for a, b in zip(starts, ends, strict=True)] if len(y) else []


def identify(docs: DataFrame, fold: int = 5, sample_docs: int = SAMPLE_DOCS, with_runs: bool = False) -> DataFrame:
    """Adds held_out, lang_pred, score, certainty (and lang_runs) to docs.

    score is the mean over words of the label's probability, certainty that of each word's own best label, so that text
    in several languages is as certain as text in one; lang_runs are the neighbouring words of one label, as number of the
    first word, number of words and label. Learns from text and lang of rows with a lang whose crc32 of
    doc_id as text is not divisible by fold; a text is drawn by its own hash, so repeated rows count once there. Texts that
    are null or without a letter get und with score and certainty 0, as does every text if nothing can be learned from; texts
    whose only words carry no known feature get the prior. Rows without doc_id are learned from and labelled; repeated rows are
    labelled each; long texts are labelled whole, in segments of about 1 MB between white space; an empty table gives no rows.
    Columns of docs named like the new ones are replaced.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % fold == 0, F.lit(False))
    docs = docs.drop("held_out", "lang_pred", "score", "certainty", "lang_runs")
    model = learn(docs.where(~held), sample_docs)
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    runs_type = "array<struct<word:int,words:int,lang:string>>"
    if model is None:
        out = docs.withColumns({"held_out": held, "lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "certainty": F.lit(0.0)})
        return out.withColumn("lang_runs", F.array().cast(runs_type)) if with_runs else out
    flat = docs.withColumns({"held_out": held, "_letters": letters})
    out_type = "lang_pred string, score double, certainty double" + f", lang_runs {runs_type}" * with_runs

    def run(batches):
        names = np.array(model["names"], dtype=object)
        for batch in batches:
            for piece in pieces_of(batch, "text", _SEGMENT):
                mean, sure, labels = _label(piece.column("text"), model, with_runs)
                on = piece.column("_letters").to_numpy(zero_copy_only=False)
                label = np.where(on, names[mean.argmax(axis=1)], UNKNOWN)
                kept = [i for i, n in enumerate(piece.schema.names) if n != "_letters"]
                cols = [piece.column(i) for i in kept] + [pa.array(label, pa.string()), *(pa.array(np.where(on, np.clip(x, 0, 1), 0.0)) for x in (mean.max(axis=1), sure))]
                if with_runs:
                    kind = pa.list_(pa.struct([("word", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))
                    cols.append(pa.array([_runs(x, model["names"]) if o else [] for x, o in zip(labels, on, strict=True)], kind))
                yield pa.RecordBatch.from_arrays(cols, names=[*(piece.schema.names[i] for i in kept), "lang_pred", "score", "certainty", *["lang_runs"] * with_runs])
        give_back()

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in flat.schema if f.name != "_letters")
    return flat.mapInArrow(run, f"{ddl}, {out_type}")
