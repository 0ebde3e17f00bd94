"""Subword tokens of texts by byte-pair merges from a public vocabulary file; vocabularies are never trained here."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: how texts are parted before merges, as the vocabulary was made for.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary() -> str:
    """The byte-level vocabulary of 50,000 among the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Merges:
    """Merges by rank of a file {"model": {"merges": [[left, right], ...]}}, applied to one piece of text at a time.

    A piece's merges go by rank and then from the left: a heap holds the pairs of neighbours that merge, and neighbours are linked,
    so a piece of n bytes takes n log n steps. Pieces are remembered, `most` of them at a time.
    """

    def __init__(self, path: str, most: int = 200_000) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            merges = json.load(f)["model"]["merges"]
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(merges)}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        #: Bytes that don't print are written as the characters from 256 on.
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.bytes = {c: b for b, c in self.letters.items()}
        self.pieces, self.most, self.known = regex.compile(PIECES), most, {}

    def merged(self, piece: str) -> list[str]:
        symbols: list[str | None] = [self.letters[b] for b in piece.encode()]
        n = len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(self.ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in self.ranks]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i] if symbols[i] is not None else n
            if j >= n or self.ranks.get((symbols[i], symbols[j])) != rank:
                continue  # one of both has merged with another since
            symbols[i], symbols[j] = symbols[i] + symbols[j], None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (found := self.ranks.get((symbols[k], symbols[after[k]]))) is not None:
                    heapq.heappush(heap, (found, k))
        return [s for s in symbols if s is not None]

    def __call__(self, text: str, limit: int | None = None) -> list[str]:
        """The text's subwords, or the first limit of them."""
        out: list[str] = []
        for hit in self.pieces.finditer(text):
            piece = hit[0]
            if piece not in self.known:
                if len(self.known) >= self.most:
                    self.known.clear()
                self.known[piece] = self.merged(piece)
            out += self.known[piece]
            if limit is not None and len(out) >= limit:
                return out[:limit]
        return out

    def text_of(self, tokens: list[str]) -> str:
        """What subwords were made of; bytes of a character that was cut become the replacement mark."""
        return bytes(self.bytes[c] for t in tokens for c in t).decode("utf-8", "replace")


def with_subwords(frame: DataFrame, text: str, out: str, vocabulary: str | None = None, ends: tuple[str, str] | None = None) -> DataFrame:
    """Adds the subwords of a column of texts, null for null, between a start and an end token if given."""
    path = vocabulary or default_vocabulary()
    first, last = ([ends[0]], [ends[1]]) if ends else ([], [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = Merges(path)
        for b in batches:
            tokens = [None if t is None else [*first, *merges(t), *last] for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tokens, pa.list_(pa.string()))], names=[*b.schema.names, out])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)
    return frame.mapInArrow(run, f"{ddl}, `{out}` array<string>")


#: Texts of a batch that are in Python at a time.
ROWS = 256


def with_embedding_text(frame: DataFrame, text: str, out: str, most: int = 512, spare: int = 8, vocabulary: str | None = None) -> DataFrame:
    """Rows with text that is not blank, and what of it goes to an embedder that takes `most` subwords: the first most - spare, as text,
    without white space at the ends and with one line end for several. An error if that has more than most subwords again."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = Merges(path)
        for b in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
            made = []
            for t in b.column(text).to_pylist():
                cut = re.sub(r"\n+", "\n", merges.text_of(merges(t.strip(), most - spare)).strip())
                if len(merges(cut, most + 1)) > most:
                    raise ValueError(f"more than {most} subwords in {cut[:40]!r}")
                made.append(cut)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], names=[*b.schema.names, out])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)
    return frame.where(F.col(text).rlike(r"(?s)[^\s\p{Z}\x1c-\x1f\x85]")).mapInArrow(run, f"{ddl}, `{out}` string")
