"""Best-fit packing of tokenised documents, planned on the histogram of lengths.

Only the counts of lengths reach the driver (at most `capacity` numbers). Best-fit over counts gives patterns
with multiplicities; a document takes the planned slot that has its rank among the pieces of its length.
"""

from __future__ import annotations

import json
import os
import sys
import zlib
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from progdiv.llm.common import materialize

CAPACITY = 2048
#: Pieces of one length that are ranked together: at most so many, and at most one in so many of all.
RANKED, SHARE = 1 << 17, 1024
_STOPS = ".,;:!?"
#: Whether an array of this kind has the bytes that ids are kept in.
_FOUR = array("I").itemsize == 4 and sys.byteorder == "little"
_SPECIAL = ("<|startoftext|>", "<|endoftext|>")
# How a tokenizer is configured for which white-space pieces can be encoded apart.
_SHAPE = [
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
    {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False},
    sorted(_SPECIAL),
]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Token ids of whole texts as little-endian 32-bit bytes, equal to the tokenizer's own.

    Any tokenizer may be given; only one that is built like _SHAPE takes the way by pieces, others encode whole texts.
    That tokenizer drops white space and no token crosses it, so ids are kept per white-space piece. When the
    store of pieces holds `most` it becomes the older one, from which pieces still in use move back; that bounds
    memory and changes time but no result.
    """

    def __init__(self, path: str, most: int = 400_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model = {k: v for k, v in made["model"].items() if k not in ("vocab", "merges")}
        special = sorted(t["content"] for t in made["added_tokens"])
        self.by_piece = [made["normalizer"], made["pre_tokenizer"], model, special] == _SHAPE
        self.model = self.whole.model
        self.most, self.store, self.older = most, {}, {}
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        #: How the byte-level step writes bytes as characters.
        self.letters = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def _pack(self, ids: list[int]) -> bytes:
        return array("I", ids).tobytes() if _FOUR else np.array(ids, dtype="<u4").tobytes()

    def _learn(self, pieces: set[str]) -> None:
        store, older, slow = self.store, self.older, []
        for piece in pieces:
            if piece in older:
                store[piece] = older[piece]
                continue
            word = piece.rstrip(_STOPS)
            if word.isalpha() and word == word.lower() and word.isascii() | (max(word) < "Ā"):
                tail = piece[len(word) :]
                if tail:
                    head = store.get(word) or older.get(word)
                    if tail not in store:
                        store[tail] = self._pack(self.whole.encode(tail, add_special_tokens=False).ids)
                    if head is not None:
                        store[piece] = head + store[tail]
                        continue
                text = word if word.isascii() else "".join(self.letters[b] for b in word.encode())
                store[word] = self._pack([t.id for t in self.model.tokenize(text)])
                store[piece] = store[word] + store[tail] if tail else store[word]
            else:
                slow.append(piece)
        for piece, e in zip(slow, self.whole.encode_batch_fast(slow, add_special_tokens=False), strict=True):
            store[piece] = self._pack(e.ids)

    def __call__(self, text: str) -> bytes:
        if not self.by_piece:
            return self._pack(self.whole.encode(text, add_special_tokens=False).ids)
        try:
            text.encode("latin-1")
            low = text.lower()
        except UnicodeEncodeError:
            low = text
        if any(c in text for c in "\x1c\x1d\x1e\x1f") or "<|" in low and any(s in low.lower() for s in _SPECIAL):
            return self._pack(self.whole.encode(text, add_special_tokens=False).ids)
        pieces = low.split()
        try:
            return b"".join(map(self.store.__getitem__, pieces))
        except KeyError:
            if len(self.store) > self.most:
                self.store, self.older = {}, self.store
            self._learn(set(pieces).difference(self.store))
            return b"".join(map(self.store.__getitem__, pieces))


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of the pieces of every text's ids and the end id."""
    width = 4 * capacity
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids

    def run(batches):
        encode, tail = WordEncoder(tokenizer), int(end).to_bytes(4, "little")
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                ids = encode(text.as_py()) + tail
                for k, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    rows.append((doc_id.as_py(), k, at // 4, len(part) // 4, zlib.crc32(part)) + ((part,) if with_ids else ()))
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True)], schema=pa.schema(fields))

    return docs.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, first rank, number, first sequence, offset) that best-fit decreasing gives.

    Sequences that look alike are one group with a count. A length goes to the groups with the
    least room that still holds it, whole groups at once, and opens new sequences only when none is left.
    """
    groups: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = defaultdict(list)  # room -> [(lengths with repeats, count)]
    for length in sorted((n for n, c in counts.items() if c), reverse=True):
        left = counts[length]
        room = length
        while left and room <= capacity:
            while left and groups.get(room):
                pattern, count = groups[room].pop()
                times = room // length
                used, rest = min(count, left // times), 0
                if used < count and left - used * times:
                    rest = left - used * times if used * times + times > left else 0
                if used:
                    groups[room - times * length].append(((*pattern, (length, times)), used))
                if rest:
                    groups[room - rest * length].append(((*pattern, (length, rest)), 1))
                if count - used - bool(rest):
                    groups[room].append((pattern, count - used - bool(rest)))
                left -= used * times + rest
                if not used and not rest:
                    break
            room += 1
        if left:
            times = capacity // length
            if left // times:
                groups[capacity - times * length].append((((length, times),), left // times))
            if left % times:
                groups[capacity - left % times * length].append((((length, left % times),), 1))
    slots, sequence, rank = [], 0, defaultdict(int)
    for room in sorted(groups):
        for pattern, count in groups[room]:
            at = 0
            for length, times in pattern:
                for _ in range(times):
                    slots.append((length, rank[length], count, sequence, at))
                    rank[length] += count
                    at += length
            sequence += count
    return slots


def ranked(pieces: DataFrame, counts: dict[int, int]) -> DataFrame:
    """Adds rank: 0, 1, ... within each length, from ranks within salts and running counts of the salts.

    A length has as many salts as its count asks for, and salts come from place, a number that every piece has for
    itself, so that neither a common length nor equal rows meet in one task."""
    most = max(1, min(RANKED, sum(counts.values()) // SHARE))
    salts = F.element_at(F.create_map(*(x for n, c in counts.items() for x in (F.lit(n), F.lit(-(-c // most))))), F.col("length").cast("int")) if counts else F.lit(1)
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("place"), salts))
    per = pieces.groupBy("length", "salt").count()
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "salt").orderBy("place")
    pieces = pieces.withColumn("own", F.row_number().over(own))
    return pieces.join(per, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("own") - 1).drop("salt", "own", "before", "place")


def place(pieces: DataFrame, slots: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """Adds sequence_id and offset to ranked pieces. The plan's size follows capacity, not the data."""
    table = np.array(sorted(slots), dtype=np.int64).reshape(-1, 5)
    starts = (table[:, 0] << 44) + table[:, 1]

    def run(batches):
        for batch in batches:
            key = (batch.column("length").to_numpy() << 44) + batch.column("rank").to_numpy()
            at = np.searchsorted(starts, key, side="right") - 1
            if len(at):
                sequence, offset = table[at, 3] + key - starts[at], table[at, 4]
            else:
                sequence = offset = np.zeros(0, np.int64)
            kept = [i for i, n in enumerate(batch.schema.names) if n != "rank"]
            names = [batch.schema.names[i] for i in kept]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name != "rank")
    return pieces.mapInArrow(run, f"{schema}, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (ids), sequence_id, offset of every piece of docs.

    A null or empty text is the end id alone; longer documents than capacity are cut into pieces of capacity
    tokens; rows that repeat a doc_id are packed each, and rows without one too; other columns don't matter; texts are encoded
    whole, however long; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    pieces = token_pieces(docs, tokenizer or default_tokenizer(), capacity, end, with_ids).withColumn("place", F.monotonically_increasing_id())
    pieces = materialize(pieces, "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    return place(ranked(pieces, counts), plan(counts, capacity))
