"""Best-fit decreasing packing of tokenised documents into windows, without padding.

Documents longer than a window are cut into full windows first. The rests are dealt by hash to groups of about GROUP, each
of which one task packs: longest first, every rest goes to the open window with the least room that still holds it, which
a segment tree over rooms finds. Windows that stay open are closed by cutting: the emptiest are taken apart and fill
the rooms of the others. What a group has over in the end, less than a window, is cut to powers of two, which need no padding.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from progdiv.llm.common import materialize

CAPACITY = 2048
#: Rests that one task packs, so its memory and time don't grow with the table. A group leaves less than one window over.
GROUP = 2048
# How a byte-level tokenizer is configured for which the pieces between its own cuts can be encoded apart.
_SHAPE = [
    None,
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True},
    {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False},
]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ByteEncoder:
    """Token ids of whole texts, equal to the tokenizer's own, as array("H") or array("I") bytes (`width` of each).

    Any tokenizer may be given; only one built like _SHAPE takes the way by pieces, others encode whole texts. That one cuts a
    text into runs of letters, numbers, white space and other characters, and no token crosses a cut, so the ids are kept
    per piece. The kind of a character is asked of the tokenizer itself, once each. When the store of pieces holds `most` it
    becomes the older one, from which pieces still in use move back: that bounds memory and changes no result.
    """

    def __init__(self, path: str, most: int = 300_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model = {k: v for k, v in made["model"].items() if k not in ("vocab", "merges")}
        self.by_piece = [made["normalizer"], made["pre_tokenizer"], model] == _SHAPE
        self.special = [t["content"] for t in made["added_tokens"]]
        self.model, self.cuts = self.whole.model, self.whole.pre_tokenizer
        self.code = "H" if self.whole.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "I"
        self.width = array(self.code).itemsize
        self.most, self.store, self.older = most, {}, {}
        self.kinds: dict[str, set[str]] = {"letter": set(), "number": set(), "space": set(), "other": set()}
        self.known: set[str] = set()
        self.pattern: re.Pattern | None = None

    def _kind(self, c: str) -> str:
        for kind, beside in (("letter", "a"), ("number", "1"), ("other", "!")):
            if len(self.cuts.pre_tokenize_str(beside + c)) == 1:
                return kind
        return "space"

    def _meet(self, new: set[str]) -> None:
        for c in new:
            self.kinds[self._kind(c)].add(c)
        self.known |= new
        inside = {k: "".join(map(re.escape, sorted(v))) for k, v in self.kinds.items()}
        some = lambda kind: f"[{inside[kind]}]" if inside[kind] else "(?!)"
        space = some("space")
        runs = "|".join(f" ?{some(kind)}+" for kind in ("letter", "number", "other"))
        self.pattern = re.compile(f"'(?:s|t|re|ve|m|ll|d)|{runs}|{space}+(?![{inside['letter']}{inside['number']}{inside['other']}])|{space}+" if len(self.known) > len(self.kinds["space"]) else f"{space}+")

    def _pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _learn(self, pieces: set[str]) -> None:
        store, older, tokenize, code = self.store, self.older, self.model.tokenize, self.code
        for piece in pieces:
            if piece in older:
                store[piece] = older[piece]
                continue
            shown = piece.replace(" ", _LETTERS[32]) if piece.isascii() and piece.isprintable() else "".join([_LETTERS[b] for b in piece.encode()])
            store[piece] = array(code, [t.id for t in tokenize(shown)]).tobytes()

    def __call__(self, text: str) -> bytes:
        if not self.by_piece or any(s in text for s in self.special):
            return self._pack(self.whole.encode(text, add_special_tokens=False).ids)
        new = set(text) - self.known
        if new:
            self._meet(new)
        pieces = self.pattern.findall(text) if text else []
        try:
            return b"".join(map(self.store.__getitem__, pieces))
        except KeyError:
            if len(self.store) > self.most:
                self.store, self.older = {}, self.store
            self._learn(set(pieces).difference(self.store))
            return b"".join(map(self.store.__getitem__, pieces))


#: How the byte-level step writes bytes as characters: printable ones as they are, the others from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LETTERS = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def _crc(ids: bytes, code: str) -> int:
    """Of the ids as little-endian unsigned 32-bit numbers."""
    return zlib.crc32(np.frombuffer(ids, dtype=code).astype("<u4").tobytes())


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end: int, with_ids: bool) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, ids of every full window of each text's ids with the end id, and of the
    rest. Full windows have ids only with with_ids; ids are as wide as the encoder's."""
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())]

    def run(batches):
        encode = ByteEncoder(tokenizer)
        tail, width = array(encode.code, [end]).tobytes(), capacity * encode.width
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                ids = encode(text.as_py()) + tail
                n = len(ids) // encode.width
                for at in range(0, len(ids), width):
                    part = ids[at : at + width]
                    rows.append((doc_id.as_py(), at // encode.width, len(part) // encode.width, _crc(part, encode.code), n, part if with_ids or len(part) < width else None))
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields, strict=True)], schema=pa.schema(fields))

    return docs.mapInArrow(run, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, ids binary")


class OpenWindows:
    """Open windows by the room they have left: a segment tree over rooms 0..capacity, whose nodes hold numbers of windows."""

    def __init__(self, capacity: int) -> None:
        self.base = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.base)
        self.windows: list[list[int]] = [[] for _ in range(self.base)]

    def _add(self, room: int, n: int) -> None:
        i = self.base + room
        while i:
            self.count[i] += n
            i >>= 1

    def put(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        self._add(room, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """Takes out a window with the least room that holds length: (room, window), or None."""
        i = self.base + length
        while not self.count[i]:
            while i & 1:  # to the right of what is known to be empty
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.base:
            i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.base
        self._add(room, -1)
        return room, self.windows[room].pop()


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """The windows as lists of indices of lengths (all at most capacity), longest first, equal ones in the order given."""
    tree, windows = OpenWindows(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = tree.take(lengths[i])
        room, w = found if found else (capacity, len(windows))
        if not found:
            windows.append([])
        windows[w].append(i)
        if room > lengths[i]:
            tree.put(room - lengths[i], w)
    return windows


def close(windows: list[list[int]], lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Windows of parts (index, from, to) that need no padding: full, or as long as a power of two.

    Windows whose length is a power of two already stay. Of the others the emptiest are taken apart and their parts fill
    the fullest, so most rests stay whole; what is left over at last is cut to powers of two.
    """
    used = [sum(lengths[i] for i in w) for w in windows]
    out = [[(i, 0, lengths[i]) for i in w] for w, n in zip(windows, used, strict=True) if n & (n - 1) == 0 or n == capacity]
    rest = sorted((w for w, n in zip(range(len(windows)), used, strict=True) if n & (n - 1) and n != capacity), key=lambda w: -used[w])
    pool: list[tuple[int, int, int]] = []

    def taken(n: int) -> list[tuple[int, int, int]]:
        parts = []
        while n:
            i, a, b = pool.pop()
            if b - a > n:
                pool.append((i, a + n, b))
                b = a + n
            parts.append((i, a, b))
            n -= b - a
        return parts

    have, lo, hi = 0, 0, len(rest)
    while lo < hi:
        room = capacity - used[rest[lo]]
        while have < room and hi > lo + 1:
            hi -= 1
            pool += [(i, 0, lengths[i]) for i in windows[rest[hi]]]
            have += used[rest[hi]]
        whole = [(i, 0, lengths[i]) for i in windows[rest[lo]]]
        lo += 1
        if have < room:
            pool += whole
            have += capacity - room
        else:
            out.append(whole + taken(room))
            have -= room
    while have:
        n = min(capacity, 1 << have.bit_length() - 1)
        out.append(taken(n))
        have -= n
    return out


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end: int = 1, with_ids: bool = False, group: int = GROUP) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of docs, and with with_ids the ids as
    bytes of little-endian unsigned 32-bit numbers.

    A null or empty text is the end id alone; documents longer than capacity (a power of two) are cut into full windows and
    a rest; rows that repeat a doc_id, or have none, are packed each; texts are encoded whole, however long; other columns
    don't matter; an empty table gives no rows. Every sequence is as long as capacity or another power of two.
    """
    if capacity & (capacity - 1) or capacity < 1:
        raise ValueError("capacity is not a power of two")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    groups = max(1, -(-docs.count() // group))
    path = tokenizer or default_tokenizer()
    code = ByteEncoder(path).code
    pieces = materialize(token_pieces(docs, path, capacity, end, with_ids).withColumn("place", F.monotonically_increasing_id()), "pieces")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    ddl = ", ".join(f"{n} {'binary' if n == 'ids' else 'bigint'}" for n in names)

    def wide(ids: bytes) -> bytes:
        return np.frombuffer(ids, dtype=code).astype("<u4").tobytes()

    def one_group(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["place"])
        lengths = [r["length"] for r in rows]
        out: list[tuple] = []
        for k, window in enumerate(close(best_fit(lengths, capacity), lengths, capacity)):
            at = 0
            for i, a, b in window:
                r = rows[i]
                cut = b - a < r["length"]
                ids = r["ids"][a * array(code).itemsize : b * array(code).itemsize] if cut or with_ids else b""
                out.append((r["doc_id"], r["start"] + a, b - a, _crc(ids, code) if cut else r["ids_crc32"], r["doc_tokens"], (r["part"] << 32 | k) * 2 + 1, at) + ((wide(ids),) if with_ids else ()))
                at += b - a
        cols = list(zip(*out, strict=True)) if out else [()] * len(names)
        return pa.table([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for c, n in zip(cols, names, strict=True)], names=names)

    def whole(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(n) if n != "ids" else pa.array([wide(x.as_py()) for x in batch.column(n)], pa.binary()) for n in names], names=names)

    full = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": F.col("place") * 2, "offset": F.lit(0).cast("long")}).select(*names)
    full = full.mapInArrow(whole, ddl) if with_ids else full
    rests = pieces.where(F.col("length") < capacity).withColumn("part", F.pmod(F.xxhash64("place"), F.lit(groups)).cast("long"))
    return full.union(rests.groupBy("part").applyInArrow(one_group, ddl))
