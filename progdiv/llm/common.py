"""What the operators of this subpackage share: table access, materialised tables, array hashing."""

from __future__ import annotations

import ctypes
import gc
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: the space and the code points 9 to 13.
SPACES = b"\t\n\x0b\x0c\r "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir. Only a local master may leave it unset (tests): elsewhere
    a folder of one machine would lose what the others write."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir is not set: it has to name a folder that all executors share")
        found = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
        spark.sparkContext.setCheckpointDir(found)
    return found


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back.

    Unlike checkpoint() the result carries no partitioning, so that a join on a hot key gets exchanges
    which adaptive execution can split, and its files are compressed and columnar.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def document_texts(df: DataFrame, *extra: str) -> DataFrame:
    """doc_id and text (null: empty) alone, whatever else the table has."""
    return df.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *extra)


def word_count(text: Column) -> Column:
    """Number of maximal runs of other characters than SPACES, without a lambda per word."""
    t = F.coalesce(text, F.lit(""))
    space = [32, 9, 10, 11, 12, 13]
    pieces = F.size(F.split(t, "[\\x20\\x09-\\x0D]+", -1))
    edges = F.ascii(t).isin(space).cast("int") + F.ascii(F.right(t, F.lit(1))).isin(space).cast("int")
    return F.when(t == "", F.lit(0)).otherwise(pieces - edges).cast("long")


def hash_key(*cols: Column) -> Column:
    """A uniform number in [0, 1) from the columns' values."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


# ---------------------------------------------------------------------------------------------------
# Word hashes over Arrow buffers.

_BLOCK = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and len + 1 offsets into them. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_utf8())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; no word crosses a text's end."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = _IS_SPACE[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    before = np.empty(len(data), dtype=bool)
    before[0] = True
    before[1:] = space[:-1]
    after = np.empty(len(data), dtype=bool)
    after[-1] = True
    after[:-1] = space[1:]
    starts = np.flatnonzero(~space & (before | cut[:-1]))
    ends = np.flatnonzero(~space & (after | cut[1:])) + 1
    return starts, ends


#: Substrings of more bytes are hashed one by one.
_LONG = 512
#: Chunks that are made at once.
_FEW = 1 << 15
#: Bytes of a number that are a substring's own, by how many there are.
_OWN = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def _keyed(chunks: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of chunks of 8 bytes as numbers and their places in a substring. Not linear in either, so no pattern of letters cancels
    out as it does in a polynomial modulo a power of two."""
    return mix(chunks ^ mix(at.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)))


def substring_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of substrings of bytes: a finalised sum over chunks of 8 bytes, each mixed with its place."""
    size = ends - starts
    sums = size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[:-8] = data
    at_byte = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    here = np.flatnonzero(size <= _LONG)
    most = -(-int(size[here].max(initial=0)) // 8)
    if len(here) * most <= _FEW:  # few substrings, as of a short text: all chunks at once
        at = np.arange(most)
        left = np.clip(size[here, None] - 8 * at, 0, 8)
        chunks = at_byte[np.minimum(starts[here, None] + 8 * at, len(data))] & _OWN[left]
        sums[here] += np.where(left > 0, _keyed(chunks, at), np.uint64(0)).sum(axis=1, dtype=np.uint64)
        here = here[:0]
    for k in range(most):
        here = here[size[here] > 8 * k]
        if not len(here):
            break
        left = np.minimum(size[here] - 8 * k, 8)
        sums[here] += _keyed(at_byte[starts[here] + 8 * k] & _OWN[left], np.array([k]))
    for i in np.flatnonzero(size > _LONG):
        for lo in range(int(starts[i]), int(ends[i]), _BLOCK):
            part = padded[lo : min(lo + _BLOCK, int(ends[i]))]
            chunks = np.zeros(-(-len(part) // 8) * 8, dtype=np.uint8)
            chunks[: len(part)] = part
            chunks = chunks.view("<u8")
            sums[i : i + 1] += _keyed(chunks, (lo - int(starts[i])) // 8 + np.arange(len(chunks))).sum(dtype=np.uint64)
    return mix(sums)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words with A-Z lower-cased."""
    return substring_hashes(_LOWER[data], starts, ends)


def pieces_of(batch: pa.RecordBatch, column: str, limit: int = 2 << 20):
    """Slices of a batch with about limit bytes of text each."""
    at = batch.schema.get_field_index(column)
    _, offs = text_buffer(batch.column(at))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j


#: A key is hot if it has more than one row in so many; fewer keys than that are.
HOT = 1000


def join_by_count(rows: DataFrame, per: DataFrame, key: str) -> DataFrame:
    """rows joined with per, which has a row for each key and the count of its rows. Rows of hot keys meet them by a
    broadcast of fewer than HOT rows, so that no task gets all rows of a common key."""
    least = max(1, (per.agg(F.sum("count")).first()[0] or 0) // HOT)
    hot = F.broadcast(per.where(F.col("count") > least))
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(per.where(F.col("count") <= least), key))


def give_back() -> None:
    """Returns free memory of this worker to the system, so that a reused worker does not hold what its last task needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def drop_table(df: DataFrame) -> None:
    """Deletes the files of a materialised table that nothing will read again."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/tables/" in name:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark drop shuffle files of finished queries, which it does when the driver collects garbage; that saves disk and
    changes nothing else. Off if spark.progdiv.release is false.

    Some of what a query held is only let go by what the first collection ran, so there are two.
    """
    if spark.conf.get("spark.progdiv.release", "true") == "false":
        return
    for pause in (0.5, 0.0):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(pause)


#: Modulus of rolling hashes, a prime: modulo a power of two, words of two letters like Thue and Morse's have equal sums.
PRIME = (1 << 61) - 1
_LOW31, _LOW30, _MOD = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1), np.uint64(PRIME)
_powers: dict[str, np.ndarray] = {}


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME."""
    x = (x & _MOD) + (x >> np.uint64(61))
    return np.where(x >= _MOD, x - _MOD, x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo PRIME, of numbers below it, by halves of 30 and 31 bits."""
    a1, a0, b1, b0 = a >> np.uint64(31), a & _LOW31, b >> np.uint64(31), b & _LOW31
    middle = a1 * b0 + a0 * b1
    return _reduced((a1 * b1 << np.uint64(1)) + (middle >> np.uint64(30)) + ((middle & _LOW30) << np.uint64(31)) + a0 * b0)


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... modulo PRIME."""
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        made = np.ones(1, dtype=np.uint64)
        while len(made) < n:
            made = np.concatenate([made, _times(made, np.full(1, pow(base, len(made), PRIME), dtype=np.uint64))])
        _powers[key] = made
    return _powers[key][:n]


class Rolling:
    """Hashes of any substring of some bytes (a few million at most), from running sums of a polynomial modulo PRIME."""

    def __init__(self, data: np.ndarray, base: int) -> None:
        powers, letters = _power(base, len(data)), data.astype(np.uint64) + np.uint64(1)
        high, low = np.cumsum(letters * (powers >> np.uint64(31))), np.cumsum(letters * (powers & _LOW31))
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        self.sums[1:] = _reduced((high >> np.uint64(30)) + ((high & _LOW30) << np.uint64(31)) + low)
        self.inverse = _power(pow(base, -1, PRIME), len(data) + 1)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix(_times(_reduced(self.sums[ends] + (_MOD - self.sums[starts])), self.inverse[starts]))


def gram_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """Of every substring of one length, by doubling, for choosing places: equal ones are equal, and a few others may be too."""
    x, have, out, done = data.astype(np.uint64) + np.uint64(1), 1, None, 0
    while True:
        if length & have:
            out = x if out is None else out[: len(x) - done] * np.uint64(pow(_GRAM, have, 1 << 64)) + x[done:]
            done += have
        if 2 * have > length:
            return mix(out[: len(data) - length + 1])
        x = x[:-have] * np.uint64(pow(_GRAM, have, 1 << 64)) + x[have:]
        have *= 2


_GRAM = 0x9E3779B97F4A7C15
