"""Running diversity of generations that arrive as a stream, with state that outlives a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_STATE = "seen binary, members bigint, total bigint"
_DDL = "members bigint, n_distinct bigint, n_total bigint"


def first_arrivals(stream: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """Each generation once: rows whose keys came before within `late` are dropped, and so are rows older than that, by the watermark;
    the state of keys is forgotten behind it."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def running_distinct_n(generations: DataFrame, problem: str, tokens: str, n: int) -> DataFrame:
    """Of a stream of generations, each once, a row for every problem of a batch: members and n-grams so far, distinct and all, and
    their share (null for at most one). A problem's state is the sorted 64-bit hashes of its n-grams, so it grows with what
    is new alone."""
    hashed = gram_hashes_in_rows(generations, [problem], tokens, n)

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, members, total = state.get if state.exists else (b"", 0, 0)
        known = [np.frombuffer(seen, np.int64)]
        for part in parts:
            members += len(part)
            for h in part["h"]:
                total += len(h)
                known.append(np.asarray(h, np.int64))
        distinct = np.unique(np.concatenate(known))
        state.update((distinct.tobytes(), members, total))
        yield pd.DataFrame({problem: [key[0]], "members": [members], "n_distinct": [len(distinct)], "n_total": [total]})

    kind = generations.schema[problem].dataType.simpleString()
    folded = hashed.groupBy(problem).applyInPandasWithState(fold, f"{problem} {kind}, {_DDL}", _STATE, "append", GroupStateTimeout.NoTimeout)
    return folded.withColumn("distinct_n", F.when(F.col("n_total") > 1, F.col("n_distinct") / F.col("n_total")))


def gram_hashes_in_rows(frame: DataFrame, keys: list[str], tokens: str, n: int) -> DataFrame:
    """keys and h, the hashes of each row's n-grams, as gram_hashes makes them; an empty array without any."""
    words = F.transform(F.coalesce(tokens, F.array().cast("array<string>")), lambda w: F.xxhash64(w))
    out = frame.select(*keys, words.alias("_w")).withColumn("h", F.col("_w"))
    for k in range(2, n + 1):
        left = F.greatest(F.size("_w") - (k - 1), F.lit(0))
        out = out.withColumn("h", F.zip_with(F.slice("h", F.lit(1), left), F.slice("_w", F.lit(k), left), lambda g, w: F.xxhash64(g, w)))
    return out.select(*keys, "h")


def latest(updates: DataFrame, problem: str) -> DataFrame:
    """The last row of each problem: the one with most members, as a member is never lost."""
    last = Window.partitionBy(problem).orderBy(F.desc("members"), F.desc("n_total"))
    return updates.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k")
