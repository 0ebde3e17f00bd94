"""Document fingerprints by winnowing, with DataFrame functions alone.

Words are hashed once; a k-gram's hash is the rolling one of Karp and Rabin, a polynomial in BASE over its words' hashes
modulo PRIME: the grams' sums are those of the one word shorter grams, rolled on by a word. Windows of w grams take their
minimum by doubling steps, ties going to the rightmost. Selected positions are kept: any passage of
w + k - 1 words shared by two texts shares a selected gram.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, W = 3, 8
#: The largest prime below 2^33, and a base that keeps products below 2^63.
PRIME, BASE = (1 << 33) - 9, 536_870_909
#: A packed gram: 33 bits of its hash above the complement of its position, so that the least is the
#: least hash and, of equal hashes, the rightmost.
_POS = 30


def _shifted(a: str, by: int, combine) -> Column:
    n = F.size(a) - by
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(by + 1), n), combine)


def _rolled(h: Column, word: Column) -> Column:
    return F.pmod(h * F.lit(BASE) + word, F.lit(PRIME))


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds `out`: packed selected grams in order of position; texts with at most W grams keep all grams.

    A text without words has none; with fewer than K words its only gram is the whole sequence of words.
    """
    keep = list(df.columns)
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "")
    df = df.withColumn("_a", F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(PRIME))))
    whole = F.aggregate("_a", F.lit(0).cast("long"), _rolled)
    df = df.select(*keep, F.when(F.size("_a") < K, F.when(F.size("_a") > 0, F.array(whole)).otherwise(F.array().cast("array<bigint>"))).alias("_few"), "_a")
    two = F.when(F.col("_few").isNull(), _shifted("_a", 1, _rolled))
    df = df.select(*keep, "_few", "_a", two.alias("_two"))
    n = F.size("_two") - 1
    grams = F.coalesce("_few", F.zip_with(F.slice("_two", F.lit(1), n), F.slice("_a", F.lit(3), n), _rolled))
    packed = F.transform(grams, lambda h, i: F.shiftleft(h, _POS) + (F.lit((1 << _POS) - 1) - i))
    df = df.select(*keep, packed.alias("_m"))
    df = df.select(*keep, F.when(F.size("_m") <= W, F.col("_m")).alias("_all"), "_m")
    by = 1
    while by < W:
        df = df.select(*keep, "_all", F.when(F.col("_all").isNull(), _shifted("_m", by, lambda x, y: F.least(x, y))).alias("_m"))
        by *= 2
    return df.select(*keep, F.coalesce("_all", F.array_distinct("_m")).alias(out))


def gram_hashes(fingerprint: str) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda x: F.shiftright(x, _POS)))


def positions(fingerprint: str) -> Column:
    """Word positions of the selected grams."""
    return F.transform(fingerprint, lambda x: F.lit((1 << _POS) - 1) - F.pmod(x, F.lit(1 << _POS)))


def digest(fingerprint: str) -> Column:
    """Of all selected hashes and positions."""
    return F.sha2(F.array_join(F.transform(fingerprint, lambda x: x.cast("string")), ","), 256)


def likeness(a: str, b: str) -> Column:
    """Shared of all distinct hashes of two hash arrays; two empty ones are alike."""
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(shared, F.size(a) + F.size(b) - shared), F.lit(1.0)).cast("double")


def _buckets(ids: DataFrame, parts: int) -> list[list[int]]:
    """Ascending values of doc_id that begin buckets of about equal counts, in at most about sqrt(parts) lists."""
    ranks = [i / parts for i in range(parts)]
    row = ids.agg(F.percentile_approx("doc_id", ranks, max(10_000, 10 * parts)).alias("q"), F.min("doc_id").alias("least")).first()
    if row["least"] is None:
        return []
    found = sorted({row["least"], *row["q"]})
    step = math.isqrt(len(found) - 1) + 1
    return [found[i : i + step] for i in range(0, len(found), step)]


def with_next(docs: DataFrame, cols: list[str], parts: int) -> DataFrame:
    """Adds next_<col> of the row that follows by doc_id (ties: by text); the first row follows the last.

    Rows are dealt into ranges of doc_id; each range's first rows are also given to the range before it,
    so that no range needs another and no sort is global. Null ids come first.
    """
    lists = _buckets(docs.select("doc_id"), parts)
    if not lists:  # no ids at all
        lists = [[0]]
    firsts = [b for x in lists for b in x]
    upto = lambda a, v: F.size(F.filter(a, lambda b: b <= v))
    v = F.coalesce(F.col("doc_id"), F.lit(firsts[0]))
    outer = F.greatest(upto(F.array(*(F.lit(x[0]) for x in lists)), v), F.lit(1))
    nested = F.array(*(F.array(*map(F.lit, x)) for x in lists))
    bucket = (outer - 1) * len(lists[0]) + F.greatest(upto(F.element_at(nested, outer), v), F.lit(1)) - 1
    docs = docs.withColumn("_b", bucket.cast("int"))
    begins = F.element_at(nested, outer)
    is_first = F.array_contains(begins, F.col("doc_id")) | F.col("doc_id").isNull()
    n = len(firsts)
    ghost = F.struct(F.pmod(F.col("_b") - 1, F.lit(n)).alias("b"), F.lit(1 if n > 1 else 2).alias("late"))
    docs = docs.withColumn("_to", F.explode(F.when(is_first, F.array(F.struct(F.col("_b").alias("b"), F.lit(0).alias("late")), ghost)).otherwise(F.array(F.struct(F.col("_b").alias("b"), F.lit(0).alias("late"))))))
    docs = docs.select(*[c for c in docs.columns if c not in ("_b", "_to")], F.col("_to.b").alias("_b"), F.col("_to.late").alias("_late"))
    order = Window.partitionBy("_b").orderBy("_late", F.col("doc_id").asc_nulls_first(), "text")
    docs = docs.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in cols))
    return docs.where("_late = 0").drop("_b", "_late")


def edited(text: str, following: str) -> Column:
    """The last quarter of the code points replaced by the first as many of the following text."""
    n = F.length(text)
    q = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - q), F.substring(following, F.lit(1), q))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text, fingerprint, next_text, next_fingerprint, edited, edited_fingerprint of every document.

    Null texts are empty; an empty table gives no rows; repeated rows follow each other, by text; rows without doc_id
    come first; texts are taken whole, up to 2^30 words; other columns don't matter.
    """
    spark = docs.sparkSession
    parts = min(65_536, max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    docs = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    docs = with_next(with_fingerprint(docs, "text", "fingerprint"), ["text", "fingerprint"], parts)
    return with_fingerprint(docs.withColumn("edited", edited("text", "next_text")), "edited", "edited_fingerprint")
