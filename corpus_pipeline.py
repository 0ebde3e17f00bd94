"""From documents to packed training sequences, in stages that are each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from progdiv.llm import langid, minhash, mixing, packing, secrets

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Least mean probability of the words' own labels in a document that is kept.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or whose words have no language that stands out; several languages may mix.

    Null, empty and letterless texts go; long ones are judged whole; repeated rows are judged each; without any row to learn
    from nothing stays, so an empty table stays empty; other columns go."""
    found = langid.identify(docs)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("certainty") >= LEAST_SCORE)).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest doc_id and, if that is on several texts of
    the group, the least hash of its text. Rows equal in doc_id and text are one document. Documents that link with nothing
    stay, as do rows without doc_id. Null and empty texts link with nothing; an empty table stays empty; other columns go."""
    found = minhash.near_duplicates(docs, k=5, percent=80).where("kept AND doc_id IS NOT NULL")
    grouped = found.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("row")).select("row.*")
    kept = grouped.union(found.where("component IS NULL").select("doc_id", "text_hash")).distinct().withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    known = docs.where("doc_id IS NOT NULL").select(*COLUMNS, F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text"))
    known = known.join(kept, (F.col("doc_id") == F.col("_id")) & (F.col("_text") == F.col("_hash")), "left_semi").dropDuplicates(["doc_id", "_text"])
    return known.select(*COLUMNS).union(docs.where("doc_id IS NULL").select(*COLUMNS))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, with its secrets replaced by a mark and its n_chars counted anew.

    Null texts stay null with their n_chars, empty ones empty; long texts are scanned whole; repeated rows stay; an empty table
    stays empty; other columns go."""
    found = secrets.scan_secrets(docs, keep=COLUMNS)
    spans = F.array_sort(F.concat("base", "added"))
    text = F.when(F.size("base") + F.size("added") > 0, secrets.redact(F.col("text"), spans)).otherwise(F.col("text"))
    return found.withColumn("text", text).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their target weights.

    Null sources are one source, the last; texts without words (null, empty) have no size and come as often as their draw says;
    repeated rows are drawn each; long texts count by their words; an empty table stays empty; other columns go."""
    return mixing.mixed(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents with their places in sequences.

    Null and empty texts are the end id alone; texts longer than a sequence are cut; repeated rows and rows without doc_id are
    packed each; an empty table gives no rows; other columns don't matter."""
    return packing.pack(docs)


STAGES = [("language", language), ("near_dedup", near_dedup), ("secrets", secret_scan), ("mix", mix), ("pack", pack)]

#: Language identification and tokenisation have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from progdiv.llm.common import materialize

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
