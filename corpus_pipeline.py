"""From raw documents to token ids: quality, language, near-duplicates, mixing, BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spectraloom.llm import bpe, jaccard, language, mixing, quality
from spectraloom.llm.common import crc_mod, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.quality(docs).where("kept").select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language, which becomes their lang; learned from the labelled rows of docs."""
    train = docs.where(F.coalesce(crc_mod("doc_id", 5) != 0, F.lit(False)))
    out = language.identify(docs, train)
    return out.where((F.col("lang_pred") != "und") & (F.col("score") >= language.MIN_SCORE)).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle sets that link at 80 %.

    It is the one with the least doc_id (null last), and of several texts under that doc_id the one with the least
    hash; of repeated rows the first by the other columns stays.  Documents without words are linked with nothing and stay.
    """
    found = written(jaccard.jaccard_components(docs, words=5, percent=80).where("class is not null"), "components")
    first = found.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th")).alias("k"))
    kept = first.select(F.col("k.doc_id").alias("_id"), F.col("k.th").alias("_th"))
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(mixing.WORD)
    keyed = docs.where(worded).withColumn("_hash", F.xxhash64("text"))
    out = keyed.join(kept.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_th")), "left_semi")
    if found.groupBy("doc_id", "th").count().where("count > 1").limit(1).count():
        first = Window.partitionBy("doc_id", "_hash").orderBy("lang", "source", "n_chars")
        out = out.withColumn("_nth", F.row_number().over(first)).where("_nth = 1")
    return out.select(*COLUMNS).unionAll(docs.where(~worded).select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: taken / size times, rounded up or down by a hash of the text."""
    rows, _, _ = mixing.mix(docs)
    rows = rows.where("size > 0").groupBy("doc_id", "th").agg((F.sum("taken") / F.sum("size")).alias("times"))
    docs = docs.withColumn("th", F.xxhash64("text"))
    share = F.pmod(F.xxhash64("doc_id", "th"), F.lit(1 << 20)) / (1 << 20)
    rows = rows.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.floor(F.col("times") + share).cast("int").alias("n")).where("n > 0")
    out = docs.join(rows.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")))
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), "n"))).select(*COLUMNS)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return bpe.encode(docs, keep=["doc_id"], digest=True)


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("near_duplicates", near_duplicates), ("mix_sources", mix_sources), ("bpe_encode", bpe_encode)]

#: SQL cannot express the language, mixing and BPE stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to the shared folder before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
