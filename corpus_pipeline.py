"""A training-corpus pipeline: five stages over `documents`, each working on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewatch.llm import decontaminate, dedup, packing, pii, quality
from lodewatch.llm.common import Stored
from lodewatch.llm.queries import tokenizer

#: Ids of dropped documents are broadcast up to this number (8 bytes each), else the texts are shuffled to them.
BROADCAST_DROPPED = 1_000_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.good_documents(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the least id; shingles of five words, 0.8.

    Rows of one id are one group, of which one row stays. Texts without words and rows without an id all stay.
    """
    stored = Stored(spark)
    found = stored.put(dedup.near_duplicates(docs, k=5, percent=80), "found")
    dropped = stored.put(found.where(~F.col("kept")).select("doc_id").distinct(), "dropped")
    again = found.where("kept and doc_id is not null and n_shingles > 0").groupBy("doc_id").count().where("count > 1")
    again = stored.put(again.select("doc_id"), "again")
    near = F.broadcast if dropped.count() <= BROADCAST_DROPPED else lambda df: df
    left = docs.join(near(dropped), "doc_id", "left_anti").select(*docs.columns)
    repeated = again.count()
    if not repeated:
        return left
    near = F.broadcast if repeated <= BROADCAST_DROPPED else lambda df: df
    worded = F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    mark = left.join(near(again.withColumnRenamed("doc_id", "again")), F.col("again") == F.col("doc_id"), "left")
    several = mark.where(F.col("again").isNotNull() & worded).groupBy("again").agg(F.min_by(F.struct(*docs.columns), F.xxhash64("text")).alias("row"))
    return mark.where(F.col("again").isNull() | ~worded).select(*docs.columns).unionByName(several.select("row.*"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, and terms that reveal it, are replaced by their kind; n_chars follows the new text."""
    clean = pii.sanitise(docs)
    return clean.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every text's tokens, placed in sequences of 2048."""
    return packing.pack_documents(docs, tokenizer("word_bpe_49k.json"), 2048)


STAGES = [
    ("quality", quality_stage),
    ("minhash_dedup", dedup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Classifier, MinHash and packing can't be said in SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; each stage's result is written to the shared folder and read again."""
    stored = Stored(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored.put(stage(spark, docs, sf_dir), name)
    return docs
