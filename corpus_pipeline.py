"""The corpus pipeline: quality rules, near-duplicates, passages, benchmark contamination, packing.

Each stage reads what the one before has written, works on all of it, and returns the columns of ``documents`` (the last:
the packed pieces). Documents that a stage rejects are gone for the next one.

Every row is a document of its own: rows that share a doc_id, equal rows and rows without a doc_id are kept, cut or dropped
one by one, and none is multiplied. Where an order decides (which copy stays, who keeps a passage), it is that of doc_id,
then of the text's digest, rows without a doc_id last. Null and empty texts fail the quality rules; nulls in other
columns, and further columns under any name, go through. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noctua.llm import decontaminate, minhash, packing, passage_dedup, quality
from noctua.llm._shared import ROW, keyed, n_buckets, read, scratch, stored, survey, without


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text no quality rule rejects."""
    return quality.kept_rows(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each group of near-duplicates: shingles of five words, similarity 0.8. Rows without words stay."""
    n_bytes, unique = survey(docs)
    rows = keyed(docs, unique)
    with scratch(spark) as keep:
        found = minhash.classes(rows.select(F.col(ROW).alias("doc_id"), F.col("text").cast("string").alias("text")), n_bytes, size=5, percent=80)
        copies = keep(stored(found.where("NOT kept").select("doc_id"), "copies"))
    return without(rows, copies, n_buckets(spark, 2, n_bytes)).select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without passages of 50 words or more that earlier ones hold; rows of which no word is left go."""
    gone = F.col(ROW + "_removed") > 0
    out = passage_dedup.cut_rows(docs, least=50).where(~gone | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.when(gone, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no window of ten words of a benchmark item."""
    _, unique = survey(docs)
    rows = keyed(docs, unique)
    with scratch(spark) as keep:
        found = decontaminate.hit_ids(rows.select(F.col(ROW).alias("doc_id"), "text"), read(spark, sf_dir, "benchmark"))
        hit = keep(stored(found.withColumnRenamed("doc_id", ROW), "hit"))
    # keys below the session's broadcast threshold go to the rows; else both are dealt out by key
    return rows.join(hit, ROW, "left_anti").select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in training sequences."""
    return packing.packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Clusters of near-duplicates, chains and packing are beyond SQL: the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
