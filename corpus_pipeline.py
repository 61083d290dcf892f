"""A corpus from raw documents to shards: five stages, each written before the next reads it.

Every stage but the last returns the columns of ``documents``; the last adds shard and slot.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, language, minhash_hamming, mixing, sharding
from tidemark.llm.common import checkpoint_folder, sized, stored, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are prose of a language learned from these documents."""
    return language.in_known_language(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near-duplicates."""
    found = minhash_hamming.near_duplicates(docs)
    dropped = sized(stored(found.where("NOT kept").select("doc_id").distinct()))
    kept = docs.join(dropped, "doc_id", "left_anti")
    # Rows of one doc_id are one document; a row without doc_id stays.
    repeated = docs.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL")
    repeated = sized(stored(repeated.select("doc_id")))
    once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(repeated, "doc_id", "left_anti").unionByName(once)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and their place in it."""
    rows = sharding.shard(docs)
    return rows.select(*docs.columns, "size", "text_crc32", "law", "shard", "slot", "grown_shard")


STAGES = [
    ("language", known_language),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: Projections, signatures and packing have no equivalent in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet in the checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs.select(*[F.col(c) for c in docs.columns])
