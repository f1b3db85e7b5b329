"""From raw documents to packed training sequences: toxicity, quality, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return
the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm import packing, quality, simhash, toxicity
from stowage.llm.common import materialize
from stowage.llm.queries import BYTE_BPE, CAPACITY

#: No SQL states the trained models or the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.train(docs, labels(spark, sf_dir)))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.train(docs, labels(spark, sf_dir)))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows whose five-word shingles are similar by 0.8 or more, one row stays: with the smallest doc_id, a missing one last, and of these the first stored.

    Rows are told apart by where they are stored, so rows without a doc_id and one doc_id's different texts go only as members of a group.
    All columns come back as they were, whatever their names.
    """
    rows = simhash.numbered(docs.select(F.struct(*docs.columns).alias("doc")))
    found = simhash.near_rows(rows.select("row", "doc.text"), words=5, similarity=0.8).join(rows.select("row", "doc.doc_id"), "row")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    kept = found.groupBy("component").agg(first.alias("first")).select("first.row")
    return rows.join(kept, "row", "left_semi").select("doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path(BYTE_BPE), CAPACITY)


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near-dedup", drop_near_copies), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each result stored as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
