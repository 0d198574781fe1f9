"""Corpus pipeline over ``documents``: four stages, each written before the next one reads it.

Quality rules, exact dedup, near dedup, packing.  All stages but the last return
the columns of ``documents``, for the documents that they keep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import exact_dedup, minhash, packing, quality_rules
from panelspark.llm._shared import discard, written
from panelspark.llm.queries import vocabulary


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that the fixed part or the learned list rejects go."""
    rules = quality_rules.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    # no filter on the verdict: it would be pushed into the statistics and repeat their work
    return quality_rules.judge(docs, rules).select(F.explode(F.when(F.col("kept"), F.array("row"))).alias("row")).select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: one document of each text stays."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: one document of each class stays."""
    return minhash.drop_near_copies(docs)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: the pieces of every document in sequences of 1024 tokens."""
    pieces = packing.token_pieces(docs, vocabulary("byte_bpe_50k.json"), capacity=1024, end_id=2)
    return packing.pack(pieces, capacity=1024)


STAGES = [("quality rules", keep_good), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("best-fit packing", pack_documents)]

#: The stages learn from labels, sketch and pack by a heuristic, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, from the documents table; a stage's input goes when its output stands."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
