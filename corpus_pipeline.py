"""The corpus pipeline: toxicity, near copies, benchmark passages, encoding.

Each stage takes (spark, docs, sf_dir) and returns a table; it is written as Parquet and read again as the
next one's ``docs``. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm import bpe, decontam, simhash, toxicity
from callweave.llm.common import absent, shared_folder

#: Documents scored at or above this are rejected.
TOXIC_FROM = 0.5


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go. The model is learned from the labels of the same table that are not held out."""
    model = toxicity.train_on_open_labels(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    own = absent(docs.columns, "score")
    scored = toxicity.score(docs, model, output=own)
    return scored.filter(F.col(own) < TOXIC_FROM).select(*(F.col(f"`{c}`") for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard 0.8 or more) one document stays."""
    return simhash.near_dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark window go."""
    return decontam.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids): the training tokens of each document that is left."""
    ids = bpe.encode(docs.select("doc_id", "text"), bpe.lexicon_for(docs))
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("toxicity", reject_toxic), ("simhash_near_dedup", drop_near_copies), ("benchmark_decontamination", drop_contaminated), ("bpe_encoding", encode)]

#: The stages' hashes, models and merges are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the cluster's shared folder."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
