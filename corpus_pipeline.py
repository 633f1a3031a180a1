"""A corpus from raw documents to packed sequences: each stage is a table that the next one reads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from structnet.llm import decontaminate, exact_dedup, packing, quality, simhash_dedup
from structnet.llm.common import only, read


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier gives a score of 0.3 or more."""
    return quality.keep_good(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the longest as written, then the smallest doc_id."""
    return only(docs, exact_dedup.exact_groups(docs).where("kept"))


def distinct_contents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the most words, then the smallest doc_id.

    Groups are linked by deletion-variant signatures at 2 bits, as in op7, and by texts that are 0.8 similar, which these miss.
    """
    groups = simhash_dedup.near_duplicates(docs, radius=2)
    best = F.max(F.struct("n_words", F.bitwise_not("doc_id").alias("neg"), "text_hash"))
    kept = groups.groupBy("group").agg(best.alias("best"))
    return only(docs, kept.select(F.bitwise_not("best.neg").alias("doc_id"), "best.text_hash"))


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean_documents(docs, read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training sequences, ids included."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", distinct_texts),
    ("simhash near-dedup", distinct_contents),
    ("benchmark decontamination", no_benchmark),
    ("packing", packed),
]

#: Neither a classifier nor a tokenizer can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from the table documents; tables between stages go to the shared checkpoint folder."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints"
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = f"{folder.rstrip('/')}/pipeline-{uuid.uuid4().hex}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
