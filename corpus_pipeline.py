"""From raw documents to packed sequences: five stages, each on all that the one before it kept.

Defined cases: null and empty texts score as texts without features, are in no near-duplicate group, have no tokens to mix
by and pack as the end token alone; rows with a null doc_id are scored, mixed and packed like others and never
removed as copies; of repeated rows of a document one stays; extra columns pass all stages but the last; an empty table
gives no rows. Labels that are missing or of one class make a classifier that scores all texts alike (see ``fm``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from echolex.llm import minhash, mixing, packing, quality, queries, toxicity
from echolex.llm.scratch import cut, drop, drop_since, mark


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.remove(docs, toxicity.train(docs, _labels(spark, sf_dir)))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.remove(docs, quality.train(docs, _labels(spark, sf_dir)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.remove(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, queries.tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("minhash", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL can express neither the classifiers nor best-fit packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, earlier = mark(), docs
        docs = cut(stage(spark, docs, sf_dir), name)
        # what the stage itself wrote, and what it read, is not read again
        drop_since(before, docs)
        drop(earlier)
    return STAGES[-1][1](spark, docs, sf_dir)
