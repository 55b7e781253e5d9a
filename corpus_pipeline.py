"""From raw documents to shuffled training shards.

Each stage takes ``(spark, docs, sf_dir)`` and gives the documents that it keeps; the last one adds
``shard`` and ``slot``. Every stage works on the whole output of the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gradeloom.llm.decontaminate import decontaminated
from gradeloom.llm.language_id import keep_identified
from gradeloom.llm.shards import sharded
from gradeloom.llm.simhash_dedup import keep_one_of_each
from gradeloom.llm.source_mix import mixed
from gradeloom.plans.durable import written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network knows; without letters or with a doubtful language they go."""
    return keep_identified(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more; by SimHash blocks, an exact check and an exact join of the rest."""
    return keep_one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the targets of their sources take them."""
    return mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their place in 40 uniformly shuffled shards."""
    return sharded(docs)


STAGES = [("language", language), ("near copies", near_copies), ("benchmark", benchmark), ("mix", mix), ("shards", shards)]
#: No SQL: the first stage is a trained network and the last one draws from a hypergeometric law.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
