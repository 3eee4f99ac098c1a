"""A training corpus from ``documents``: filtered, deduplicated, decontaminated, mixed and sharded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import decontaminate, mixing, ngram_join, sharding, toxicity
from tidewell.llm.common import free_name, table, written

SHARDS = 24

#: No SQL: stages learn from labels and mix by hash order. Each stage is tested against a brute-force version.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half. Labels are read, and learnt from outside the held-out fold."""
    chars, judge = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    own = free_name(docs, "toxicity")
    return toxicity.score_documents(docs, chars, judge, into=own).filter(F.col(own) < 0.5).drop(own)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts whose five-word shingles are at least 80 % alike."""
    return ngram_join.one_of_each(docs, width=5, threshold=ngram_join.Threshold(80, 100))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which fewer than one word in twenty stands in a passage of the benchmark."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"), window=13, share=20)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the curriculum reads them, in its order."""
    return mixing.mixed_corpus(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the shard and slot they are stored at."""
    return sharding.sharded_corpus(docs, SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
