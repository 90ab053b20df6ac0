"""A corpus pipeline over ``documents``: five stages, each one corpus operator.

Every stage takes (spark, docs, sf_dir), works on all rows of its predecessor
and returns a DataFrame; all but the last return the columns of documents.
``run`` writes each stage's result as Parquet to the shared folder and reads it
again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidevec.llm._util import written
from tidevec.llm.decontamination import without_hits
from tidevec.llm.jaccard_join import keep_one
from tidevec.llm.mixing import mixed_rows
from tidevec.llm.quality import keep_clean
from tidevec.llm.sharding import shard_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by 80 % of their five-word shingles one stays."""
    return keep_one(docs, k=5, t=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window of ten words with a benchmark item go."""
    return without_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixed_rows(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix dealt to 24 shards of near equal size; copies stay together."""
    return shard_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("sharding", sharding),
]

#: SQL can't express the fitted classifier; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
