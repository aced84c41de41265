"""Raw documents to sharded training data: five stages, each over all that the one before kept.

Every stage's result is written as Parquet under the shared folder and read again by the next, so a lost executor costs
tasks and no stage; what a stage wrote for itself goes when it is done. All stages but the last return the columns of
documents, whatever further columns there are and whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import classifier, decontaminate, mixing, neardup, sharding
from millrace.llm import kernel as K
from millrace.workspace import cleared, drop, scratch


def kept_rows(judged: DataFrame, docs: DataFrame) -> DataFrame:
    return judged.filter("kept").select(*K.unboxed(docs.columns))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the hierarchical classifier keeps.

    A null or empty text is judged as one, a very long one as a whole, repeated rows each for itself. Without labels of
    both kinds all rows stay; an empty table stays empty.
    """
    rows = docs.select(K.boxed(docs.columns), "doc_id", "text", "source", "lang")
    return kept_rows(classifier.classify(rows, K.tuned(spark).read.parquet(f"{sf_dir}/labels.parquet"), carry=["row"]), docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near duplicates (five words, 0.8).

    Rows of one doc_id are one document and stay or go together; rows without doc_id, and texts without words, all stay,
    null and empty ones among them. Very long texts are compared whole. An empty table stays empty.
    """
    K.tuned(spark)
    rows = docs.select(K.boxed(docs.columns), "doc_id", "text")
    return kept_rows(neardup.near_duplicates(rows, shingle=5, percent=80, carry=True), docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs.

    Null and empty texts hold none; very long ones are searched whole, repeated rows judged alike. An empty benchmark
    hits nothing; an empty table stays empty.
    """
    return decontaminate.decontaminate(docs, K.tuned(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def in_proportion(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as the mix takes them.

    Null and empty texts have no words and stay once, unless their source has no words at all. Very long texts count
    whole; repeated rows and null ids or sources are fine. An empty table gives an empty mix.
    """
    K.tuned(spark)
    return mixing.mixed(docs)


def in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns, with shard and slot. Every row gets a place, whatever is null, empty, long or repeated in it."""
    K.tuned(spark)
    return sharding.shard(docs)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", without_copies),
    ("decontaminate", without_benchmark),
    ("mix", in_proportion),
    ("shard", in_shards),
]

#: The classifier's verdicts can't be said in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        with cleared(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            drop(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
