"""From raw documents to shards: five stages, each an operator of ``pricelens.llm``.

A stage takes all documents that its predecessor kept. All but the last return the columns of
documents; each is written as Parquet and read again before the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.llm import contamination, mixing, quality, sharding, similarity
from pricelens.llm.tables import fresh, quoted, table
from pricelens.session import shared_dir, ship_package

#: Shares of tokens after the mixing stage.
SHARES = {"clean": 0.97, "low": 0.02, "toxic": 0.01}

#: Neither a stage's decisions nor the model can be written in SQL.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more; columns stay as they are."""
    ship_package(spark)
    labels = table(spark, sf_dir, "labels")
    model = quality.train(table(spark, sf_dir, "documents"), labels)
    scored = quality.score(docs, model)
    kept = scored.where(F.col(quoted(scored.columns[-1])) >= 0.5)
    return kept.select(*[F.col(quoted(c)) for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document (smallest doc_id) of each group of linked ones.

    Rows with the same doc_id and text count once; rows without doc_id link nothing and stay.
    """
    ship_package(spark)
    found = similarity.jaccard_classes(docs)
    id_, other = fresh(docs, "_id"), F.col("component_id") != F.col("doc_id")
    losers = found.where(other).select(F.col("doc_id").alias(id_)).distinct()
    kept = docs.join(losers.hint("shuffle_hash"), docs.doc_id == F.col(id_), "left_anti")
    return kept.dropDuplicates(["doc_id", "text"])


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark; rows without doc_id stay."""
    ship_package(spark)
    found = contamination.report(docs, table(spark, sf_dir, "benchmark"), distance=None)
    id_ = fresh(docs, "_id")
    losers = found.where("contaminated").select(F.col("doc_id").alias(id_)).distinct()
    return docs.join(losers.hint("shuffle_hash"), docs.doc_id == F.col(id_), "left_anti")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents thinned to the target shares; nothing is doubled, clean documents stay."""
    ship_package(spark)
    labels = mixing.domain(table(spark, sf_dir, "labels"))
    return mixing.thinned(docs, labels, SHARES)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and slot."""
    ship_package(spark)
    return sharding.shard(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", clean_of_benchmark),
    ("mixing sources to target weights", mixture),
    ("sharding", shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; intermediate tables go to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for place, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{place}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
