"""The corpus pipeline: quality rules, toxicity, near-duplicate removal, packing.

Every stage gets all that its predecessor kept, reread from Parquet. All but the last return the columns of documents, whatever further
columns there are. Null and empty texts pass the first two stages and have no near copies; no bin holds them, as they need no room. Null
doc_ids pass and are in no group; repeated rows of a doc_id become one in the third stage. Ties: of a group the smallest doc_id stays. Of
an empty table every stage gives an empty one, and run() no bins. Without labels of both classes no document is toxic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexispark.llm import packing, perplexity, simhash, toxicity
from lexispark.llm.util import remove, shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity lies inside their language's band, under a model of these documents."""
    return perplexity.reject(docs, perplexity.train(perplexity.count(docs)))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, trained on the labels of these documents, does not find toxic."""
    return toxicity.reject(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.deduplicate(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of documents."""
    return packing.pack_documents(docs)


STAGES = [("quality rules", quality), ("toxicity", toxic), ("near-duplicate removal", near_duplicates), ("best-fit packing", pack)]

#: The language model, the network and the search for near copies are beyond SQL: tests/llm/test_pipeline.py holds run() against plain versions of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table goes once its successor is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        path = shared_dir(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
