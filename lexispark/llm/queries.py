"""One query for each operator, over its whole table with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fingerprints, html_extract, langid, packing, perplexity, sentence_pieces, simhash, token_counts, toxicity, warc
from .util import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scores = stored(perplexity.score(docs, perplexity.train(perplexity.count(docs))), "scores")
    return perplexity.judge(scores, perplexity.bands(scores))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = stored(fingerprints.fingerprint(table(spark, sf_dir, "documents")), "prints")
    items = fingerprints.fingerprint(table(spark, sf_dir, "benchmark"), "item_id").withColumnRenamed("doc_id", "item_id")
    return fingerprints.nearest(fingerprints.near_copies(fingerprints.twins(prints)), items)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(table(spark, sf_dir, "pages"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality_rules, op2_fingerprints, op3_html_text, op4_packing, op5_language, op6_token_counts, op7_warc, op8_sentence_pieces, op9_toxicity, op10_near_duplicates)
}
ORACLES: dict[str, str] = {"op7_warc": warc.ROUND_TRIP_SQL}
