"""From a query tree to one lazy plan.

All leaves are scored by one pass over postings; one aggregate by document holds a column for each leaf; the
Boolean tree over them is an expression. So a query of any depth shuffles once.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexispark.functions.scoring import Similarity
from lexispark.operators.leaves import leaf_scores
from lexispark.plans.query import MUST, MUST_NOT, SHOULD, Boolean, Query, QueryParams, build_query
from lexispark.sources.index import Index

#: Hits up to which a top list passes through the driver to fetch stored fields by id.
FETCHED = 1000
HITS = "doc_id long, score double"


def leaves_of(q: Query) -> list[Query]:
    """The distinct leaves of a tree."""
    if isinstance(q, Boolean):
        return list(dict.fromkeys(leaf for _, c in q.clauses for leaf in leaves_of(c)))
    return [q]


def composed(q: Query, number: Mapping[Query, int]) -> tuple[Column, Column]:
    """Whether a document matches, and its score, from the leaves' columns s0, s1, ..."""
    if not isinstance(q, Boolean):
        s = F.col(f"s{number[q]}")
        return s.isNotNull(), F.coalesce(s, F.lit(0.0))
    parts = {o: [composed(c, number) for o2, c in q.clauses if o2 == o] for o in (MUST, SHOULD, MUST_NOT)}
    if not parts[MUST] and not parts[SHOULD]:
        return F.lit(False), F.lit(0.0)
    matched = F.lit(bool(parts[MUST]))
    for m, _ in parts[MUST]:
        matched = matched & m
    count, total = F.lit(len(parts[MUST])), F.lit(0.0)
    for _, s in parts[MUST]:
        total = total + s
    for m, s in parts[SHOULD]:
        if not parts[MUST]:
            matched = matched | m
        count = count + m.cast("int")
        total = total + F.when(m, s).otherwise(0.0)
    for m, _ in parts[MUST_NOT]:
        matched = matched & ~m
    return matched, total * count / F.lit(float(len(parts[MUST]) + len(parts[SHOULD])))


def evaluate(index: Index, q: Query, similarity: Similarity = Similarity.BM25, weights: Mapping[str, float] | None = None) -> DataFrame:
    """(doc_id, score) of every match, not normalised."""
    leaves = leaves_of(q)
    parts = leaf_scores(index, leaves, similarity, weights or {})
    if parts is None:
        return index.spark.createDataFrame([], HITS)
    sums = [F.sum(F.when(F.col("leaf") == k, F.col("part"))).alias(f"s{k}") for k in range(len(leaves))]
    docs = parts.groupBy("doc_id").agg(*sums)
    matched, score = composed(q, {leaf: k for k, leaf in enumerate(leaves)})
    return docs.where(matched).select("doc_id", score.cast("double").alias("score"))


def normalized(hits: DataFrame) -> DataFrame:
    """Scores divided by the highest, if that is above 0."""
    top = hits.agg(F.greatest(F.max("score"), F.lit(0.0)).alias("top"))
    return hits.crossJoin(F.broadcast(top)).select("doc_id", F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(F.col("score")).alias("score"))


def ranked(hits: DataFrame, min_score: float = 0.0, limit: int | None = None, normalize: bool = True) -> DataFrame:
    """(doc_id, score) by falling score, then rising id; at most `limit` (None: all) of those from min_score on.

    The best hits are taken before they are normalised and filtered, which selects the same ones: so only they
    reach the last steps."""
    order = (F.desc("score"), F.asc("doc_id"))
    if limit is not None:
        hits = hits.orderBy(*order).limit(limit)
        if normalize:
            top = F.expr("max(score) over ()")
            hits = hits.select("doc_id", F.when(top > 0, F.col("score") / top).otherwise(F.col("score")).alias("score"))
    elif normalize:
        hits = normalized(hits)
    return hits.where(F.col("score") >= min_score).orderBy(*order)


def hydrated(index: Index, hits: DataFrame, limit: int | None = None, source_fields: list[str] | None = None) -> DataFrame:
    """(id, score, fields) with the stored fields of the hits alone.

    At most FETCHED hits are found first, and their documents looked up by id; more, or all of them, are joined."""
    stored = F.coalesce(F.col("stored"), F.create_map().cast("map<string,string>"))
    docs = index.docs
    if limit is not None and limit <= FETCHED:
        rows = hits.collect()
        hits = F.broadcast(index.spark.createDataFrame([(r.doc_id, r.score) for r in rows], HITS).coalesce(1))
        docs = index.docs_by_id([r.doc_id for r in rows]) if rows else docs.where(F.lit(False))
    # fields that are not asked for are left behind before the join
    kept = F.map_filter("stored", lambda k, _: k.isin(*source_fields)) if source_fields else F.col("stored")
    docs = docs.select(F.col("doc_id").alias("stored_id"), kept.alias("stored"))
    joined = docs.join(hits, F.col("stored_id") == F.col("doc_id"), "right")
    return joined.select(F.col("doc_id").alias("id"), "score", stored.alias("fields")).orderBy(F.desc("score"), F.asc("id"))


def search(index: Index, q: Query, similarity: Similarity = Similarity.BM25, weights: Mapping[str, float] | None = None, min_score: float = 0.0, limit: int | None = None, normalize: bool = True) -> DataFrame:
    """(doc_id, score), ranked. A leaf on its own may be asked for without normalisation."""
    return ranked(evaluate(index, q, similarity, weights), min_score, limit, normalize)


def search_params(index: Index, p: QueryParams) -> DataFrame:
    """(doc_id, score) for search parameters."""
    return search(index, build_query(p), p.similarity, p.field_weights, p.min_score, p.limit)
