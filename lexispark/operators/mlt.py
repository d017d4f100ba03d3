"""More like this: documents that share a document's most telling terms."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions import analysis, scoring
from lexispark.functions.scoring import Similarity
from lexispark.operators.leaves import scored, with_stats
from lexispark.plans.planner import ranked, search
from lexispark.plans.query import In, QueryParams, build_query
from lexispark.sources.index import Index


@dataclass(frozen=True)
class MinShouldMatch:
    """How many of the selected terms a hit has: a number, or a percentage of them rounded down."""

    value: int
    percent: bool = False

    def of(self, selected: int) -> int:
        return self.value * selected // 100 if self.percent else self.value

    @classmethod
    def parse(cls, given: object) -> MinShouldMatch | None:
        """A number, "2" or "30%"; None for anything else."""
        if isinstance(given, bool):
            return None
        if isinstance(given, int):
            return cls(given) if given >= 0 else None
        if isinstance(given, str):
            text = given.strip()
            digits = text.removesuffix("%").strip() if text.endswith("%") else text
            if digits.isascii() and digits.isdigit():
                n = int(digits)
                if text.endswith("%"):
                    return cls(n, True) if n <= 255 else None
                return cls(n)
        return None


@dataclass(frozen=True)
class Range:
    """Both ends belong to it; None is open."""

    field: str
    low: float | None = None
    high: float | None = None


@dataclass(frozen=True)
class MltParams:
    fields: Sequence[str]
    min_term_freq: int = 2
    max_query_terms: int = 25  # 0: all
    min_doc_freq: int = 5
    max_doc_freq: int | None = None  # None: half of the documents, 0: no bound
    posting_budget: int | None = None  # None: as many as documents, 0: no bound
    min_should_match: MinShouldMatch | None = None
    term_filters: Sequence[tuple[str, str]] = ()
    range_filters: Sequence[Range] = ()
    field_weights: Mapping[str, float] = field(default_factory=dict)
    min_score: float = 0.0
    size: int | None = None
    timeout_ms: int | None = None
    source_fields: Sequence[str] = ()


def resolve(index: Index, id_field: str, value: str) -> int | None:
    """The document that a keyword field's value names: the first of several."""
    hit = search(index, build_query(QueryParams(in_=[In(id_field, [value])])), limit=1).first()
    return hit[0] if hit else None


def select_terms(index: Index, doc_id: int, p: MltParams) -> DataFrame:
    """(field, term, tf, doc_freq, weight, nth) of the terms that are worth asking for, best first."""
    stored = index.docs_by_id([doc_id]).select(F.explode("stored").alias("field", "value")).where(F.col("field").isin(*p.fields))
    tf = stored.select("field", F.explode(analysis.analyze("value")).alias("term")).groupBy("field", "term").agg(F.count("*").alias("tf")).where(F.col("tf") >= p.min_term_freq)
    d = index.dictionary.select(F.col("field").alias("d_field"), F.col("term").alias("d_term"), "doc_freq")
    # one document's terms
    rows = d.where(F.col("d_field").isin(*p.fields)).join(F.broadcast(tf), (F.col("field") == F.col("d_field")) & (F.col("term") == F.col("d_term"))).drop("d_field", "d_term")
    rows = rows.crossJoin(F.broadcast(index.field_stats.agg(F.max("total_docs").alias("n"))))
    rows = rows.where(F.col("doc_freq") >= p.min_doc_freq)
    if p.max_doc_freq != 0:
        rows = rows.where(F.col("doc_freq") <= (F.lit(p.max_doc_freq) if p.max_doc_freq is not None else F.floor(F.col("n") / 2)))
    weight = F.col("tf") * scoring.idf(Similarity.TFIDF, F.col("n"), F.col("doc_freq"))
    best = (F.desc("weight"), F.asc("field"), F.asc("term"))
    rows = rows.withColumn("weight", weight)
    if p.max_query_terms:
        rows = rows.orderBy(*best).limit(p.max_query_terms)
    over = Window.orderBy(*best)  # one document's terms: a few rows
    rows = rows.withColumn("nth", F.row_number().over(over))
    if p.posting_budget != 0:
        budget = F.lit(p.posting_budget) if p.posting_budget is not None else F.col("n")
        rows = rows.withColumn("sum", F.sum("doc_freq").over(over.rowsBetween(Window.unboundedPreceding, 0))).where((F.col("nth") == 1) | (F.col("sum") <= budget))
    return rows.select("field", "term", "tf", "doc_freq", "weight", "nth")


def candidates(index: Index, doc_id: int, p: MltParams, terms: DataFrame, names: list[str], count: int) -> DataFrame:
    """(doc_id, score) of the documents that pass all filters."""
    t = terms.select(F.col("field").alias("t_field"), F.col("term").alias("t_term"), "doc_freq")
    near = F.col("field").isin(*p.fields) & F.col("term").isin(*sorted(set(names)))  # for Parquet
    rows = index.frequencies.where(near).join(F.broadcast(t), (F.col("field") == F.col("t_field")) & (F.col("term") == F.col("t_term")))
    rows = with_stats(index, rows.where(F.col("doc_id") != doc_id))
    hits = rows.groupBy("doc_id").agg(F.sum(scored(index, rows, Similarity.TFIDF, p.field_weights)).alias("score"), F.count("*").alias("n"))
    if p.min_should_match and (least := p.min_should_match.of(count)) > 1:
        hits = hits.where(F.col("n") >= least)
    for name, value in p.term_filters:
        have = index.frequencies.where((F.col("field") == name) & (F.col("term") == value)).select(F.col("doc_id").alias("have"))
        hits = hits.join(have, F.col("doc_id") == F.col("have"), "left_semi")
    if p.range_filters:
        number = {r.field: analysis.to_number(F.col("stored")[r.field]) for r in p.range_filters}
        fits = F.lit(True)
        for r in p.range_filters:
            x = number[r.field]
            fits = fits & x.isNotNull()
            if r.low is not None:
                fits = fits & (x >= float(r.low))
            if r.high is not None:
                fits = fits & (x <= float(r.high))
        hits = hits.join(index.docs.where(fits).select(F.col("doc_id").alias("fits")), F.col("doc_id") == F.col("fits"), "left_semi")
    return hits.select("doc_id", "score")


def more_like_this(index: Index, doc_id: int, p: MltParams) -> DataFrame:
    """(doc_id, score), ranked after all filters, so that the best hit has 1.0. Frequencies are TF-IDF's whatever else is used.

    The terms (one document's) are selected first. With a timeout, scoring that has not ended by then is
    given up for the best term's alone; 0 asks for that at once."""
    spark = index.spark
    rows = select_terms(index, doc_id, p).orderBy("nth").collect()
    if not rows:
        return spark.createDataFrame([], "doc_id long, score double")

    def plan(some: list) -> DataFrame:
        terms = spark.createDataFrame([(r.field, r.term, r.doc_freq) for r in some], "field string, term string, doc_freq long")
        return ranked(candidates(index, doc_id, p, terms, [r.term for r in some], len(rows)), p.min_score, p.size)

    if p.timeout_ms is None:
        return plan(rows)
    if p.timeout_ms > 0:
        tag, held = f"mlt-{uuid.uuid4().hex}", []

        def score() -> None:
            spark.addTag(tag)
            try:
                held.extend(plan(rows).collect())
                held.append(None)
            except Exception as e:
                if "cancel" not in str(e).lower() and "interrupt" not in str(e).lower():
                    failed.append(e)
            finally:
                spark.removeTag(tag)

        failed: list[Exception] = []
        worker = threading.Thread(target=score, daemon=True)
        worker.start()
        worker.join(p.timeout_ms / 1000)
        if worker.is_alive():
            spark.interruptTag(tag)
        elif failed:
            raise failed[0]
        elif held and held[-1] is None:
            return spark.createDataFrame(held[:-1], "doc_id long, score double").orderBy(F.desc("score"), F.asc("doc_id"))
    return plan(rows[:1])
