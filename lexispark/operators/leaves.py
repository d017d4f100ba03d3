"""Leaf queries as DataFrames.

All leaves but phrases come down to rows (leaf, field, term, doc_freq): literal terms looked up in the dictionary, and
patterns expanded from it. One join of these with postings scores every leaf of a query at once.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexispark.functions import analysis, scoring
from lexispark.plans.query import AccentTerm, Fuzzy, MultiTerm, Phrase, Query, Term, Wildcard
from lexispark.sources.index import Index

#: Terms that a fuzzy query expands to at most, in each field.
FUZZY_TERMS = 1024


def literal_terms(q: Query) -> list[str] | None:
    """The terms that a leaf names itself; None where the dictionary has to tell."""
    if isinstance(q, Term):
        return [q.term]
    if isinstance(q, MultiTerm):
        return list(q.terms)
    if isinstance(q, AccentTerm):
        return analysis.accent_variants(q.term)
    if isinstance(q, Wildcard) and not set("*?") & set(q.pattern):
        return [q.pattern] if len(q.pattern.encode()) >= q.min_prefix_len else []
    return None


def in_field(field: str | None) -> Column:
    return F.lit(True) if field is None else F.col("field") == field


def wildcard_terms(index: Index, q: Wildcard) -> DataFrame:
    """(field, term, doc_freq) of the terms that match a pattern."""
    prefix = analysis.literal_prefix(q.pattern)
    d = index.dictionary.where(in_field(q.field))
    if len(prefix.encode()) < q.min_prefix_len:
        return d.where(F.lit(False))
    return d.where(F.col("term").startswith(prefix) & F.col("term").rlike(analysis.wildcard_regex(q.pattern)))


def fuzzy_similarity(q: Fuzzy) -> Column:
    """Similarity of a dictionary term that has the query's prefix, from the bytes after it."""
    taken = q.term[: q.prefix_len]
    rest, p = q.term[len(taken) :], len(taken)
    r = len(rest.encode())
    tail = F.expr(f"substring(term, {p + 1})")
    t = F.octet_length(tail)
    threshold = single(q.min_similarity)
    without = lambda n: F.lit(1.0) - n / float(p) if p else F.lit(0.0)
    if r == 0:
        return without(t)
    shorter = F.least(F.lit(r), t)
    # not more edits than could still be similar enough
    far = F.floor((1 - threshold) * (shorter + p)) < F.abs(F.lit(r) - t)
    distance = F.levenshtein(F.lit(rest.encode().decode("latin-1")), analysis.as_bytes(tail))
    return F.when(t == 0, without(F.lit(r))).when(far, F.lit(0.0)).otherwise(1 - distance / (shorter + p).cast("double"))


def single(x: float) -> float:
    """x as a 32-bit float has it, which is what a threshold is compared as."""
    return struct.unpack("<f", struct.pack("<f", x))[0]


def fuzzy_terms(index: Index, q: Fuzzy) -> DataFrame:
    """(field, term, doc_freq) of the most similar terms of each field."""
    d = index.dictionary.where(in_field(q.field) & F.col("term").startswith(q.term[: q.prefix_len]))
    d = d.withColumn("similarity", fuzzy_similarity(q)).where(F.col("similarity") > single(q.min_similarity))
    best = (F.desc("similarity"), F.asc("term"))
    if q.field is not None:
        d = d.orderBy(*best).limit(FUZZY_TERMS)
    else:
        d = d.withColumn("nth", F.row_number().over(Window.partitionBy("field").orderBy(*best))).where(F.col("nth") <= FUZZY_TERMS)
    return d.select("field", "term", "doc_freq")


def term_rows(index: Index, leaves: list[tuple[int, Query]]) -> tuple[DataFrame | None, Column | None]:
    """(leaf, field, term, doc_freq) of all leaves but phrases, and a filter on postings that Parquet can apply."""
    literal, frames, reach = [], [], []
    for k, q in leaves:
        own = literal_terms(q)
        if own is not None:
            literal += [(k, q.field, t) for t in own]
        elif isinstance(q, Wildcard):
            frames.append(wildcard_terms(index, q).select(F.lit(k).alias("leaf"), "field", "term", "doc_freq"))
            reach.append(in_field(q.field) & F.col("term").startswith(analysis.literal_prefix(q.pattern)))
        elif isinstance(q, Fuzzy):
            frames.append(fuzzy_terms(index, q).select(F.lit(k).alias("leaf"), "field", "term", "doc_freq"))
            reach.append(in_field(q.field) & F.col("term").startswith(q.term[: q.prefix_len]))
    if literal:
        wanted = F.col("term").isin(*sorted({t for _, _, t in literal}))
        if all(f is not None for _, f, _ in literal):
            wanted = wanted & F.col("field").isin(*sorted({f for _, f, _ in literal}))
        reach.append(wanted)
        # as many rows as the query has terms
        asked = index.spark.createDataFrame(literal, "leaf int, asked_field string, asked string")
        found = index.dictionary.where(wanted).join(F.broadcast(asked), (F.col("term") == F.col("asked")) & (F.col("asked_field").isNull() | (F.col("field") == F.col("asked_field"))))
        frames.append(found.select("leaf", "field", "term", "doc_freq"))
    if not frames:
        return None, None
    return reduce(DataFrame.unionByName, frames), reduce(Column.__or__, reach)


def weight_of(weights: Mapping[str, float]) -> Column:
    out = F.lit(1.0)
    for name, w in weights.items():
        out = F.when(F.col("field") == name, F.lit(float(w))).otherwise(out)
    return out


def scored(index: Index, postings: DataFrame, similarity: scoring.Similarity, weights: Mapping[str, float]) -> Column:
    """Score of a row that has postings' columns, doc_freq, total_docs and avg_len."""
    idf = scoring.idf(similarity, F.col("total_docs"), F.col("doc_freq"))
    return scoring.score(similarity, F.col("tf"), F.col("field_len"), F.col("avg_len"), idf) * weight_of(weights)


def with_stats(index: Index, rows: DataFrame) -> DataFrame:
    """total_docs and avg_len beside each row's field; there is one row a field."""
    stats = index.field_stats.select(F.col("field").alias("stat_field"), "total_docs", "avg_len")
    return rows.join(F.broadcast(stats), F.col("field") == F.col("stat_field")).drop("stat_field")


def shifted(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda x: x - F.lit(by))


def phrase_hits(index: Index, q: Phrase, leaf: int, similarity: scoring.Similarity, weights: Mapping[str, float]) -> DataFrame | None:
    """(leaf, doc_id, part): documents with the terms side by side, scored by each term's whole frequency.

    One pass over the terms' postings: a document's position lists meet in one aggregate."""
    if not q.terms:
        return None
    distinct = sorted(set(q.terms))
    at = (F.col("field") == q.field) & F.col("term").isin(*distinct)
    freq = index.dictionary.where(at).select(F.col("term").alias("d_term"), "doc_freq")
    rows = with_stats(index, index.postings.where(at).join(F.broadcast(freq), F.col("term") == F.col("d_term")))
    rows = rows.withColumn("part", scored(index, rows, similarity, weights) * sum((F.when(F.col("term") == t, F.lit(float(q.terms.count(t)))).otherwise(0.0) for t in distinct), F.lit(0.0)))
    lists = [F.first(F.when(F.col("term") == t, F.col("positions")), ignorenulls=True).alias(f"p{i}") for i, t in enumerate(distinct)]
    docs = rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("part").alias("part"), *lists).where(F.col("n") == len(distinct))
    where = [F.col(f"p{distinct.index(t)}") for t in q.terms]
    # starts of the phrase: positions of the first term that every other term follows at its distance
    starts = where[0]
    for k, p in enumerate(where[1:], 1):
        starts = F.array_intersect(starts, shifted(p, k))
    return docs.where(F.size(starts) > 0).select(F.lit(leaf).alias("leaf"), "doc_id", "part")


def leaf_scores(index: Index, leaves: Iterable[Query], similarity: scoring.Similarity, weights: Mapping[str, float]) -> DataFrame | None:
    """(leaf, doc_id, part): every leaf's score for a document is the sum of its parts. None if nothing can match."""
    numbered = list(enumerate(leaves))
    frames = []
    terms, reach = term_rows(index, [(k, q) for k, q in numbered if not isinstance(q, Phrase)])
    if terms is not None:
        terms = terms.withColumnsRenamed({"field": "t_field", "term": "t_term"})
        literal = all(literal_terms(q) is not None for _, q in numbered if not isinstance(q, Phrase))
        side = F.broadcast(terms) if literal else terms  # what a pattern expands to is for the planner to measure
        rows = index.frequencies.where(reach).join(side, (F.col("field") == F.col("t_field")) & (F.col("term") == F.col("t_term")))
        rows = with_stats(index, rows)
        frames.append(rows.select("leaf", "doc_id", scored(index, rows, similarity, weights).alias("part")))
    for k, q in numbered:
        if isinstance(q, Phrase):
            hits = phrase_hits(index, q, k, similarity, weights)
            if hits is not None:
                frames.append(hits)
    return reduce(DataFrame.unionByName, frames) if frames else None
