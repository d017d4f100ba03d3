"""Queries as trees, search parameters, and the tree that parameters stand for."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from lexispark.functions.analysis import analyze_text, key_field
from lexispark.functions.scoring import Similarity

MUST, SHOULD, MUST_NOT = "must", "should", "mustnot"


class QueryError(ValueError):
    """A query or a request that cannot be run."""


class EmptyQuery(QueryError):
    """Parameters that ask for nothing."""


class EmptyField(QueryError):
    """A blank field name."""


class Query:
    """A node. A leaf's field None stands for all indexed fields."""


@dataclass(frozen=True)
class Term(Query):
    field: str | None
    term: str


@dataclass(frozen=True)
class MultiTerm(Query):
    field: str | None
    terms: tuple[str, ...]


@dataclass(frozen=True)
class AccentTerm(Query):
    field: str | None
    term: str


@dataclass(frozen=True)
class Wildcard(Query):
    field: str | None
    pattern: str
    min_prefix_len: int = 0


@dataclass(frozen=True)
class Fuzzy(Query):
    field: str | None
    term: str
    min_similarity: float = 0.5
    prefix_len: int = 3


@dataclass(frozen=True)
class Phrase(Query):
    field: str
    terms: tuple[str, ...]


@dataclass(frozen=True)
class Boolean(Query):
    clauses: tuple[tuple[str, Query], ...]


def occur(name: str) -> str:
    """must and mustnot; every other word means should."""
    return name if name in (MUST, MUST_NOT) else SHOULD


@dataclass(frozen=True)
class Where:
    """Values of a keyword field, any of which will do, as one clause."""

    field: str
    values: Sequence[str]
    occur: str = SHOULD


@dataclass(frozen=True)
class In:
    field: str
    values: Sequence[str]


@dataclass(frozen=True)
class QueryParams:
    text: str | None = None
    text_field: str | None = None
    where: Sequence[Where] = ()
    in_: Sequence[In] = ()
    similarity: Similarity = Similarity.BM25
    field_weights: Mapping[str, float] = field(default_factory=dict)
    min_score: float = 0.0
    limit: int | None = None
    accent_insensitive: bool = False
    fuzzy_similarity: float = 0.5
    fuzzy_prefix_len: int = 3
    wildcard_min_prefix_len: int = 0


def text_query(p: QueryParams) -> Boolean:
    """What a text typed by a user asks for: its words nearly, its beginning, its tokens exactly; any of these."""
    lowered = (p.text or "").lower()
    nodes: list[Query] = [Fuzzy(p.text_field, w, p.fuzzy_similarity, p.fuzzy_prefix_len) for w in lowered.split()]
    nodes.append(Wildcard(p.text_field, lowered + "*", p.wildcard_min_prefix_len))
    exact = AccentTerm if p.accent_insensitive else Term
    nodes += [exact(p.text_field, t) for t in analyze_text(p.text or "")]
    return Boolean(tuple((SHOULD, n) for n in nodes))


def build_query(p: QueryParams) -> Boolean:
    """EmptyQuery where nothing is asked for, EmptyField for a blank field name."""
    clauses: list[tuple[str, Query]] = []
    if p.text and p.text.strip():
        if p.text_field is not None and not p.text_field.strip():
            raise EmptyField("the text's field is blank")
        clauses.append((MUST, text_query(p)))
    for w in p.where:
        if not w.field.strip():
            raise EmptyField("a where clause has a blank field")
        clauses.append((occur(w.occur), Boolean(tuple((SHOULD, Term(w.field + "_key", v)) for v in w.values))))
    for i in p.in_:
        if not i.field.strip():
            raise EmptyField("an in clause has a blank field")
    # all groups together are one clause: a document may match any of them
    anyof = tuple((SHOULD, Term(key_field(i.field), v)) for i in p.in_ for v in i.values)
    if anyof:
        clauses.append((MUST, Boolean(anyof)))
    if not clauses:
        raise EmptyQuery("the query is empty")
    return Boolean(tuple(clauses))
