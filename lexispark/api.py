"""Requests and answers as JSON, and as Python objects."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from lexispark.functions.scoring import Similarity
from lexispark.operators import mlt
from lexispark.plans.planner import hydrated, search_params
from lexispark.plans.query import In, QueryError, QueryParams, Where
from lexispark.sources.index import Index
from lexispark.sources.store import Store

HIT = "id long, score double, fields map<string,string>"


def _request(request: str | Mapping[str, Any]) -> Mapping[str, Any]:
    try:
        found = json.loads(request) if isinstance(request, str) else request
    except ValueError as e:
        raise QueryError(f"bad request: {e}") from e
    if not isinstance(found, Mapping):
        raise QueryError("a request is an object")
    return found


def _is(value: Any, kind: type, what: str) -> Any:
    """value, if it is of that JSON type; a whole number also counts as a number, true and false as neither."""
    kinds = (int, float) if kind is float else kind
    if not isinstance(value, kinds) or (isinstance(value, bool) and kind is not bool):
        raise QueryError(f"{what} is no {kind.__name__}")
    return float(value) if kind is float else value


def _get(r: Mapping[str, Any], name: str, kind: type, default: Any = None) -> Any:
    """An optional value: null and nothing mean the default."""
    return default if r.get(name) is None else _is(r[name], kind, name)


def _count(r: Mapping[str, Any], name: str, default: int | None = None) -> int | None:
    n = _get(r, name, int, default)
    if n is not None and n < 0:
        raise QueryError(f"{name} is below 0")
    return n


def _strings(values: Any, what: str) -> list[str]:
    return [_is(v, str, what) for v in _is(values, list, what)]


def _objects(r: Mapping[str, Any], name: str) -> list[Mapping[str, Any]]:
    return [_is(x, Mapping, name) for x in _get(r, name, list, [])]


def _weights(r: Mapping[str, Any]) -> dict[str, float]:
    return {k: _is(v, float, "a field weight") for k, v in _get(r, "field_weights", Mapping, {}).items()}


def parse_search(request: str | Mapping[str, Any]) -> QueryParams:
    """QueryError for what is no request: types are those of JSON, without conversions. Every where group needs its occur."""
    r = _request(request)
    try:
        return QueryParams(
            text=_get(r, "text", str, ""),
            where=[Where(_is(w["field"], str, "field"), _strings(w["values"], "values"), _is(w["occur"], str, "occur")) for w in _objects(r, "where")],
            in_=[In(_is(i["field"], str, "field"), _strings(i["values"], "values")) for i in _objects(r, "in")],
            similarity=Similarity.parse(_get(r, "similarity", str)),
            field_weights=_weights(r),
            min_score=_get(r, "min_score", float, 0.0),
            limit=_count(r, "limit") or None,
            accent_insensitive=_get(r, "accent_insensitive", bool, False),
        )
    except KeyError as e:
        raise QueryError(f"bad request: {e} is missing") from e
    except ValueError as e:
        raise QueryError(str(e)) from e


def parse_mlt(request: str | Mapping[str, Any]) -> tuple[str, str, mlt.MltParams]:
    """Field and value that name the source document, and the parameters."""
    r = _request(request)
    try:
        p = mlt.MltParams(
            fields=_strings(r.get("fields", []), "fields"),
            min_term_freq=_count(r, "min_term_freq", 2),
            max_query_terms=_count(r, "max_query_terms", 25),
            min_doc_freq=_count(r, "min_doc_freq", 5),
            max_doc_freq=_count(r, "max_doc_freq"),
            posting_budget=_count(r, "posting_budget"),
            min_should_match=mlt.MinShouldMatch.parse(r.get("min_should_match")),
            term_filters=[(_is(f["field"], str, "field"), _is(f["value"], str, "value")) for f in _objects(r, "term_filters")],
            range_filters=[mlt.Range(_is(f["field"], str, "field"), _get(f, "from", float), _get(f, "to", float)) for f in _objects(r, "range_filters")],
            field_weights=_weights(r),
            min_score=_get(r, "min_score", float, 0.0),
            size=_count(r, "size") or None,
            timeout_ms=_count(r, "timeout_ms") or None,
            source_fields=_strings(r.get("source_fields") or [], "source_fields"),
        )
        return _is(r["id_field"], str, "id_field"), _is(r["id_value"], str, "id_value"), p
    except KeyError as e:
        raise QueryError(f"bad request: {e} is missing") from e


def to_json(hits: DataFrame) -> str:
    """[{"id", "score", "fields"}] of hits in their order."""
    return json.dumps([{"id": r.id, "score": r.score, "fields": dict(r.fields)} for r in hits.collect()], ensure_ascii=False)


class SearchEngine:
    """Searches the current generation of an index on disk, or an index given as it is."""

    def __init__(self, spark: SparkSession, index: str | Index) -> None:
        self.spark, self.given = spark, index

    def index(self) -> Index:
        return self.given if isinstance(self.given, Index) else Store(self.given).open(self.spark)

    def search(self, request: str | Mapping[str, Any] | QueryParams) -> DataFrame:
        """(id, score, fields), ranked."""
        p = request if isinstance(request, QueryParams) else parse_search(request)
        index = self.index()
        return hydrated(index, search_params(index, p), p.limit)

    def search_json(self, request: str) -> str:
        return to_json(self.search(request))

    def more_like_this(self, request: str | Mapping[str, Any]) -> DataFrame:
        """(id, score, fields), ranked; none if the source document is unknown."""
        id_field, value, p = parse_mlt(request)
        index = self.index()
        doc = mlt.resolve(index, id_field, value)
        if doc is None:
            return self.spark.createDataFrame([], HIT)
        return hydrated(index, mlt.more_like_this(index, doc, p), p.size, list(p.source_fields))

    def more_like_this_json(self, request: str) -> str:
        return to_json(self.more_like_this(request))
