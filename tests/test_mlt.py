"""More like this: selection of terms, filters, thresholds."""

import pytest

from lexispark.operators.mlt import MinShouldMatch, MltParams, Range, more_like_this, resolve, select_terms
from lexispark.sources.index import FieldSpec, build_index

FREE = dict(min_term_freq=1, min_doc_freq=1, max_doc_freq=0, posting_budget=0)


@pytest.fixture(scope="module")
def index(spark):
    rows = [(0, "alpha beta", "k0", "1000"), (1, "alpha beta", "k1", "1500"), (2, "alpha zzz", "k1", "2500"), (3, "gamma delta", "k1", "oops"), (4, "alpha alpha gamma", "k0", " 12 ")]
    df = spark.createDataFrame(rows, "doc_id long, body string, k string, created string")
    return build_index(df, "doc_id", [FieldSpec("body"), FieldSpec("id_key", "k", "keyword"), FieldSpec("created", kind="unindexed")]).cache()


def ids(index, doc=0, **kw):
    return [r.doc_id for r in more_like_this(index, doc, MltParams(["body"], **FREE | kw)).collect()]


def test_hits_exclude_the_source_and_the_best_has_one(index):
    hits = more_like_this(index, 0, MltParams(["body"], **FREE)).collect()
    assert [h.doc_id for h in hits][0] == 1 and hits[0].score == 1.0
    assert {h.doc_id for h in hits} == {1, 2, 4}


def test_thresholds(index):
    assert ids(index, min_should_match=MinShouldMatch(2)) == [1]
    assert ids(index, min_should_match=MinShouldMatch(3)) == []
    assert ids(index, min_should_match=MinShouldMatch(100, True)) == [1]
    assert ids(index, min_should_match=MinShouldMatch(1)) == ids(index)
    assert ids(index, min_should_match=MinShouldMatch(2), timeout_ms=0) == []
    assert ids(index, timeout_ms=600_000) == ids(index)
    assert MinShouldMatch(75, True).of(2) == 1 and MinShouldMatch(50, True).of(4) == 2


@pytest.mark.parametrize("given, found", [(2, MinShouldMatch(2)), ("2", MinShouldMatch(2)), (" 30% ", MinShouldMatch(30, True)), ("300%", None), ("x", None), (None, None), (-1, None), ("-1", None)])
def test_parsed_thresholds(given, found):
    assert MinShouldMatch.parse(given) == found


def test_filters(index):
    assert ids(index, term_filters=[("id_key", "k1")]) == [1, 2]
    assert ids(index, term_filters=[("id_key", "k1"), ("body", "zzz")]) == [2]
    assert ids(index, range_filters=[Range("created", 1500, None)]) == [1, 2]
    assert ids(index, range_filters=[Range("created", None, 2000)]) == [1]
    assert ids(index, 1, range_filters=[Range("created")]) == [0, 2]


def test_selection(index):
    terms = lambda **kw: [r.term for r in select_terms(index, 0, MltParams(["body"], **FREE | kw)).orderBy("nth").collect()]
    assert terms() == ["beta", "alpha"]
    assert terms(max_query_terms=1) == ["beta"]
    assert terms(min_doc_freq=3) == ["alpha"]
    assert terms(max_doc_freq=None) == ["beta"]  # alpha is in four of five
    assert terms(posting_budget=3) == ["beta"]
    assert terms(posting_budget=1) == ["beta"]
    assert terms(min_term_freq=2) == []


def test_size_and_source(index):
    assert ids(index, size=1) == [1]
    assert resolve(index, "id", "k1") == 1 and resolve(index, "id_key", "nothing") is None
    assert more_like_this(index, 99, MltParams(["body"], **FREE)).collect() == []
