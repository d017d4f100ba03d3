"""Leaf queries, Boolean composition, the query builder and ranking on small corpora."""

import math

import pytest

from lexispark.functions.scoring import Similarity
from lexispark.plans.planner import evaluate, hydrated, search, search_params
from lexispark.plans.query import MUST, MUST_NOT, SHOULD, AccentTerm, Boolean, EmptyField, EmptyQuery, Fuzzy, In, MultiTerm, Phrase, QueryParams, Term, Where, Wildcard, build_query
from lexispark.sources.index import FieldSpec, build_index

SPECS = [FieldSpec("title"), FieldSpec("lang_key", "lang", "keyword"), FieldSpec("note", kind="unindexed")]


def make(spark, *rows):
    df = spark.createDataFrame([(i, *r, *[None] * (3 - len(r))) for i, r in enumerate(rows)], "doc_id long, title string, lang string, note string")
    return build_index(df, "doc_id", SPECS).cache()


@pytest.fixture(scope="module")
def vpn(spark):
    return make(spark, ("vpn guide", "es", "a"), ("vpn setup", "en", "b"), ("mysql notes", "es", "c"))


def ids(index, q, **kw):
    return [r.doc_id for r in search(index, q, **kw).collect()]


def any_of(*qs):
    return Boolean(tuple((SHOULD, q) for q in qs))


def test_boolean(vpn):
    v, es = Term("title", "vpn"), Term("lang_key", "es")
    assert ids(vpn, Boolean(((MUST, v), (MUST, es)))) == [0]
    assert sorted(ids(vpn, any_of(v, es))) == [0, 1, 2]
    assert ids(vpn, Boolean(((MUST, v), (MUST_NOT, Term("lang_key", "en"))))) == [0]
    assert sorted(ids(vpn, Term(None, "es"))) == [0, 2]
    assert ids(vpn, Boolean(((MUST_NOT, v),))) == []
    assert ids(vpn, Boolean(())) == []
    assert ids(vpn, Boolean(((MUST, v), (MUST, Boolean(()))))) == []


def test_coord_at_every_level(vpn):
    inner = any_of(Term("title", "vpn"), Term("title", "guide"))
    one = {r.doc_id: r.score for r in evaluate(vpn, Term("title", "vpn")).collect()}
    got = {r.doc_id: r.score for r in evaluate(vpn, any_of(inner, Term("title", "nothing"))).collect()}
    assert got[1] == pytest.approx(one[1] / 2 / 2)


def test_wildcard(spark):
    index = make(spark, ("testing guide",), ("tested feature",), ("text editor",), ("team meeting",))
    assert ids(index, Wildcard("title", "test*"), normalize=False) == [0, 1]
    assert ids(index, Wildcard("title", "te?t")) == [2]
    assert ids(index, Wildcard("title", "a*b*", 2)) == []
    assert ids(index, Wildcard("title", "team")) == [3]
    assert ids(index, Wildcard("title", "t.*")) == []


def test_fuzzy(spark):
    index = make(spark, ("testing",), ("tesla",), ("vpn",), ("vpns",), ("vpnsx",), ("añb",))
    assert ids(index, Fuzzy("title", "testintg", 0.6)) == [0]
    assert sorted(ids(index, Fuzzy("title", "vpn"))) == [2, 3]
    assert ids(index, Fuzzy("title", "anb", 0.5, 0)) == []  # two of three bytes differ
    assert sorted(ids(index, Fuzzy(None, "vpn"))) == [2, 3]


def test_phrase(spark):
    index = make(spark, ("quick brown fox",), ("brown fox jumps",), ("the lazy dog",), ("fox fox brown",), ("go go go",))
    assert sorted(ids(index, Phrase("title", ("brown", "fox")))) == [0, 1]
    assert ids(index, Phrase("title", ("dog", "lazy"))) == []
    assert ids(index, Phrase("title", ("fox", "fox"))) == [3]
    assert ids(index, Phrase("title", ("go", "go", "go"))) == [4]
    assert ids(index, Phrase("title", ("go",) * 4)) == []
    assert ids(index, Phrase("title", ())) == []
    both = {r.doc_id: r.score for r in evaluate(index, MultiTerm("title", ("brown", "fox"))).collect()}
    phrase = {r.doc_id: r.score for r in evaluate(index, Phrase("title", ("brown", "fox"))).collect()}
    assert phrase[0] == pytest.approx(both[0])


def test_accents(spark):
    index = make(spark, ("el avión despega",), ("reserva de avion",), ("año nuevo",))
    assert sorted(ids(index, AccentTerm("title", "avión"))) == [0, 1]
    assert ids(index, Term("title", "avion")) == [1]
    assert ids(index, AccentTerm("title", "ano")) == []


def test_scores(spark):
    index = make(spark, ("vpn vpn vpn",), ("vpn a b c d e f g",), ("x",))
    hits = search(index, Term("title", "vpn")).collect()
    assert [h.doc_id for h in hits] == [0, 1] and hits[0].score == 1.0 and 0 < hits[1].score < 1
    assert search(index, Term("title", "vpn"), min_score=1.0001).collect() == []
    raw = {h.doc_id: h.score for h in evaluate(index, Term("title", "vpn")).collect()}
    idf = math.log(1 + (3 - 2 + 0.5) / 2.5)
    assert raw[0] == pytest.approx(idf * 3 * 2.2 / (3 + 1.2 * (0.25 + 0.75 * 3 / 4)))
    tfidf = {h.doc_id: h.score for h in evaluate(index, Term("title", "vpn"), Similarity.TFIDF).collect()}
    assert tfidf[0] == pytest.approx(math.sqrt(3) * (1 + math.log(3 / 3)) ** 2 / math.sqrt(3))
    assert raw[1] / raw[0] > tfidf[1] / tfidf[0]
    assert [h.doc_id for h in search(index, Term("title", "vpn"), limit=1).collect()] == [0]
    assert search(index, Term("title", "vpn"), limit=0).collect() == []


def test_weights(spark):
    df = spark.createDataFrame([(0, "vpn", "x"), (1, "x", "vpn")], "doc_id long, title string, body string")
    index = build_index(df, "doc_id", [FieldSpec("title"), FieldSpec("body")]).cache()
    assert ids(index, Term(None, "vpn"), weights={"title": 5.0})[0] == 0
    assert ids(index, Term(None, "vpn"), weights={"body": 5.0})[0] == 1


def test_params(vpn):
    run = lambda **kw: [r.doc_id for r in search_params(vpn, QueryParams(**kw)).collect()]
    assert sorted(run(text="vpn")) == [0, 1]
    assert sorted(run(text="vpn", where=[Where("lang", ["es"], "should")])) == [0, 1]
    assert run(text="vpn", where=[Where("lang", ["es"], "must")]) == [0]
    assert run(text="vpn", where=[Where("lang", [], "must")]) == []
    assert run(text="vpn", in_=[In("lang", ["en"]), In("lang_key", ["nothing"])]) == [1]
    assert sorted(run(text="VPN Guide")) == [0, 1]
    with pytest.raises(EmptyQuery):
        build_query(QueryParams(text="  "))
    with pytest.raises(EmptyField):
        build_query(QueryParams(where=[Where(" ", ["x"])]))
    assert build_query(QueryParams(text=" ", in_=[In("a", ["1"])])) == Boolean(((MUST, any_of(Term("a_key", "1"))),))


def test_hydration(vpn):
    rows = hydrated(vpn, search(vpn, Term("title", "vpn"), limit=1), 1, ["note"]).collect()
    assert rows[0].id == 0 and rows[0].fields == {"note": "a"}
