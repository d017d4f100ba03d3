"""What a step costs must grow no faster than its input, and an order is the same however it is partitioned."""

import re

from lexispark import queries
from lexispark.sources.index import FIELDS_TYPE, index_documents

SF = "/root/testdata/sf0.01"


def test_all_terms_are_numbered_without_gaps_over_several_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = queries.QUERIES["all_terms"](spark, SF).orderBy("nth").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r.nth for r in rows] == list(range(1, len(rows) + 1))
    names = [(r.field.encode(), r.term.encode()) for r in rows]
    assert names == sorted(names) and len(set(names)) == len(names)


def test_inversion_moves_no_token_between_executors(spark):
    assert "Exchange" not in queries.QUERIES["inverted_postings"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_inversion_against_brute_force(spark):
    fields = [("a", "b a  B c", "text", True), ("k", "b a", "keyword", True), ("e", "", "text", True), ("a", "a c", "text", True), ("k", "x", "keyword", True), ("u", "b", "unindexed", True)]
    index = index_documents(spark.createDataFrame([(7, fields), (9, [])], f"doc_id long, fields {FIELDS_TYPE}"))
    want = {("a", "a"): [1, 2], ("a", "b"): [1, 3], ("a", "c"): [2, 4], ("k", "b a"): [0], ("k", "x"): [0]}
    n = {"a": 2, "k": 1}
    assert {(r.field, r.term): (r.doc_id, r.tf, r.field_len, r.positions) for r in index.postings.collect()} == {k: (7, len(v), n[k[0]], v) for k, v in want.items()}
    assert {(r.field, r.term): (r.doc_id, r.tf, r.field_len) for r in index.frequencies.collect()} == {k: (7, len(v), n[k[0]]) for k, v in want.items()}
    assert {(r.field, r.term): r.doc_freq for r in index.dictionary.collect()} == dict.fromkeys(want, 1)
    assert {(r.field, r.doc_id): r.field_len for r in index.lengths.collect()} == {("a", 7): 2, ("k", 7): 1}


def test_searches_analyse_their_texts_once(spark):
    """More like this needs frequencies, dictionary and statistics several times: no plan of it goes back to the texts' tokens."""
    plan = queries.QUERIES["mlt_hits"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"regexp_extract_all", plan)


def test_more_like_this_by_json_analyses_its_texts_once(spark, monkeypatch):
    """The source document is found in the index on disk, not in a second one made from the table."""
    monkeypatch.setattr(queries, "build_index", lambda *_, **__: 1 / 0)
    assert not queries.QUERIES["mlt_json"](spark, SF).isEmpty()
