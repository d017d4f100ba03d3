"""Queries over whole texts and tables, against brute force."""

from lexispark import queries


def test_byte_distance_of_whole_texts(spark, tmp_path):
    rows = [(1, "Ça été où añb the" + " and more" * 30), (2, "x" * 200), (3, "the"), (4, ""), (5, None), (6, "é" * 41)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    b = "Ça été où añb the".encode()
    want = {}
    for i, text in rows:
        a, row = (text or "").encode(), list(range(len(b) + 1))
        for x in range(len(a)):
            last, row[0] = row[:], x + 1
            for y in range(len(b)):
                row[y + 1] = min(last[y + 1] + 1, row[y] + 1, last[y] + (a[x] != b[y]))
        want[i] = None if text is None else row[-1]
    assert {r.doc_id: r.distance for r in queries.QUERIES["byte_distance"](spark, str(tmp_path)).collect()} == want


def test_upsert_of_the_whole_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    got = queries.QUERIES["upsert"](spark, sf_dir).groupBy("lang_key").agg({"n": "sum"}).collect()
    langs = spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy("lang").count().collect()
    assert {r[0]: r[1] for r in got} == {r.lang: r["count"] for r in langs} | {"new": spark.read.parquet(f"{sf_dir}/part.parquet").count()}


def test_more_like_this_and_accents_find_something(spark):
    for name in ("accent_term", "mlt_select_terms", "mlt_hits", "mlt_msm", "mlt_term_filter", "mlt_range_filter", "mlt_source_fields"):
        assert not queries.QUERIES[name](spark, "/root/testdata/sf0.01").isEmpty(), name
