"""Text functions and scores on their own."""

import pytest
from pyspark.sql import functions as F

from lexispark.functions import analysis, scoring


def test_analysis(spark):
    rows = [("Über 2 Ítems",), ("a --- b",), ("mail me@x.org, see https://a.b/c",), ("done. ÑU",), ("",), (None,)]
    df = spark.createDataFrame(rows, "t string")
    want = [["über", "2", "ítems"], ["a", "---", "b"], ["mail", "me@x.org", "see", "https://a.b/c"], ["done.", "ñu"], [], None]
    assert [r[0] for r in df.select(analysis.analyze("t")).collect()] == want
    assert [analysis.analyze_text(r[0]) for r in rows[:-1]] == want[:-1]
    assert analysis.accent_variants("avión") == ["avion", "ávion", "avíon", "avión"]
    assert analysis.accent_variants("tu") == ["tu", "tú", "tü"]
    got = spark.sql("select 1").select(analysis.levenshtein_bytes(F.lit("añb"), F.lit("anb")), analysis.fold_accents(F.lit("ÁñÜç")), analysis.base36(F.lit(71))).first()
    assert tuple(got) == (2, "AñUç", "1z")
    assert analysis.to_base36(71) == "1z" and analysis.key_field("a") == "a_key" and analysis.key_field("a_key_b") == "a_key_b"


def test_numbers(spark):
    rows = [("12", 12.0), ("1e3", 1000.0), (".5", 0.5), ("-inf", float("-inf")), (" 12 ", None), ("12d", None), ("nan", None), ("", None), (None, None)]
    df = spark.createDataFrame(rows, "v string, want double")
    assert [r[0] for r in df.select(analysis.to_number("v")).collect()] == [w for _, w in rows]


def test_norms(spark):
    steps = {n: scoring.length_of(b) for n, b in scoring.norm_steps()}
    assert [steps[n] for n in (1, 2, 5, 7, 9, 13, 97, 1166, 18642)] == [1, 2, 5, 7, 10, 16, 114, 1337, 21400]
    assert scoring.norm_of(0) == 255 and scoring.length_of(255) == 1 and scoring.encode_norm(0) == 0
    df = spark.range(1, 200)
    got = df.select("id", scoring.quantized_length(F.col("id")), scoring.norm_byte(F.col("id"))).collect()
    assert all(r[1] == scoring.length_of(scoring.norm_of(r[0])) and r[2] == scoring.norm_of(r[0]) for r in got)
    assert scoring.Similarity.parse(None) is scoring.Similarity.BM25
    with pytest.raises(ValueError):
        scoring.Similarity.parse("other")
