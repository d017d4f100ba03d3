"""One query for each operator over the driver's tables, and the same in SQL."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.api import SearchEngine
from lexispark.functions import analysis, scoring
from lexispark.functions.scoring import Similarity
from lexispark.operators import mlt
from lexispark.operators.leaves import wildcard_terms
from lexispark.plans.planner import evaluate, hydrated, search, search_params
from lexispark.plans.query import MUST, MUST_NOT, SHOULD, AccentTerm, Boolean, Fuzzy, In, MultiTerm, Phrase, Query, QueryParams, Term, Where, Wildcard
from lexispark.sources.index import FieldSpec, Index, as_documents, build_index, index_documents, parse_documents, read_json_batch
from lexispark.sources.store import TABLES, Store
from lexispark.sources.writer import IndexWriter, numbered_rows
from lexispark.streaming.ingest import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """A new folder below the one that spark.checkpoint.dir names; a temporary one where that is unset on a single machine."""
    base = (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or "").removeprefix("file://")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        base = tempfile.gettempdir()
    return f"{base.removeprefix('file:').rstrip('/')}/lexispark-{uuid.uuid4().hex}"


DOCUMENT_SPECS = [FieldSpec("text"), FieldSpec("lang_key", "lang", "keyword"), FieldSpec("source_key", "source", "keyword"), FieldSpec("n_chars_key", "n_chars", "keyword")]
PART_SPECS = [FieldSpec("name", "p_name"), FieldSpec("type", "p_type"), FieldSpec("brand_key", "p_brand", "keyword"), FieldSpec("retailprice_attr", "p_retailprice", "unindexed")]


def documents(spark: SparkSession, sf_dir: str, **options) -> Index:
    return build_index(table(spark, sf_dir, "documents"), "doc_id", DOCUMENT_SPECS, **options)


def searched(spark: SparkSession, sf_dir: str) -> Index:
    """The same, analysed once: searches need frequencies, dictionary and statistics several times."""
    return documents(spark, sf_dir, stage=f"file://{work_dir(spark)}")


R = r"[\p{L}\p{N}\-_.:#/@]+"
#: p: postings, d: dictionary, s: statistics; sc and sct: BM25 and TF-IDF of every posting.
_SCORES = """
d AS (SELECT field, term, count(*) AS df FROM p GROUP BY field, term),
f AS (SELECT *, count(*) OVER (PARTITION BY field, term) AS df FROM p),
j AS (SELECT f.*, s.n, s.avg_len FROM f JOIN s ON f.field = s.field),
sc AS (SELECT field, term, doc_id, greatest(CAST(0 AS DOUBLE), ln(1e0 + (n - df + 0.5e0) / (df + 0.5e0))) * (tf * 2.2e0) / (tf + 1.2e0 * (0.25e0 + 0.75e0 * greatest(CAST(len AS DOUBLE), 1e0) / avg_len)) AS score FROM j),
sct AS (SELECT field, term, doc_id, sqrt(CAST(tf AS DOUBLE)) * (1e0 + ln(n / (df + 1e0))) * (1e0 + ln(n / (df + 1e0))) / sqrt(greatest(CAST(len AS DOUBLE), 1e0)) AS score FROM j)"""


def base(where: str = "TRUE") -> str:
    """The index of documents as common table expressions."""
    return f"""WITH docs AS (SELECT * FROM documents WHERE {where}),
toks AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '{R}'))) AS term FROM docs),
tfs AS (SELECT term, doc_id, count(*) AS tf FROM toks GROUP BY term, doc_id),
p AS (SELECT 'text' AS field, term, doc_id, tf, CAST(sum(tf) OVER (PARTITION BY doc_id) AS BIGINT) AS len FROM tfs
  UNION ALL SELECT 'lang_key', lang, doc_id, 1, 1 FROM docs UNION ALL SELECT 'source_key', source, doc_id, 1, 1 FROM docs UNION ALL SELECT 'n_chars_key', CAST(n_chars AS VARCHAR), doc_id, 1, 1 FROM docs),
s AS (SELECT 'text' AS field, CAST(sum(len(regexp_extract_all(text, '{R}'))) AS DOUBLE) / count(*) AS avg_len, CAST(count(*) AS DOUBLE) AS n FROM docs
  UNION ALL SELECT 'lang_key', count(lang) / CAST(count(*) AS DOUBLE), count(*) FROM docs UNION ALL SELECT 'source_key', count(source) / CAST(count(*) AS DOUBLE), count(*) FROM docs UNION ALL SELECT 'n_chars_key', count(n_chars) / CAST(count(*) AS DOUBLE), count(*) FROM docs),{_SCORES}
"""


#: Accent variants by hand: the plain word, then one vowel accented.
_VARIANTS = {"dé": ["de", "dé"], "más": ["mas", "más"], "de": ["de", "dé"]}


def leaf(q: Query) -> str:
    """The postings of a leaf as a condition."""
    own = f"field = '{q.field}' AND " if q.field else ""
    if isinstance(q, (Term, MultiTerm, AccentTerm)):
        terms = [q.term] if isinstance(q, Term) else q.terms if isinstance(q, MultiTerm) else _VARIANTS[q.term]
        return f"({own}term IN ({', '.join(repr(t) for t in terms)}))"
    if isinstance(q, Wildcard):
        regex = "".join(".*" if c == "*" else "." if c == "?" else c for c in q.pattern)
        return f"({own}regexp_full_match(term, '{regex}'))"
    assert isinstance(q, Fuzzy)
    prefix, rest = q.term[: q.prefix_len], q.term[q.prefix_len :]
    n, r = len(prefix), len(rest.encode())
    t = f"strlen(substr(term, {n + 1}))"
    if r == 0:
        sim = f"1 - {t} / {n}e0"
    else:
        m = f"least({r}, {t})"
        sim = f"CASE WHEN {t} = 0 THEN 1 - {r} / {n}e0 WHEN floor({1 - q.min_similarity}e0 * ({m} + {n})) < abs({r} - {t}) THEN 0 ELSE 1 - levenshtein('{rest}', substr(term, {n + 1})) / CAST({n} + {m} AS DOUBLE) END"
    best = f"SELECT field || ' ' || term FROM (SELECT field, term, row_number() OVER (PARTITION BY field ORDER BY sim DESC, term) AS nth FROM (SELECT field, term, {sim} AS sim FROM d WHERE {own}starts_with(term, '{prefix}')) AS a WHERE sim > {q.min_similarity}e0) AS b WHERE nth <= 1024"
    return f"((field || ' ' || term) IN ({best}))"


def tree(q: Query, where: str = "TRUE", scores: str = "sc", weights: dict[str, float] | None = None, more: str = "", extra: str = "") -> str:
    """(doc_id, score) of a tree, before normalisation."""
    leaves: list[Query] = []

    def visit(node: Query) -> None:
        for c in [x for _, x in node.clauses] if isinstance(node, Boolean) else [node]:
            if isinstance(c, Boolean):
                visit(c)
            elif c not in leaves:
                leaves.append(c)

    visit(q)

    def expr(node: Query) -> tuple[str, str]:
        if not isinstance(node, Boolean):
            k = leaves.index(node)
            return f"(s{k} IS NOT NULL)", f"coalesce(s{k}, 0)"
        parts = {o: [expr(c) for o2, c in node.clauses if o2 == o] for o in (MUST, SHOULD, MUST_NOT)}
        must, should = parts[MUST], parts[SHOULD]
        matched = " AND ".join([m for m, _ in must] or ["(" + " OR ".join(m for m, _ in should) + ")"])
        matched += "".join(f" AND NOT {m}" for m, _ in parts[MUST_NOT])
        total = " + ".join([s for _, s in must] + [f"CASE WHEN {m} THEN {s} ELSE 0 END" for m, s in should])
        count = " + ".join([str(len(must))] + [f"CASE WHEN {m} THEN 1 ELSE 0 END" for m, _ in should])
        return f"({matched})", f"(({total}) * ({count}) / {len(must) + len(should)}e0)"

    w = "CASE " + " ".join(f"WHEN field = '{k}' THEN {v}e0" for k, v in weights.items()) + " ELSE 1e0 END" if weights else "1e0"
    columns = ", ".join(f"sum(CASE WHEN {leaf(x)} THEN score * {w} END) AS s{k}" for k, x in enumerate(leaves))
    matched, score = expr(q)
    return f"{base(where)}{more}, piv AS (SELECT doc_id, {columns} FROM {scores} GROUP BY doc_id), h0 AS (SELECT doc_id, {score} AS score FROM piv WHERE {matched}{extra}), h AS (SELECT doc_id, score, max(score) OVER () AS top FROM h0)"


RAW = " SELECT doc_id, round(score, 6) AS score FROM h"
NORMAL = " SELECT doc_id, round(score / top, 6) AS score FROM h"


def rounded(hits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return hits.select(id_col, F.round("score", 6).alias("score"))


# functions


@query(f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{R}')) AS BIGINT) AS n_tokens, md5(lower(array_to_string(regexp_extract_all(text, '{R}'), ' '))) AS tokens FROM documents")
def analyze_tokens(spark, sf_dir):
    tokens = table(spark, sf_dir, "documents").select("doc_id", analysis.analyze("text").alias("t"))
    return tokens.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens"))


@query("SELECT doc_id, md5(translate(text, 'áéíóúüÁÉÍÓÚÜ', 'aeiouuAEIOUU')) AS folded FROM documents")
def fold_accents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(analysis.fold_accents("text")).alias("folded"))


@query("SELECT doc_id, CAST(levenshtein(text, 'Ça été où añb the') AS BIGINT) AS distance FROM documents")
def byte_distance(spark, sf_dir):
    """Over whole texts; the other side is short, so the cost is linear."""
    return table(spark, sf_dir, "documents").select("doc_id", analysis.levenshtein_bytes("text", F.lit("Ça été où añb the")).cast("long").alias("distance"))


@query("SELECT o_orderkey, lower(to_base(o_orderkey, 36)) AS name FROM orders")
def base36_names(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", analysis.base36(F.col("o_orderkey").cast("string")).alias("name"))


@query("SELECT event_id, CASE WHEN regexp_full_match(v, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN CAST(v AS DOUBLE) END AS number FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN ' 12 ' WHEN 2 THEN '12d' ELSE props END AS v FROM events)")
def parsed_numbers(spark, sf_dir):
    k = F.col("event_id") % 4
    v = F.when(k == 0, F.col("user_id").cast("string")).when(k == 1, " 12 ").when(k == 2, "12d").otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", analysis.to_number(v).alias("number"))


#: A norm is 1 / sqrt(n) as the nearest of the values that a byte stands for, the smaller of two equally near ones.
_NORMS = "norms AS (SELECT pow(2e0, b // 4 - 31) * (1 + (b % 4) / 4e0) AS v FROM (SELECT unnest(range(1, 256)) AS b) AS a)"


@query(f"WITH {_NORMS}, c AS (SELECT doc_id, len(regexp_extract_all(text, '{R}')) AS n FROM documents), lens AS (SELECT n, arg_min(v, (abs(v - CAST(CAST(1 AS REAL) / CAST(sqrt(n) AS REAL) AS DOUBLE)), v)) AS v FROM (SELECT DISTINCT n FROM c WHERE n > 0) AS d, norms GROUP BY n) SELECT doc_id, greatest(1, CAST(floor(1 / (v * v) + 0.5e0) AS BIGINT)) AS field_len FROM c JOIN lens USING (n)")
def quantized_lengths(spark, sf_dir):
    return documents(spark, sf_dir, length_mode="quantized").lengths.where("field = 'text'").select("doc_id", F.col("field_len").cast("long").alias("field_len"))


# tables of the index


@query(f"SELECT term, doc_id, count(*) AS tf, min(nth) AS first_at, CAST(sum(nth) AS BIGINT) AS sum_at FROM (SELECT doc_id, lower(unnest(regexp_extract_all(text, '{R}'))) AS term, generate_subscripts(regexp_extract_all(text, '{R}'), 1) AS nth FROM documents) GROUP BY term, doc_id")
def inverted_postings(spark, sf_dir):
    p = documents(spark, sf_dir).postings.where("field = 'text'")
    total = F.aggregate("positions", F.lit(0).cast("long"), lambda a, x: a + x)
    return p.select("term", "doc_id", F.col("tf").cast("long").alias("tf"), F.array_min("positions").cast("long").alias("first_at"), total.alias("sum_at"))


@query(base() + "SELECT field, term, df AS doc_freq FROM d")
def dictionary_df(spark, sf_dir):
    return documents(spark, sf_dir).dictionary


@query(base() + "SELECT field, CAST(n AS BIGINT) AS total_docs, round(avg_len, 6) AS avg_len FROM s")
def field_stats(spark, sf_dir):
    return documents(spark, sf_dir).field_stats.where("indexed").select("field", "total_docs", F.round("avg_len", 6).alias("avg_len"))


@query(base() + "SELECT doc_id, CAST(tf AS BIGINT) AS tf FROM p WHERE field = 'text' AND term = 'the'")
def postings_scan(spark, sf_dir):
    return documents(spark, sf_dir).postings_for("text", "the").select("doc_id", F.col("tf").cast("long").alias("tf"))


@query(f"SELECT doc_id, CAST(nth AS BIGINT) AS place FROM (SELECT doc_id, lower(unnest(regexp_extract_all(text, '{R}'))) AS term, generate_subscripts(regexp_extract_all(text, '{R}'), 1) AS nth FROM documents) WHERE term = 'the'")
def positions_scan(spark, sf_dir):
    return documents(spark, sf_dir).positions_for("text", "the").select("doc_id", F.explode("positions").alias("place")).withColumn("place", F.col("place").cast("long"))


@query(base() + "SELECT term FROM d WHERE field = 'text' AND starts_with(term, 'lic')")
def prefix_scan(spark, sf_dir):
    return documents(spark, sf_dir).terms_with_prefix("text", "lic")


@query("SELECT doc_id, md5(text) AS text, lang AS lang_key, source AS source_key, CAST(n_chars AS VARCHAR) AS n_chars_key FROM documents")
def stored_fields(spark, sf_dir):
    s = F.col("stored")
    return documents(spark, sf_dir).docs.select("doc_id", F.md5(s["text"]).alias("text"), *[s[k].alias(k) for k in ("lang_key", "source_key", "n_chars_key")])


@query("SELECT field, CAST(1 AS BIGINT) AS one FROM (VALUES ('lang_key'), ('n_chars_key'), ('source_key'), ('text')) AS v(field)")
def indexed_fields(spark, sf_dir):
    return documents(spark, sf_dir).field_stats.where("indexed").select("field", F.lit(1).cast("long").alias("one"))


# leaves


def _leaf(name: str, q: Query, similarity: Similarity = Similarity.BM25) -> None:
    def run(spark, sf_dir):
        return rounded(evaluate(searched(spark, sf_dir), q, similarity))

    run.__name__ = name
    query(tree(q, scores="sct" if similarity is Similarity.TFIDF else "sc") + RAW)(run)


_leaf("term_bm25", Term("text", "the"))
_leaf("term_tfidf", Term("text", "the"), Similarity.TFIDF)
_leaf("multi_term", MultiTerm("text", ("licensed", "the", "nothing-has-this")))
_leaf("all_fields_term", Term(None, "en"))
_leaf("keyword_term", Term("lang_key", "fr"))
_leaf("accent_term", AccentTerm("text", "dé"))
_leaf("wildcard_star", Wildcard("text", "licen*"))
_leaf("wildcard_question", Wildcard("text", "licen?ed"))
_leaf("wildcard_inner", Wildcard(None, "th*n?"))
_leaf("fuzzy", Fuzzy("text", "licensed"))
_leaf("fuzzy_short_term", Fuzzy("text", "the"))
_leaf("fuzzy_all_fields", Fuzzy(None, "worthles", 0.6))


@query(base() + "SELECT term, df AS doc_freq FROM d WHERE field = 'text' AND starts_with(term, 'th') AND regexp_full_match(term, 'th.*ing')")
def wildcard_expansion(spark, sf_dir):
    return wildcard_terms(documents(spark, sf_dir), Wildcard("text", "th*ing")).select("term", "doc_freq")


def _phrase(name: str, terms: tuple[str, ...]) -> None:
    def run(spark, sf_dir):
        return rounded(evaluate(documents(spark, sf_dir), Phrase("text", terms)))

    run.__name__ = name
    joins = " ".join(f"JOIN pos p{k} ON p{k}.doc_id = p0.doc_id AND p{k}.nth = p0.nth + {k} AND p{k}.term = '{t}'" for k, t in enumerate(terms) if k)
    pos = f", pos AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '{R}'))) AS term, generate_subscripts(regexp_extract_all(text, '{R}'), 1) AS nth FROM documents), m AS (SELECT p0.doc_id FROM pos p0 {joins} WHERE p0.term = '{terms[0]}' GROUP BY p0.doc_id)"
    times = "CASE term " + " ".join(f"WHEN '{t}' THEN {terms.count(t)}" for t in dict.fromkeys(terms)) + " END"
    query(base() + pos + f" SELECT doc_id, round(sum(score * {times}), 6) AS score FROM sc WHERE field = 'text' AND term IN ({', '.join(repr(t) for t in terms)}) AND doc_id IN (SELECT doc_id FROM m) GROUP BY doc_id")(run)


_phrase("phrase2", ("of", "the"))
_phrase("phrase3", ("under", "the", "apache"))
_phrase("phrase_repeated", ("the", "the"))


# Boolean composition

_THE, _LICENSED, _EN, _FR = Term("text", "the"), Term("text", "licensed"), Term("lang_key", "en"), Term("lang_key", "fr")
_leaf("bool_must", Boolean(((MUST, _THE), (MUST, _EN))))
_leaf("bool_should", Boolean(((SHOULD, _LICENSED), (SHOULD, _FR))))
_leaf("bool_must_should", Boolean(((MUST, _EN), (SHOULD, _LICENSED), (SHOULD, _FR))))
_leaf("bool_mustnot", Boolean(((MUST, _EN), (MUST_NOT, _LICENSED))))
_leaf("bool_nested_coord", Boolean(((MUST, _EN), (SHOULD, Boolean(((SHOULD, _LICENSED), (SHOULD, Wildcard("text", "disgus*")), (MUST_NOT, Term("source_key", "src1"))))))))
_leaf("bool_fuzzy_and_wildcard", Boolean(((MUST, Fuzzy("text", "licensed")), (MUST, Wildcard("text", "apac*")), (SHOULD, _FR))))


@query("SELECT doc_id, CAST(0 AS DOUBLE) AS score FROM documents WHERE FALSE")
def bool_pure_negative(spark, sf_dir):
    return rounded(evaluate(documents(spark, sf_dir), Boolean(((MUST_NOT, _EN),))))


# searches


def _search(name: str, p: QueryParams, q: Query, **sql) -> None:
    def run(spark, sf_dir):
        return rounded(search_params(searched(spark, sf_dir), p))

    run.__name__ = name
    end = NORMAL + (f" WHERE score / top >= {p.min_score}" if p.min_score else "")
    query(tree(q, **sql) + end)(run)




def _text(text: str, accent_insensitive: bool = False) -> Boolean:
    """What a text asks for, written out: each word nearly, the whole as a beginning, each word exactly."""
    words = text.lower().split()
    exact = AccentTerm if accent_insensitive else Term
    return Boolean(tuple((SHOULD, q) for q in [*(Fuzzy(None, w) for w in words), Wildcard(None, text.lower() + "*"), *(exact(None, w) for w in words)]))


_search("search_text", QueryParams(text="Licensed"), _text("Licensed"))
_search("search_text_words", QueryParams(text="the license"), _text("the license"))
_search("search_accents", QueryParams(text="Más de", accent_insensitive=True), _text("Más de", accent_insensitive=True))
_search("search_where_must", QueryParams(text="disgusting", where=[Where("source", ["src1", "src2", "src3"], "must")]), Boolean(((MUST, _text("disgusting")), (MUST, Boolean(tuple((SHOULD, Term("source_key", f"src{i}")) for i in (1, 2, 3)))))))
_search("search_where_should", QueryParams(text="disgusting", where=[Where("lang", ["en"])]), Boolean(((MUST, _text("disgusting")), (SHOULD, Boolean(((SHOULD, _EN),))))))
_search("search_where_mustnot", QueryParams(text="licensed", where=[Where("lang", ["en", "fr"], "mustnot")]), Boolean(((MUST, _text("licensed")), (MUST_NOT, Boolean(((SHOULD, _EN), (SHOULD, _FR)))))))
_search("search_in_multi", QueryParams(in_=[In("lang", ["fr"]), In("source_key", ["src4", "src5"])]), Boolean(((MUST, Boolean(((SHOULD, _FR), (SHOULD, Term("source_key", "src4")), (SHOULD, Term("source_key", "src5"))))),)))
_search("search_weights", QueryParams(text="en", field_weights={"lang_key": 3.0, "text": 0.5}), _text("en"), weights={"lang_key": 3.0, "text": 0.5})
_search("search_tfidf", QueryParams(text="licensed", similarity=Similarity.TFIDF), _text("licensed"), scores="sct")
_search("search_min_score", QueryParams(text="licensed", min_score=0.6), _text("licensed"))


@query(tree(_THE) + " SELECT doc_id, round(score / top, 6) AS score FROM h ORDER BY h.score DESC, doc_id LIMIT 20")
def search_top20(spark, sf_dir):
    return rounded(search(searched(spark, sf_dir), _THE, limit=20))


@query(tree(_THE) + " SELECT doc_id AS id, round(h.score / top, 6) AS score, lang AS lang_key, md5(text) AS text FROM h JOIN documents USING (doc_id) ORDER BY h.score DESC, doc_id LIMIT 20")
def search_hydrated(spark, sf_dir):
    index = searched(spark, sf_dir)
    hits = hydrated(index, search(index, _THE, limit=20), 20)
    return hits.select("id", F.round("score", 6).alias("score"), F.col("fields")["lang_key"].alias("lang_key"), F.md5(F.col("fields")["text"]).alias("text"))


_PART = f"""WITH a AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT p_partkey AS doc_id, lower(unnest(regexp_extract_all(p_name, '{R}'))) AS term FROM part) AS x GROUP BY term, doc_id),
b AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT p_partkey AS doc_id, lower(unnest(regexp_extract_all(p_type, '{R}'))) AS term FROM part) AS x GROUP BY term, doc_id),
p AS (SELECT 'name' AS field, term, doc_id, tf, CAST(sum(tf) OVER (PARTITION BY doc_id) AS BIGINT) AS len FROM a
UNION ALL SELECT 'type', term, doc_id, tf, CAST(sum(tf) OVER (PARTITION BY doc_id) AS BIGINT) FROM b
UNION ALL SELECT 'brand_key', p_brand, p_partkey, 1, 1 FROM part),
s AS (SELECT 'name' AS field, CAST(sum(len(regexp_extract_all(p_name, '{R}'))) AS DOUBLE) / count(*) AS avg_len, CAST(count(*) AS DOUBLE) AS n FROM part
  UNION ALL SELECT 'type', CAST(sum(len(regexp_extract_all(p_type, '{R}'))) AS DOUBLE) / count(*), count(*) FROM part UNION ALL SELECT 'brand_key', 1.0, count(*) FROM part),{_SCORES}
"""


@query(_PART + "SELECT doc_id, round(sum(score * CASE field WHEN 'type' THEN 2e0 ELSE 1e0 END), 6) AS score FROM sc WHERE (field <> 'brand_key' AND regexp_full_match(term, 's.*')) GROUP BY doc_id")
def part_fields(spark, sf_dir):
    index = build_index(table(spark, sf_dir, "part"), "p_partkey", PART_SPECS)
    return rounded(evaluate(index, Wildcard(None, "s*"), weights={"type": 2.0}))


@query(f"SELECT conv_id, turn FROM (SELECT conv_id, turn, role, ' ' || lower(array_to_string(regexp_extract_all(text, '{R}'), ' ')) || ' ' AS t FROM conversations) WHERE role = 'user' AND t LIKE '% of the %'")
def conversations_phrase(spark, sf_dir):
    df = table(spark, sf_dir, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    index = build_index(df, "id", [FieldSpec("text"), FieldSpec("role_key", "role", "keyword"), FieldSpec("conv_id_attr", "conv_id", "unindexed")])
    hits = evaluate(index, Boolean(((MUST, Phrase("text", ("of", "the"))), (MUST, Term("role_key", "user")))))
    return hits.select(F.expr("doc_id div 1000").alias("conv_id"), (F.col("doc_id") % 1000).alias("turn"))


# more like this

_MLT = mlt.MltParams(["text"], min_doc_freq=3)
#: The document with most terms that _MLT takes, the first of several: in SQL a subquery on the index.
_SOURCE = "(SELECT doc_id FROM src)"
_SRC = ", src AS (SELECT doc_id FROM j WHERE field = 'text' AND tf >= 2 AND df >= 3 AND df <= floor(n / 2) GROUP BY doc_id ORDER BY count(*) DESC, doc_id LIMIT 1)"


def source(index: Index, key: str | None = None) -> int:
    """Its number, or what a keyword field calls it: then the first of several is the one with the smallest such number."""
    df = index.dictionary.select("field", "term", "doc_freq").where("field = 'text' and doc_freq >= 3").crossJoin(F.broadcast(index.field_stats.agg(F.max("total_docs").alias("n")))).where("doc_freq <= floor(n / 2)").select("term")
    terms = index.frequencies.where("field = 'text' and tf >= 2").join(df, "term").groupBy("doc_id").count()
    if key:
        names = index.frequencies.where(F.col("field") == key).select("doc_id", F.col("term").cast("long").alias("name"))
        terms = terms.join(names, "doc_id").select(F.col("name").alias("doc_id"), "count")
    return terms.orderBy(F.desc("count"), "doc_id").first()[0]


def _terms(p: mlt.MltParams) -> str:
    budget = "TRUE" if p.posting_budget == 0 else f"nth = 1 OR cum <= {p.posting_budget if p.posting_budget is not None else 'n'}"
    most = "TRUE" if p.max_doc_freq == 0 else f"df <= {p.max_doc_freq if p.max_doc_freq is not None else 'floor(n / 2)'}"
    top = f"nth <= {p.max_query_terms}" if p.max_query_terms else "TRUE"
    return f"""{_SRC}, rk AS (SELECT field, term, tf, df, n, weight, row_number() OVER (ORDER BY weight DESC, field, term) AS nth FROM (SELECT field, term, tf, df, n, tf * (1e0 + ln(n / (df + 1e0))) AS weight FROM j WHERE doc_id = {_SOURCE} AND field = 'text' AND tf >= {p.min_term_freq} AND df >= {p.min_doc_freq} AND {most}) AS a),
cu AS (SELECT *, sum(df) OVER (ORDER BY nth) AS cum FROM rk WHERE {top}), te AS (SELECT * FROM cu WHERE {budget})"""


@query(base() + _terms(_MLT) + " SELECT field, term, CAST(tf AS BIGINT) AS tf, df AS doc_freq, round(weight, 6) AS weight, CAST(nth AS BIGINT) AS nth FROM te")
def mlt_select_terms(spark, sf_dir):
    index = searched(spark, sf_dir)
    return mlt.select_terms(index, source(index), _MLT).select("field", "term", "tf", "doc_freq", F.round("weight", 6).alias("weight"), F.col("nth").cast("long").alias("nth"))


def _mlt(name: str, p: mlt.MltParams, where: str = "TRUE", having: str = "TRUE") -> None:
    def run(spark, sf_dir):
        index = searched(spark, sf_dir)
        return rounded(mlt.more_like_this(index, source(index), p))

    run.__name__ = name
    h = f", h0 AS (SELECT sct.doc_id, sum(score) AS score, count(*) AS c FROM sct JOIN te ON sct.field = te.field AND sct.term = te.term WHERE sct.doc_id <> {_SOURCE} AND {where} GROUP BY sct.doc_id HAVING {having}), h AS (SELECT doc_id, score, max(score) OVER () AS top FROM h0)"
    query(base() + _terms(p) + h + NORMAL)(run)


def _with(**kw) -> mlt.MltParams:
    return mlt.MltParams(**(_MLT.__dict__ | kw))


_mlt("mlt_hits", _MLT)
_mlt("mlt_all_terms", _with(max_query_terms=0, max_doc_freq=0, posting_budget=0, min_term_freq=3))
_mlt("mlt_msm", _with(posting_budget=0, min_should_match=mlt.MinShouldMatch(30, True)), having="count(*) >= (SELECT count(*) FROM te) * 30 // 100")
_mlt("mlt_term_filter", _with(term_filters=[("lang_key", "en"), ("text", "the")]), "sct.doc_id IN (SELECT doc_id FROM p WHERE field = 'lang_key' AND term = 'en') AND sct.doc_id IN (SELECT doc_id FROM p WHERE field = 'text' AND term = 'the')")
_mlt("mlt_range_filter", _with(range_filters=[mlt.Range("n_chars_key", 500, 4000)]), "sct.doc_id IN (SELECT doc_id FROM documents WHERE n_chars BETWEEN 500 AND 4000)")


@query(base() + _terms(_MLT) + f", h0 AS (SELECT sct.doc_id, sum(score) AS score FROM sct JOIN te ON sct.field = te.field AND sct.term = te.term WHERE sct.doc_id <> {_SOURCE} GROUP BY sct.doc_id), h AS (SELECT doc_id, score, max(score) OVER () AS top FROM h0) SELECT h.doc_id AS id, round(score / top, 6) AS score, lang AS lang_key FROM h JOIN documents ON documents.doc_id = h.doc_id")
def mlt_source_fields(spark, sf_dir):
    index = searched(spark, sf_dir)
    hits = hydrated(index, mlt.more_like_this(index, source(index), _MLT), None, ["lang_key"])
    return hits.select("id", F.round("score", 6).alias("score"), F.col("fields")["lang_key"].alias("lang_key"))


# interfaces and the writer


def as_json(df: DataFrame) -> DataFrame:
    """Rows of documents as JSON documents."""
    fields = [F.struct(F.lit(s.name).alias("name"), F.col(s.source or s.name).cast("string").alias("value"), F.lit(s.kind).alias("kind")) for s in DOCUMENT_SPECS]
    return df.select("doc_id", F.to_json(F.struct(F.array(*fields).alias("fields"))).alias("json"))


@query(base() + "SELECT field, term, df AS doc_freq FROM d WHERE field <> 'n_chars_key'")
def json_documents(spark, sf_dir):
    return index_documents(parse_documents(as_json(table(spark, sf_dir, "documents"))).select("doc_id", "fields")).dictionary.where("field <> 'n_chars_key'")


@query(tree(_text("licensed")) + " SELECT h.doc_id AS id, round(score / top, 6) AS score, lang AS lang_key FROM h JOIN documents ON documents.doc_id = h.doc_id")
def json_search(spark, sf_dir):
    hits = SearchEngine(spark, searched(spark, sf_dir)).search(json.dumps({"text": "licensed", "limit": 0}))
    return hits.select("id", F.round("score", 6).alias("score"), F.col("fields")["lang_key"].alias("lang_key"))


def written(spark: SparkSession, sf_dir: str) -> str:
    """An index on disk with all documents."""
    path = work_dir(spark)
    with IndexWriter(spark, path, length_mode="exact") as w:
        w.add_table(table(spark, sf_dir, "documents"), DOCUMENT_SPECS)
        w.commit()
    return path


def by_text(index: Index, hits: DataFrame) -> DataFrame:
    """Hits by their text's digest: writers number documents themselves. Copies count as often as they occur."""
    docs = index.docs.select(F.col("doc_id").alias("id"), F.md5(F.col("stored")["text"]).alias("digest"))
    return hits.join(docs, F.col("doc_id") == F.col("id")).select("digest", F.round("score", 6).alias("score"))


_GONE = "source IN ('src1', 'src2')"


def deleted(spark: SparkSession, sf_dir: str) -> str:
    path = written(spark, sf_dir)
    with IndexWriter(spark, path) as w:
        w.delete_documents(w.reader().postings.where((F.col("field") == "source_key") & F.col("term").isin("src1", "src2")).select("doc_id"))
        w.commit()
    return path


@query(tree(_THE, extra=f" AND doc_id NOT IN (SELECT doc_id FROM documents WHERE {_GONE})") + " SELECT md5(text) AS digest, round(score / top, 6) AS score FROM h JOIN documents ON documents.doc_id = h.doc_id")
def delete_then_search(spark, sf_dir):
    """Deleted documents are no hits, but count in the statistics."""
    index = Store(deleted(spark, sf_dir)).open(spark)
    return by_text(index, search(index, _THE))


@query(tree(_THE, where=f"NOT {_GONE}") + " SELECT md5(text) AS digest, round(score / top, 6) AS score FROM h JOIN documents ON documents.doc_id = h.doc_id")
def optimize_then_search(spark, sf_dir):
    path = deleted(spark, sf_dir)
    with IndexWriter(spark, path) as w:
        w.optimize()
    index = Store(path).open(spark)
    return by_text(index, search(index, _THE))


@query("SELECT lang AS lang_key, md5(text) AS digest, count(*) AS n FROM documents GROUP BY lang, text UNION ALL SELECT 'new', md5(p_name), count(*) FROM part GROUP BY p_name")
def upsert(spark, sf_dir):
    """All parts as documents, then those again, which replace the first ones of the same key."""
    path = written(spark, sf_dir)
    new = as_documents(table(spark, sf_dir, "part").select("p_partkey", "p_name", F.concat(F.lit("part"), F.col("p_partkey")).alias("key"), F.lit("new").alias("lang")), "p_partkey", [FieldSpec("text", "p_name"), FieldSpec("id_key", "key", "keyword"), FieldSpec("lang_key", "lang", "keyword")])
    for _ in range(2):
        with IndexWriter(spark, path, length_mode="exact") as w:
            w.upsert(new, "id_key")
            w.commit()
    s = F.col("stored")
    return Store(path).open(spark).docs.groupBy(s["lang_key"].alias("lang_key"), F.md5(s["text"]).alias("digest")).agg(F.count("*").alias("n"))


@query(tree(_LICENSED) + " SELECT md5(text) AS digest, round(score / top, 6) AS score FROM h JOIN documents ON documents.doc_id = h.doc_id")
def stream_ingest(spark, sf_dir):
    """All documents through a stream, file by file."""
    root = work_dir(spark)
    source = table(spark, sf_dir, "documents")
    source.select(F.to_json(F.struct(F.array(*[F.struct(F.lit(s.name).alias("name"), F.col(s.source or s.name).cast("string").alias("value"), F.lit(s.kind).alias("kind")) for s in DOCUMENT_SPECS]).alias("fields"))).alias("json")).repartition(2).write.parquet(f"file://{root}-in")
    Store(f"{root}-index").create("exact")
    stream = spark.readStream.schema("json string").option("maxFilesPerTrigger", 1).parquet(f"file://{root}-in")
    ingest(stream, f"{root}-index", f"file://{root}-check").trigger(availableNow=True).start().awaitTermination()
    index = Store(f"{root}-index").open(spark)
    return by_text(index, search(index, _LICENSED))


@query(base() + "SELECT field, term, df AS doc_freq, row_number() OVER (ORDER BY encode(field), encode(term)) AS nth FROM d")
def all_terms(spark, sf_dir):
    """The whole dictionary in its order."""
    # written once in their order, and numbered by file and row: bounds of ranges that are computed again may be others
    path = f"file://{work_dir(spark)}"
    documents(spark, sf_dir).all_terms().write.parquet(path)
    rows, _ = numbered_rows(spark.read.schema(TABLES["dictionary"]).parquet(path))
    return rows.select("field", "term", "doc_freq", (F.col("doc_id") + 1).alias("nth"))


@query(base() + _terms(_MLT) + f", h0 AS (SELECT sct.doc_id, sum(score) AS score FROM sct JOIN te ON sct.field = te.field AND sct.term = te.term WHERE sct.doc_id <> {_SOURCE} GROUP BY sct.doc_id), h AS (SELECT doc_id, score, max(score) OVER () AS top FROM h0) SELECT md5(text) AS digest, round(score / top, 6) AS score FROM h JOIN documents ON documents.doc_id = h.doc_id")
def mlt_json(spark, sf_dir):
    """More like this by a JSON request, on an index on disk; the source is named by a keyword."""
    path = work_dir(spark)
    docs = table(spark, sf_dir, "documents")
    with IndexWriter(spark, path, length_mode="exact") as w:
        w.add_table(docs, [*DOCUMENT_SPECS, FieldSpec("id_key", "doc_id", "keyword")])
        w.commit()
    request = {"id_field": "id", "id_value": str(source(Store(path).open(spark), "id_key")), "fields": ["text"], "min_doc_freq": 3}
    hits = SearchEngine(spark, path).more_like_this(json.dumps(request))
    return hits.select(F.md5(F.col("fields")["text"]).alias("digest"), F.round("score", 6).alias("score"))


@query("SELECT source AS source_key, md5(text) AS digest, count(*) AS n FROM documents WHERE source = 'src3' GROUP BY source, text")
def lookup(spark, sf_dir):
    """All documents that a keyword names, by the writer's lookup."""
    path = written(spark, sf_dir)
    with IndexWriter(spark, path) as w:
        docs = w.reader().docs_by_id(w.find_doc_ids("source_key", "src3"))
    s = F.col("stored")
    return docs.groupBy(s["source_key"].alias("source_key"), F.md5(s["text"]).alias("digest")).agg(F.count("*").alias("n"))


@query(tree(_THE) + " SELECT md5(text) AS digest, round(score / top, 6) AS score FROM h JOIN documents ON documents.doc_id = h.doc_id")
def compaction(spark, sf_dir):
    """All documents language by language, as one transaction whose segments are merged once there are more than two."""
    path = work_dir(spark)
    docs = table(spark, sf_dir, "documents")
    with IndexWriter(spark, path, max_segments=2, length_mode="exact") as w:
        for lang in sorted(r.lang for r in docs.select("lang").distinct().collect()):
            w.add_table(docs.where(F.col("lang") == lang), DOCUMENT_SPECS)
        w.commit()
    index = Store(path).open(spark)
    return by_text(index, search(index, _THE))


@query("SELECT 'before' AS at, count(*) AS n FROM documents UNION ALL SELECT 'pending', count(*) + (SELECT count(*) FROM part) FROM documents UNION ALL SELECT 'after', count(*) FROM documents UNION ALL SELECT 'generation', 2")
def rollback(spark, sf_dir):
    """Documents before, in and after a transaction that is given up, and the generation."""
    path = written(spark, sf_dir)
    with IndexWriter(spark, path) as w:
        counts = [("before", w.document_count())]
        w.add_table(table(spark, sf_dir, "part"), PART_SPECS)
        counts.append(("pending", w.document_count()))
        w.rollback()
    m = Store(path).current()
    return spark.createDataFrame([*counts, ("after", m.num_docs), ("generation", m.generation)], "at string, n long")


@query(base() + "SELECT field, term, df AS doc_freq FROM d WHERE field <> 'n_chars_key'")
def json_batches(spark, sf_dir):
    """Files with lists of JSON documents, one a source, as an index."""
    path = f"file://{work_dir(spark)}"
    rows = as_json(table(spark, sf_dir, "documents").select("*", F.col("doc_id").alias("id"))).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    rows.repartition("source").groupBy("source").agg(F.array_join(F.collect_list("json"), ",").alias("j")).select(F.concat(F.lit('{"docs":['), "j", F.lit("]}")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    docs = read_json_batch(spark, path).withColumn("doc_id", F.monotonically_increasing_id())
    return index_documents(docs).dictionary.where("field <> 'n_chars_key'")


@query(base() + "SELECT p.doc_id, CAST(len AS BIGINT) AS n FROM p WHERE field = 'text' AND term = 'the'")
def boosted_lengths(spark, sf_dir):
    """A document boost changes norms alone: with exact lengths they count as they are."""
    return documents(spark, sf_dir, doc_boost=2.0).frequencies.where("field = 'text' and term = 'the'").select("doc_id", F.col("field_len").cast("long").alias("n"))
