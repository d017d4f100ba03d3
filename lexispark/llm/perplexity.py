"""N-gram perplexity: a modified Kneser-Ney model counted by Spark, held in sorted hash arrays, and quality bands.

N-grams are of ORDER characters. A character is a 12-bit symbol: its code point below 2048, else one of 2048
hash classes, so that an n-gram of up to five is one 60-bit key and its shorter forms are shifts and masks of it. Every
document is padded with ORDER - 1 start symbols and one end symbol. The highest order has raw counts, lower orders
have the numbers of distinct left extensions; each order has three discounts for each language from its counts of counts.

Every document of every language (the lang column; null counts as a language of its own) is counted, whatever
its length. The model is a table in the shared folder, sorted by language, kind and key, which the scoring
workers load as arrays: the driver never holds it.

Bands: for each language the median of the documents' mean negative log-probability and the median absolute
deviation (MAD), both over bins of 1/1024 and exact at any size. A document passes if its mean lies between
median - LOW and median + HIGH scaled deviations; the deviation is widened for short texts, of which a mean says less.
Null and empty texts have no perplexity and pass: this rule has nothing against them. Equal texts of one language get
equal results, repeated rows repeated ones; a null doc_id is carried along, a null language and "" are one language. Whole texts are counted
and scored, long ones STEP_CHARS n-grams at a time. An empty table gives an empty model, no bands and no rows. Other columns are not read,
or in reject() passed through untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .util import STEP_CHARS, codes, free, only, shared_dir, steps, stored, sums

ORDER, START, END = 5, "\x02", "\x03"
#: Scaled median absolute deviations that a document may lie below and above its language's median. Set on the labelled rows of sf0.1: the
#: points beyond which fewer than 0.15 % of the good ones lie (4 of 3,409 below, none above), and 241 of the 571 bad ones.
LOW, HIGH = 5.0, 6.0
#: The least deviation, and the characters of which a text's own spread equals the language's.
LEAST, SHORT = 0.01, 5000
FLUSH = 1 << 21


def symbols(cp: np.ndarray) -> np.ndarray:
    return np.where(cp < 2048, cp, 2048 + (cp * np.uint32(2654435761) >> np.uint32(21))).astype(np.int64)


def slices(texts: list[str], most: int = STEP_CHARS) -> Iterator[tuple[list[str], list[int]]]:
    """The padded texts and their numbers, some at a time: a long text in slices of `most` n-grams that overlap by ORDER - 1 symbols."""
    out, own, n = [], [], 0
    for i, t in enumerate(texts):
        t = START * (ORDER - 1) + t + END
        for a in range(0, len(t) - ORDER + 1, most):
            out.append(t[a : a + most + ORDER - 1])
            own.append(i)
            n += len(out[-1])
            if n > most:
                yield out, own
                out, own, n = [], [], 0
    if out:
        yield out, own


def keys(padded: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all n-grams of the highest order, a slice's together, and how many each slice has."""
    cp, starts = codes(padded, "")
    s = symbols(cp)
    k = np.zeros(max(len(s) - ORDER + 1, 0), np.int64)
    for i in range(ORDER):
        k <<= 12
        k |= s[i : i + len(k)]
    size = np.diff(starts) - (ORDER - 1)
    inside = np.ones(len(k), bool)
    if len(starts) > 2:
        inside[(starts[1:-1, None] - np.arange(1, ORDER)).ravel()] = False
    return k[inside], size


def tallied(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    k, c = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.diff(k, prepend=k[0] - 1)) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


def count(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, key, c) of every n-gram of the highest order: tallied in each task, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                k, c = tallied(parts)
                for i in range(0, len(k), 1 << 16):
                    n = len(k[i : i + (1 << 16)])
                    yield pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(n, np.int64))), pa.array(k[i : i + n]), pa.array(c[i : i + n])], ["lang", "key", "c"])
            held.clear()

        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in steps(texts):
                by: dict[str, list[str]] = {}
                for t, lang in zip(texts[i:j], langs[i:j]):
                    by.setdefault(lang, []).append(t)
                for lang, own in by.items():
                    for part, _ in slices(own):
                        k = np.sort(keys(part)[0])
                        first = np.flatnonzero(np.diff(k, prepend=-1))
                        held.setdefault(lang, []).append((k[first], np.diff(first, append=len(k))))
                        if sum(len(p[0]) for p in held[lang]) > FLUSH:
                            held[lang] = [tallied(held[lang])]
                if sum(len(p[0]) for parts in held.values() for p in parts) > 2 * FLUSH:
                    yield from flush()
        yield from flush()

    rows = only(docs, text=text_col, lang=lang_col).where("text != ''").select("text", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"))
    return rows.mapInArrow(run, "lang string, key long, c long").groupBy("lang", "key").agg(F.sum("c").alias("c"))


def discount(a: Column) -> Column:
    return F.when(a == 1, F.col("d1")).when(a == 2, F.col("d2")).otherwise(F.col("d3"))


def discounts(orders: dict[int, DataFrame]) -> DataFrame:
    """(lang, n, d1, d2, d3) of every language and order, from its counts of counts."""
    tallies = [t.where("a <= 4").groupBy("lang").agg(*[F.sum((F.col("a") == i).cast("long")).alias(f"n{i}") for i in (1, 2, 3, 4)]).withColumn("n", F.lit(n)) for n, t in orders.items()]
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    out = []
    for i in (1, 2, 3):
        d = F.when((F.col("n1") > 0) & (F.col(f"n{i}") > 0), i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"))
        # without enough counts of counts, and where a discount would leave 0..i, the usual constants
        out.append(F.coalesce(F.when((d > 0) & (d < i), d), F.lit(0.5 * i)).alias(f"d{i}"))
    return reduce(DataFrame.unionByName, tallies).select("lang", "n", *out)


def train(counts: DataFrame) -> str:
    """The model's address. Its rows: lang, kind (order n for log-probabilities, 10 + n for log back-off weights of
    contexts of n symbols), key, value. Each order's tables are stored, so that none is computed twice."""
    orders = {ORDER: stored(counts.select("lang", "key", F.col("c").alias("a")), "ngrams")}
    for n in range(ORDER - 1, 0, -1):
        orders[n] = stored(orders[n + 1].groupBy("lang", F.col("key").bitwiseAND((1 << 12 * n) - 1).alias("key")).agg(F.count("*").alias("a")), "ngrams")
    known = stored(discounts(orders).coalesce(1), "discounts")
    # p of the empty context: uniform over the language's symbols and one unknown
    lower = orders[1].groupBy("lang").agg((1 / (F.count("*") + 1)).alias("q")).select("lang", F.lit(0).cast("long").alias("key"), "q")
    out = [lower.select("lang", F.lit(0).alias("kind"), "key", F.log("q").alias("value"))]
    for n in range(1, ORDER + 1):
        d = known.where(F.col("n") == n).select(F.col("lang").alias("d_lang"), "d1", "d2", "d3")
        # a row a language, which nothing that is counted can be more than
        t = orders[n].join(F.broadcast(d), F.col("lang") == F.col("d_lang"), "left").withColumns({name: F.coalesce(name, F.lit(0.5 * i)) for i, name in ((1, "d1"), (2, "d2"), (3, "d3"))})
        t = t.select("lang", "key", "a", F.shiftright("key", 12).alias("ctx"), discount(F.col("a")).alias("left"))
        w = Window.partitionBy("lang", "ctx")
        t = t.withColumns({"s": F.sum("a").over(w), "g": F.sum("left").over(w), "at": F.row_number().over(w.orderBy("key"))})
        below = lower.select(F.col("lang").alias("b_lang"), F.col("key").alias("b_key"), F.col("q").alias("b_q"))
        t = t.join(below, (F.col("lang") == F.col("b_lang")) & (F.col("key").bitwiseAND((1 << 12 * (n - 1)) - 1) == F.col("b_key")))
        g = F.col("g") / F.col("s")
        t = stored(t.select("lang", "key", ((F.col("a") - F.col("left")) / F.col("s") + g * F.col("b_q")).alias("q"), F.when(F.col("at") == 1, g).alias("g")), "ngrams")
        lower = t.select("lang", "key", "q")
        out.append(lower.select("lang", F.lit(n).alias("kind"), "key", F.log("q").alias("value")))
        out.append(t.where("g is not null").select("lang", F.lit(10 + n - 1).alias("kind"), F.shiftright("key", 12).alias("key"), F.log("g").alias("value")))
    path = shared_dir(counts.sparkSession, "model")
    reduce(DataFrame.unionByName, out).repartitionByRange("lang", "kind", "key").sortWithinPartitions("lang", "kind", "key").write.parquet(path)
    return path


_HELD: dict[str, dict] = {}


def load(path: str) -> dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]:
    """Sorted keys and their values by language and kind. A worker process holds the last model that it was asked for."""
    if path not in _HELD:
        _HELD.clear()
        _HELD[path] = read_model(path)
        pa.default_memory_pool().release_unused()
    return _HELD[path]


def read_model(path: str) -> dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]:
    """Batch by batch; what the files hold in order is not sorted again."""
    parts: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in ds.dataset(path, format="parquet").to_batches(columns=["lang", "kind", "key", "value"]):
        if not batch.num_rows:
            continue
        lang = batch.column(0).dictionary_encode()
        names, group = lang.dictionary.to_pylist(), lang.indices.to_numpy().astype(np.int64) * 32 + batch.column(1).to_numpy()
        key, value = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        edges = np.flatnonzero(np.diff(group, prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:]):
            parts.setdefault((names[group[a] // 32], int(group[a] % 32)), []).append((key[a:b].copy(), value[a:b].astype(np.float32)))
    out = {}
    for name in list(parts):
        own = parts.pop(name)
        key, value = (np.concatenate(x) for x in zip(*own))
        if (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
        out[name] = key, value
    return out


def found(table: tuple[np.ndarray, np.ndarray] | None, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys a table has, and their values."""
    if table is None:
        return np.zeros(len(k), bool), np.zeros(len(k))
    at = np.minimum(np.searchsorted(table[0], k), len(table[0]) - 1)
    return table[0][at] == k, table[1][at]


def log_probabilities(k: np.ndarray, lang: str, model: dict) -> np.ndarray:
    """Of each n-gram's last symbol after the others."""
    out, at = np.zeros(len(k)), np.arange(len(k))
    for n in range(ORDER, 0, -1):
        sub = k[at] & ((1 << 12 * n) - 1)
        hit, value = found(model.get((lang, n)), sub)
        out[at[hit]] += value[hit]
        at, sub = at[~hit], sub[~hit]
        if not len(at):
            return out
        hit, value = found(model.get((lang, 10 + n - 1)), sub >> 12)
        out[at[hit]] += value[hit]
    out[at] += model[lang, 0][1][0]
    return out


def mean_losses(texts: list[str | None], langs: list[str | None], model: dict) -> np.ndarray:
    """Mean negative log-probability a symbol; NaN without text, or for a language that the model lacks."""
    out = np.full(len(texts), np.nan)
    by: dict[str, list[int]] = {}
    for i, (t, lang) in enumerate(zip(texts, langs)):
        if t and (lang or "", 0) in model:
            by.setdefault(lang or "", []).append(i)
    for lang, own in by.items():
        total, n = np.zeros(len(own)), np.zeros(len(own), np.int64)
        for part, of in slices([texts[i] for i in own]):
            k, size = keys(part)
            np.add.at(total, of, sums(log_probabilities(k, lang, model), size))
            np.add.at(n, of, size)
        out[own] = -total / n
    return out


def score(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, lang, n_chars, loss) of every row; loss is the log of the perplexity and null where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        for batch in batches:
            texts, langs = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for i, j in steps(texts):
                loss = mean_losses(texts[i:j], langs[i:j], m)
                size = pa.array([None if t is None else len(t) for t in texts[i:j]], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(2)[i:j], size, pa.array(loss, mask=np.isnan(loss))], ["doc_id", "lang", "n_chars", "loss"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = only(docs, doc_id=id_col, text=text_col, lang=lang_col).withColumn("lang", F.col("lang").cast("string"))
    return rows.mapInArrow(run, f"doc_id {kind}, lang string, n_chars long, loss double")


def bands(scores: DataFrame) -> DataFrame:
    """(band_lang, median, deviation) for each language, from exact tallies of 1/1024 bins."""

    def middle(df: DataFrame, value: str) -> DataFrame:
        """The lower median of an integer column for each language; only tallies are sorted."""
        tally = df.groupBy("band_lang", value).count()
        w = Window.partitionBy("band_lang")
        run = tally.withColumn("upto", F.sum("count").over(w.orderBy(value))).withColumn("all", F.sum("count").over(w))
        return run.where(2 * F.col("upto") >= F.col("all")).groupBy("band_lang").agg(F.min(value).alias("mid"))

    # a mean over few symbols spreads more: it is brought to the spread of a long text before the deviation is taken
    x = scores.where("loss is not null").select(F.coalesce("lang", F.lit("")).alias("band_lang"), F.floor(F.col("loss") * 1024).alias("bin"), widening(F.col("n_chars")).alias("wide"))
    mid = middle(x, "bin")
    off = x.join(mid, "band_lang").select("band_lang", F.floor(F.abs(F.col("bin") - F.col("mid")) / F.col("wide")).alias("off"))
    dev = middle(off, "off").select("band_lang", (F.col("mid") * 1.4826 / 1024).alias("dev"))
    return mid.join(dev, "band_lang").select("band_lang", (F.col("mid") / 1024).alias("median"), F.greatest("dev", F.lit(LEAST)).alias("deviation"))


def widening(n_chars: Column) -> Column:
    return F.sqrt(1 + SHORT / (n_chars + 1))


def ends(median: Column, deviation: Column, n_chars: Column, low: float, high: float) -> tuple[Column, Column]:
    """The least and greatest perplexity that pass."""
    spread = deviation * widening(n_chars)
    return F.exp(median - low * spread), F.exp(median + high * spread)


def judge(scores: DataFrame, band: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """scores with perplexity, the band's ends for the text's language and length, and keep."""
    lower, upper = ends(F.col("median"), F.col("deviation"), F.col("n_chars"), low, high)
    s = scores.withColumn("band_lang", F.coalesce("lang", F.lit(""))).join(band, "band_lang", "left")
    judged = s.select(*scores.columns, F.exp("loss").alias("perplexity"), lower.alias("lower"), upper.alias("upper"))
    return judged.withColumn("keep", F.coalesce(F.col("perplexity").between(F.col("lower"), F.col("upper")), F.lit(True)))


def reject(docs: DataFrame, model: str, low: float = LOW, high: float = HIGH, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that pass, with all their columns.

    Rows are written once with their loss beside them, and read again when the bands are known: each text is scored once, and nothing is
    joined by an id, so that null and repeated ids make no difference."""
    names = docs.columns
    loss, n_chars = free(docs, "loss"), free(docs, "n_chars_of_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        for batch in batches:
            texts, langs = batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist()
            for i, j in steps(texts):
                own = mean_losses(texts[i:j], langs[i:j], m)
                size = pa.array([None if t is None else len(t) for t in texts[i:j]], pa.int64())
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(own, mask=np.isnan(own)), size], [*names, loss, n_chars])

    given = docs.select("*", F.col(f"`{text_col}`").alias(free(docs, "text_read")), F.col(f"`{lang_col}`").cast("string").alias(free(docs, "lang_read")))
    schema = StructType([*docs.schema.fields, StructField(loss, DoubleType()), StructField(n_chars, LongType())])
    rows = stored(given.mapInArrow(run, schema), "scored")
    scores = rows.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(n_chars).alias("n_chars"), F.col(loss).alias("loss"))
    limits = F.broadcast(bands(scores))  # a row a language
    of = F.coalesce(F.col(f"r.`{lang_col}`").cast("string"), F.lit(""))
    found = rows.alias("r").join(limits.alias("b"), of == F.col("b.band_lang"), "left")
    lower, upper = ends(F.col("b.median"), F.col("b.deviation"), F.col(f"r.{n_chars}"), low, high)
    keep = F.coalesce(F.exp(F.col(f"r.{loss}")).between(lower, upper), F.lit(True))
    return found.where(keep).select(*[F.col(f"r.`{c}`") for c in names])
