"""Language identification: multinomial naive Bayes over hashed character n-grams.

The model counts the n-grams (1 to 4 characters, with word ends marked by spaces) of labelled rows in BITS-bit
buckets and smooths with ALPHA. Its log-probability matrix, of a size fixed by BITS and the number of languages, is
broadcast; batches are scored as sparse rows of bucket indices against it.

The fit uses at most FIT_ROWS labelled rows, of each language as many and equal texts once, chosen by hash, so that fit and
matrix stay bounded; scoring covers whole texts of all rows, long ones STEP_CHARS characters at a time (some 20 bytes a
character are held). Nulls and texts without any letter (emoji are none) have a null language and margin. Ties go to the
language first in order. Rows are independent: repeated rows give repeated results, a null doc_id is carried along,
unlabelled rows (null lang) are scored like others. With no labelled row at all every prediction is null; an
empty table gives no rows. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .util import STEP_CHARS, codes, only, steps, sums

BITS, ORDERS, ALPHA, FIT_ROWS = 16, 4, 0.5, 4096


_LETTER = np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)


def grams(texts: list[str], bits: int = BITS, orders: int = ORDERS, most: int = STEP_CHARS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bucket of every n-gram, all of a text together, and how many each text has: the indices and row lengths of a sparse matrix.

    Of long texts in parts, by the n-grams' first characters, `most` of them at a time."""
    cp, starts = codes([f" {t.lower()} " for t in texts], "")
    for low in range(0, len(cp), most):
        part = cp[low : low + most + orders - 1]
        yield _grams(part, np.searchsorted(starts, np.arange(low, low + len(part)), "right") - 1, min(most, len(cp) - low), len(texts), bits, orders)


def _grams(cp: np.ndarray, text: np.ndarray, n_first: int, n_texts: int, bits: int, orders: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that start at one of the first n_first characters."""
    letter = _LETTER[cp]
    c = np.where(letter, cp, 32).astype(np.uint32)
    columns, rows = [], []
    h = np.zeros(len(c), np.uint32)
    for n in range(1, orders + 1):
        h = h[: max(len(c) - n + 1, 0)] * np.uint32(0x01000193) + c[n - 1 :]
        # no n-gram crosses texts or holds a gap between words other than at its ends
        ok = text[: len(h)] == text[n - 1 :] if n > 1 else letter.copy()
        if n == 2:
            ok &= letter[:-1] | letter[1:]
        elif n > 2:
            inner = np.ones(len(h), bool)
            for k in range(1, n - 1):
                inner &= letter[k : k + len(h)]
            ok &= inner
        at = np.flatnonzero(ok[:n_first])
        columns.append((h[at] * np.uint32(2654435761) + np.uint32(n * 40503)) * np.uint32(2246822519) >> np.uint32(32 - bits))
        rows.append(text[at])
    row, col = np.concatenate(rows), np.concatenate(columns)
    order = np.argsort(row, kind="stable")
    return col[order], np.bincount(row, minlength=n_texts)


def sample(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS) -> DataFrame:
    """(lang, text) of at most fit_rows labelled rows: of each language as many, those of smallest hash, equal texts once.

    Rows are chosen by hashes alone, below a threshold that the languages' numbers of distinct texts give; only the texts of
    chosen rows move."""
    rows = only(docs, text=text_col, lang=lang_col).where("text is not null and lang is not null").select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("text", "lang").alias("h"))
    known = rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n"))
    langs = known.orderBy(F.desc("n"), "lang").limit(fit_rows).collect()  # a row a language
    if not langs:
        return rows.where(F.lit(False)).select("lang", "text")
    each = max(1, fit_rows // len(langs))
    share = docs.sparkSession.createDataFrame([(r.lang, min(1.0, 1.5 * each / r.n + 30 / r.n)) for r in langs], "of string, share double")
    low = rows.join(F.broadcast(share), F.col("lang") == F.col("of")).where(F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h"))
    picked = low.select("lang", "h").distinct().withColumn("nth", nth).where(F.col("nth") <= each).select(F.col("lang").alias("p_lang"), F.col("h").alias("p_h"))
    # at most fit_rows pairs
    found = rows.join(F.broadcast(picked), (F.col("lang") == F.col("p_lang")) & (F.col("h") == F.col("p_h")))
    return found.groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text")


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", bits: int = BITS, fit_rows: int = FIT_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the matrix of log-probabilities (buckets, languages) with the log-prior in an added last row.

    The n-grams of the sample are counted in one task, batch by batch; the driver gets the counts alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        n: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = counts.setdefault(lang, np.zeros(1 << bits, np.int64))
                for col, _ in grams([text], bits):
                    own += np.bincount(col, minlength=1 << bits)
                n[lang] = n.get(lang, 0) + 1
        for lang in counts:
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([n[lang]], pa.int64()), pa.array([counts[lang].tobytes()], pa.binary())], ["lang", "n", "counts"])

    rows = sorted(sample(docs, text_col, lang_col, fit_rows).repartition(1).mapInArrow(run, "lang string, n long, counts binary").collect())
    if not rows:
        return [], np.zeros(((1 << bits) + 1, 1))
    p = np.stack([np.frombuffer(r.counts, np.int64) for r in rows], 1) + ALPHA
    prior = np.array([r.n + 1 for r in rows], float)
    return [r.lang for r in rows], np.vstack([np.log(p / p.sum(0)), np.log(prior / prior.sum())])


def score(texts: list[str | None], matrix: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language's index, margin to the second (mean log-odds an n-gram) and whether a text could be scored."""
    total = np.tile(matrix[-1], (len(texts), 1))
    n = np.zeros(len(texts), np.int64)
    for col, size in grams([t or "" for t in texts], bits):
        for k in range(matrix.shape[1]):
            total[:, k] += sums(matrix[:-1, k][col], size)
        n += size
    best = total.argmax(1)
    top = total[np.arange(len(texts)), best]
    total[np.arange(len(texts)), best] = -np.inf
    second = total.max(1)
    margin = np.where(np.isfinite(second), top - second, 0) / np.maximum(n, 1)
    return best, margin, n > 0


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text", bits: int = BITS) -> DataFrame:
    """(doc_id, predicted, margin) of every row."""
    langs, matrix = model
    sent = docs.sparkSession.sparkContext.broadcast((np.array(langs, object), matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, m = sent.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, j in steps(texts):
                if len(names):
                    best, margin, ok = score(texts[i:j], m, bits)
                    name = np.where(ok, names[best], None)
                else:
                    margin, ok = np.zeros(j - i), np.zeros(j - i, bool)
                    name = np.full(j - i, None)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(name.tolist(), pa.string()), pa.array(margin, mask=~ok)], ["doc_id", "predicted", "margin"])

    kind = docs.schema[id_col].dataType.simpleString()
    return only(docs, doc_id=id_col, text=text_col).mapInArrow(run, f"doc_id {kind}, predicted string, margin double")
