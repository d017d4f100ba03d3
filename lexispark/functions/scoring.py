"""Scores as Column expressions, and the quantised field lengths of one-byte norms."""

from __future__ import annotations

import struct
from bisect import bisect_right
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: The norm of a document that lacks the field.
NO_NORM = 255


class Similarity(Enum):
    BM25 = "bm25"
    TFIDF = "tfidf"

    @classmethod
    def parse(cls, name: str | None) -> Similarity:
        """BM25 without a name; a ValueError for an unknown one."""
        return cls.BM25 if name is None else cls(name)


def idf(similarity: Similarity, total_docs: Column, doc_freq: Column) -> Column:
    if similarity is Similarity.TFIDF:
        return 1 + F.log(total_docs / (doc_freq + 1))
    return F.greatest(F.lit(0.0), F.log(1 + (total_docs - doc_freq + 0.5) / (doc_freq + 0.5)))


def score(similarity: Similarity, tf: Column, field_len: Column, avg_len: Column, idf_: Column) -> Column:
    length = F.greatest(field_len, F.lit(1)).cast("double")
    if similarity is Similarity.TFIDF:
        return F.sqrt(tf.cast("double")) * idf_ * idf_ / F.sqrt(length)
    mean = F.when(avg_len <= 0, F.lit(1.0)).otherwise(avg_len)
    return F.when(tf == 0, F.lit(0.0)).otherwise(idf_ * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * length / mean)))


def _single(x: float) -> float:
    return struct.unpack("<f", struct.pack("<f", x))[0]


def decode_norm(byte: int) -> float:
    """A byte is a float with a three-bit mantissa and an exponent biased by 15."""
    return struct.unpack("<f", struct.pack("<i", (byte << 21) + (48 << 24)))[0] if byte else 0.0


_NORMS = [decode_norm(b) for b in range(256)]


def encode_norm(norm: float) -> int:
    """The byte whose value is nearest, the smaller of two equally near ones."""
    if norm <= 0:
        return 0
    at = bisect_right(_NORMS, norm) - 1
    up = at < NO_NORM and _single(norm - _NORMS[at]) > _single(_NORMS[at + 1] - norm)
    return at + up


def norm_of(tokens: int, boost: float = 1.0) -> int:
    """The byte for a field of so many tokens; NO_NORM for none."""
    return NO_NORM if tokens <= 0 else encode_norm(_single(_single(1 / _single(tokens**0.5)) * boost))


def length_of(byte: int) -> int:
    """The length that a reader takes a norm for."""
    norm = decode_norm(byte)
    return max(1, int(1 / (norm * norm) + 0.5)) if norm else 1


def norm_steps(boost: float = 1.0, most: int = 1 << 31) -> list[tuple[int, int]]:
    """(least number of tokens, byte), the byte falling as tokens rise."""
    out, n = [(1, norm_of(1, boost))], 1
    while True:
        low, high = n, most
        if norm_of(high, boost) == out[-1][1]:
            return out
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if norm_of(mid, boost) == out[-1][1] else (low, mid)
        n = high
        out.append((n, norm_of(n, boost)))


def _case(tokens: Column, steps: list[tuple[int, int]], none: int) -> Column:
    out = None
    for least, value in reversed(steps):
        out = F.when(tokens >= least, value) if out is None else out.when(tokens >= least, value)
    return out.otherwise(F.lit(none)).cast("int")


def norm_byte(tokens: Column, boost: float = 1.0) -> Column:
    return _case(tokens, norm_steps(boost), NO_NORM)


def quantized_length(tokens: Column, boost: float = 1.0) -> Column:
    return _case(tokens, [(n, length_of(b)) for n, b in norm_steps(boost)], 1)


def quantized_length_sql(tokens: str, boost: float = 1.0) -> str:
    """The same steps as an SQL CASE."""
    return "CASE " + " ".join(f"WHEN {tokens} >= {n} THEN {length_of(b)}" for n, b in reversed(norm_steps(boost))) + " ELSE 1 END"
