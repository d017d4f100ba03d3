"""Token counts: byte-level BPE in Arrow functions that return lengths only.

Pieces of texts are encoded in batches of about BATCH_BYTES that are balanced by bytes; a text of over PIECE_CHARS is split where the
tokenizer's own pattern always splits, so counts are exact: before a single space between two characters that are no white space,
since every match of the pattern takes at most one leading space and no match runs from other characters into a space.
A text without such a place stays whole.

A null text has a null count, an empty one 0; an empty table gives no rows. Whole texts are counted, however long. Rows are independent:
repeated rows give repeated results, a null doc_id is carried along. Special tokens' strings in a text are ordinary text. Other columns of
the input are not read.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from .util import only, steps

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BATCH_BYTES, PIECE_CHARS = 1 << 19, 1 << 16
#: Batches that are made from one stretch of rows, and threads that encode them; a task has one core.
STEP_BATCHES, THREADS = 8, 1
_SAFE = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(2)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, most: int = PIECE_CHARS) -> list[str]:
    """The text, split at safe places into pieces of about `most` characters."""
    out, at = [], 0
    while len(text) - at > most:
        m = _SAFE.search(text, at + most)
        if not m:
            break
        out.append(text[at : m.start()])
        at = m.start()
    out.append(text[at:])
    return out


def batches_of(sizes: list[int], most: int = BATCH_BYTES) -> list[list[int]]:
    """Numbers of the pieces in batches of about `most` bytes each: no more than needed, filled evenly, the largest piece first.

    A batch has more bytes only if a piece alone has."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    out: list[list[int]] = [[] for _ in range(max(1, -(-sum(sizes) // most)))]
    heap = [(0, k) for k in range(len(out))]
    for i in order:
        n, k = heapq.heappop(heap)
        out[k].append(i)
        heapq.heappush(heap, (n + sizes[i], k))
    return [b for b in out if b]


def encode_batch(batch: list[str], enc: tiktoken.Encoding) -> list[int]:
    """Lengths of the texts of one batch; the ids never become Python objects."""
    return [len(enc.encode_to_numpy(t, disallowed_special=())) for t in batch]


def count(texts: list[str | None], enc: tiktoken.Encoding, most: int = PIECE_CHARS, batch_bytes: int = BATCH_BYTES, threads: int = THREADS) -> list[int | None]:
    """Tokens of each text: its pieces' lengths added up, batches of pieces encoded by `threads` at a time."""
    cut = [(i, p) for i, t in enumerate(texts) if t for p in (pieces(t, most) if len(t) > most else (t,))]
    groups = batches_of([len(p.encode("utf-8", "surrogatepass")) for _, p in cut], batch_bytes)
    with ThreadPoolExecutor(threads) as pool:
        found = list(pool.map(lambda g: encode_batch([cut[k][1] for k in g], enc), groups)) if len(groups) > 1 and threads > 1 else [encode_batch([cut[k][1] for k in g], enc) for g in groups]
    out: list[int | None] = [None if t is None else 0 for t in texts]
    for g, sizes in zip(groups, found):
        for k, n in zip(g, sizes):
            out[cut[k][0]] += n
    return out


def count_tokens(docs: DataFrame, ranks: str = RANKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, j in steps(texts, STEP_BATCHES * BATCH_BYTES):
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(count(texts[i:j], enc), pa.int64())], ["doc_id", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return only(docs, doc_id=id_col, text=text_col).mapInArrow(run, f"doc_id {kind}, n_tokens long")
