"""Best-two-fit packing of documents into bins of fixed capacity.

Documents are spread over shards by a hash; each shard is packed by itself. A bin is filled greedily, always
with the longest document that fits. Then its smallest document is exchanged for two unpacked ones
if they fill the gap that opens more tightly. Longer documents are cut into pieces of the bin's capacity, and the
rest of each, if any, is packed like a document.

A length is the UTF-8 bytes of a text plus one separator, which is what a byte-level model sees. A null or
empty text has length 0, needs no room and goes into no bin. Ties go to the smaller doc_id, then piece; null doc_ids
come first. Repeated rows are packed as often as they occur, spread over the shards. An empty table gives no bins. Texts of any length
count whole. Other columns of the input are not read, and only ids and lengths are shuffled.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import only

CAPACITY, SHARD_ROWS = 32768, 16384


def pack(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of indices; lengths are 1..capacity, earlier indices win ties."""
    by: dict[int, deque[int]] = {}
    for i, n in enumerate(lengths):
        by.setdefault(n, deque()).append(i)
    open_ = sorted(by)  # lengths that are still unpacked
    left = len(lengths)

    def take(n: int) -> int:
        nonlocal left
        q = by[n]
        i = q.popleft()
        if not q:
            del open_[bisect_right(open_, n) - 1]
        left -= 1
        return i

    def put(n: int, i: int) -> None:
        nonlocal left
        q = by[n]
        if not q:
            open_.insert(bisect_right(open_, n), n)
        q.appendleft(i)
        left += 1

    bins = []
    while left:
        bin_, gap = [], capacity
        while open_ and (k := bisect_right(open_, gap)):
            n = open_[k - 1]
            bin_.append(take(n))
            gap -= n
        if gap and left > 1:
            small = lengths[bin_[-1]]
            pair = best_pair(open_, by, small, small + gap)
            if pair:
                i = bin_.pop()
                bin_ += [take(pair[0]), take(pair[1])]
                put(small, i)
        bins.append(bin_)
    return bins


def best_pair(open_: list[int], by: dict[int, deque[int]], above: int, gap: int) -> tuple[int, int] | None:
    """Two unpacked lengths, the larger first, of the greatest sum that is over `above` and at most `gap`;
    among equal sums the pair with the longest document."""
    a = np.array(open_[: bisect_right(open_, gap - open_[0])] if open_ else [], np.int64)
    if not len(a):
        return None
    k = np.searchsorted(a, gap - a, "right") - 1  # the longest partner of each
    k = np.minimum(k, np.arange(len(a)))  # as the smaller of the two
    once = np.flatnonzero(k == np.arange(len(a)))
    k[once] -= np.fromiter((len(by[x]) < 2 for x in a[once].tolist()), np.int64, len(once))
    total = np.where(k >= 0, a + a[np.maximum(k, 0)], -1)
    j = len(total) - 1 - int(np.argmax(total[::-1]))
    return (int(a[j]), int(a[k[j]])) if total[j] > above else None


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a bin: shard, bin, doc_ids, pieces (0 for a document's first part) and lengths in order, and used."""
    if capacity < 1 or shard_rows < 1:
        raise ValueError("capacity and shard_rows are at least 1")
    rows = only(docs, doc_id=id_col, text=text_col).select("doc_id", F.when(F.octet_length("text") > 0, F.octet_length("text").cast("long") + 1).otherwise(F.lit(0).cast("long")).alias("n"))
    shards = max(1, -(-docs.count() // shard_rows))
    # equal rows are numbered by counting them, so that they spread over the shards like others
    rows = rows.where("n > 0").groupBy("doc_id", "n").agg(F.count("*").alias("times")).select("doc_id", "n", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("nth"))
    rows = rows.select(F.pmod(F.xxhash64("doc_id", "n", "nth"), F.lit(shards)).cast("int").alias("shard"), "doc_id", "n").repartition(shards, "shard")

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "n"], na_position="first", kind="stable")
        ids = [None if pd.isna(x) else int(x) for x in part["doc_id"]]
        n = part["n"].to_numpy(np.int64)
        full, rest = n // capacity, n % capacity
        out = [([ids[i]], [p], [capacity]) for i in np.flatnonzero(full) for p in range(full[i])]
        loose = np.flatnonzero(rest)
        for b in pack(rest[loose].tolist(), capacity):
            own = loose[b]
            out.append(([ids[i] for i in own], full[own].tolist(), rest[own].tolist()))
        return pd.DataFrame({"shard": key[0], "bin": np.arange(len(out), dtype=np.int32), "doc_ids": [x[0] for x in out], "pieces": [x[1] for x in out], "lengths": [x[2] for x in out], "used": np.array([sum(x[2]) for x in out], np.int64)})

    return rows.groupBy("shard").applyInPandas(run, "shard int, bin int, doc_ids array<long>, pieces array<int>, lengths array<long>, used long")
