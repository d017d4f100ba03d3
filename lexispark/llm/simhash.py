"""SimHash near-duplicate removal by bit-sliced comparison.

A signature has BITS bits: the majority, over a text's distinct words and distinct word pairs, of each bit of their
hashes. Rows of equal signature are one node. Candidates are found in tables, each keyed by BAND (for over 2**24 signatures
more) sampled bits of the signature. The rows of one key are compared bit-sliced: each bit of
the signatures is a plane with one lane a row; planes are combined by XOR, added up by carry-save
counters, and a block of lanes is abandoned once every lane's count exceeds RADIUS. The rows of many keys share
planes and blocks, so that no step is made for one key or pair alone, but in keys of BLOCK_FROM rows or more. Pairs that could only connect what is
connected already are left out, in keys of more than 64 rows. Groups are the connected components of the pairs within RADIUS.

Search is approximate, with no cap on candidates: a pair at a distance of RADIUS meets in one of the tables with RECALL, whatever the
key's width, which the number of tables follows; nearer pairs meet with more (d = 24: 0.99), and a group is whole as soon as its pairs connect it.
Tasks hold a bounded number of rows; a key with more is compared in blocks, two by two.

A null text, or one without letters or digits, has no signature and is in no group. A null doc_id is in no
group either: such rows are kept. Repeated rows (equal doc_id) are one node; the first by text stays. Of a group the
smallest doc_id stays. An empty table gives no groups. Whole texts are read: some 60 bytes a character are held meanwhile. Other columns
are not read, or in deduplicate() passed through untouched.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import compared, free, mix, only, ragged, remove, runs, steps, stored, stored_at, sums, words

BITS, RADIUS, BAND, RECALL, SEED = 128, 28, 16, 0.93, 20240229
#: Rows of a key from which they are compared by spanning(), and its rows at a time.
BLOCK_FROM, QUERIES = 2048, 64
#: Words of 64 lanes that are compared at a time, and pairs that are held before they are joined.
WORDS, PAIRS = 1 << 13, 1 << 17
#: Ids of dropped rows that may be broadcast; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 1 << 22

_SQUARES = [(j, np.uint64(sum(1 << b for b in range(64) if not b & j))) for j in (32, 16, 8, 4, 2, 1)]
_SPREAD = np.array([[b >> (7 - i) & 1 for i in range(8)] for b in range(256)], np.uint8).view("<u8").ravel()


def signatures(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Signatures as (n, BITS // 64) words of 64 bits, and which texts have one."""
    _, _, _, h, doc = words(texts)
    out, good = np.zeros((len(texts), BITS // 64), np.uint64), np.zeros(len(texts), bool)
    if not len(h):
        return out, good
    pair = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[doc[:-1] == doc[1:]]
    f = np.concatenate([h, pair])
    row = np.concatenate([doc, doc[:-1][doc[:-1] == doc[1:]]]).astype(np.uint64)
    # distinct features of each text: its number in the upper bits, then 44 bits of the feature's hash
    key = np.sort(row << np.uint64(44) | f >> np.uint64(20))
    key = key[np.diff(key, prepend=key[0] ^ np.uint64(1)) != 0]
    row = (key >> np.uint64(44)).astype(np.int64)
    n = np.bincount(row, minlength=len(texts))
    good = n > 0
    low = key & np.uint64((1 << 44) - 1)
    counts = np.empty((len(texts), BITS), np.int64)
    size = runs_of(n, 255)
    for w in range(BITS // 64):
        b = mix(low + np.uint64((w + 1) << 44)).view(np.uint8).reshape(-1, 8)
        for k in range(8):
            part = sums(_SPREAD[b[:, k]], size).view(np.uint8).reshape(-1, 8)  # eight counters of a byte each
            counts[:, w * 64 + k * 8 : w * 64 + k * 8 + 8] = sums(part.astype(np.int64), -(-n // 255))
    bits = 2 * counts > n[:, None]
    return np.packbits(bits, axis=1).view("<u8").reshape(len(texts), -1), good


def runs_of(n: np.ndarray, most: int) -> np.ndarray:
    """Every n cut into runs of `most` and a rest."""
    parts = -(-n // most)
    out = np.full(int(parts.sum()), most, np.int64)
    last = np.cumsum(parts)[n > 0] - 1
    out[last] = (n[n > 0] - 1) % most + 1
    return out


def planes(sig: np.ndarray) -> np.ndarray:
    """(BITS, lanes / 64) words: plane b has bit b of every signature."""
    n = -(-len(sig) // 64)
    rows = np.zeros((n * 64, BITS // 64), np.uint64)
    rows[: len(sig)] = sig
    x = np.ascontiguousarray(rows.reshape(n, 64, BITS // 64).transpose(2, 1, 0))  # each 64 x 64 bits are turned by swaps of ever smaller squares
    for j, m in _SQUARES:
        low, high = x.reshape(BITS // (2 * j), 2, j, n).swapaxes(0, 1)
        t = ((low >> np.uint64(j)) ^ high) & m
        high ^= t
        low ^= t << np.uint64(j)
    return x.reshape(BITS // 8, 8, n)[:, ::-1].reshape(BITS, n)  # in a byte the upper bit first, as unpackbits has it


def within(xor, n_planes: int, radius: int) -> np.ndarray | None:
    """Lanes at most `radius` apart, as words; None if the block was abandoned. xor(b) gives the differences in plane b."""
    zero = np.zeros_like(xor(0))
    ones, twos, fours, eights = (zero.copy() for _ in range(4))
    high: list[np.ndarray] = []  # counters of 16, 32, ...

    def add(a, b, c):
        u = a ^ b
        return (a & b) | (u & c), u ^ c

    for at in range(0, n_planes, 16):
        carry: list[np.ndarray] = []
        for i in range(at, at + 16, 8):
            two = []
            for j in range(i, i + 8, 2):
                t, ones = add(ones, xor(j), xor(j + 1))
                two.append(t)
            f1, twos = add(twos, two[0], two[1])
            f2, twos = add(twos, two[2], two[3])
            e, fours = add(fours, f1, f2)
            carry.append(e)
        c, eights = add(eights, carry[0], carry[1])
        for k in range(len(high)):
            high[k], c = high[k] ^ c, high[k] & c
        high.append(c)
        over = exceeds([ones, twos, fours, eights, *high], radius)
        if (over == ~zero).all():
            return None
    return ~over


def exceeds(digits: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose binary count is more than radius."""
    over, same = np.zeros_like(digits[0]), ~np.zeros_like(digits[0])
    for k in range(max(len(digits), radius.bit_length()) - 1, -1, -1):
        d = digits[k] if k < len(digits) else np.zeros_like(over)
        if radius >> k & 1:
            same = same & d
        else:
            over = over | (same & d)
            same = same & ~d
    return over


def lanes(mask: np.ndarray) -> np.ndarray:
    """Numbers of the set lanes, along the last axis as (..., lane)."""
    return np.unpackbits(np.ascontiguousarray(mask).view(np.uint8), axis=-1, bitorder="little")


def placed(size: np.ndarray) -> tuple[np.ndarray, int]:
    """The first lane of each run, and the number of words: the longest runs first, those of up to 64 rows within one word, longer ones from
    the start of a word."""
    order = np.argsort(-size, kind="stable")
    s = size[order]
    per, need = np.maximum(64 // s, 1), -(-s // 64)
    edge = runs(s)
    group = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
    i = np.arange(len(s)) - edge[group]
    ends = np.cumsum(-(-np.diff(edge) // per[edge[:-1]]) * need[edge[:-1]])
    first = np.empty(len(s), np.int64)
    first[order] = (np.concatenate([[0], ends])[group] + i // per * need) * 64 + i % per * s
    return first, int(ends[-1]) if len(ends) else 0


def near_blocks(sig: np.ndarray, start: np.ndarray, size: np.ndarray, radius: int, root: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of row numbers at most radius apart, both in one of the runs start[i] .. start[i] + size[i], some at a time.

    Planes are made once for all runs. Within a word a plane is compared with itself shifted, WORDS of all runs and offsets at a time; of a run of
    more than a word, every two words are. With root, which who takes the pairs keeps, words whose rows are one component already are left out."""
    start, size = start[size > 1], size[size > 1]
    first, n = placed(size)
    lane = ragged(first, size)
    row, run = np.full((2, n * 64), -1)
    row[lane], run[lane] = ragged(start, size), np.repeat(np.arange(len(size)), size)
    p, used = np.zeros((BITS, n), np.uint64), np.packbits(row >= 0, bitorder="little").view("<u8")
    for w in range(0, n, 1 << 9):
        own = row[w * 64 : (w + (1 << 9)) * 64]
        p[:, w : w + (1 << 9)] = planes(sig[own])

    def pairs(hit: np.ndarray, left: Callable, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the set lanes of hit (k, words): of left(k, word, lane) and of lane `lane` of the word right[word]."""
        k, w = np.nonzero(hit)
        some, bit = np.nonzero(lanes(hit[k, w][:, None]))
        k, w = k[some], w[some]
        a, b = left(k, w, bit), right[w] * 64 + bit
        ok = run[a] == run[b]
        return row[a[ok]], row[b[ok]]

    # within words: a word's runs are as long as its first one or shorter, so at offset k only a prefix of the words is left
    width = np.zeros(n, np.int64)
    np.maximum.at(width, lane >> 6, np.repeat(np.minimum(size, 64), size))
    k = 1
    while k < 64 and (m := int((width > k).sum())):
        offsets = np.arange(k, min(64, k + max(1, WORDS // m)))
        by = offsets[:, None].astype(np.uint64)
        for w in range(0, m, WORDS):
            own, have = p[:, w : min(m, w + WORDS)], used[w : min(m, w + WORDS)]
            hit = within(lambda b, own=own, by=by: own[b] ^ (own[b] << by), BITS, radius)
            if hit is not None:
                yield pairs(hit & have & (have << by), lambda k, x, bit, w=w, offsets=offsets: (w + x) * 64 + bit - offsets[k], np.arange(w, w + own.shape[1]))
        k += len(offsets)
    # between the words of a run, near ones first
    words_of = -(-size // 64)
    words_of, at = words_of[words_of > 1], first[words_of > 1] >> 6
    if not len(words_of):
        return
    u = [ragged(at[words_of > d], words_of[words_of > d] - d) for d in range(1, int(words_of.max()))]
    v = np.concatenate([x + d for d, x in enumerate(u, 1)])
    u = np.concatenate(u)
    up = (63 - np.arange(64, dtype=np.uint64))[:, None]
    some, last = WORDS // 64, int(v.max()) + 1
    for i in range(0, len(u), some * 4):
        x, y = u[i : i + some * 4], v[i : i + some * 4]
        if root is not None:
            own = row[: last * 64].reshape(-1, 64)
            low, high = np.where(own < 0, len(root), root[own]).min(1), np.where(own < 0, -1, root[own]).max(1)
            open_ = (np.minimum(low[x], low[y]) != np.maximum(high[x], high[y])).nonzero()[0]
            x, y = x[open_], y[open_]
        for j in range(0, len(x), some):
            c, d = x[j : j + some], y[j : j + some]
            q, o = p[:, c], p[:, d]
            hit = within(lambda b, q=q, o=o: ((q[b] << up).view(np.int64) >> 63).view(np.uint64) ^ o[b], BITS, radius)
            if hit is not None:
                have = ((used[c] << up).view(np.int64) >> 63).view(np.uint64) & used[d]
                yield pairs(hit & have, lambda k, w, bit, c=c: c[w] * 64 + k, d)


def near_pairs(sig: np.ndarray, start: np.ndarray, size: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of row numbers at most radius apart, the smaller first, both in one of the runs start[i] .. start[i] + size[i]."""
    e = np.zeros(0, np.int64)
    left, right = zip((e, e), *near_blocks(sig, start, size, radius))
    return np.concatenate(left), np.concatenate(right)


def spanning(sig: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each row of one long run the first row that it is connected with by steps of at most radius.

    QUERIES rows at a time are compared with all; rows of the largest component found so far need no comparison with each other, so
    only the others go on as queries. So a dense group costs a few passes, and no pairs are kept."""
    m = len(sig)
    p, root, asked = planes(sig), np.arange(m), np.zeros(m, bool)
    while True:
        inside = np.bincount(root, minlength=m)
        waiting = np.flatnonzero(~asked & (root != inside.argmax())) if inside.max() > 1 else np.flatnonzero(~asked)
        if not len(waiting):
            return root
        own = waiting[:QUERIES]
        asked[own] = True
        mask = np.unpackbits(np.ascontiguousarray(sig[own]).view(np.uint8), axis=1).astype(np.uint64) * ~np.uint64(0)  # a query's bit in every lane
        left, right = [own], [own]
        for w in range(0, p.shape[1], 1 << 9):
            block = p[:, w : w + (1 << 9)]
            hit = within(lambda b, block=block, mask=mask: block[b][None, :] ^ mask[:, b, None], BITS, radius)
            if hit is None:
                continue
            x, y = np.nonzero(lanes(hit)[:, : m - w * 64].T)[::-1]  # by lane, so that a lane's first query comes first
            first = runs(y)[:-1]
            one = np.repeat(x[first], np.diff(np.append(first, len(y))))
            left += [own[x[first]], own[one]]
            right += [y[first] + w * 64, own[x]]
        pairs = np.unique(np.concatenate(left) * m + np.concatenate(right))
        root = forest(np.concatenate([pairs // m, np.arange(m)]), np.concatenate([pairs % m, root]), m)


def links(sig: np.ndarray, edge: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each row the first row of its run edge[i] .. edge[i + 1] that it is connected with by steps of at most radius."""
    size, root = np.diff(edge), np.arange(len(sig))
    short = (size > 1) & (size < BLOCK_FROM)
    left, right, held = [], [], 0

    def join() -> None:
        nonlocal held
        root[:] = forest(np.concatenate([np.arange(len(sig)), *left]), np.concatenate([root, *right]), len(sig))
        left.clear(), right.clear()
        held = 0

    for i, j in near_blocks(sig, edge[:-1][short], size[short], radius, root):
        left.append(i)
        right.append(j)
        held += len(i)
        if held > PAIRS:
            join()
    join()
    for g in np.flatnonzero(size >= BLOCK_FROM):
        root[edge[g] : edge[g + 1]] = edge[g] + spanning(sig[edge[g] : edge[g + 1]], radius)
    return root


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the smallest node that the edges connect it with."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        use = low != high
        if not use.any():
            return root
        i, j = i[use], j[use]
        np.minimum.at(root, high[use], low[use])
        while not np.array_equal(up := root[root], root):
            root = up
    return root


def sign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, hi, lo) of the rows that have a doc_id and a signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, j in steps(texts):
                sig, good = signatures(texts[i:j])
                sig = sig.view(np.int64)
                keep = pa.array(good)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j].filter(keep), pa.array(sig[good, 0]), pa.array(sig[good, 1])], ["doc_id", "hi", "lo"])

    kind = docs.schema[id_col].dataType.simpleString()
    return only(docs, doc_id=id_col, text=text_col).where("doc_id is not null and text is not null").mapInArrow(run, f"doc_id {kind}, hi long, lo long")


def tables_for(band: int, radius: int = RADIUS) -> int:
    """Tables with which a pair at a distance of radius is met with RECALL; a nearer one is met with more."""
    same = np.prod([(BITS - radius - i) / (BITS - i) for i in range(band)])
    return math.ceil(math.log(1 - RECALL) / math.log1p(-same))


def band_for(n: int) -> int:
    """Bits of a key: more for more signatures, so that the rows of one key stay some hundreds at most but for copies."""
    return BAND + max(0, math.ceil(math.log2(max(n, 1))) - 24)


def samples(band: int = BAND, tables: int | None = None) -> np.ndarray:
    """The bits that each table's key is made of, disjoint within a permutation."""
    tables = tables or tables_for(band)
    rng, each = np.random.default_rng(SEED), BITS // band
    return np.concatenate([rng.permutation(BITS)[: each * band].reshape(each, band) for _ in range(-(-tables // each))])[:tables]


def edges(nodes: DataFrame, radius: int = RADIUS, band: int = BAND) -> DataFrame:
    """(a, b), a < b: nodes (node, hi, lo) found within radius of each other, as a spanning forest of each table's key."""
    pick = samples(band, tables_for(band, radius))

    def fan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                sig = np.stack([part.column(k).to_numpy() for k in (0, 1)], 1)
                bits = np.unpackbits(sig.view(np.uint8), axis=1)
                weights = 1 << np.arange(band, dtype=np.int64)
                key = np.concatenate([(bits[:, p] @ weights) * len(pick) + t for t, p in enumerate(pick)])
                again = pa.array(np.tile(np.arange(len(sig)), len(pick)))
                yield pa.RecordBatch.from_arrays([pa.array(key), *[c.take(again) for c in part.columns]], ["key", "hi", "lo", "node"])

    def compare(whole: pa.Table) -> pa.Table:
        node = whole.column("node").to_numpy()
        sig = np.stack([whole.column(k).to_numpy() for k in ("hi", "lo")], 1).view(np.uint64)
        root = links(sig, runs(whole.column("key").to_numpy()), radius)
        at = np.flatnonzero(root != np.arange(len(node)))
        return pa.Table.from_pydict({"a": pa.array(node[root[at]], whole.column("node").type), "b": pa.array(node[at], whole.column("node").type)})

    kind = nodes.schema["node"].dataType.simpleString()
    fanned = nodes.select("hi", "lo", "node").mapInArrow(fan, f"key long, hi long, lo long, node {kind}")
    return compared(fanned, compare, f"a {kind}, b {kind}").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge: root is the smallest node of its component.

    Alternating large-star and small-star steps until nothing changes; each step's edges are stored in the shared
    folder, so a lost executor costs no more than one step."""
    spark = pairs.sparkSession
    e, path = stored_at(pairs.where("a <> b"), "edges")
    before = None
    while True:
        # large star: link larger neighbours to the least of the neighbourhood
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # small star: link a node and its smaller neighbours to the least of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("x"), F.col("a").alias("y")).unionByName(least.select(F.col("m").alias("x"), F.col("b").alias("y")))
        e, new = stored_at(small.where("x <> y").distinct().select(F.col("x").alias("a"), F.col("y").alias("b")), "edges")
        remove(spark, path)
        path = new
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("a"), F.count_distinct("b")).first())
        if now == before:
            return e.select(F.col("b").alias("node"), F.col("a").alias("root")).distinct()
        before = now


def groups(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, root) of every doc_id that is in a group of two or more; root is the doc_id that stays."""
    signed = stored(sign(docs, id_col, text_col), "signatures").dropDuplicates(["doc_id", "hi", "lo"])
    node = signed.groupBy("hi", "lo").agg(F.min("doc_id").alias("node"))
    node = stored(node, "nodes")
    # of a doc_id that has several texts every signature counts; its node links them
    same = signed.join(node, ["hi", "lo"]).where("doc_id <> node").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    found = components(edges(node, radius, band_for(node.count())).unionByName(same))
    return found.select(F.col("node").alias("doc_id"), "root").unionByName(found.select(F.col("root").alias("doc_id"), "root").distinct())


def deduplicate(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows of a group other than its smallest doc_id, and without repeated rows of a doc_id that has a text."""
    found = stored(groups(docs, radius, id_col, text_col), "groups")
    mark = free(docs, "marked")
    gone = found.where("doc_id <> root").select(F.col("doc_id").alias(mark)).distinct()
    n = gone.count()
    side = F.broadcast(gone) if n <= BROADCAST_ROWS else gone
    kept = docs.join(side, docs[id_col] == F.col(mark), "left_anti")
    again = only(docs, doc_id=id_col).where("doc_id is not null").groupBy(F.col("doc_id").alias(mark)).agg(F.count("*").alias("n")).where("n > 1").select(mark)
    again = stored(again, "repeated")
    if (m := again.count()) == 0:
        return kept
    side = F.broadcast(again) if m <= BROADCAST_ROWS else again
    once = kept.join(side, kept[id_col] == F.col(mark), "left_anti")
    several = kept.join(side, kept[id_col] == F.col(mark), "left_semi")
    return once.unionByName(first_of(several, id_col, text_col))


def first_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each id: the first by text (nulls last)."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.groupBy("id").agg(F.min_by("row", F.struct(F.col("text").isNull(), F.col("text"))).alias("row")).select("row.*")
