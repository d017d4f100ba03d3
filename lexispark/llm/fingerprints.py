"""Document fingerprints: a digest of bucket quartiles, and a bounded difference score between digests.

Three salted byte triplets of every window of four UTF-8 bytes are hashed into 128 buckets. The digest
holds, as 70 hexadecimal digits: a checksum, a logarithmic length code, two quartile ratios, and for
each bucket the quartile (2 bits) that its count falls in.

Nulls and texts of under MIN_BYTES bytes, or whose third quartile is 0 (too little variety), have a null
digest, and then null twin, near, item and scores. Rows are independent: equal texts have equal digests, repeated
rows give repeated results, a null doc_id is carried along. Whole texts are hashed, STEP_CHARS windows at a time; an empty table gives no
rows, without references item_id and score are null. Other columns of the input are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import STEP_CHARS, compared, mix, only, powers, runs, shared_dir, steps, stored

BUCKETS, MIN_BYTES, BOUND = 128, 50, 500
SIZE = 3 + BUCKETS // 4
#: Difference up to which digests of documents count as near; of near copies by SimHash in sf0.1 90 % lie within 32.
#: Their search has tables keyed by BAND or more of the 3 * BUCKETS bits of a digest's quartiles in unary and by ranges of LENGTHS length codes.
NEAR, BAND, LENGTHS, RECALL, SEED = 30, 32, 10, 0.92, 20240301
#: Digests that are compared with as many at once, and rows that a task holds while it goes through the references.
BLOCK, HELD = 512, 1 << 16

_CODES = np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3
_STEP = np.abs(_CODES[:, None, :] - _CODES[None, :, :])
#: Difference of two body bytes: a bucket that is one or two quartiles off costs as much, one that is three off costs 6.
_BODY = np.where(_STEP == 3, 6, _STEP).sum(2).astype(np.int16)


def digests(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digest bytes (n, SIZE), which rows have a digest, and lengths in bytes. Windows are hashed STEP_CHARS at a time, whatever a text's length."""
    raw = [t.encode("utf-8", "replace") if t else b"" for t in texts]
    n = np.fromiter(map(len, raw), np.int64, len(raw))
    out, good = np.zeros((len(raw), SIZE), np.uint8), n >= MIN_BYTES
    if not good.any():
        return out, good, n
    use = np.flatnonzero(good)
    joined = np.frombuffer(b"".join([raw[i] for i in use]), np.uint8)
    size = n[use]
    ends = np.cumsum(size)
    counts, check = np.zeros(len(use) * BUCKETS, np.int64), np.zeros(len(use), np.int64)
    for low in range(0, len(joined) - 3, STEP_CHARS):
        b = joined[low : low + STEP_CHARS + 3].astype(np.uint32)
        place = np.arange(low, low + len(b) - 3)
        own = np.searchsorted(ends, place, "right")
        at = np.flatnonzero(place + 3 < ends[own])  # windows that lie in one text
        own = own[at]
        w = [b[at + k] for k in range(4)]
        for salt, (i, j, k) in ((3, (0, 1, 2)), (11, (0, 1, 3)), (23, (0, 2, 3))):
            h = (w[i] * np.uint32(65599) + w[j]) * np.uint32(65599) + w[k] + np.uint32(salt * 7919)
            h = h * np.uint32(2654435761) >> np.uint32(25)
            first, last = own[0] * BUCKETS, (own[-1] + 1) * BUCKETS
            counts[first:last] += np.bincount(own * BUCKETS - first + h, minlength=last - first)
        check[own[0] : own[-1] + 1] += np.bincount(own - own[0], mixed(w[0], w[1])).astype(np.int64)
    counts = counts.reshape(-1, BUCKETS)
    ranked = np.sort(counts, 1)
    q1, q2, q3 = (ranked[:, k * BUCKETS // 4 - 1 : k * BUCKETS // 4] for k in (1, 2, 3))
    quarter = ((counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)).reshape(len(use), -1, 4)
    q = np.maximum(q3[:, 0], 1)
    d = np.empty((len(use), SIZE), np.uint8)
    d[:, 0] = check & 255
    d[:, 1] = np.minimum(8 * np.log2(size), 255)
    d[:, 2] = q1[:, 0] * 15 // q << 4 | q2[:, 0] * 15 // q
    d[:, 3:] = (quarter << np.array([0, 2, 4, 6], np.uint8)).sum(2)
    out[use] = d
    good[use] = q3[:, 0] > 0
    return out, good, n


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a * np.uint32(31) + b) * np.uint32(2246822519) >> np.uint32(24)).astype(np.int64)


def differences(a: np.ndarray, b: np.ndarray, bound: int = BOUND) -> np.ndarray:
    """Score of each digest of a (n, SIZE) against the one digest b, or each against its own of b (n, SIZE): 0 for equal ones, at most `bound`."""
    x, y = a.astype(np.int32), np.atleast_2d(b).astype(np.int32)
    length = np.abs(x[:, 1] - y[:, 1])
    ratio = np.abs(np.stack([x[:, 2] >> 4, x[:, 2] & 15]) - np.stack([y[:, 2] >> 4, y[:, 2] & 15]))
    head = (x[:, 0] != y[:, 0]).astype(np.int32) + np.where(length > 1, 4 * (length - 1), length)
    head += np.where(ratio > 1, 12 * (ratio - 1), ratio).sum(0)
    return np.minimum(head + _BODY[a[:, 3:], np.atleast_2d(b)[:, 3:]].sum(1, dtype=np.int32), bound)


def difference(a: str, b: str, bound: int = BOUND) -> int:
    """Score between two digests as text."""
    x, y = (np.frombuffer(bytes.fromhex(d), np.uint8) for d in (a, b))
    return int(differences(x[None], y, bound)[0])


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, n_bytes) of every row; n_bytes of a null text is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, j in steps(texts):
                d, good, n = digests(texts[i:j])
                hexed = [bytes(x).hex() if g else None for x, g in zip(d, good)]
                null = np.array([t is None for t in texts[i:j]])
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(hexed, pa.string()), pa.array(n, mask=null)], ["doc_id", "digest", "n_bytes"])

    kind = docs.schema[id_col].dataType.simpleString()
    return only(docs, doc_id=id_col, text=text_col).mapInArrow(run, f"doc_id {kind}, digest string, n_bytes long")


class Planes(NamedTuple):
    """Digests taken apart for comparison by words: the quartiles in unary, plane by plane, and the head's numbers."""

    over: np.ndarray  # (3, BUCKETS // 64, n): bit set where a bucket's quartile is over 0, 1, 2
    check: np.ndarray
    length: np.ndarray
    ratio: np.ndarray  # (2, n)


def planes(d: np.ndarray) -> Planes:
    codes = (d[:, 3:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3).reshape(len(d), -1)
    over = np.stack([np.packbits(codes > k, axis=1).view(np.uint64).T for k in range(3)])
    return Planes(np.ascontiguousarray(over), d[:, 0].copy(), d[:, 1].astype(np.int16), np.stack([d[:, 2] >> 4, d[:, 2] & 15]).astype(np.int16))


def table_of(a: Planes, b: Planes, bound: int = BOUND) -> np.ndarray:
    """(n, m) scores of all digests of a against all of b: differences(), by population counts."""
    body = np.zeros((a.check.size, b.check.size), np.int16)
    for w in range(BUCKETS // 64):
        for k in range(3):
            body += np.bitwise_count(a.over[k, w][:, None] ^ b.over[k, w])
        # a quartile of 3 against one of 0 counts three more
        for x, y in ((a, b), (b, a)):
            far = x.over[2, w][:, None] & ~y.over[0, w] if x is a else ~y.over[0, w][:, None] & x.over[2, w]
            body += 3 * np.bitwise_count(far).astype(np.int16)
    length = np.abs(a.length[:, None] - b.length)
    body += (a.check[:, None] != b.check) + np.where(length > 1, 4 * (length - 1), length)
    for k in range(2):
        ratio = np.abs(a.ratio[k][:, None] - b.ratio[k])
        body += np.where(ratio > 1, 12 * (ratio - 1), ratio)
    return np.minimum(body, bound)


def nearest(prints: DataFrame, references: DataFrame, bound: int = BOUND) -> DataFrame:
    """prints with the reference (item_id, digest) of least score, ties to the smallest item_id, and that score.

    Exact: every row is held against every reference, BLOCK rows by BLOCK references at a time. The references are a table in the shared folder, of
    which each task reads a part of a file at a time, so their number has no bound; rows pass as they come, and repeated ones stay."""
    refs = references.where("digest is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "digest").distinct()
    path = shared_dir(prints.sparkSession, "references")
    refs.write.parquet(path)
    names = prints.columns
    at = names.index("digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= HELD:  # the more rows are held, the less often the references are read
                yield from judged(held)
                held, n = [], 0
        if held:
            yield from judged(held)

    def judged(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hexed = [h for batch in held for h in batch.column(at).to_pylist()]
        have = np.array([h is not None for h in hexed], bool)
        a = np.frombuffer(bytes.fromhex("".join(h for h in hexed if h is not None)), np.uint8).reshape(-1, SIZE)
        score, item = np.full(len(a), 1 << 20, np.int64), np.zeros(len(a), np.int64)
        for part in ds.dataset(path, format="parquet").to_batches(columns=["item_id", "digest"], batch_size=1 << 14) if len(a) else ():
            order = np.argsort(part.column(0).to_numpy(), kind="stable")
            ids = part.column(0).to_numpy()[order]
            ref = np.frombuffer(bytes.fromhex("".join(part.column(1).to_pylist())), np.uint8).reshape(-1, SIZE)[order]
            for k in range(0, len(ids), BLOCK):
                b = planes(ref[k : k + BLOCK])
                for i in range(0, len(a), BLOCK):
                    t = table_of(planes(a[i : i + BLOCK]), b, bound)
                    who = t.argmin(1)  # the first, so the smallest item_id
                    least, own = t[np.arange(len(t)), who].astype(np.int64), ids[k + who]
                    rows = slice(i, i + BLOCK)
                    less = (least < score[rows]) | ((least == score[rows]) & (own < item[rows]))
                    score[rows][less], item[rows][less] = least[less], own[less]
        none = np.ones(len(hexed), bool)
        none[have] = score == 1 << 20
        items, scores = np.zeros(len(hexed), np.int64), np.zeros(len(hexed), np.int64)
        items[have], scores[have] = item, score
        first = 0
        for batch in held:
            own = slice(first, first + batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(items[own], mask=none[own]), pa.array(scores[own].astype(np.int32), mask=none[own])], [*names, "item_id", "score"])
            first += batch.num_rows

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prints.schema) + ", item_id long, score int"
    return prints.mapInArrow(run, schema)


def twins(prints: DataFrame) -> DataFrame:
    """prints with twin: the smallest doc_id among the rows of equal digest."""
    least = prints.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("twin"))
    return prints.join(least, "digest", "left").select(*prints.columns, "twin")


def unary(d: np.ndarray) -> np.ndarray:
    """(n, 3 * BUCKETS) bits: quartile k of a bucket as k ones. Digests differ in no more bits than their difference."""
    codes = (d[:, 3:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3).reshape(len(d), -1)
    return np.concatenate([codes > k for k in range(3)], axis=1).astype(np.uint8)


def tables_for(band: int, radius: int = NEAR) -> int:
    """Tables with which a pair at a difference of `radius` is met with RECALL, wherever its difference lies: all of it in the quartiles, or a
    part of it in the lengths, which have to fall into one of the table's ranges as well."""
    least = 1.0
    for apart in range(LENGTHS):
        body = radius - (apart if apart < 2 else 4 * (apart - 1))
        if body >= 0:
            same = np.prod([(3 * BUCKETS - body - i) / (3 * BUCKETS - i) for i in range(band)])
            least = min(least, same * (1 - apart / LENGTHS))
    return math.ceil(math.log(1 - RECALL) / math.log1p(-least))


def band_for(n: int) -> int:
    """Bits of a key: more for more digests, so that the rows of one key stay about as few."""
    return BAND + 4 * max(0, math.ceil(math.log2(max(n, 1))) - 22)


def samples(band: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """The unary bits that each table's key is made of, disjoint within a permutation, and where its ranges of lengths begin."""
    rng, each = np.random.default_rng(SEED), 3 * BUCKETS // band
    bits = np.concatenate([rng.permutation(3 * BUCKETS)[: each * band].reshape(each, band) for _ in range(-(-tables // each))])[:tables]
    return bits, rng.integers(0, LENGTHS, tables)


def nearest_in_runs(d: np.ndarray, start: np.ndarray, size: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each digest the least difference to the others of its run start[i] .. start[i] + size[i], and the first row that has it.

    All pairs of a run are compared; a difference of more than radius may be missed. Memory follows the rows, not the pairs."""
    bits = np.concatenate([np.packbits(unary(d[i : i + 16384]), axis=1).view(np.uint64) for i in range(0, len(d), 16384)]).T.copy()
    best = np.full(len(d), 1 << 60, np.int64)  # score and row in one number
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    for k in range(1, int(size[0])):
        # longest runs first: at offset k only those of over k rows are left, a prefix
        n = size[: np.searchsorted(-size, -k, "left")] - k
        total = np.cumsum(n)
        at = 0
        while at < len(n):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + (1 << 15), "right")))
            m = n[at:to]
            i = np.repeat(start[at:to] - np.cumsum(m) + m, m) + np.arange(int(m.sum()))
            apart = np.zeros(len(i), np.int16)
            for w in range(len(bits)):
                apart += np.bitwise_count(bits[w, i] ^ bits[w, i + k])
                if w & 1:  # most are too far apart by then
                    near = apart <= radius
                    i, apart = i[near], apart[near]
            score = differences(d[i], d[i + k]).astype(np.int64) << 40
            best[i] = np.minimum(best[i], score | i + k)
            best[i + k] = np.minimum(best[i + k], score | i)
            at = to
    return best >> 40, best & (1 << 40) - 1


def near_copies(prints: DataFrame, radius: int = NEAR, band: int | None = None) -> DataFrame:
    """prints with near, the doc_id of least difference, at most radius, among the rows of another digest, ties to the smallest doc_id, and near_score.

    Candidates are the digests that agree in a table's key, which is sampled bits of the quartiles and a range of lengths; all of them are
    compared. A pair at a difference of radius is met with RECALL, a nearer one with more; the key's width (unless it is given) follows the
    number of digests and the number of tables follows the width. A digest that only rows without doc_id have is not searched: near is null."""
    nodes = stored(prints.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("node")).where("node is not null").select(F.unhex("digest").alias("code"), "node"), "digests")
    width = band or band_for(nodes.count())
    pick, begin = samples(width, tables_for(width, radius))

    def fan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = powers(width)
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                d = np.frombuffer(b"".join(part.column(0).to_pylist()), np.uint8).reshape(-1, SIZE)
                bits = unary(d).astype(np.uint64)
                length = d[:, 1].astype(np.int64)
                key = np.concatenate([mix((bits[:, p] * weights).sum(1, dtype=np.uint64) + mix(np.array((length + o) // LENGTHS * len(pick) + t))) for t, (p, o) in enumerate(zip(pick, begin))])
                again = pa.array(np.tile(np.arange(len(bits)), len(pick)))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *[c.take(again) for c in part.columns]], ["key", "code", "node"])

    def compare(whole: pa.Table) -> pa.Table:
        key, node = whole.column("key").to_numpy(), whole.column("node").to_numpy()
        edge = runs(key)
        some = np.repeat(np.diff(edge) > 1, np.diff(edge))  # rows that have their key alone have nobody to meet
        if not some.any():
            return pa.Table.from_pydict({"code": pa.array([], pa.binary()), "near": pa.array([], whole.column("node").type), "near_score": pa.array([], pa.int32())})
        key, node = key[some], node[some]
        d = np.frombuffer(b"".join(whole.column("code").filter(pa.array(some)).to_pylist()), np.uint8).reshape(-1, SIZE)
        edge = runs(key)
        score, other = nearest_in_runs(d, edge[:-1], np.diff(edge), radius)
        own = np.flatnonzero(score <= radius)
        return pa.Table.from_pydict({"code": pa.array([x.tobytes() for x in d[own]], pa.binary()), "near": pa.array(node[other[own]], whole.column("node").type), "near_score": pa.array(score[own], pa.int32())})

    kind = prints.schema["doc_id"].dataType.simpleString()
    fanned = nodes.mapInArrow(fan, f"key long, code binary, node {kind}")
    found = compared(fanned, compare, f"code binary, near {kind}, near_score int")
    best = found.groupBy("code").agg(F.min(F.struct("near_score", "near")).alias("best")).select(F.lower(F.hex("code")).alias("digest"), "best.near", "best.near_score")
    return prints.join(best, "digest", "left").select(*prints.columns, "near", "near_score")
