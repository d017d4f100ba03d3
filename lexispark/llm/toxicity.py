"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word's input is the embedding of its hash plus those of its hashed character n-grams (3 to 5 characters, word ends
marked) and of its beginnings of up to 9, scaled by their number's root. Words are lower-cased runs of letters and digits. A text is cut
into windows of WINDOW words, one every STRIDE words and one that ends with the text, so that all words are in a window
and neighbours overlap. Each window is read in both directions, a learned query weighs the states of its
words, and their weighted sum gives the window's probability. A document's score is that of its worst window; it is
toxic from the model's threshold on.

The fit uses at most FIT_ROWS labelled documents of each class, those of smallest hash, with their whole texts. As labels are of
documents, toxic windows are learned from the windows that score highest of each toxic document. Four in five documents
give gradients; the threshold is set on the others. Scoring covers all windows of all rows.

Null and empty texts and those without letters or digits have no windows, a null score, and are not toxic. Equal texts
get equal scores, repeated rows repeated results; a null doc_id is carried along. Label rows without a document, or with a null,
are not used. Without toxic or without clean examples nothing can be learned: scores are null and no row is
toxic. An empty table gives no rows. Whole texts are read, some 15 bytes a character being held, and 100 a character of a single word. Other
columns are not read, or in reject() passed through untouched.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import mix, only, powers, ragged, steps, sums, words

WINDOW, STRIDE, FIT_ROWS = 32, 16, 1500
BITS, DIM, HIDDEN, ORDERS, BEGINNINGS = 15, 12, 12, (3, 4, 5), (6, 7, 8, 9, 10)
WARM, EPOCHS, BATCH, RATE, SEED = 6, 14, 192, 0.02, 7
#: Gradient steps at least: few labelled rows are gone through more often.
LEAST_STEPS = 300
#: Windows of a document that give gradients in an epoch: of a toxic one at first by chance and then the highest scored, and of a clean one. A
#: bound on the fit alone; other windows take their turn in other epochs, and scoring covers all.
PER_DOCUMENT = (4, 2, 3)
#: Windows that are scored at once.
LANES = 1024

Parameters = dict[str, np.ndarray]


class Words(NamedTuple):
    """The distinct words of some texts, and the windows over all their words."""

    hash: np.ndarray  # of each distinct word
    word: np.ndarray  # its bucket
    gram: np.ndarray  # buckets of the character n-grams, a distinct word's together
    n_gram: np.ndarray  # how many each has
    token: np.ndarray  # the distinct word at each place
    first: np.ndarray  # place where each window starts
    length: np.ndarray  # its words
    doc: np.ndarray  # its text


def read(texts: list[str | None]) -> Words:
    """Some texts at a time, as words take several times their texts' room while they are looked for."""
    parts = [(i, read_some(texts[i:j])) for i, j in steps(texts)]
    if len(parts) == 1:
        return parts[0][1]
    if not parts:
        return read_some([""])
    hashes = np.concatenate([w.hash for _, w in parts])
    _, at, same = np.unique(hashes, return_index=True, return_inverse=True)
    gram, n_gram = np.concatenate([w.gram for _, w in parts]), np.concatenate([w.n_gram for _, w in parts])
    owns = np.cumsum([0, *(len(w.hash) for _, w in parts)])
    places = np.cumsum([0, *(len(w.token) for _, w in parts)])
    token = np.concatenate([same[owns[k] + w.token] for k, (_, w) in enumerate(parts)])
    gram = gram[ragged((np.cumsum(n_gram) - n_gram)[at], n_gram[at])]
    rest = [np.concatenate(x) for x in ([w.first + places[k] for k, (_, w) in enumerate(parts)], [w.length for _, w in parts], [w.doc + i for i, w in parts])]
    return Words(hashes[at], np.concatenate([w.word for _, w in parts])[at], gram, n_gram[at], token, *rest)


def read_some(texts: list[str | None]) -> Words:
    cp, a, b, h, doc = words([t or "" for t in texts])
    _, at, token = np.unique(h, return_index=True, return_inverse=True)
    size = b[at] - a[at] + 2
    inner = cp[ragged(a[at], size - 2)].astype(np.uint64) + np.uint64(3)
    ends = np.cumsum(size)
    c = np.full(int(ends[-1]) if len(ends) else 0, 2, np.uint64)
    inside = np.ones(len(c), bool)
    inside[ends - size] = inside[ends - 1] = False
    c[ends - size] = 1
    c[inside] = inner
    own = np.repeat(np.arange(len(size)), size)
    left = np.repeat(ends, size) - np.arange(len(c))  # symbols from here to the word's end
    grams, owner, p = [], [], powers(max(*ORDERS, *BEGINNINGS))
    for n in (*ORDERS, *BEGINNINGS):
        at_ = np.flatnonzero(left >= n) if n in ORDERS else (ends - size)[size >= n]
        roll = np.full(len(at_), n, np.uint64)
        for k in range(n):
            roll += c[at_ + k] * p[k]
        grams.append((mix(roll) >> np.uint64(64 - BITS)).astype(np.int64))
        owner.append(own[at_])
    gram, owner = np.concatenate(grams), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    n_words = np.bincount(doc, minlength=len(texts)).astype(np.int64)
    n_windows = np.where(n_words > WINDOW, -(-(n_words - WINDOW) // STRIDE) + 1, n_words > 0).astype(np.int64)
    k = ragged(np.zeros(len(texts), np.int64), n_windows)
    last = np.repeat(np.maximum(n_words - WINDOW, 0), n_windows)
    start = np.repeat(np.cumsum(n_words) - n_words, n_windows) + np.minimum(k * STRIDE, last)
    return Words(h[at], (h[at] >> np.uint64(64 - BITS)).astype(np.int64), gram[order], np.bincount(owner, minlength=len(size)), token, start, np.repeat(np.minimum(n_words, WINDOW), n_windows), np.repeat(np.arange(len(texts)), n_windows))


def embedded(w: Words, p: Parameters, some: np.ndarray | None = None) -> np.ndarray:
    """Input vectors of the distinct words, some of them at a time."""
    some = np.arange(len(w.word)) if some is None else some
    x = p["word"][w.word[some]]
    starts = np.cumsum(w.n_gram) - w.n_gram
    for i in range(0, len(some), 1 << 13):
        own = some[i : i + (1 << 13)]
        n = w.n_gram[own]
        x[i : i + len(own)] += sums(p["char"][w.gram[ragged(starts[own], n)]], n) / np.sqrt(np.maximum(n, 1))[:, None].astype(x.dtype)
    return x


def new_parameters(rng: np.random.Generator, dtype=np.float32) -> Parameters:
    def random(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(dtype)

    p = {"word": np.zeros((1 << BITS, DIM), dtype), "char": np.zeros((1 << BITS, DIM), dtype)}  # what was never seen says nothing
    for d in "fb":
        p |= {f"W{d}": random(DIM, 3 * HIDDEN, scale=DIM**-0.5), f"b{d}": np.zeros(3 * HIDDEN, dtype), f"U{d}": random(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5), f"c{d}": np.zeros(HIDDEN, dtype)}
    return p | {"query": random(2 * HIDDEN, scale=0.3), "out": random(2 * HIDDEN, scale=0.3), "bias": np.zeros(1, dtype)}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def window_logits(w: Words, p: Parameters) -> np.ndarray:
    """Log-odds of every window. Windows of equal length go together, short ones in order of their lengths."""
    x = embedded(w, p)
    H = HIDDEN
    half = np.concatenate([np.full(2 * H, 0.5, np.float32), np.ones(H, np.float32)])  # sigmoid by tanh of the half
    gate = {d: (x @ p[f"W{d}"] + p[f"b{d}"]) * half for d in "fb"}
    out = np.empty(len(w.first), np.float32)
    order = np.argsort(-w.length, kind="stable")
    for i in range(0, len(order), LANES):
        own = order[i : i + LANES]
        length = w.length[own]
        T, same = int(length[0]), length[0] == length[-1]
        at = w.first[own]
        states = np.zeros((2, T, len(own), H), np.float32)
        weight = np.full((T, len(own)), -1e30 if not same else 0, np.float32)
        live = [len(own)] * T if same else [int(np.searchsorted(-length, -t, "left")) for t in range(T)]  # windows of over t words
        for side, d in enumerate("fb"):
            u, c = p[f"U{d}"] * half, p[f"c{d}"]
            h = np.zeros((len(own), H), np.float32)
            for t in range(T):
                k = live[t]
                where = at[:k] + (t if d == "f" else length[:k] - 1 - t)
                g = gate[d][w.token[where]]
                hp = h[:k]
                q = hp @ u
                zr = np.tanh(g[:, : 2 * H] + q[:, : 2 * H])
                zr *= 0.5
                zr += 0.5
                n = q[:, 2 * H :] + c
                n *= zr[:, H:]
                n += g[:, 2 * H :]
                np.tanh(n, out=n)
                hp -= n
                hp *= zr[:, :H]
                hp += n
                if same:
                    states[side, t if d == "f" else T - 1 - t] = hp
                else:
                    states[side, np.full(k, t) if d == "f" else length[:k] - 1 - t, np.arange(k)] = hp
        seen = weight if same else np.where(np.arange(T)[:, None] < length, np.float32(0), weight)
        s = states[0] @ p["query"][:H] + states[1] @ p["query"][H:] + seen
        s = np.exp(s - s.max(0))
        s /= s.sum(0)
        value = states[0] @ p["out"][:H] + states[1] @ p["out"][H:]
        out[own] = (s * value).sum(0) + p["bias"][0]
    return out


def loss_and_gradients(w: Words, own: np.ndarray, target: np.ndarray, weight: np.ndarray, p: Parameters) -> tuple[float, Parameters]:
    """Weighted cross-entropy of the windows in own, and its derivatives by every parameter."""
    H, B = HIDDEN, len(own)
    length = w.length[own]
    T = int(length.max())
    inside = np.arange(T)[:, None] < length
    place = np.minimum(w.first[own] + np.arange(T)[:, None], len(w.token) - 1)
    used, token = np.unique(w.token[place], return_inverse=True)
    token = token.reshape(T, B)
    x = embedded(w, p, used)
    kept, states = {}, np.zeros((2, T, B, H), x.dtype)
    for side, d in enumerate("fb"):
        gx, h, trace = x @ p[f"W{d}"] + p[f"b{d}"], np.zeros((B, H), x.dtype), []
        for t in range(T) if d == "f" else range(T - 1, -1, -1):
            g, q, m = gx[token[t]], h @ p[f"U{d}"], inside[t][:, None]
            z, r, qn = sigmoid(g[:, :H] + q[:, :H]), sigmoid(g[:, H : 2 * H] + q[:, H : 2 * H]), q[:, 2 * H :] + p[f"c{d}"]
            n = np.tanh(g[:, 2 * H :] + r * qn)
            new = np.where(m, n + z * (h - n), h)
            trace.append((t, h, z, r, n, qn, m))
            h = states[side, t] = new
        kept[d] = trace
    both = np.concatenate([states[0], states[1]], 2)
    s = np.where(inside, both @ p["query"], -1e30)
    s = np.exp(s - s.max(0))
    s /= s.sum(0)
    value = both @ p["out"]
    logit = (s * value).sum(0) + p["bias"][0]
    y = sigmoid(logit)
    total = weight.sum()
    loss = float((weight * (np.logaddexp(0, logit) - target * logit)).sum() / total)
    dl = (weight * (y - target) / total).astype(x.dtype)
    g: Parameters = {"bias": np.array([dl.sum()], x.dtype)}
    dvalue = s * dl
    ds = s * (value - (s * value).sum(0)) * dl
    g["out"], g["query"] = (both * dvalue[..., None]).sum((0, 1)), (both * ds[..., None]).sum((0, 1))
    dstates = dvalue[..., None] * p["out"] + ds[..., None] * p["query"]
    dx = np.zeros_like(x)
    for side, d in enumerate("fb"):
        U = p[f"U{d}"]
        dgx, dU, dc, dh = np.zeros((T, B, 3 * H), x.dtype), np.zeros_like(U), np.zeros(H, x.dtype), np.zeros((B, H), x.dtype)
        for t, hp, z, r, n, qn, m in reversed(kept[d]):
            dh = dh + dstates[t, :, side * H : (side + 1) * H]
            live, rest = dh * m, dh * ~m
            dn = live * (1 - z) * (1 - n * n)
            daz, dar, dq = live * (hp - n) * z * (1 - z), dn * qn * r * (1 - r), dn * r
            dgx[t] = np.concatenate([daz, dar, dn], 1)
            back = np.concatenate([daz, dar, dq], 1)
            dU += hp.T @ back
            dc += dq.sum(0)
            dh = rest + live * z + back @ U.T
        dgx = dgx.reshape(-1, 3 * H)
        flat = token.ravel()
        per = np.stack([np.bincount(flat, dgx[:, k], len(used)) for k in range(3 * H)], 1).astype(x.dtype)
        g |= {f"U{d}": dU, f"c{d}": dc, f"b{d}": per.sum(0), f"W{d}": x.T @ per}
        dx += per @ p[f"W{d}"].T
    g["word"] = np.stack([np.bincount(w.word[used], dx[:, k], 1 << BITS) for k in range(DIM)], 1).astype(x.dtype)
    n = w.n_gram[used]
    gram = w.gram[ragged((np.cumsum(w.n_gram) - w.n_gram)[used], n)]
    spread = np.repeat(dx / np.sqrt(np.maximum(n, 1))[:, None], n, 0)
    g["char"] = np.stack([np.bincount(gram, spread[:, k], 1 << BITS) for k in range(DIM)], 1).astype(x.dtype)
    return loss, g


def worst(w: Words, logits: np.ndarray, n: int) -> np.ndarray:
    """Highest log-odds among each text's windows; -inf without any."""
    out = np.full(n, -np.inf)
    np.maximum.at(out, w.doc, logits)
    return out


class Model(NamedTuple):
    parameters: Parameters
    threshold: float  # on log-odds


def train(texts: list[str], labels: list[int], seed: int = SEED, epochs: int = EPOCHS, per_document: tuple[int, int, int] = PER_DOCUMENT) -> Model | None:
    """None where a class has no text with words. All windows of all texts compete for a place in each epoch."""
    w, y, rng = read(texts), np.asarray(labels, np.int64), np.random.default_rng(seed)
    has = np.bincount(w.doc, minlength=len(y)) > 0
    if not (has & (y == 1)).any() or not (has & (y == 0)).any():
        return None
    held = np.zeros(len(y), bool)
    for c in (0, 1):
        own = rng.permutation(np.flatnonzero(has & (y == c)))
        held[own[: len(own) // 5]] = True
    fit_windows = np.flatnonzero(~held[w.doc])
    p, cache, logits = new_parameters(rng), {}, None
    per = max(1, sum(min(n, per_document[2]) for n in np.bincount(w.doc[fit_windows], minlength=1).tolist()) // BATCH)
    epochs = max(epochs, min(-(-LEAST_STEPS // per), 20 * epochs))
    warm, again, step = epochs * WARM // EPOCHS, max(4, epochs // 6), 0
    for epoch in range(epochs):
        key = rng.random(len(w.first))
        if epoch >= warm:
            if (epoch - warm) % again == 0:
                logits = window_logits(w, p)
            key = np.where(rng.random(len(key)) < 0.7, -logits, 100 * key)
        order = fit_windows[np.lexsort((key[fit_windows], w.doc[fit_windows]))]
        doc = w.doc[order]
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        rank = np.arange(len(doc)) - np.repeat(first, np.diff(first, append=len(doc)))
        toxic = y[doc] == 1
        pick = rng.permutation(order[np.where(toxic, rank < per_document[0 if epoch < warm else 1], rank < per_document[2])])
        target = y[w.doc[pick]].astype(np.float32)
        share = np.array([0.5 / max((target == c).mean(), 1e-6) for c in (0, 1)], np.float32)
        for i in range(0, len(pick), BATCH):
            some = slice(i, i + BATCH)
            _, g = loss_and_gradients(w, pick[some], target[some], share[target[some].astype(int)], p)
            step += 1
            rate = RATE * (1 - 0.9 * epoch / epochs)
            for name, grad in g.items():
                # one scale for a whole table of embeddings, or rare words would move as far as telling ones
                square = grad * grad if name not in ("word", "char") else np.array((grad * grad).sum() / max(np.count_nonzero(grad), 1))
                m, v = cache.setdefault(name, (np.zeros_like(grad), np.zeros_like(square)))
                m *= 0.9
                m += 0.1 * grad
                v *= 0.99
                v += 0.01 * square
                p[name] -= (rate / (1 - 0.9**step)) * m / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    top = worst(w, window_logits(w, p), len(y))
    judged = has & (held if (held & (y == 1)).any() and (held & (y == 0)).any() else True)
    return Model(p, best_threshold(top[judged], y[judged]))


def best_threshold(score: np.ndarray, y: np.ndarray) -> float:
    """Of the gaps between scores with the fewest errors (a clean text taken for toxic counts as three) the widest, two thirds up."""
    edge = np.unique(score)
    low, high = np.concatenate([[edge[0] - 3], edge]), np.concatenate([edge, [edge[-1] + 3]])
    cuts = low + (high - low) * 2 / 3
    clean, toxic = np.sort(score[y == 0]), np.sort(score[y == 1])
    errors = 3 * (len(clean) - np.searchsorted(clean, cuts)) + np.searchsorted(toxic, cuts)
    best = np.flatnonzero(errors == errors.min())
    return float(cuts[best[int(np.argmax((high - low)[best]))]])


def packed(model: Model) -> bytes:
    out = io.BytesIO()
    np.savez(out, __threshold=np.array(model.threshold), **model.parameters)
    return out.getvalue()


def unpacked(data: bytes) -> Model:
    with np.load(io.BytesIO(data)) as f:
        return Model({k: f[k] for k in f.files if k != "__threshold"}, float(f["__threshold"]))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """Trained in one task from at most fit_rows documents of each class; documents are not shuffled, and the driver gets the weights alone."""
    mine = only(labels, doc_id=id_col, toxic=label_col).where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    picked = mine.where("toxic = 1").orderBy(*order).limit(fit_rows).unionByName(mine.where("toxic = 0").orderBy(*order).limit(fit_rows))
    own = only(docs, doc_id=id_col, text=text_col).where("text is not null")
    found = own.join(F.broadcast(picked.withColumnRenamed("doc_id", "label_id")), F.col("doc_id") == F.col("label_id"))
    rows = found.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).select("text", F.col("toxic").cast("int").alias("toxic")).limit(2 * fit_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            y += batch.column(1).to_pylist()
        model = train(texts, y)
        if model:
            yield pa.RecordBatch.from_pydict({"model": pa.array([packed(model)], pa.binary())})

    got = rows.coalesce(1).mapInArrow(run, "model binary").collect()
    return unpacked(bytes(got[0][0])) if got else None


def score_texts(texts: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of each text's worst window (-inf without any) and its number of windows."""
    w = read(texts)
    return worst(w, window_logits(w, model.parameters), len(texts)), np.bincount(w.doc, minlength=len(texts))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_windows, toxicity, toxic) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, j in steps(texts):
                top, n = score_texts(texts[i:j], m) if m else (np.full(j - i, -np.inf), np.bincount((w := read(texts[i:j])).doc, minlength=j - i))
                none = np.isneginf(top)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(n.astype(np.int32)), pa.array(sigmoid(np.where(none, 0, top)), mask=none), pa.array(top >= (m.threshold if m else np.inf))], ["doc_id", "n_windows", "toxicity", "toxic"])

    kind = docs.schema[id_col].dataType.simpleString()
    return only(docs, doc_id=id_col, text=text_col).mapInArrow(run, f"doc_id {kind}, n_windows int, toxicity double, toxic boolean")


def reject(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of docs that are not toxic, with all their columns."""
    if model is None:
        return docs
    sent, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            texts = batch.column(names.index(text_col)).to_pylist()
            for i, j in steps(texts):
                top, _ = score_texts(texts[i:j], m)
                yield batch.slice(i, j - i).filter(pa.array(~(top >= m.threshold)))

    return docs.mapInArrow(run, docs.schema)
