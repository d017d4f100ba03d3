"""Operators against brute force, round trips, held-out accuracy, and on odd tables."""

import gzip
import io
import itertools
import math
import struct
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from lexispark.llm import fingerprints, html_extract, langid, packing, perplexity, sentence_pieces, simhash, token_counts, toxicity, warc

ODD = [(0, "", "en", 0), (1, None, "en", None), (2, "word " * 60000, None, 1), (3, "the cat sat on the mat and the dog ran to the house by the sea", "en", 5), (3, "the cat sat on the mat and the dog ran to the house by the sea", "en", 5), (None, "the cat sat on the mat", "fr", 7), (5, "\u0000 % ! \n", "en", 1), (6, "x" * 70000, "de", 2)]
SCHEMA = "doc_id long, text string, lang string, key long"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def test_odd_and_empty_tables(spark, odd):
    """Clashing extra columns, nulls, ties, repeated rows, empty tables."""
    labels = spark.createDataFrame([(3, 1), (2, 0), (99, 1), (None, 0)], "doc_id long, toxic int")
    for docs in (odd.withColumnsRenamed({"key": "hi"}), odd.limit(0)):
        n = docs.count()
        assert fingerprints.fingerprint(docs).count() == n
        assert langid.identify(docs, langid.fit(docs)).count() == n
        assert token_counts.count_tokens(docs).count() == n
        pieces = sentence_pieces.encode(docs)
        assert pieces.count() == n and sentence_pieces.decode(pieces).where("text is null").count() == (1 if n else 0)
        found = [r.doc_id for r in simhash.deduplicate(docs).collect()]
        assert sorted(x for x in found if x is not None) == sorted({r[0] for r in ODD if r[0] is not None})[: len(found)] if n else found == []
        bins = packing.pack_documents(docs).collect()
        assert sum(sum(b.lengths) for b in bins) == sum(len(t.encode()) + 1 for _, t, *_ in ODD if t) * bool(n)
        assert toxicity.score(docs, None).where("toxic or toxicity is not null").count() == 0
    assert toxicity.fit(odd.limit(0), labels) is None


def test_perplexity_against_brute_force(spark):
    texts = [("a", "abcab abc"), ("a", "abcd bcd ab"), ("b", "xyx yxy"), ("a", "")]
    docs = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(texts)], "doc_id long, text string, lang string")
    model = perplexity.load(perplexity.train(perplexity.count(docs)))
    N = perplexity.ORDER
    grams = {n: Counter() for n in range(1, N + 1)}
    for lang, t in texts:
        if lang == "a" and t:
            s = perplexity.START * (N - 1) + t + perplexity.END
            grams[N].update(s[i : i + N] for i in range(len(s) - N + 1))
    for n in range(N - 1, 0, -1):
        grams[n] = Counter(g[1:] for g in grams[n + 1])
    D = {}
    for n, g in grams.items():
        c = Counter(g.values())
        for i in (1, 2, 3):
            d = i - (i + 1) * c[1] / (c[1] + 2 * c[2]) * c[i + 1] / c[i] if c[1] and c[i] else 0
            D[n, i] = d if 0 < d < i else 0.5 * i

    def p(context, x):
        n = len(context) + 1
        if n == 1:
            below = 1 / (len(grams[1]) + 1)
        else:
            below = p(context[1:], x)
        own = {g: c for g, c in grams[n].items() if g[:-1] == context}
        if not own:
            return below
        total = sum(own.values())
        gamma = sum(D[n, min(c, 3)] for c in own.values()) / total
        c = own.get(context + x, 0)
        return (c - D[n, min(c, 3)] if c else 0) / total + gamma * below

    for text in ("abcab abc", "zzz", "bcda"):
        s = perplexity.START * (N - 1) + text + perplexity.END
        want = -sum(math.log(p(s[i : i + N - 1], s[i + N - 1])) for i in range(len(text) + 1)) / (len(text) + 1)
        assert perplexity.mean_losses([text], ["a"], model)[0] == pytest.approx(want)
    assert np.isnan(perplexity.mean_losses(["", None, "abc"], ["a", "a", "none"], model)).all()


def test_digests_by_hand():
    rng = np.random.default_rng(0)
    a = "".join(rng.choice(list("abcdefgh "), 3000))
    b = a[:1500] + "changed" + a[1500:]
    c = "".join(rng.choice(list("qrstuvwxyz "), 3000))
    d, good, n = fingerprints.digests([a, b, c, "short", None])
    x, y, z = (bytes(r).hex() for r in d[:3])
    assert good.tolist() == [True, True, True, False, False] and n.tolist()[0] == 3000
    assert fingerprints.difference(x, x) == 0 and fingerprints.difference(x, y) < 60 < fingerprints.difference(x, z) <= fingerprints.BOUND
    raw = a.encode()
    counts = np.zeros(128, int)
    for i in range(len(raw) - 3):
        w = raw[i : i + 4]
        for salt, pick in ((3, (0, 1, 2)), (11, (0, 1, 3)), (23, (0, 2, 3))):
            h = 0
            for k in pick:
                h = h * 65599 + w[k]
            counts[((h + salt * 7919) * 2654435761 % 2**32) >> 25] += 1
    q = np.sort(counts)[[31, 63, 95]]
    code = (counts[:, None] > q).sum(1)
    got = [(byte >> s) & 3 for byte in d[0][3:].tolist() for s in (0, 2, 4, 6)]
    assert got == code.tolist()


def test_html():
    stop = "the man and the dog that was in the house with all of the people who were there for the day " * 4
    page = f"<html lang='en'><body><nav><a href=x>Home</a> <a href=y>All news of the day</a></nav><h1>A title</h1><p>{stop}</p><p>Yes.</p><p>{stop}</p><script>var x = '<p>no</p>';</script><div>Copyright \xa9 us</div></body>"
    text, n, good = html_extract.extract(page)
    assert "A title" in text and "Yes." in text and "Home" not in text and "no" not in text.split("\n") and "\xa9" not in text
    assert html_extract.extract(None) == (None, 0, 0) and html_extract.extract("") == ("", 0, 0) and html_extract.extract("<!-- x")[0] == ""


def test_packing():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n = rng.integers(1, 60, rng.integers(0, 40)).tolist()
        bins = packing.pack(n, 60)
        assert sorted(itertools.chain(*bins)) == list(range(len(n))) and all(sum(n[i] for i in b) <= 60 for b in bins)
    assert packing.pack([6, 3, 2, 2], 10) == [[0, 2, 3], [1]]  # 6 + 3 leaves 1; two of 2 fill the gap of 4


def test_language_on_held_out_text(spark):
    words = {"en": "the house and this water with they from", "de": "das haus und dieses wasser mit ihnen von", "fr": "la maison et cette eau avec elles dans"}
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(words[lang].split(), 12)), lang) for i, lang in enumerate(["en", "de", "fr"] * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.predicted for r in langid.identify(docs, langid.fit(docs.where("doc_id < 45"))).collect()}
    assert all(got[i] == lang for i, _, lang in rows)


def test_token_counts_of_split_texts():
    enc = token_counts.encoding(token_counts.RANKS)
    for text in ("a few  words, isn't it?\n\n  yes " * 50, "x" * 500, " \n " * 300, "né 12 !? " * 99):
        assert token_counts.count([text], enc, 40) == [len(enc.encode_ordinary(text))]
    assert token_counts.count([None, ""], enc) == [None, 0]


def record(i, body, extra=""):
    return f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <{i}>\r\n{extra}Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def test_warc_streams():
    bodies = [b"one", b"", b"\r\n\r\nWARC/1.0\r\n" * 3, bytes(range(256)) * 4000]
    whole = b"".join(record(i, b) for i, b in enumerate(bodies))
    members = b"".join(gzip.compress(record(i, b)) for i, b in enumerate(bodies))
    for data in (gzip.compress(whole), whole, members):
        out = io.BytesIO()
        rows, status = warc.normalise_stream(io.BytesIO(data), out)
        assert status == "ok" and [r["content_length"] for r in rows] == [len(b) for b in bodies]
        for i, r in enumerate(rows):
            assert gzip.decompress(out.getvalue()[r["offset"] : r["offset"] + r["length"]]) == record(i, bodies[i])
    assert warc.normalise_stream(io.BytesIO(b""), io.BytesIO()) == ([], "ok")
    rows, status = warc.normalise_stream(io.BytesIO(gzip.compress(record(0, b"one") + record(1, b"two"))[:-30]), io.BytesIO())
    assert status in ("truncated", "damaged") and len(rows) <= 1
    assert warc.normalise_stream(io.BytesIO(b"no warc\r\n"), io.BytesIO()) == ([], "malformed")


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(1, "http://a", "<p>é</p>", 1), (1, "http://a", "<p>é</p>", 1), (2, None, "", 2), (None, "u", "x", 3), (4, "v", None, 4)], "page_id long, url string, html string, id long")
    got = sorted((r.page_id or -1, r.url or "", r.n_bytes) for r in warc.round_trip(pages).collect())
    assert got == [(-1, "u", 1), (1, "http://a", 9), (1, "http://a", 9), (2, "", 0)]
    assert warc.round_trip(pages.limit(0)).count() == 0


def field(number, value):
    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def model(kind, pieces, fallback):
    names = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + ([(f"<0x{i:02X}>", 0.0, 6) for i in range(256)] if fallback else []) + [(p, s, 1) for p, s in pieces]
    out = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, t)) for p, s, t in names)
    return out + field(2, field(3, kind) + field(35, int(fallback))) + field(3, field(1, b"identity") + field(3, 1) + field(4, 1) + field(5, 1))


TEXTS = ["", " ", "ab abc", "  ab   ba ", "cabé abc\U0001f600", "aaaa bbbb", "<s> ab", "▁ab ▁", "abcabcabc" * 200]


@pytest.mark.parametrize("fallback", [True, False])
@pytest.mark.parametrize("kind", [1, 2])
def test_piece_parity(kind, fallback):
    pieces = [("▁", -3.0), ("a", -3.5), ("b", -3.75), ("c", -4.0), ("ab", -2.0), ("▁ab", -1.5), ("bc", -2.5), ("abc", -2.25), ("<", -5.0)]
    data = model(kind, pieces, fallback)
    library, own = sentencepiece.SentencePieceProcessor(model_proto=data), sentence_pieces.Backend(data, verify=False)
    ids, _ = own.encode(TEXTS)
    assert ids == library.encode(TEXTS)
    verified, differ = sentence_pieces.Backend(data).encode(TEXTS)
    assert verified == ids and sum(differ) == 0
    if fallback:
        assert own.decode(ids) == [library.decode(i) for i in ids]


def test_installed_model_parity():
    with open(sentence_pieces.MODEL, "rb") as f:
        data = f.read()
    library, own = sentencepiece.SentencePieceProcessor(model_proto=data), sentence_pieces.Backend(data)
    ids, differ = own.encode([*TEXTS, None])
    assert ids == [*library.encode(TEXTS), None] and sum(differ) == 0
    assert own.decode(ids) == [*(library.decode(i) for i in ids[:-1]), None]


def test_backend_alone_over_documents(spark):
    """Without the library's help: ids and decoded texts of all documents, whole, and the query's columns."""
    with open(sentence_pieces.MODEL, "rb") as f:
        data = f.read()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate([*TEXTS, None])], "doc_id long, text string")
    rows = {r.doc_id: r.text for r in docs.union(extra).collect()}
    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    for verify in (False, True):
        got = sentence_pieces.encode(docs.union(extra), verify=verify).collect()
        assert len(got) == len(rows)
        for r in got:
            t = rows[r.doc_id]
            want = None if t is None else library.encode(t)
            assert r.ids == want and r.n_differ == (None if t is None else 0) and r.restored == (None if t is None else library.decode(want) == t)


def test_toxicity_gradients_and_windows():
    w, rng = toxicity.read(["a bb ccc dd e f", "x yy", "one two three " * 30]), np.random.default_rng(0)
    assert w.length.tolist() == [6, 2, 32, 32, 32, 32, 32] and w.doc.tolist() == [0, 1, 2, 2, 2, 2, 2]
    p = {k: v + rng.standard_normal(v.shape) * 0.3 for k, v in toxicity.new_parameters(rng, np.float64).items()}
    own, y, weight = np.arange(3), np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 1.0])
    _, g = toxicity.loss_and_gradients(w, own, y, weight, p)
    for name, value in p.items():
        flat, slope = value.reshape(-1), g[name].reshape(-1)
        for i in np.flatnonzero(slope)[:4]:
            old, ends = flat[i], []
            for d in (1e-5, -1e-5):
                flat[i] = old + d
                ends.append(toxicity.loss_and_gradients(w, own, y, weight, p)[0])
            flat[i] = old
            assert (ends[0] - ends[1]) / 2e-5 == pytest.approx(slope[i], abs=1e-6)


def test_toxicity_on_held_out_text():
    rng = np.random.default_rng(3)
    plain, bad = [f"w{i}x" for i in range(200)], ["scum", "moron", "trash"]
    rows = []
    for i in range(160):
        words = rng.choice(plain, rng.integers(20, 120)).tolist()
        if i % 2:
            for _ in range(3):
                words[rng.integers(len(words))] = str(rng.choice(bad))
        rows.append((" ".join(words), i % 2))
    m = toxicity.unpacked(toxicity.packed(toxicity.train([t for t, _ in rows[:100]], [y for _, y in rows[:100]])))
    top, n = toxicity.score_texts([t for t, _ in rows[100:]] + [None, ""], m)
    right = ((top[:60] >= m.threshold) == np.array([y == 1 for _, y in rows[100:]])).mean()
    assert right >= 0.9 and n[-2:].tolist() == [0, 0] and np.isneginf(top[-2:]).all()


def test_near_pairs_against_brute_force():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, (20, 2), dtype=np.uint64)
    sig = np.concatenate([base, base, base, rng.integers(0, 2**63, (60, 2), dtype=np.uint64)])
    for row in sig[20:60]:
        for b in rng.integers(0, 128, rng.integers(10, 40)):
            row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    bits = np.unpackbits(sig.view(np.uint8), axis=1)
    for edge in ([0, 120], [0, 40, 87, 120], [0, 10, 11, 40]):
        want = {(i, j) for a, b in zip(edge, edge[1:]) for i in range(a, b) for j in range(i + 1, b) if (bits[i] != bits[j]).sum() <= simhash.RADIUS}
        i, j = simhash.near_pairs(sig, np.array(edge[:-1]), np.diff(edge))
        assert set(zip(i.tolist(), j.tolist())) == want and want
        root = list(range(len(sig)))
        for _ in root:
            for i, j in want:
                root[i] = root[j] = min(root[i], root[j])
        assert simhash.links(sig[: edge[-1]], np.array(edge)).tolist() == root[: edge[-1]]


def test_keys_share_comparisons(monkeypatch):
    """Keys of any size give their components, and the steps that it takes follow the rows, not the keys and their longest one."""
    rng = np.random.default_rng(9)
    calls = []
    plain = simhash.within
    monkeypatch.setattr(simhash, "within", lambda *a: calls.append(1) or plain(*a))
    size = rng.permutation(np.array([*[60] * 100, *[3] * 500, *[1] * 40, 2, 31, 33, 63, 64, 65, 127, 128, 129, 300, 700]))
    edge = np.concatenate([[0], np.cumsum(size)])
    bits = rng.integers(0, 2, (len(size), 3, 128), dtype=np.uint8)[np.repeat(np.arange(len(size)), size), rng.integers(0, 3, edge[-1])]
    bits ^= rng.random(bits.shape) < 0.11  # pairs around RADIUS
    sig = np.packbits(bits, axis=1).view(np.uint64)
    want, pairs = np.arange(len(sig)), set()
    for a, b in zip(edge, edge[1:]):
        flat = bits[a:b].astype(np.float32) * 2 - 1
        near = (128 - flat @ flat.T) / 2 <= simhash.RADIUS
        pairs |= {(a + i, a + j) for i, j in zip(*np.nonzero(np.triu(near, 1)))}
        root = np.arange(b - a)
        while not np.array_equal(new := np.array([root[n].min() for n in near]), root):
            root = new
        want[a:b] = a + root
    assert np.array_equal(simhash.links(sig, edge), want) and (want != np.arange(len(sig))).any()
    assert len(calls) < 100
    i, j = simhash.near_pairs(sig, edge[:-1], size)
    assert len(i) == len(pairs) and set(zip(i.tolist(), j.tolist())) == pairs


def test_keys_of_many_rows(spark):
    """Rows of one key that are too many for a task meet in blocks."""
    from lexispark.llm import util

    rows = [(k, i * 1000 + k, i) for k, n in ((1, 50), (2, 900), (3, 2), (4, 300)) for i in range(n)]

    def compare(part):
        from collections import defaultdict

        by = defaultdict(list)
        for key, node in zip(part.column("key").to_pylist(), part.column("node").to_pylist()):
            by[key].append(node)
        assert all(len(x) <= 260 for x in by.values())
        pairs = [(a, b) for own in by.values() for a in own for b in own if a < b]
        return pa.Table.from_pydict({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})

    fanned = spark.createDataFrame([(k, n) for k, n, _ in rows], "key long, node long")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        found = {(r.a, r.b) for r in util.compared(fanned, compare, "a long, b long", 64, 200).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {(a, b) for k in (1, 2, 3, 4) for a in range(k, 900_000, 1000) for b in range(a + 1000, 900_000, 1000)}
    nodes = {n for _, n, _ in rows}
    assert found == {(a, b) for a, b in want if a in nodes and b in nodes}


def test_groups_of_copies(spark):
    rng = np.random.default_rng(5)
    words = [f"v{i}" for i in range(3000)]
    texts = [" ".join(rng.choice(words, 150)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, texts[i % 10] + (" more" if i > 20 else "")) for i in range(30)]
    got = {r.doc_id: r.root for r in simhash.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i % 100 % 10 for i in [*range(10), *range(100, 130)]}


def test_search_reaches_the_radius(spark):
    """Pairs at each distance up to RADIUS are found, and none beyond it."""
    rng = np.random.default_rng(6)
    far = (20, 24, 26, 28, 29)
    n = 200
    bits = rng.integers(0, 2, (len(far) * n, 2, simhash.BITS), dtype=np.uint8)
    for k in range(len(bits)):
        bits[k, 1] = bits[k, 0]
        bits[k, 1, rng.permutation(simhash.BITS)[: far[k // n]]] ^= 1
    sig = np.packbits(bits.reshape(-1, simhash.BITS), axis=1).view(np.int64)
    nodes = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(sig)], "node long, hi long, lo long")
    flat = bits.reshape(-1, simhash.BITS).astype(np.float32) * 2 - 1
    near = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu((simhash.BITS - flat @ flat.T) / 2 <= simhash.RADIUS, 1)))}
    found = {(r.a, r.b) for r in simhash.edges(nodes).collect()}
    assert found <= near
    for k, d in enumerate(far):
        met = sum((2 * i, 2 * i + 1) in found for i in range(k * n, k * n + n))
        assert met >= 0.9 * n if d <= simhash.RADIUS else met == 0


def test_near_documents_by_digest(spark):
    """Every row gets the nearest other digest within NEAR, as all pairs have it; the search meets 0.9 of the pairs at NEAR itself."""
    rng = np.random.default_rng(7)
    far, n = (10, 20, 25, 30, 31), 150
    codes = rng.integers(0, 4, (len(far) * n, 2, fingerprints.BUCKETS))
    for k in range(len(codes)):
        at = rng.permutation(fingerprints.BUCKETS)[: far[k // n]]
        codes[k, 1] = codes[k, 0]
        codes[k, 1, at] += np.where(codes[k, 0, at] > 1, -1, 1)
    body = (codes.reshape(-1, fingerprints.BUCKETS // 4, 4) << np.array([0, 2, 4, 6])).sum(2).astype(np.uint8)
    d = np.concatenate([np.full((len(body), 3), 7, np.uint8), body], axis=1)
    rows = [(i, bytes(x).hex(), 100) for i, x in enumerate(d)] + [(5000, bytes(d[0]).hex(), 100), (None, bytes(d[2]).hex(), 100), (5001, None, 3)]
    got = {r.doc_id: (r.near, r.near_score) for r in fingerprints.near_copies(spark.createDataFrame(rows, "doc_id long, digest string, n_bytes long")).collect()}
    assert len(got) == len(rows) and got[5000] == got[0] and got[None] == got[2] and got[5001] == (None, None)
    for i in range(len(d)):
        all_pairs = fingerprints.differences(d, d[i])
        all_pairs[i] = fingerprints.BOUND
        best = int(all_pairs.argmin())
        want = (best, int(all_pairs[best])) if all_pairs[best] <= fingerprints.NEAR else (None, None)
        assert got[i] in (want, (None, None))
    for k, x in enumerate(far):
        met = sum(got[2 * i][0] == 2 * i + 1 for i in range(k * n, k * n + n))
        assert met >= 0.9 * n if x <= fingerprints.NEAR else met == 0


def test_near_copy_in_the_result(spark, tmp_path):
    from lexispark.llm import queries

    rng = np.random.default_rng(0)
    a = "".join(rng.choice(list("abcdefgh "), 3000))
    spark.createDataFrame([(1, a), (2, a[:1500] + "changed" + a[1500:]), (3, "short")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "x" * 9)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r.near for r in queries.op2_fingerprints(spark, str(tmp_path)).collect()}
    assert got == {1: 2, 2: 1, 3: None}
