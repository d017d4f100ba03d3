"""Each operator's result against a plain version of it, on small tables."""

import itertools
import math
import re
from collections import Counter

import numpy as np
import pytest

from lexispark.llm import fingerprints, html_extract, langid, packing, perplexity, simhash, token_counts, toxicity, util, warc


def test_bands_and_judgement(spark):
    """Medians, deviations, bands and kept rows, computed with plain lists; odd ids, languages and columns in the table."""
    rng = np.random.default_rng(0)
    words = ["the", "house", "of", "water", "and", "people", "were", "here"]
    rows = [(i, " ".join(rng.choice(words, rng.integers(5, 60))), i % 2, f"x{i}") for i in range(60)]
    rows += [(None, "".join(rng.choice(list("qzxjkvwpy%$#"), 400)), 0, "odd"), (7, "", 1, None), (8, None, None, None), (9, rows[0][1], 0, "again"), (9, rows[0][1], 0, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang int, loss_0 string")
    model = perplexity.train(perplexity.count(docs))
    scores = perplexity.score(docs, model).collect()
    assert len(scores) == len(rows) and sum(r.loss is None for r in scores) == 2
    wide = lambda n: math.sqrt(1 + perplexity.SHORT / (n + 1))
    limits = {}
    for lang in ("0", "1"):
        own = [(math.floor(r.loss * 1024), r.n_chars) for r in scores if r.lang == lang and r.loss is not None]
        low = lambda v: sorted(v)[(len(v) - 1) // 2]
        mid = low([b for b, _ in own])
        dev = low([math.floor(abs(b - mid) / wide(n)) for b, n in own])
        limits[lang] = mid / 1024, max(dev * 1.4826 / 1024, perplexity.LEAST)
    band = {r.band_lang: (r.median, r.deviation) for r in perplexity.bands(perplexity.score(docs, model)).collect()}
    assert band == {k: pytest.approx(v) for k, v in limits.items()}

    def passes(text, lang):
        if not text:
            return True
        loss = perplexity.mean_losses([text], [lang], perplexity.load(model))[0]
        mid, dev = limits[lang]
        spread = dev * wide(len(text))
        return math.exp(mid - perplexity.LOW * spread) <= math.exp(loss) <= math.exp(mid + perplexity.HIGH * spread)

    want = Counter(r for r in rows if passes(r[1], None if r[2] is None else str(r[2])))
    assert Counter(map(tuple, perplexity.reject(docs, model).collect())) == want
    assert sum(want.values()) == len(rows) - 1  # the noise alone goes
    judged = perplexity.judge(perplexity.score(docs, model), perplexity.bands(perplexity.score(docs, model))).collect()
    assert Counter(r.keep for r in judged) == {True: len(rows) - 1, False: 1}
    none = docs.limit(0)
    empty = perplexity.train(perplexity.count(none))
    assert perplexity.reject(none, empty).collect() == [] and perplexity.reject(none, empty).columns == docs.columns
    assert perplexity.judge(perplexity.score(none, empty), perplexity.bands(perplexity.score(none, empty))).count() == 0


def test_slices_of_long_texts():
    """Cut work gives what whole work gives."""
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abé cd. Zß"), n)) for n in (0, 3, 97, 1000)]
    whole = [perplexity.keys(p)[0] for p, _ in perplexity.slices(texts)]
    cut = Counter(np.concatenate([perplexity.keys(p)[0] for p, _ in perplexity.slices(texts, 50)]).tolist())
    assert Counter(np.concatenate(whole).tolist()) == cut
    a = sum(np.bincount(c, minlength=1 << 16) for c, _ in langid.grams(texts))
    b = sum(np.bincount(c, minlength=1 << 16) for c, _ in langid.grams(texts, most=37))
    assert (a == b).all()
    long = "wörd " * 5000 + "x" * 9000
    before = util.words([long]), fingerprints.digests([long, "short", long])
    old = util.STEP_CHARS, fingerprints.STEP_CHARS
    try:
        util.STEP_CHARS = fingerprints.STEP_CHARS = 1001
        after = util.words([long]), fingerprints.digests([long, "short", long])
    finally:
        util.STEP_CHARS, fingerprints.STEP_CHARS = old
    for x, y in zip(before, after):
        assert all(np.array_equal(p, q) for p, q in zip(x, y))
    assert len(set(util.words(["a" * n for n in range(1, 9000, 7)])[3].tolist())) == len(range(1, 9000, 7))
    assert len(util.words(["\U0001f600 \U0001f601"])[1]) == 0


def test_texts_of_millions_of_characters(spark):
    """Every operator on texts takes a text of five million characters, and one of two million without a space."""
    rows = [(1, "some words that are read as they stand, and more. " * 100_000, "en"), (2, "x" * 2_000_000, "en"), (3, "some words", "en"), (4, "des mots", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(3, 1), (4, 0)], "doc_id long, toxic int")
    assert {r.doc_id: r.n_bytes for r in fingerprints.fingerprint(docs).collect()} == {i: len(t) for i, t, _ in rows}
    assert {r.doc_id for r in langid.identify(docs, langid.fit(docs)).where("predicted is not null").collect()} == {1, 2, 3, 4}
    model = toxicity.fit(docs, labels)
    windows = {r.doc_id: r.n_windows for r in toxicity.score(docs, model).collect()}
    assert windows[2] == windows[3] == 1 and windows[1] == -(-(1_000_000 - 32) // 16) + 1
    assert perplexity.reject(docs, perplexity.train(perplexity.count(docs))).count() == 4
    assert {r.doc_id for r in simhash.deduplicate(docs).collect()} == {1, 2, 3, 4}
    assert sum(r.used for r in packing.pack_documents(docs).collect()) == sum(len(t) + 1 for _, t, _ in rows)


def test_nearest_reference(spark, monkeypatch):
    """The same rows and scores whatever the sizes of blocks; repeated rows, null digests, no references."""
    rng = np.random.default_rng(2)
    d = rng.integers(0, 256, (90, fingerprints.SIZE), dtype=np.uint8)
    d[:, 1], d[:, 2] = rng.integers(40, 60, 90), 0x9C
    ref = np.concatenate([d[:30] ^ (rng.random((30, fingerprints.SIZE)) < 0.05).astype(np.uint8), d[:5], d[:5]])
    prints = [(i, bytes(x).hex(), "e") for i, x in enumerate(d)] + [(3, bytes(d[3]).hex(), "e")] * 2 + [(None, None, "n"), (200, None, None)]
    items = [(100 - i, bytes(x).hex()) for i, x in enumerate(ref)] + [(None, bytes(d[9]).hex()), (7, None)]
    docs = spark.createDataFrame(prints, "doc_id long, digest string, near string").repartition(3)
    refs = spark.createDataFrame(items, "item_id long, digest string")

    def best(digest):
        if digest is None:
            return None, None
        return min((fingerprints.difference(digest, r), i) for i, r in items if i is not None and r is not None)[::-1]

    want = Counter((i, h, e, *best(h)) for i, h, e in prints)
    for block, held in ((512, 1 << 16), (7, 1 << 16), (1, 5)):
        monkeypatch.setattr(fingerprints, "BLOCK", block)
        monkeypatch.setattr(fingerprints, "HELD", held)
        assert Counter(map(tuple, fingerprints.nearest(docs, refs).collect())) == want
    assert Counter(map(tuple, fingerprints.nearest(docs, refs.limit(0)).collect())) == Counter((*p, None, None) for p in prints)
    twins = Counter((r.doc_id, r.twin) for r in fingerprints.twins(docs.drop("near")).collect())
    least = {h: min(j for j, g, _ in prints if g == h and j is not None) for _, h, _ in prints if h}
    assert twins == Counter((i, least.get(h)) for i, h, _ in prints)


def test_html_blocks():
    stop = "the man and the dog that was in the house with all of the people who were there for the day " * 4
    assert html_extract.extract("<html><head><title>t</title><body><p>" + stop + "</p>")[0] == stop.strip()
    assert html_extract.extract("<head><meta a=b><link c='d>e'><p>" + stop)[0] == stop.strip()
    assert html_extract.extract(f'<p title="a > b" class=\'x<y>z\'>{stop}</p>')[0] == stop.strip()
    assert [b[0] for b in html_extract.blocks('<p a="x>one <b>two</b><p>three')] == ["one two", "three"]
    assert [b[0] for b in html_extract.blocks("1 < 2 and <3 <p>x</p>")] == ["1 < 2 and <3", "x"]
    # labels by hand: the first pass, then the nearest decided neighbours
    good, bad, near, short = "good", "bad", "near", "short"
    cases = [([good, short, good], [good] * 3), ([good, short, bad], [good, bad, bad]), ([good, near, bad], [good, good, bad]), ([short, short], [bad, bad]), ([bad, short, near, good], [bad, bad, good, good]), ([bad, near, short, good], [bad, good, good, good]), ([short, good], [bad, good])]
    for first, second in cases:
        assert html_extract.second_pass(first, [False] * len(first), [10] * len(first)) == second
    assert html_extract.second_pass([short, good], [True, False], [10, 300]) == [good, good]


def test_html_table(spark):
    rows = [(1, "<p>a</p>", "t", 1), (1, "<p>a</p>", "t", 1), (None, None, None, None), (2, "", "", 0), (3, "<div>x " * 200_000, "u", 2)]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string, n_blocks int")
    got = html_extract.extract_text(pages).collect()
    assert Counter((r.page_id, r.text, r.n_blocks, r.n_good) for r in got) == Counter((i, *html_extract.extract(h)) for i, h, *_ in rows)
    assert html_extract.extract_text(pages.limit(0)).count() == 0


def test_best_two_fit():
    """The packing against a plain version that tries all pairs."""

    def plain(lengths, capacity):
        left, bins = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)), []
        while left:
            own, gap = [], capacity
            while fit := [i for i in left if lengths[i] <= gap]:
                own.append(fit[0])
                left.remove(fit[0])
                gap -= lengths[fit[0]]
            small = lengths[own[-1]]
            pairs = [(lengths[a] + lengths[b], max(lengths[a], lengths[b]), a, b) for a, b in itertools.combinations(left, 2) if small < lengths[a] + lengths[b] <= small + gap]
            if pairs and gap:
                _, _, a, b = max(pairs, key=lambda p: p[:2])
                total, high = lengths[a] + lengths[b], max(lengths[a], lengths[b])
                first = next(i for i in left if lengths[i] == high)
                second = next(i for i in left if i != first and lengths[i] == total - high)
                left += [own.pop()]
                left = sorted(set(left) - {first, second}, key=lambda i: (-lengths[i], i))
                own += [first, second]
            bins.append(own)
        return bins

    rng = np.random.default_rng(3)
    for _ in range(200):
        n = rng.integers(1, 30, rng.integers(0, 25)).tolist()
        assert [sorted(n[i] for i in b) for b in packing.pack(n, 30)] == [sorted(n[i] for i in b) for b in plain(n, 30)]


def test_packing_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a" * 99)] * 500 + [(None, "b" * 9)] * 3 + [(2, ""), (3, None), (4, "c" * 250)], "doc_id long, text string")
    bins = packing.pack_documents(docs, 200, 50).collect()
    assert Counter(x for b in bins for x in zip(b.doc_ids, b.lengths)) == {(1, 100): 500, (None, 10): 3, (4, 200): 1, (4, 51): 1}
    assert all(sum(b.lengths) == b.used <= 200 for b in bins) and len({b.shard for b in bins if 1 in b.doc_ids}) > 5


def test_naive_bayes(spark):
    """Bucket counts, priors and best languages against a plain multinomial naive Bayes."""
    rng = np.random.default_rng(4)
    words = {"en": "the house and this water".split(), "de": "das haus und dieses wasser".split(), "fr": "la maison et cette eau".split()}
    rows = [(i, " ".join(rng.choice(words[lang], 8)) + rng.choice(["", "!", " 12, "]), lang) for i, lang in enumerate(["en", "de", "fr", "en"] * 12)]
    docs = spark.createDataFrame(rows + rows[:5], "doc_id long, text string, lang string")

    def grams(text):
        text = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
        out = [c for c in text if c != " "]
        out += [text[i : i + 2] for i in range(len(text) - 1) if text[i : i + 2] != "  "]
        return out + [text[i : i + n] for n in (3, 4) for i in range(len(text) - n + 1) if " " not in text[i + 1 : i + n - 1]]

    def bucket(gram):
        h = 0
        for c in gram:
            h = (h * 0x01000193 + ord(c)) & 0xFFFFFFFF
        return (((h * 2654435761 + len(gram) * 40503) & 0xFFFFFFFF) * 2246822519 & 0xFFFFFFFF) >> (32 - langid.BITS)

    counts, prior = {}, Counter()
    for text, lang in {(t, lang) for _, t, lang in rows}:
        counts.setdefault(lang, Counter()).update(map(bucket, grams(text)))
        prior[lang] += 1
    langs, matrix = langid.fit(docs)
    assert langs == sorted(counts)
    for k, lang in enumerate(langs):
        total = sum(counts[lang].values()) + langid.ALPHA * (1 << langid.BITS)
        for b in [*counts[lang]][:200] + [0, 1]:
            assert matrix[b, k] == pytest.approx(math.log((counts[lang][b] + langid.ALPHA) / total))
        assert matrix[-1, k] == pytest.approx(math.log((prior[lang] + 1) / (sum(prior.values()) + len(prior))))
    texts = ["the water", "das wasser und", "cette eau!", "x", "house haus"]
    best, margin, ok = langid.score([*texts, "", None, "\U0001f600 12"], matrix)
    for i, t in enumerate(texts):
        own = sorted((matrix[-1, k] + sum(matrix[b, k] for b in map(bucket, grams(t))) for k in range(3)), reverse=True)
        each = [matrix[-1, k] + sum(matrix[b, k] for b in map(bucket, grams(t))) for k in range(3)]
        assert each[best[i]] == pytest.approx(own[0]) and margin[i] == pytest.approx((own[0] - own[1]) / len(grams(t)))
    assert ok.tolist() == [True] * 5 + [False] * 3


def test_language_sample(spark):
    """As many of each language, equal texts once, whatever the order of the rows."""
    rows = [(f"text {i}", "big") for i in range(3000)] + [("same text", "copies")] * 2000 + [(f"other {i}", "small") for i in range(10)] + [(None, "big"), ("x", None)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    got = Counter(r.lang for r in langid.sample(docs, fit_rows=300).collect())
    assert got == {"big": 100, "copies": 1, "small": 10}
    again = {tuple(r) for r in langid.sample(docs.repartition(7), fit_rows=300).collect()}
    assert again == {tuple(r) for r in langid.sample(docs, fit_rows=300).collect()}


def test_balanced_batches():
    rng = np.random.default_rng(5)
    for _ in range(50):
        n = rng.integers(1, 100, rng.integers(1, 200)).tolist()
        got = token_counts.batches_of(n, 300)
        assert sorted(itertools.chain(*got)) == list(range(len(n))) and len(got) <= -(-sum(n) // 300)
        if sum(n) > 3000:
            each = [sum(n[i] for i in b) for b in got]
            assert max(each) - min(each) <= 100 and max(each) <= 400
    enc = token_counts.encoding(token_counts.RANKS)
    texts = ["a few words, and <|endoftext|> " * 40, None, "", "é\U0001f600 " * 30]
    assert token_counts.count(texts, enc, 64, 100, 3) == [None if t is None else len(enc.encode_ordinary(t)) for t in texts]


def test_token_counts_of_documents(spark):
    enc = token_counts.encoding(token_counts.RANKS)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: len(enc.encode_ordinary(r.text)) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs).collect()} == want


def test_warc_long_headers_and_gaps():
    import gzip
    import io

    def record(i, body, extra=""):
        return f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <{i}>\r\n{extra}Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"

    uri = "http://x/" + "y" * 3_000_000
    data = record(0, b"a") + record(1, b"b", f"WARC-Target-URI: {uri}\r\n") + record(2, b"c")
    for raw in (data, gzip.compress(data)):
        rows, status = warc.normalise_stream(io.BytesIO(raw), io.BytesIO())
        assert status == "ok" and [r["id"] for r in rows] == ["<0>", "<1>", "<2>"] and rows[1]["uri"] == uri
    broken = record(0, b"a") + b"noise\r\nmore\r\n" + b"WARC/1.0\r\nWARC-Record-ID: <x>\r\n\r\nlost\r\n\r\n" + record(2, b"c")
    out = io.BytesIO()
    rows, status = warc.normalise_stream(io.BytesIO(broken), out)
    assert status == "malformed" and [r["id"] for r in rows] == ["<0>", "<2>"]
    assert gzip.decompress(out.getvalue()[rows[1]["offset"] :]) == record(2, b"c")


def test_forward_pass():
    """window_logits against a plain loop over words, gates and states."""
    texts = ["a bb ccc dd e f", "x yy", " ".join(f"w{i % 7}" for i in range(70)), "one"]
    rng = np.random.default_rng(6)
    w = toxicity.read(texts)
    p = {k: (v + rng.standard_normal(v.shape) * 0.3).astype(np.float32) for k, v in toxicity.new_parameters(rng).items()}
    got = toxicity.window_logits(w, p)
    H, sig = toxicity.HIDDEN, lambda x: 1 / (1 + np.exp(-x))
    words = [re.findall(r"\w+", t.lower()) for t in texts]
    x = toxicity.embedded(w, p).astype(float)
    for k, (first, length, doc) in enumerate(zip(w.first, w.length, w.doc)):
        own = [x[t] for t in w.token[first : first + length]]
        states = {}
        for d, order in (("f", range(length)), ("b", range(length - 1, -1, -1))):
            h = np.zeros(H)
            for t in order:
                g, q = own[t] @ p[f"W{d}"] + p[f"b{d}"], h @ p[f"U{d}"]
                z, r = sig(g[:H] + q[:H]), sig(g[H : 2 * H] + q[H : 2 * H])
                n = np.tanh(g[2 * H :] + r * (q[2 * H :] + p[f"c{d}"]))
                h = (1 - z) * n + z * h
                states[d, t] = h
        both = np.stack([np.concatenate([states["f", t], states["b", t]]) for t in range(length)])
        a = np.exp(both @ p["query"] - (both @ p["query"]).max())
        assert got[k] == pytest.approx(float((a / a.sum()) @ (both @ p["out"]) + p["bias"][0]), abs=1e-4)
        assert length == min(len(words[doc]), toxicity.WINDOW)
    covered = {doc: set() for doc in range(4)}
    base = np.cumsum([0, *map(len, words)])
    for first, length, doc in zip(w.first, w.length, w.doc):
        covered[doc] |= set(range(first - base[doc], first - base[doc] + length))
    assert all(covered[d] == set(range(len(words[d]))) for d in covered)


def test_signatures_and_components(spark):
    """Bits by majority over distinct words and pairs, and components by plain search."""
    texts = ["The cat sat. The cat ran", "one", "", "a b a b c"]
    sig, good = simhash.signatures(texts)
    assert good.tolist() == [True, True, False, True]
    same, _ = simhash.signatures(["the CAT sat, the cat; ran", "a b  a b c", "a b c"])
    assert (same[0] == sig[0]).all() and (same[1] == sig[3]).all() and (same[2] != sig[3]).any()
    _, _, _, h, doc = util.words(texts)
    for t in (0, 3):
        own = h[doc == t]
        f = set(own.tolist()) | set(util.mix(own[:-1] * np.uint64(0x9E3779B97F4A7C15) + own[1:]).tolist())
        low = np.array(sorted({x >> 20 for x in f}), np.uint64)
        bits = []
        for k in range(simhash.BITS // 64):
            b = np.unpackbits(util.mix(low + np.uint64((k + 1) << 44)).view(np.uint8).reshape(-1, 8), axis=1)
            bits.append(2 * b.sum(0) > len(low))
        assert (np.packbits(np.concatenate(bits)).view("<u8") == sig[t]).all()
    rng = np.random.default_rng(7)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2)) if a != b] + [(400 + i, 401 + i) for i in range(40)] + [(5, 5)]
    root = {n: n for p in pairs for n in p}
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame([(min(p), max(p)) for p in pairs], "a long, b long")).collect()}
    assert got == {n: r for n, r in root.items() if n != r}


def test_dense_group_of_many(spark):
    """A run far longer than a block, of one dense group, one small group and strangers."""
    rng = np.random.default_rng(8)
    centre = rng.integers(0, 2, 128, dtype=np.uint8)
    bits = np.tile(centre, (3000, 1))
    for row in bits[:2500]:
        row[rng.permutation(128)[:9]] ^= 1
    bits[2500:] = rng.integers(0, 2, (500, 128), dtype=np.uint8)
    bits[2990:] = bits[2700]
    sig = np.packbits(bits, axis=1).view(np.uint64)
    flat = bits.astype(np.float32) * 2 - 1
    near = (128 - flat @ flat.T) / 2 <= simhash.RADIUS
    root = np.arange(3000)
    while True:
        new = np.array([root[n].min() for n in near])
        if (new == root).all():
            break
        root = new
    assert (simhash.spanning(sig) == root).all()
