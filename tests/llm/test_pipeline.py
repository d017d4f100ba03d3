"""The pipeline's rows against plain versions of its four stages, and on odd tables."""

import math
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from lexispark.llm import packing, perplexity, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents of sf0.001 with copies, near copies, noise, insults and odd rows."""
    folder = str(tmp_path_factory.mktemp("corpus"))
    rng = np.random.default_rng(0)
    docs = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    labels = [(i, 0) for i, *_ in docs]
    english = [d for d in docs if d[2] == "en" and len(d[1]) > 800]
    for k, (_, text, lang, source) in enumerate(english[:20]):
        words = text.split(" ")
        docs.append((1000 + k, text if k % 2 else " ".join(words[:40] + ["indeed"] + words[40:]), lang, source))
    bad = ["zorgle", "blimfuck", "snarfhead", "grotscum"]
    for k, (_, text, lang, source) in enumerate(english[20:50]):
        words = text.split(" ")
        for _ in range(6):
            words.insert(int(rng.integers(len(words))), " ".join(rng.choice(bad, 3)))
        docs.append((2000 + k, " ".join(rng.permutation(words)), lang, source))
        if k < 24:
            labels.append((2000 + k, 1))
    docs += [(3000 + k, "".join(rng.choice(list("qzxjkvw%$# "), 3000)), "en", "src1") for k in range(3)]
    docs += [(4000, "", "en", None), (4001, None, None, None), (None, english[0][1], "en", "src0"), (4002, "few words", "en", "s"), (4002, "few words", "en", "s")]
    spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_run(spark, tables):
    rows = [tuple(r) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    table = lambda some: spark.createDataFrame(some, SCHEMA)
    # quality: mean losses, medians and bands by lists
    model = perplexity.load(perplexity.train(perplexity.count(table(rows))))
    loss = [perplexity.mean_losses([r[1]], [r[2]], model)[0] for r in rows]
    wide = [math.sqrt(1 + perplexity.SHORT / (len(r[1] or "") + 1)) for r in rows]
    kept = []
    limits = {}
    for lang in {r[2] or "" for r in rows}:
        own = [(math.floor(x * 1024), w) for r, x, w in zip(rows, loss, wide) if (r[2] or "") == lang and not math.isnan(x)]
        if own:
            mid = sorted(b for b, _ in own)[(len(own) - 1) // 2]
            dev = sorted(math.floor(abs(b - mid) / w) for b, w in own)[(len(own) - 1) // 2]
            limits[lang] = mid / 1024, max(dev * 1.4826 / 1024, perplexity.LEAST)
    for r, x, w in zip(rows, loss, wide):
        mid, dev = limits.get(r[2] or "", (0, 0))
        if math.isnan(x) or mid - perplexity.LOW * dev * w <= x <= mid + perplexity.HIGH * dev * w:
            kept.append(r)
    assert 0 < len(rows) - len(kept) < 60 and not any(r[0] in (3000, 3001, 3002) for r in kept)
    # toxicity: one text at a time
    net = toxicity.fit(table(kept), spark.read.parquet(f"{tables}/labels.parquet"))
    clean = [r for r in kept if not toxicity.score_texts([r[1]], net)[0][0] >= net.threshold]
    assert sum(2000 <= (r[0] or 0) < 3000 for r in kept) > sum(2000 <= (r[0] or 0) < 3000 for r in clean)
    # near duplicates: all pairs of signatures
    sig, good = simhash.signatures([r[1] or "" for r in clean])
    bits = np.unpackbits(sig.view(np.uint8), axis=1).astype(np.float32) * 2 - 1
    near = (simhash.BITS - bits @ bits.T) / 2 <= simhash.RADIUS
    number = [i for i, r in enumerate(clean) if r[0] is not None]
    root = {clean[i][0]: clean[i][0] for i in number}
    edges = [(clean[i][0], clean[j][0]) for i in number for j in number if good[i] and good[j] and near[i, j] and clean[i][0] < clean[j][0]]
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    once, seen = [], set()
    for r in clean:
        if r[0] is None or (root[r[0]] == r[0] and r[0] not in seen):
            once.append(r)
            seen.add(r[0])
    assert 10 <= len({r[0] for r in clean}) - len({r[0] for r in once})
    # packing: every byte in one bin, bins filled as pack() fills them
    got = corpus_pipeline.run(spark, tables).collect()
    assert all(sum(b.lengths) == b.used <= packing.CAPACITY for b in got)
    sizes = Counter()
    for b in got:
        for i, n in zip(b.doc_ids, b.lengths):
            sizes[i] += n
    assert sizes == Counter({r[0]: len(r[1].encode()) + 1 for r in once if r[1]})
    own = sorted((r for r in once if r[1]), key=lambda r: (r[0] is not None, r[0] or 0, len(r[1].encode())))
    n = [len(r[1].encode()) + 1 for r in own]
    loose = [i for i in range(len(n)) if n[i] % packing.CAPACITY]
    bins = packing.pack([n[i] % packing.CAPACITY for i in loose], packing.CAPACITY)
    assert Counter(tuple(own[loose[i]][0] for i in b) for b in bins) <= Counter(tuple(b.doc_ids) for b in got)


def test_stages_keep_columns_and_odd_rows(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    odd = docs.selectExpr("*", "'x' as toxic", "doc_id as __gone", "text as loss_0", "1 as band_lang", "doc_id as root", "n_chars as n_chars_0")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, tables)
        assert out.columns == odd.columns
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        assert {4000, 4001, 4002, None} <= ids
        assert stage(spark, odd.limit(0), tables).collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, odd.limit(0), tables).collect() == []
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "toxicity", "near-duplicate removal", "best-fit packing"]
