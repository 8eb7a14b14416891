import math
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from sievework.llm import quality_fm as q
from sievework.llm import queries


def test_linear_time_identity():
    """raw() equals the sum over all pairs, written out."""
    rng = np.random.default_rng(3)
    model = q.Model(0.3, rng.normal(size=q.WIDTH).astype(np.float32), rng.normal(size=(q.WIDTH, q.RANK)).astype(np.float32), None, None)
    sizes = np.array([1, 5, 9])
    starts = np.cumsum(sizes) - sizes
    index, value = rng.integers(0, q.WIDTH, sizes.sum()), rng.normal(size=sizes.sum()).astype(np.float32)
    got, _ = model.raw(index, value, starts)
    for n, (a, k) in enumerate(zip(starts, sizes)):
        row = range(a, a + k)
        want = 0.3 + sum(model.w[index[i]] * value[i] for i in row) + sum(model.v[index[i]] @ model.v[index[j]] * value[i] * value[j] for i, j in combinations(row, 2))
        assert got[n] == pytest.approx(want, rel=1e-4)


def test_learns_a_pair_interaction():
    """The label is whether two words agree: no linear model can tell."""
    rng = np.random.default_rng(0)
    texts, labels = [], []
    for _ in range(3000):
        a, b = rng.integers(0, 2, 2)
        texts.append(f"{'left' if a else 'right'} {'up' if b else 'down'}")
        labels.append(int(a == b))
    index, value, starts = q.features(texts, [""] * len(texts))
    old = q.EPOCHS
    try:
        q.EPOCHS = 30
        model = q.fit(index, value, starts, np.array(labels))
    finally:
        q.EPOCHS = old
    assert ((model.scores(texts, [""] * len(texts)) >= 0.5) == np.array(labels)).mean() > 0.95


def test_one_class_or_none():
    index, value, starts = q.features(["a b", "c"], ["", ""])
    assert np.allclose(q.fit(index, value, starts, np.array([1, 1])).scores(["x", ""], ["", ""]), 0.75)
    none = q.fit(np.empty(0, np.int64), np.empty(0, np.float32), np.empty(0, np.int64), np.empty(0))
    assert (none.scores(["x"], [""]) == 0.5).all()


def test_query_and_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = queries.op1_quality_classifier(spark, sf_dir).collect()
    docs = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    test = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(p == y for p, y in test) / len(test) > 0.93
    clean = [p for p, y in test if y == 1]
    assert sum(clean) / len(clean) > 0.95


def test_held_out_labels_teach_nothing(spark):
    docs = spark.createDataFrame([(i, "good text here" if i % 2 else "BAD!! $$$") for i in range(300)], "doc_id long, text string")
    true = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    lies = true.withColumn("quality", q.F.when(q.held_out("doc_id"), 1 - q.F.col("quality")).otherwise(q.F.col("quality")))
    a, b = (q.train(docs, x).scores(["good text here", "BAD!! $$$", ""], [""] * 3) for x in (true, lies))
    assert (a == b).all() and a[0] > 0.5 > a[1]
    assert (q.train(docs, true.union(true.selectExpr("doc_id", "1 - quality"))).scores(["x"], [""]) == 0.5).all()


def plain_features(text, meta):
    """The features of one text as a dict, written out without arrays."""
    data = text.encode()
    words, lines = data.lower().split(), [x for x in data.split(b"\n") if x]
    x = {}
    kinds = [0] * q.SHARES
    for byte in data:
        c = chr(byte)
        marks = [i for i, m in enumerate(q.MARKS) if c in m]
        kind = 6 if byte > 127 else 1 if "A" <= c <= "Z" else 2 if "a" <= c <= "z" else 3 if "0" <= c <= "9" else 4 if c in "\t\x0b\x0c\r " else 5 if c == "\n" else 7 + marks[0] if marks else 0
        kinds[kind] += 1
    n, counts = max(1, len(words)), Counter(words)
    more = [math.log1p(len(words)), math.log1p(len(data)), sum(len(w) for w in words) / n / 10, len(counts) / n, max(counts.values(), default=0) / n, len(set(lines)) / max(1, len(lines)), len(lines) / n, sum(a == b for a, b in zip(words, words[1:])) / n]
    for i, s in enumerate([k / max(1, len(data)) for k in kinds] + more):
        x[q.WIDTH - q.STATS + i] = s
    for m in meta.split("\x1f"):
        if m:
            x[q.WORD_BUCKETS + zlib.crc32(m.encode()) % q.META_BUCKETS] = 1
    buckets = Counter()
    for w, k in counts.items():
        buckets[zlib.crc32(w) % q.WORD_BUCKETS] += k
    norm = math.sqrt(sum((1 + math.log(k)) ** 2 for k in buckets.values())) or 1
    return x | {b: (1 + math.log(k)) / norm for b, k in buckets.items()}


def test_scored_equals_all_pairs_written_out(spark, odd_docs):
    """The Spark path on odd documents, against features and pairs one by one."""
    rng = np.random.default_rng(5)
    model = q.Model(0.2, rng.normal(0, 0.3, q.WIDTH).astype(np.float32), rng.normal(0, 0.2, (q.WIDTH, q.RANK)).astype(np.float32), rng.normal(0, 0.1, q.STATS).astype(np.float32), np.full(q.STATS, 0.7, np.float32))
    docs = odd_docs.select("doc_id", "text", "n_chars").union(spark.createDataFrame([(50, "A b a B! 12\n\nx|y <z> b", 22), (51, " ".join(f"w{i % 300}" for i in range(900)), 4000)], "doc_id long, text string, n_chars long"))
    meta = [q.length_class("n_chars")]
    rows = q.scored(docs, model, meta=meta).select("text", q.metadata(meta).alias("meta"), "score").collect()
    assert len(rows) == docs.count()
    for r in rows:
        x = plain_features(r.text or "", r.meta)
        for i in range(q.STATS):
            at = q.WIDTH - q.STATS + i
            x[at] = min(4, max(-4, (x[at] - model.mean[i]) / model.scale[i]))
        raw = model.w0 + sum(float(model.w[i]) * v for i, v in x.items())
        raw += sum(float(model.v[i].astype(float) @ model.v[j].astype(float)) * a * b for (i, a), (j, b) in combinations(x.items(), 2))
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, raw)))), abs=2e-4), (r.text or "")[:40]


def test_bounds_hold_for_repeated_ids(spark):
    """One labelled id on many rows, and texts whose features are more than the bound."""
    a, b = [i for i in range(1, 50) if zlib.crc32(str(i).encode()) % 3 != 1][:2]
    labels = spark.createDataFrame([(a, 1), (b, 0)], "doc_id long, quality int")
    docs = spark.range(3000).selectExpr(f"if(id % 2 = 0, {a}L, {b}L) as doc_id", "concat('text number ', id div 2) as text").union(spark.createDataFrame([(b, "the same")] * 500, "doc_id long, text string"))
    assert q.training_features(docs, labels).count() == 3001
    n = q.training_features(docs, labels, max_rows=300).count()
    assert 200 < n < 400
    rows = q.training_features(docs, labels, max_bytes=30_000).collect()
    assert 15_000 < sum(len(r["index"]) + len(r["value"]) for r in rows) < 45_000
    long = " ".join(f"w{i}" for i in range(300_000))
    index, _, _ = q.features([long], [""])
    assert len(index) <= q.WIDTH and len(set(index.tolist())) == len(index)


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (5, None), (6, 7), (7, 1), (8, 0), (8, 0)], "doc_id long, quality int").selectExpr("*", "'x' as text", "0 as y")
    meta = [q.length_class("n_chars")]
    model = q.train(odd_docs, labels, meta=meta)
    rows = q.scored(odd_docs, model, meta=meta).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert q.scored(no_docs, q.train(no_docs, labels.limit(0)), meta=meta).count() == 0
