import random
import re
from collections import Counter

import numpy as np
import pytest

from sievework.llm import line_dedup as d
from sievework.llm import mph


def test_minimal_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 100, 20_000):
        h = rng.integers(0, 2**64, (n, 2), dtype=np.uint64)
        h[: n // 4, 0] = h[:1, 0] if n else 0  # equal first halves must still come apart
        counts = np.arange(1, n + 1)
        built = mph.build(h[:, 0], h[:, 1], counts)
        assert len(built["counts"]) == 4 * n
        index = mph.Index(**built)
        assert (index.lookup(h[:, 0], h[:, 1]) == counts).all()
        other = rng.integers(0, 2**64, (5000, 2), dtype=np.uint64)
        assert not index.lookup(other[:, 0], other[:, 1]).any()


def brute(rows, min_docs, min_chars):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x))
    split = [(t or "").split("\n") for _, t in rows]
    docs = Counter(k for ls in split for k in {key(x) for x in ls})
    out = []
    for (i, _), ls in zip(rows, split):
        keep = [x for x in ls if not (len(key(x)) >= min_chars and docs[key(x)] >= min_docs)]
        out.append((i, len(ls), len(ls) - len(keep), "\n".join(keep)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("broadcast_bytes", [1 << 25, 300, -1])
@pytest.mark.parametrize("min_chars", [1, 3])
def test_equals_brute_force(spark, broadcast_bytes, min_chars):
    rng = random.Random(8)
    bits = ["Éa", " éA", "éa\t", "x", "", "  ", "Menu\r", "menu", "日本語", "a b", "A B\x0b", "\x85z", "z"]
    rows = [(i, "\n".join(rng.choice(bits) + (str(rng.randrange(99)) if rng.random() < 0.3 else "") for _ in range(rng.randrange(7)))) for i in range(150)] + [(500, None), (None, "menu\nown")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for min_docs in (2, 10):
        got = d.drop_common_lines(df, ["doc_id"], min_docs=min_docs, min_chars=min_chars, broadcast_bytes=broadcast_bytes, shard_keys=4)
        assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, min_docs, min_chars)


def test_the_index_holds_every_line_with_its_count(spark, sf_dir):
    """Counts below the threshold are read back too."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index, bits, size = d.line_index(d.line_counts(docs), shard_keys=100)
    shards = d.Shards(bits, index.collect())
    want = Counter(k for r in docs.select("text").collect() for k in {d.line_key(x) for x in r.text.encode().split(b"\n")} if k)
    keys = list(want)
    assert shards.lookup(d.digests(keys)).tolist() == [want[k] for k in keys] and 1 in want.values()
    assert not shards.lookup(d.digests([k + b"?" for k in keys])).any()
    assert size < 14 * len(keys) + 64 * len(shards.rows) * 4


def test_query_equals_sql(same_as_sql):
    assert any(r[3] for r in same_as_sql("op3_line_dedup"))


@pytest.mark.parametrize("broadcast_bytes", [1 << 25, -1])
def test_odd_rows(odd_docs, no_docs, broadcast_bytes):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    got = d.drop_common_lines(odd_docs, ["doc_id"], min_docs=3, broadcast_bytes=broadcast_bytes)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 3, 1)
    assert d.drop_common_lines(no_docs, ["doc_id", "key"], broadcast_bytes=broadcast_bytes).count() == 0


@pytest.mark.parametrize("hot", [2, 100_000])
def test_routed_answers_go_by_text(spark, monkeypatch, hot):
    """Rows without id or with equal ids: each text gets what it asked for; a hot line is answered before anything is sent."""
    monkeypatch.setattr(d, "HOT", hot)
    lines = [f"a line that is long enough to be dropped, number {i}" for i in range(12)]
    rows = [(i, "\n".join([*lines[k : k + 2], "everywhere", f"own {i} {k}"])) for i in (None, 4) for k in range(0, 12, 2)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = d.drop_common_lines(docs, ["doc_id", "kept"], min_docs=3, broadcast_bytes=-1)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 3, 1)
