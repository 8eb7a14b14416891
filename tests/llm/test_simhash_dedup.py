import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
import xxhash

from sievework.llm import queries
from sievework.llm import simhash_dedup as s


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(fps):
    """(id, fingerprint) rows -> id -> least id reachable."""
    least = {}
    distinct = sorted({f for _, f in fps})
    left = set(distinct)
    while left:
        todo, group = [left.pop()], set()
        while todo:
            a = todo.pop()
            group.add(a)
            near = {b for b in left if (a ^ b).bit_count() <= 3}
            left -= near
            todo += near
        low = min((i for i, f in fps if f in group and i is not None), default=None)
        least |= dict.fromkeys(group, low)
    return least


@pytest.mark.parametrize("text", ["", " \t", "One", "One two", "A b c", "Ab cd ef ÄÖ gh " * 40, "x y z w", "a " * 70_000])
def test_fingerprint(text):
    assert s.fingerprint(text) == brute_fingerprint(text)


def test_every_pair_in_reach_has_a_chain():
    """The principle behind the keys: for any difference of up to 3 bits, some start holds the chain."""
    for n in (1, 2, 3):
        for bits in combinations(range(0, 64, 1 if n < 3 else 2), n):
            x = np.array([sum(1 << b for b in bits)], dtype=np.uint64)
            assert any(len(s.chain_holds(s._turned(x, 8 * i))) for i in range(8))
    assert not len(s.chain_holds(np.array([0xF], dtype=np.uint64)))


@pytest.mark.parametrize("many", [10**9, 0])
def test_classes_compared_and_looked_up(monkeypatch, many):
    monkeypatch.setattr(s, "MANY", many)
    rng = random.Random(7)
    base, nodes = rng.getrandbits(64), set()
    for _ in range(40):
        nodes.add(base ^ sum(1 << b for b in rng.sample(range(32), rng.randrange(5))))
    nodes = np.array(sorted(nodes), dtype=np.uint64)
    got = {frozenset(c.tolist()) for c in s.classes(nodes)}
    left, want = set(nodes.tolist()), set()
    while left:
        todo, group = [left.pop()], set()
        while todo:
            a = todo.pop()
            group.add(a)
            near = {b for b in left if len(s.chain_holds(np.array([a ^ b], dtype=np.uint64)))}
            left -= near
            todo += near
        if len(group) > 1:
            want.add(frozenset(group))
    assert got == want and want


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    fps = [(r.doc_id, brute_fingerprint(r.text)) for r in docs]
    least = brute_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op6_simhash_near_dedup(spark, sf_dir).collect()}
    assert got == {i: (f"{f:016x}", least[f]) for i, f in fps}


@pytest.mark.parametrize("split", [1 << 16, 1])
def test_components_of_dense_and_long_groups(spark, monkeypatch, split):
    """Links between fingerprints of random walks: long chains of links, and dense balls."""
    monkeypatch.setattr(s, "SPLIT", split)
    rng = random.Random(11)
    fps = []
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(60):
            fps.append(x)
            for b in rng.sample(range(64), rng.choice((1, 2, 3, 3, 4))):
                x ^= 1 << b
    centre = rng.getrandbits(64)
    fps += [centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(200)]
    fps = sorted(set(fps))
    rng.shuffle(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    stars = s.components(s.links(spark.createDataFrame([(f,) for f in signed], "fp long"))).collect()
    centre_of = {r.a: r.b for r in stars}
    assert len(centre_of) == len(stars)
    groups = {}
    for i, f in enumerate(signed):
        groups.setdefault(centre_of.get(f, f), set()).add(i)
    least = brute_components(list(enumerate(fps)))
    wanted = {}
    for i, f in enumerate(fps):
        wanted.setdefault(least[f], set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_a_hot_fingerprint_is_spread_over_tasks(spark):
    """Nine rows of ten under one fingerprint, without the planner's broadcasts and without adaptive execution."""
    own = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        docs = spark.createDataFrame([(i, "the same words in all of these" if i % 10 else f"own words {i} of one text {i}") for i in range(4000)], "doc_id long, text string").repartition(8)
        got = s.near_duplicates(docs)
        hot = got.where("component_id = 1").groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in hot) == 3600 and len(hot) >= 4 and max(r["count"] for r in hot) < 1200
        least = brute_components([(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()])
        assert got.select("component_id").distinct().count() == len(set(least.values()))
    finally:
        for c, value in own.items():
            spark.conf.set(c, value)


def test_odd_rows(odd_docs, no_docs):
    rows = s.near_duplicates(odd_docs).collect()
    texts = [(r.doc_id, brute_fingerprint(r.text)) for r in odd_docs.select("doc_id", "text").collect()]
    least = brute_components(texts)
    assert sorted(map(tuple, rows), key=repr) == sorted(((i, f"{f:016x}", least[f]) for i, f in texts), key=repr)
    assert s.near_duplicates(no_docs).count() == 0
