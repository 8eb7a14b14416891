import random
import re

import numpy as np
import pytest

from sievework.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(text, items, window):
    words = WORD.findall(low(text))
    hit, holders, longest = set(), set(), 0
    for i, t in items:
        q = WORD.findall(low(t))
        n = min(len(q), window)
        for a in range(len(q) - n + 1 if q else 0):
            for p in range(len(words) - n + 1):
                if words[p : p + n] == q[a : a + n]:
                    hit |= set(range(p, p + n))
                    holders.add(str(i))
                    m = n
                    while a + m < len(q) and p + m < len(words) and words[p + m] == q[a + m]:
                        m += 1
                    longest = max(longest, m)
    return len(words), len(hit), sorted(holders), longest


def test_suffix_array():
    rng = random.Random(2)
    for _ in range(60):
        words = [rng.randrange(3) for _ in range(rng.randrange(40))]
        assert d.suffix_array(np.array(words, dtype=np.int64)).tolist() == sorted(range(len(words)), key=lambda i: words[i:])


def test_search_equals_brute_force():
    rng = random.Random(4)
    for trial in range(40):
        bits = [rng.choice(["a", "B", "c", "é", "d-", "1"]) for _ in range(4)]
        text = lambda n: " ".join(rng.choice(bits) for _ in range(n))
        items = [(i, text(rng.randrange(9))) for i in range(4)] + [(9, None), (1, text(5))]
        docs = [text(rng.randrange(30)) for _ in range(5)] + ["", items[0][1] + " x"]
        block = d.Block([(str(i), w, True) for i, t in items if (w := d.words_of(t or ""))], 4)
        for size in (1, 20, 10**6):
            for t, got in zip(docs, d.search_texts(docs, [block], size), strict=True):
                words, n_hit, holders, longest = brute(t, items, 4)
                assert (got[0], got[1], got[2], got[5]) == (words, n_hit, holders, longest)
                assert sum(b - a for a, b in zip(got[3], got[4])) == n_hit and all(b < c for b, c in zip(got[4], got[3][1:]))
                if longest:
                    own = next(WORD.findall(low(x)) for i, x in items if str(i) == got[7] and " ".join(WORD.findall(low(t))[got[6] : got[6] + longest]) in " ".join(WORD.findall(low(x))))
                    assert longest <= len(own)


def test_query_equals_sql(same_as_sql):
    rows = same_as_sql("op4_decontaminate")
    assert any(r[0] for r in rows) and not all(r[0] for r in rows)


def unpacked(rows, window, block_bytes):
    packed = list(d.blocks_of(rows, window, block_bytes))
    return packed, [d.Block.unpacked(x) for x in packed]


def test_blocks_are_bounded():
    """Repeated words, new words and long names; an item longer than a block lies in pieces that hold each of its windows."""
    rng = random.Random(7)
    say = lambda n: " ".join(f"word{rng.randrange(3000)}" for _ in range(n))
    items = [(str(i), say(rng.randrange(60))) for i in range(300)] + [("long", say(5000)), ("x" * 200, say(30)), ("short", "a b")]
    for most in (4_000, 20_000, 10**6):
        packed, blocks = unpacked(items, 10, most)
        assert all(len(x) <= most for x in packed) and len(packed) < 3 + 3 * sum(len(t) for _, t in items) / most
        windows = {}
        for b in blocks:
            words = [b.vocabulary[w] for w in b.words]
            for at in np.flatnonzero(b.depth):
                windows.setdefault(b.ids[b.item[at]], set()).add(tuple(words[at : at + b.depth[at]]))
        for i, t in items:
            w = d.words_of(t)
            n = min(len(w), 10)
            assert windows.get(i, set()) == {tuple(w[a : a + n]) for a in range(len(w) - n + 1 if w else 0)}
    assert unpacked([], 10, 100) == ([], [])


def test_equal_items_are_one(spark):
    bench = spark.createDataFrame([("same", "one two three four")] * 5_000 + [(str(i), f"five six {i}") for i in range(100)], "item_id string, text string")
    parts = list(d._parts(d._items(bench, "item_id", "text"), 10, 5_000, 10**6))
    blocks = [d.Block.unpacked(x) for x in parts[0]]
    assert len(parts) == 1 and sum(len(b.ids) for b in blocks) == 101 and all(len(x) <= 5_000 for x in parts[0])


def test_long_items_in_pieces(spark):
    """Answers don't depend on where an item is cut."""
    rng = random.Random(8)
    say = lambda n: [f"w{rng.randrange(50)}" for _ in range(n)]
    item = say(3000)
    texts = [" ".join(say(rng.randrange(20)) + item[a : a + n] + say(5)) for a in range(0, 2900, 97) for n in (3, 9, 10, 25)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item[500:530]))], "item_id long, text string")
    one, many = ({r.doc_id: tuple(r.found) for r in d.find_matches(docs, bench, block_bytes=b).collect()} for b in (10**8, 2_000))
    assert one == many and sum(1 for x in one.values() if x[1]) == len(texts) // 2


def test_blocks_give_the_same(spark, sf_dir):
    """All fields, ties of the longest match among them, in one pass over the texts whatever the number of blocks."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    bench = bench.union(bench.selectExpr("item_id + 100", "text"))
    found = [d.find_matches(docs, bench, block_bytes=b) for b in (10**8, 3000)]
    one, many = ({r.doc_id: tuple(r.found) for r in f.collect()} for f in found)
    assert one == many and any(x[5] for x in one.values())
    plans = [f._jdf.queryExecution().executedPlan().toString() for f in found]
    assert [p.count("ArrowEvalPython") for p in plans] == [1, 1]
    clean = {k for k, v in one.items() if not v[1]}
    assert d.decontaminated(docs, bench).columns == docs.columns
    assert {r.doc_id for r in d.decontaminated(docs, bench).collect()} == clean
    # A benchmark too large to be sent out at once.
    assert {r.doc_id for r in d.decontaminated(docs, bench, block_bytes=3000, most_bytes=10_000).collect()} == clean
    with pytest.raises(ValueError, match="more than"):
        d.find_matches(docs, bench, block_bytes=3000, most_bytes=10_000)


def test_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, None), (2, ""), (None, "No ID"), (3, "four five six"), (3, "four five six")], "item_id long, text string").selectExpr("*", "1 as found", "2 as doc_id")
    rows = d.find_matches(odd_docs, bench).collect()
    assert len(rows) == odd_docs.count()
    assert {(r.doc_id, r.found.n_hit, tuple(r.found["items"])) for r in rows if r.found.n_hit} == {(3, 3, ("3",)), (4, 3, ("3",)), (None, 2, ("",))}
    assert d.find_matches(no_docs, bench).count() == 0
    assert d.decontaminated(odd_docs, bench.limit(0)).count() == len(rows)
