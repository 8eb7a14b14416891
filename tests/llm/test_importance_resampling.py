import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest

from sievework.llm import importance_resampling as r

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, target, orders, buckets, min_words, percent, seed):
    def features(text):
        w = words(text)
        return [crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(orders[0], orders[1] + 1) for i in range(len(w) - n + 1)]

    s, t = (Counter(b for x in texts for b in features(x)) for texts in ([x for _, x in rows], target))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for i, text in rows:
        f = features(text)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    may = [x for x, (_, text) in zip(out, rows) if len(words(text)) >= min_words]
    may.sort(key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for n, x in enumerate(may[: percent * len(may) // 100], 1):
        x[4] = n
    return sorted(map(tuple, out), key=repr)


def test_runs_from_prefixes():
    rng = random.Random(4)
    for text in ["", "a", "x" * 70_000 + " y", *(" ".join("".join(rng.choice("aBé 日z9-\U000130c0") for _ in range(rng.randrange(90))) for _ in range(30)) for _ in range(40))]:
        w = r.words_of(text)
        assert [x.decode() for x in w] == words(text)
        prefixes = r.Prefixes(w)
        for n in range(1, 6):
            assert prefixes.runs(n).tolist() == [crc32(b" ".join(w[i : i + n])) for i in range(len(w) - n + 1)]


@pytest.mark.parametrize("orders", [(1, 1), (1, 3), (2, 2)])
def test_equals_brute_force(spark, orders):
    rng = random.Random(5)
    say = lambda: " ".join(rng.choice(["One", "two", "thrée", "4", "five;", "日本", "x-y"]) for _ in range(rng.randrange(40)))
    rows, target = [(i, say()) for i in range(200)], [say() for _ in range(5)] + [None]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = r.resample(docs, goal, ["doc_id"], orders=orders, buckets=97, min_words=10, percent=33, seed=9)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, target, orders, 97, 10, 33, 9)


def test_ranks_are_whole_over_many_equal_rows(spark):
    """Equal rows are numbered each once, also where they fill a range."""
    text = " ".join("abcdefghijklmnopqrstuvwxyz")
    docs = spark.createDataFrame([(None, text)] * 500 + [(i, text + f" {i}") for i in range(500)], "doc_id long, text string").repartition(5)
    got = r.resample(docs, docs, ["doc_id"], percent=80).collect()
    assert sorted(x["rank"] for x in got if x["rank"]) == list(range(1, 801)) and len(got) == 1000
    by_rank = sorted((x for x in got if x["rank"]), key=lambda x: x["rank"])
    assert [x.score for x in by_rank] == sorted((x.score for x in got), reverse=True)[:800]


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(x.doc_id, x.text) for x in odd_docs.collect()]
    target = ["one two three wörd", None, ""]
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = r.resample(odd_docs, goal, min_words=1, percent=70)
    assert got.columns == [c for c in odd_docs.columns if c != "score"] + ["n_features", "weight", "score", "rank"]
    want = brute(rows, target, (1, 1), r.BUCKETS, 1, 70, r.SEED)
    same = lambda xs: sorted((x[:4] for x in xs), key=repr)
    assert same(map(tuple, got.select("doc_id", "n_features", "weight", "score", "rank").collect())) == same(want)
    assert sorted(x["rank"] for x in got.collect() if x["rank"]) == sorted(x[4] for x in want if x[4])
    assert r.resample(no_docs, goal).count() == 0
    assert r.resample(odd_docs, goal.limit(0), ["doc_id"], percent=0).where("rank is not null").count() == 0


def test_query_equals_sql(same_as_sql):
    assert any(x[2] for x in same_as_sql("op13_importance_resampling"))
