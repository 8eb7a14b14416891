import hashlib
import random
from zlib import crc32

import pytest

from sievework.llm import prefix_trie as p
from sievework.llm import queries


def brute(conversations):
    """conv -> [(role, text)]: the nodes by walking all prefixes."""
    members, out = {}, []
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    for prefix, ids in members.items():
        below = [x for x in members if x[: len(prefix)] == prefix]
        ends = ",".join(map(str, sorted(c for c in ids if len(conversations[c]) == len(prefix))))
        out.append(
            (
                min(ids),
                len(prefix),
                min(members[prefix[:-1]]) if prefix else None,
                len(ids),
                sum(len(x) == len(prefix) + 1 for x in below),
                sum(not any(y != x and y[: len(x)] == x for y in below) for x in below),
                sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x),
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def made(spark, conversations, extra=()):
    rows = [(c, i, r, t) for c, turns in conversations.items() for i, (r, t) in enumerate(turns)] + list(extra)
    random.Random(2).shuffle(rows)
    return p.turns_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3))


@pytest.mark.parametrize(("width", "crowded"), [(8, 50_000), (2, 50_000), (2, 6), (3, 0)])
def test_equals_brute_force(spark, width, crowded):
    """Whether depths are peeled in groups or one by one, in one band or in many."""
    rng = random.Random(3)
    conversations = {}
    for c in range(60):
        turns = [("user", rng.choice("ab"))] + [(rng.choice(("user", "assistant")), rng.choice(["x", "yy", "日本", ""])) for _ in range(rng.randrange(9))]
        conversations[rng.randrange(-5, 10**12)] = turns
        if conversations and rng.random() < 0.3:
            conversations[c * 7 + 1] = list(rng.choice(list(conversations.values())))
    conversations[77] = [("user", "a")] * 31
    conversations[78] = [("user", "a")] * 31 + [("user", "b")]
    assert rows_of(p.trie(made(spark, conversations), width, crowded)) == brute(conversations)


def test_many_equal_conversations_and_none_with_turns(spark):
    same = {c: [("user", "hello"), ("assistant", "ok")] for c in range(3_000, 15_000, 2)}
    assert rows_of(p.trie(made(spark, same))) == brute(same)
    bare = spark.createDataFrame([(c, None, None, None) for c in (5, 3)], "conv long, at long, digest binary, chars long")
    assert rows_of(p.trie(bare)) == brute({3: [], 5: []})
    assert p.trie(bare.limit(0)).count() == 0


def test_odd_rows(spark):
    """Null turns come first, equal ones go by their digest; null roles and texts are empty; rows without conversation belong to none; a role can't be taken for a text."""
    rows = [(1, 2, "user", "b"), (1, None, None, None), (2, 0, "us", "erb"), (2, 0, "us", "erb"), (None, 0, "user", "b"), (3, 7, "user", "x" * 200_000), (4, 1, "a", "c"), (4, 1, "a", "b")]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "conv_id long, turn long, role string, text string, conv string, digest string")
    tied = sorted([("a", "b"), ("a", "c")], key=lambda t: hashlib.md5(f"1:{t[0]}{t[1]}".encode()).digest())
    want = {1: [("", ""), ("user", "b")], 2: [("us", "erb")] * 2, 3: [("user", "x" * 200_000)], 4: tied}
    assert rows_of(p.trie(p.turns_of(df))) == brute(want)


def test_query_equals_brute_force(spark, sf_dir):
    """The rebuilt conversations too."""
    turns = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    want = {}
    for c, own in turns.items():
        h = crc32(str(c).encode()) % 6
        want[c] = turns.get(c - c % 100, [])[:h] + own[h:]
    assert rows_of(queries.op12_prefix_trie(spark, sf_dir)) == brute(want)


def test_query_equals_sql(same_as_sql):
    assert same_as_sql("op12_prefix_trie")
