import random
import re
from hashlib import md5

import numpy as np
import pandas as pd
import pytest

from sievework.llm import repeated_phrases as p

BLANKS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    """(id, text) -> (id, words, removed, kept); rows that agree in both are one document."""
    first, split = {}, [BLANKS.findall(t or "") for _, t in rows]
    place = lambda n: (rows[n][0] is None, rows[n][0] or 0, md5((rows[n][1] or "").encode()).digest())
    for n in sorted(range(len(rows)), key=place):
        for i in range(len(split[n]) - window + 1):
            first.setdefault(tuple(split[n][i : i + window]), (place(n), i))
    out = []
    for n, words in enumerate(split):
        gone = {j for i in range(len(words) - window + 1) if first[tuple(words[i : i + window])] < (place(n), i) for j in range(i, i + window)}
        out.append((rows[n][0], len(words), len(gone), " ".join(w for j, w in enumerate(words) if j not in gone)))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_removed", "kept").collect()), key=repr)


def passages(rng, vocabulary=400):
    say = lambda n: [f"w{rng.randrange(vocabulary)}é" for _ in range(n)]
    shared, rows = [say(n) for n in (12, 25, 60, 60, 200)], []
    for i in range(120):
        words = say(rng.randrange(40))
        for _ in range(rng.randrange(4)):
            passage = rng.choice(shared)
            a = rng.randrange(len(passage))
            words += passage[a : a + rng.randrange(80)] + say(rng.randrange(15))
        if words and rng.random() < 0.3:
            words[rng.randrange(len(words))] = "changed"
        rows.append((i * 3, rng.choice([" ", "\n", "\t "]).join(words)))
    rows += [(1000 + i, rows[i][1]) for i in range(30)]
    rows += [(2000, " ".join(["again"] * 90)), (2001, " ".join(["again", "and"] * 40)), (1, " ".join(["again"] * 25))]
    return rows


@pytest.mark.parametrize(("window", "shard", "crowded", "sent"), [(12, 20_000, 2_000, 1 << 25), (20, 30, 1, -1), (9, 50, 3, 1 << 25), (12, 1, 0, -1)])
def test_equals_brute_force(spark, window, shard, crowded, sent):
    """One shard or many, anchors crowded or not, lists sent or joined."""
    rows = passages(random.Random(window))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = p.remove_repeats(docs, ["doc_id"], window=window, shard=shard, crowded=crowded, sent_bytes=sent)
    want = brute(rows, window)
    assert rows_of(got) == want and sum(r[2] for r in want) > 500


def test_ranges_hold_what_goes(spark):
    rows = passages(random.Random(1))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in p.remove_repeats(docs, window=12).collect():
        words = r.text.split()
        gone = {j for a, b in zip(r.removed_from, r.removed_to) for j in range(a, b + 1)}
        assert len(gone) == r.n_removed and " ".join(w for j, w in enumerate(words) if j not in gone) == r.kept
        assert all(a > b + 1 for a, b in zip(r.removed_from[1:], r.removed_to))


def test_odd_rows(spark, odd_docs, no_docs):
    """Rows without id, with equal ids, repeated rows, texts of one word over and over, and many equal rows of one document."""
    text, other = " ".join(map(str, range(30))), " ".join(map(str, range(10, 60)))
    more = [(None, text), (None, other), (7, other), (7, text), (7, text), (9, text)] + [(11, "own " + text)] * 40
    odd = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert rows_of(p.remove_repeats(odd, ["doc_id"], window=10)) == brute(rows, 10)
    got = p.remove_repeats(odd_docs.withColumnRenamed("size", "Kept"))
    assert got.columns == [c for c in odd_docs.columns if c != "size"] + ["n_words", "n_removed", "kept", "removed_from", "removed_to"]
    assert got.count() == odd_docs.count() and p.remove_repeats(no_docs).count() == 0
    with pytest.raises(ValueError):
        p.remove_repeats(odd_docs, window=8)


def test_anchors():
    rng = np.random.default_rng(6)
    for n, of in ((0, 3), (2, 3), (3, 3), (200, 13), (200, 1), (50, 2)):
        g = rng.integers(0, 9, n).astype(np.uint64)
        assert p.anchors_at(g, of).tolist() == [i + int(np.argmin(g[i : i + of])) for i in range(n - of + 1)]
    many = rng.integers(0, 99, p.BLOCK + 50).astype(np.uint64)
    at = p.anchors_at(many, 13)
    assert len(at) == len(many) - 12 and all(at[i] == i + np.argmin(many[i : i + 13]) for i in range(p.BLOCK - 30, p.BLOCK + 30))


def test_stretches_of_long_words_come_in_small_frames():
    """A task hands stretches on by bytes as well as by rows, within one text too: as in languages without blanks, whose words are long."""
    rng = random.Random(8)
    pool = [f"{i:0500}" for i in range(500)]
    texts = [" ".join(rng.choice(pool) for _ in range(n)) for n in (20_000, 30, 3_000)]
    anchors = [np.unique(p.anchors_at(p.grams(p.words_of(t), p._Hashes()), 13)) for t in texts]
    batch = pd.DataFrame({"no": range(3), "text": texts, "anchor_from": [np.array([0])] * 3, "anchor_to": [np.array([len(a) - 1]) for a in anchors]})
    frames = list(p._stretch(20)(iter([batch])))
    assert max(f["words"].map(len).sum() for f in frames) < p.BYTES + p.CUT * 32 * 501
    found = pd.concat(frames)
    assert found["no"].value_counts().to_dict() == {n: len(a) for n, a in enumerate(anchors)}
    for no, text in enumerate(texts):
        words, own = p.words_of(text), found[found["no"] == no]
        assert own["at"].iloc[0] == 0 and own["at"].is_monotonic_increasing and own["words"].iloc[-1].split()[-1] == words[-1]
        assert all(said.split() == words[at : at + said.count(b" ") + 1] for at, said in zip(own["at"], own["words"]))
        # Windows of neighbouring stretches follow each other without a gap.
        assert (own["at"].iloc[:-1] + own["words"].iloc[:-1].map(lambda w: w.count(b" ") + 1 - 19)).tolist() == own["at"].iloc[1:].tolist()


def test_query_equals_sql(same_as_sql):
    assert any(r[3] for r in same_as_sql("op11_substring_dedup"))
