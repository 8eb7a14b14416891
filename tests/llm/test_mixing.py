from collections import defaultdict

import pytest

from sievework.llm import mixing


def test_query_equals_sql(same_as_sql):
    rows = same_as_sql("op5_mix_sources")
    assert rows


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = set(), share * sum(sizes.values())
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        open_w = sum(w[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and left * w[s] / open_w > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in capped else left * w[s] / open_w for s in names}
        capped |= over


def test_targets_and_budgets(spark):
    docs = [(i, "w " * (1 + i % 7), None if i % 11 == 0 else f"s{i % 5 if i % 3 else 0}") for i in range(2000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.mix_sources(df, keep=["doc_id", "source"]).collect()
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        assert r.taken == r.copies * r.size <= 2 * r.size
    want = brute_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6
    assert sorted(rows, key=repr) == sorted(mixing.mix_sources(df.repartition(7), keep=["doc_id", "source"]).collect(), key=repr)


def test_weights_prefer_clean_text(spark):
    """Where half the words are wanted, clean documents are taken more often than noisy ones."""
    docs = [(i, "aaaa bbbb" if i % 2 else "$$$$ %%%%", "a") for i in range(2000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.mix_sources(df, keep=["doc_id"], share=0.5, weights=(1,)).collect()
    clean = sum(r.copies for r in rows if r.doc_id % 2)
    assert clean > 700 and sum(r.copies for r in rows) == 1000


def in_reach(rows):
    """Each source's taken words are within half of its largest document of the target."""
    taken, target, largest = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        taken[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
        assert r.taken == r.copies * r.size <= 2 * r.size
    return all(abs(taken[s] - t) <= largest[s] / 2 + 1e-6 for s, t in target.items())


@pytest.mark.parametrize("id_", [1, None])
def test_repeated_rows_are_taken_to_the_target(spark, monkeypatch, id_):
    monkeypatch.setattr(mixing, "PIECE_ROWS", 50)
    df = spark.createDataFrame([(id_, "a b c d e f g h i j", "s")] * 1000, "doc_id long, text string, source string").repartition(3)
    rows = mixing.mix_sources(df, keep=["source"]).collect()
    assert len(rows) == 1000 and sum(r.taken for r in rows) == 15_000 and {r.copies for r in rows} == {1, 2}
    assert mixing.mixed_documents(df).count() == 1500


@pytest.mark.parametrize("many", [5, 100_000])
def test_hot_bins_repeats_and_null_ids(spark, duck, monkeypatch, many):
    """Bins dealt again and again, keys crowded by a low weight, repeated rows at every cut: as the SQL."""
    from sievework.llm import queries

    monkeypatch.setattr(mixing, "MANY", many)
    monkeypatch.setattr(mixing, "BINS", 7)
    docs = [(None if i % 5 == 0 else i % 90, ("$% " if i % 2 else "w ") * (1 + i % 4), f"s{i % 3}") for i in range(900)]
    docs += [(7, None, None), (8, "", "s1"), (9, "", "none"), (9, "", "none")] + [(11, "x y z", "t")] * 31
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4)
    rows = mixing.mix_sources(df, keep=["doc_id", "source"]).collect()
    assert len(rows) == len(docs) and in_reach(rows)
    con = duck.cursor()
    con.sql("create schema if not exists mixed")
    con.sql("create or replace table mixed.documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into mixed.documents values (?, ?, ?)", docs)
    con.sql("use mixed")
    want = con.sql(queries.OP5_SQL.replace("from documents", "from mixed.documents")).fetchall()
    con.sql("use main")
    assert sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in rows), key=repr) == sorted(((w[0], w[1], w[2], round(w[3], 6), w[4]) for w in want), key=repr)


def test_null_ids_draw_apart(spark):
    df = spark.createDataFrame([(None, f"w {i}", "s") for i in range(3000)], "doc_id long, text string, source string")
    assert mixing.drawn(df, []).select("key").distinct().count() == 3000
    rows = mixing.mix_sources(df, keep=["source"], share=0.5, weights=(1,)).collect()
    assert sum(r.taken for r in rows) == 3000


def test_odd_rows(odd_docs, no_docs):
    mixed = mixing.mix_sources(odd_docs, keep=["doc_id", "size", "key", "copies"])
    assert mixed.columns == ["doc_id", "key", "size", "source_size", "target", "copies", "taken"]
    rows = mixed.collect()
    words = sorted((str(r.doc_id), len((r.text or "").encode().split())) for r in odd_docs.select("doc_id", "text").collect())
    assert sorted((str(r.doc_id), r["size"]) for r in rows) == words and {r["key"] for r in rows} == {"clash"}
    assert mixing.mix_sources(no_docs, keep=["doc_id"]).count() == 0
    rows = mixing.mix_sources(odd_docs.where("text is null"), keep=["doc_id"]).collect()
    assert [(r.size, r.target, r.taken) for r in rows] == [(0, 0.0, 0)] * 2


def test_rows_of_a_large_source_are_binned(spark, monkeypatch):
    """The rounds of bins see the sources' row counts, and leave at most MANY rows of a source to sort."""
    docs = spark.range(5_000).selectExpr("id doc_id", "concat('w', id) text", "if(id % 10 < 8, 'a', 'b') source")
    seen, kept = [], mixing.written
    monkeypatch.setattr(mixing, "written", lambda df, name, *a: [out := kept(df, name, *a), seen.append((name, out))][0])
    mixing.cuts_of(kept(mixing.drawn(docs, []), "drawn"))
    targets = next(df for name, df in seen if name == "mix-targets")
    assert {r.mix_source: r.n for r in targets.collect()} == {"a": 4_000, "b": 1_000}
    ends = [df for name, df in seen if name == "mix-ends"]
    assert ends and max(r.n for r in ends[-1].collect()) <= mixing.MANY
