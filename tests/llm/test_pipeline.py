import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline as p
from sievework import sources
from sievework.llm import queries

from .test_near_copies import brute_least

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's input and output as lists of rows, from its real predecessor."""
    docs = p.table(spark, SF, "documents")
    seen = {}
    for name, stage in p.STAGES:
        out = p.written(stage(spark, docs, SF), f"test-{name}")
        seen[name] = (docs.collect(), out.collect())
        if name != "shard":
            assert out.schema.simpleString() == docs.schema.simpleString()
        docs = out
    return seen


def test_quality(spark, stages):
    before, after = stages["quality"]
    rejected = {r.doc_id for r in queries.op1_quality_classifier(spark, SF).collect() if not r.predicted}
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before if r.doc_id not in rejected) and rejected


def test_near_dedup(stages):
    before, after = stages["near_dedup"]
    rows = sorted(before, key=lambda r: r.doc_id)
    least = brute_least([" ".join(b.decode() for b in (r.text or "").encode().lower().split()) for r in rows])
    want, kept = {rows[x].doc_id for x in least}, [r.doc_id for r in after]
    assert sorted(kept) == sorted(want)


def sql_rows(sql, docs, more=""):
    """The rows of a query's SQL with a stage's input as the documents."""
    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", [(r.doc_id, r.text, r.source) for r in docs])
    con.sql(f"create view benchmark as select * from read_parquet('{SF}/benchmark.parquet')")
    found = con.sql(sql)
    return [dict(zip(found.columns, r)) for r in found.fetchall()]


def test_decontaminate(stages):
    """Every document, against op4's SQL on the stage's own input."""
    before, after = stages["decontaminate"]
    clean = {r["doc_id"] for r in sql_rows(queries.OP4_SQL, before) if not r["contaminated"]}
    assert sorted(r.doc_id for r in after) == sorted(clean) and len(clean) < len(before)


def test_mix(stages):
    """Every document, against op5's SQL on the stage's own input; a text without words adds nothing however often it is taken."""
    before, after = stages["mix"]
    times = Counter(r.doc_id for r in after)
    want = sql_rows(queries.OP5_SQL, before)
    assert all(times[r["doc_id"]] * r["size"] == r["taken"] for r in want) and set(times) <= {r["doc_id"] for r in want}
    assert set(times.values()) == {1, 2}


def test_shard(stages):
    before, after = stages["shard"]
    assert Counter((r.doc_id, r.text) for r in after) == Counter((r.doc_id, r.text) for r in before)
    slots, loads, of_text = defaultdict(list), defaultdict(int), defaultdict(set)
    for r in after:
        slots[r.shard].append(r.slot)
        loads[r.shard] += r.size
        of_text[r.text].add(r.shard)
        assert (r.size, r.text_crc32) == (len(r.text.encode()) + 1, zlib.crc32(r.text.encode()))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(len(s) == 1 for s in of_text.values())


def test_registered(spark):
    assert "pipeline" in __spark_entry__.queries() and len(p.STAGES) == 5
    assert p.run(spark, SF).count() > 0


def test_odd_rows(spark, odd_docs, no_docs, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(1, 1, 0), (3, 1, 0), (7, 0, 0), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "no such words here at all"), (2, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    for docs in (odd_docs, no_docs):
        for name, stage in p.STAGES:
            out = stage(spark, docs, sf)
            n = out.count()
            assert n <= docs.count() * (2 if name == "mix" else 1)
            if name != "shard":
                assert out.columns == docs.columns
    kept = stage_named("near_dedup")(spark, odd_docs, sf).collect()
    assert Counter(r.doc_id for r in kept)[3] == 1 and not any(r.doc_id == 4 for r in kept)
    assert [r.text for r in kept if r.doc_id is None] == ["no id\nhere"] and sum(not (r.text or "").strip() for r in kept) == 1


def stage_named(name):
    return dict(p.STAGES)[name]


#: Names that stages and operators use, or once used, inside.
INNER = ["copy", "__copy", "__text", "__more", "__score", "__found", "copies", "score", "found", "node", "id", "in_0", "n", "kept_id", "mix_id", "taken", "key", "of_source", "at", "piece", "_score"]


def test_columns_of_any_name_come_through(spark, sf_dir, odd_docs):
    """All five stages: the values of every column, not just their names."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").unionByName(odd_docs.select("doc_id", "text", "lang", "source", "n_chars"))
    docs = docs.withColumns({c: F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in INNER})
    for name, stage in p.STAGES:
        out = p.written(stage(spark, docs, sf_dir), f"test-{name}")
        assert out.columns[: len(docs.columns)] == docs.columns
        rows = out.collect()
        assert rows
        for r in rows:
            for c in INNER:
                assert r[c] == f"{c} of {'none' if r.doc_id is None else r.doc_id}", (name, c)
        docs = out


def test_run_leaves_only_its_result(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sources, "shared_dir", lambda spark: str(tmp_path))
    rows = p.run(spark, SF).collect()
    left = [x.name for x in tmp_path.iterdir()]
    assert rows and len(left) == 1 and left[0].startswith("stage-shard")
