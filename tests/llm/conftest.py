import duckdb
import os

import pytest

#: Names that the operators make or use inside; an input may have columns of these names too.
CLASHING = ["size", "shard", "slot", "cell", "id", "key", "score", "n", "component_id", "fingerprint", "group", "n_lines", "items", "copies", "law", "__row"]
ODD = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, "one two three four five six seven eight nine ten eleven twelve", "en", "a"),
    (3, "one two three four five six seven eight nine ten eleven twelve", "en", "a"),
    (4, "one two three four five six seven eight nine ten eleven twelve", None, None),
    (None, "no id\nhere", "en", "b"),
    (None, None, None, None),
    (5, " \t\r\n \x0b\x0c", "de", "b"),
    (6, "x" * 300_000, "en", "b"),
    (7, "wörd " * 60_000, "fr", "c"),
    (8, "日本語 \U000130c0 <s> [INST]", "ja", "c"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    return df.withColumn("n_chars", F.length("text").cast("long")).withColumns({c: F.lit("clash") for c in CLASHING})


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in os.listdir(sf_dir):
        if t.endswith(".parquet"):
            con.sql(f"create view {t[:-8]} as select * from read_parquet('{sf_dir}/{t}')")
    return con


@pytest.fixture(scope="session")
def same_as_sql(spark, sf_dir, duck):
    """Asserts that a registered query gives the rows of its SQL."""

    def check(name):
        from sievework.llm import queries

        df = queries.queries()[name](spark, sf_dir)
        rel = duck.sql(queries.oracle_sql()[name])
        assert sorted(df.columns) == sorted(rel.columns)
        order = [rel.columns.index(c) for c in sorted(rel.columns)]
        got = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)
        want = sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=repr)
        assert got == want
        return got

    return check
