import subprocess
import sys
import time
from pathlib import Path

import __spark_entry__
from sievework.llm import common

OUTSIDE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
from sievework.llm import queries
print("ROWS", queries.op3_line_dedup(spark, {data!r}).count())
"""


def test_workers_need_no_installed_package(tmp_path, sf_dir):
    """From a folder where Python doesn't find the package by itself."""
    repo = str(Path(common.__file__).resolve().parents[2])
    out = subprocess.run([sys.executable, "-c", OUTSIDE.format(repo=repo, data=sf_dir)], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "ROWS 200" in out.stdout, out.stderr[-2000:]


def test_written_keeps_empty_tables(spark):
    df = common.written(spark.createDataFrame([], "a long, b array<string>"), "test")
    assert df.count() == 0 and df.schema.simpleString() == "struct<a:bigint,b:array<string>>"


def test_all_are_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= names


def test_written_leaves_no_shuffle_files(spark, tmp_path):
    """They go with the query that made them, not when the driver's garbage is next collected; the session's own setting stays."""
    dirs = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {f for d in dirs for f in Path(d).glob("*/shuffle_*.data")}
    before, was = files(), spark.conf.get(common.TIDY, None)
    df = spark.range(100_000).selectExpr("id % 50000 as k").groupBy("k").count()
    common.written(df, "tidy")
    for _ in range(30):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and spark.conf.get(common.TIDY, None) == was
    df.write.parquet(f"{tmp_path}/plain")
    assert files() - before
