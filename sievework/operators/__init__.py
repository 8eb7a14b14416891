"""Operators over any DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group. Tasks cut each group to ``k`` rows before the shuffle, so a hot group costs no more than others."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn(rank, n).where(F.col(rank) <= k)


def sessions(df: DataFrame, by: str, at: str, gap: str, *aggregates: Column) -> DataFrame:
    """One row per session: rows of a ``by`` that follow each other within ``gap`` are one. Tasks merge their own rows before the shuffle."""
    found = df.groupBy(by, F.session_window(at, gap).alias("session")).agg(*aggregates)
    return found.select(F.col("session.start").alias("started"), F.col("session.end").alias("ended"), *(c for c in found.columns if c != "session"))
