"""Queries over the star-schema and event tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework import operators, streaming
from sievework.functions import json_long, net_price
from sievework.sources import table


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items shipped up to a date, by return flag and line status. One shuffle of a few partial sums."""
    lines = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02 00:00:00'")
    return lines.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("count_order"),
        F.sum("l_quantity").alias("sum_qty"),
        F.round(F.sum(net_price()), 2).alias("sum_disc_price"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"),
    )


def top_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five customers of each market segment who ordered most. Orders are summed per customer before the join."""
    spent = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("spent"), F.count("*").alias("n_orders"))
    named = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment").join(spent, F.col("c_custkey") == F.col("o_custkey"))
    best = operators.top_k(named, ["c_mktsegment"], [F.desc("spent"), F.asc("c_custkey")], 5)
    return best.select("c_mktsegment", F.col("rank").cast("long").alias("rank"), "c_custkey", "c_name", "spent", "n_orders")


def revenue_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net revenue by the supplier's region and nation. Lines are summed per supplier before the joins."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(net_price()).alias("net"), F.count("*").alias("n"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("r_name", "n_name").agg(F.round(F.sum("net"), 2).alias("revenue"), F.sum("n").alias("n_lines"))


def orders_without_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice").join(lines, "o_orderkey", "left_anti")


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users with gaps of less than eight hours."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", json_long("props", "k").alias("k"))
    return operators.sessions(events, "user_id", "ts", "8 hours", F.count("*").alias("n_events"), F.sum("k").alias("sum_k"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pricing_summary": pricing_summary,
        "top_customers": top_customers,
        "revenue_by_nation": revenue_by_nation,
        "orders_without_lines": orders_without_lines,
        "user_sessions": user_sessions,
        "stream_event_days": streaming.stream_event_days,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "pricing_summary": """
            select l_returnflag, l_linestatus, count(*) as count_order, sum(l_quantity) as sum_qty,
              round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc_price, round(avg(l_discount), 6) as avg_disc
            from lineitem where l_shipdate <= timestamp '1998-09-02 00:00:00' group by all""",
        "top_customers": """
            select c_mktsegment, row_number() over (partition by c_mktsegment order by spent desc, c_custkey) as rank, c_custkey, c_name, spent, n_orders
            from customer join (select o_custkey, round(sum(o_totalprice), 2) as spent, count(*) as n_orders from orders group by 1) on c_custkey = o_custkey
            qualify rank <= 5""",
        "revenue_by_nation": """
            select r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, count(*) as n_lines
            from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
            group by all""",
        "orders_without_lines": """
            select o_orderkey, o_custkey, o_totalprice from orders where o_orderkey not in (select l_orderkey from lineitem)""",
        "user_sessions": """
            with e as (select user_id, ts, cast(json_extract_string(props, '$.k') as bigint) as k,
              case when ts < lag(ts) over (partition by user_id order by ts, event_id) + interval 8 hours then 0 else 1 end as new from events),
            s as (select *, sum(new) over (partition by user_id order by ts, new desc rows unbounded preceding) as n from e)
            select user_id, min(ts) as started, max(ts) + interval 8 hours as ended, count(*) as n_events, sum(k)::bigint as sum_k from s group by user_id, n""",
        "stream_event_days": """
            select cast(ts as date) as day, event_type, count(*) as n_events, sum(floor(value)::bigint)::bigint as sum_value from events group by 1, 2""",
    }
