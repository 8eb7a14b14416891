"""Structured Streaming jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.sources import shared_path


def event_days(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events per day and type with their summed value, over a stream or a table. State older than the watermark is dropped.

    Times without zone keep their own date in any session: they are taken as UTC, and so are the windows' days.
    """
    ts = F.col("ts")
    if events.schema["ts"].dataType.simpleString() == "timestamp_ntz":
        ts = F.concat(ts.cast("string"), F.lit("Z")).cast("timestamp")
    timed = events.withColumn("ts", ts).withWatermark("ts", late)
    days = timed.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n_events"), F.sum(F.floor("value").cast("long")).alias("sum_value"))
    day = F.date_from_unix_date(F.floor(F.unix_seconds("window.start") / 86_400).cast("int"))
    return days.select(day.alias("day"), "event_type", "n_events", "sum_value")


def stream_event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_days() over the events table read as a stream of files, until all that is there has been read."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/*events.parquet")
    out = shared_path(spark, "event-days")
    # Each batch's complete result replaces the one before: after a restart a batch may come again and does no harm.
    query = event_days(stream).writeStream.outputMode("complete").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return spark.read.parquet(out)
