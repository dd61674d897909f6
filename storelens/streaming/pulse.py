"""The daily order pulse as a Structured Streaming job.

Order-line files (canonical base columns, Parquet) arriving in a directory
are aggregated per order day: sales, profit and distinct orders.  Distinct
orders are exact: lines are first combined per (day, order) and the days are
then aggregated over those groups (two chained event-time aggregations with
one watermark, append mode).  A day is emitted once the watermark passes its
end, so late lines within ``late_delay`` are still counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.schema import ORDER_LINE_SCHEMA


def read_order_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(ORDER_LINE_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def daily_pulse_stream(lines: DataFrame, late_delay: str = "2 days") -> DataFrame:
    """Streaming frame: order_day, sales, profit, orders (one row per closed day)."""
    timed = (lines.where(F.col("order_date").isNotNull())
             .withColumn("event_ts", F.col("order_date").cast("timestamp"))
             .withWatermark("event_ts", late_delay))
    per_order = (timed.groupBy(F.window("event_ts", "1 day").alias("w"), "order_id")
                 .agg(F.sum("sales").alias("s"), F.sum("profit").alias("p")))
    per_day = (per_order.groupBy(F.window(F.window_time("w"), "1 day").alias("d"))
               .agg(F.sum("s").alias("s"), F.sum("p").alias("p"), F.count("order_id").alias("orders")))
    return per_day.select(F.col("d.start").cast("date").alias("order_day"),
                          F.coalesce(F.col("s"), F.lit(0)).cast("double").alias("sales"),
                          F.coalesce(F.col("p"), F.lit(0)).cast("double").alias("profit"),
                          "orders")


def start_pulse(spark: SparkSession, in_path: str, out_path: str, checkpoint: str, *,
                late_delay: str = "2 days", trigger: dict | None = None):
    """Run the pulse into a Parquet sink (exactly-once via the checkpoint)."""
    q = (daily_pulse_stream(read_order_stream(spark, in_path), late_delay)
         .writeStream.outputMode("append").format("parquet")
         .option("path", out_path).option("checkpointLocation", checkpoint))
    q = q.trigger(**(trigger or {"processingTime": "1 minute"}))
    return q.start()
