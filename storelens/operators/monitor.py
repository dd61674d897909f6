"""Operations monitor: recent orders, snapshot measures and the daily pulse.

The newest rows of a table partitioned by ``order_year`` lie in its last
partitions: their names are read, newest first, until enough rows (or days) are
covered, and only those partitions are scanned.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.functions.exprs import mean, money_text
from storelens.operators.summaries import top_k, total


def dated(ol: DataFrame, date_col: str | None = None) -> DataFrame:
    """Rows with a usable order date (unparseable text -> dropped).

    Resolves the date column as the monitor does: ``Order Date`` if present,
    else ``order_date``.
    """
    if date_col is None:
        date_col = "Order Date" if "Order Date" in ol.columns else "order_date"
    c = F.col(f"`{date_col}`")
    dtype = ol.schema[date_col].dataType.typeName()
    if dtype not in ("date", "timestamp", "timestamp_ntz"):
        c = F.try_to_timestamp(c.cast("string")).cast("date")
    return ol.withColumn("order_date", c.cast("date")).where(F.col("order_date").isNotNull())


def newest(ol: DataFrame, covered: Callable[[DataFrame], int], wanted: int) -> DataFrame:
    """The newest ``order_year`` partitions in which ``covered`` counts ``wanted`` or more; all of ``ol`` if it is not
    stored by year or never has as many."""
    if "order_year" not in ol.columns or "Order Date" in ol.columns:
        return ol
    files = ol.inputFiles()
    found = {m.group(1) for m in (re.search(r"/order_year=(\d+)/", f) for f in files) if m}
    if len(found) < 2 or any("/order_year=" not in f for f in files):
        return ol
    years = sorted(map(int, found), reverse=True)
    got = 0
    for i, year in enumerate(years):  # days and rows of different years add up
        got += covered(ol.where(F.col("order_year") == year))
        if got >= wanted:
            return ol.where(F.col("order_year").isin(years[:i + 1]))
    return ol


def _rows(part: DataFrame) -> int:
    return part.where(F.col("order_date").isNotNull()).count()


def _days(part: DataFrame) -> int:
    return part.agg(F.count_distinct("order_date")).first()[0]


def recent_orders(ol: DataFrame, k: int = 12) -> DataFrame:
    """Newest ``k`` order lines (ties: ``row_id``) with risk flag and money text."""
    recent = top_k(dated(newest(ol, _rows, k)), k, F.desc("order_date"), "row_id")
    return recent.select(
        "order_date", "order_id", "customer_name", "category", "sub_category", "region",
        money_text("sales").alias("sales_text"), money_text("profit").alias("profit_text"),
        F.when(F.col("profit") < 0, F.lit("High Risk")).otherwise(F.lit("Normal")).alias("risk_flag"))


def monitor_snapshot(ol: DataFrame, k: int = 12) -> DataFrame:
    """Counts and means over the ``k`` newest order lines."""
    recent = top_k(dated(newest(ol, _rows, k)), k, F.desc("order_date"), "row_id")
    return recent.agg(
        F.count(F.lit(1)).alias("recent_orders"),
        F.count_if(F.col("profit") < 0).alias("negative_profit_orders"),
        F.coalesce(mean("shipping_days"), F.lit(0.0)).alias("avg_shipping_days"),
        F.coalesce(mean("discount"), F.lit(0.0)).alias("avg_discount"))


def daily_pulse(ol: DataFrame, days: int = 14) -> DataFrame:
    """Sales, profit and distinct orders of the latest ``days`` order days."""
    d = (dated(newest(ol, _days, days)).groupBy(F.col("order_date").alias("order_day"))
         .agg(total("sales").alias("sales"), total("profit").alias("profit"),
              F.count_distinct("order_id").alias("orders")))
    return top_k(d, days, F.desc("order_day")).orderBy("order_day")
