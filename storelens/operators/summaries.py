"""Grouped summaries of order lines (partial + final hash aggregation).

Summaries with an :class:`~storelens.operators.rollup.Rollup` in place of the
lines read the stored table that covers their keys; results are the same.
Group keys follow pandas ``groupby`` defaults: rows with a null key are
dropped, sums of all-null values are 0, means skip nulls.  Money sums are
exact decimal sums cast to double at the end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storelens.functions.exprs import growth, mean
from storelens.operators.rollup import Rollup, source


def keys_present(df: DataFrame, keys: list[str]) -> DataFrame:
    """Drop rows whose group key has a null part (pandas ``dropna=True``)."""
    return df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))


def total(c: str) -> Column:
    """Exact sum (0 for an all-null group) as double."""
    return F.coalesce(F.sum(c), F.lit(0)).cast("double")


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """``orderBy(...).limit(k)``: planned as TakeOrderedAndProject (per-task top k)."""
    return df.orderBy(*order).limit(k)


def customer_summary(ol: DataFrame | Rollup) -> DataFrame:
    keys = ["customer_id", "customer_name", "segment"]
    src, m = source(ol, keys)
    return (keys_present(src, keys).groupBy(*keys)
            .agg(total("sales").alias("sales"), total("profit").alias("profit"),
                 m.orders().alias("orders"), m.mean("discount").alias("avg_discount"),
                 m.last_order().alias("last_order"))
            .orderBy(F.desc("sales"), F.desc("profit"), "customer_id"))


def state_summary(ol: DataFrame | Rollup) -> DataFrame:
    keys = ["state", "region"]
    src, m = source(ol, keys)
    return (keys_present(src, keys).groupBy(*keys)
            .agg(total("sales").alias("sales"), total("profit").alias("profit"),
                 m.orders().alias("orders"), m.mean("discount").alias("avg_discount"))
            .orderBy(F.desc("sales"), "state", "region"))


def monthly_base(ol: DataFrame | Rollup) -> DataFrame:
    """Per present month: exact decimal sales/profit sums and distinct orders."""
    keys = ["order_month", "order_month_ts"]
    src, m = source(ol, keys)
    return (keys_present(src, keys).groupBy(*keys)
            .agg(m.total("sales").alias("sales_dec"), m.total("profit").alias("profit_dec"),
                 m.orders().alias("orders")))


def monthly_summary(ol: DataFrame | Rollup) -> DataFrame:
    """Monthly totals with month-over-month growth over *present* months.

    The window runs on the aggregated frame (one row per month), never on the
    order lines, so its single partition stays tiny at any scale.
    """
    m = monthly_base(ol)
    w = Window.orderBy("order_month_ts")
    sales = F.col("sales_dec").cast("double")
    profit = F.col("profit_dec").cast("double")
    return (m.select("order_month", "order_month_ts", sales.alias("sales"), profit.alias("profit"), "orders")
            .select("*",
                    growth("sales", F.lag("sales").over(w)).alias("sales_growth_pct"),
                    growth("profit", F.lag("profit").over(w)).alias("profit_growth_pct"))
            .orderBy("order_month_ts"))


def region_summary(ol: DataFrame | Rollup) -> DataFrame:
    src, m = source(ol, ["region"])
    return (keys_present(src, ["region"]).groupBy("region")
            .agg(total("sales").alias("sales"), total("profit").alias("profit"),
                 m.mean("discount").alias("avg_discount"))
            .orderBy(F.desc("sales"), "region"))


def category_summary(ol: DataFrame | Rollup) -> DataFrame:
    src, m = source(ol, ["category"])
    return (keys_present(src, ["category"]).groupBy("category")
            .agg(total("sales").alias("sales"), total("profit").alias("profit"),
                 m.orders().alias("orders"))
            .orderBy(F.desc("sales"), "category"))


def subcategory_summary(ol: DataFrame | Rollup) -> DataFrame:
    src, m = source(ol, ["sub_category"])
    return (keys_present(src, ["sub_category"]).groupBy("sub_category")
            .agg(total("sales").alias("sales"), total("profit").alias("profit"),
                 m.mean("discount").alias("avg_discount"))
            .orderBy("sub_category"))


def sales_by_year(ol: DataFrame) -> DataFrame:
    return (keys_present(ol, ["order_year"]).groupBy("order_year")
            .agg(total("sales").alias("sales")).orderBy("order_year"))


def sales_by_category(ol: DataFrame | Rollup) -> DataFrame:
    return (keys_present(source(ol, ["category"])[0], ["category"]).groupBy("category")
            .agg(total("sales").alias("sales")).orderBy(F.desc("sales"), "category"))


def profit_by_category(ol: DataFrame | Rollup) -> DataFrame:
    return (keys_present(source(ol, ["category"])[0], ["category"]).groupBy("category")
            .agg(total("profit").alias("profit")).orderBy(F.desc("profit"), "category"))


def profit_by_subcategory(ol: DataFrame | Rollup) -> DataFrame:
    return (keys_present(source(ol, ["sub_category"])[0], ["sub_category"]).groupBy("sub_category")
            .agg(total("profit").alias("profit")).orderBy("profit", "sub_category"))


def profit_by_discount(ol: DataFrame) -> DataFrame:
    """Mean profit per exact discount level (grouped on the decimal value)."""
    return (keys_present(ol, ["discount"]).groupBy("discount")
            .agg(mean("profit").alias("avg_profit"))
            .select(F.col("discount").cast("double").alias("discount"), "avg_profit")
            .orderBy("discount"))


def sales_by_region(ol: DataFrame | Rollup) -> DataFrame:
    return (keys_present(source(ol, ["region"])[0], ["region"]).groupBy("region")
            .agg(total("sales").alias("sales")).orderBy(F.desc("sales"), "region"))


def monthly_sales_trend(ol: DataFrame | Rollup, months: int = 18) -> DataFrame:
    """Sales of the last ``months`` present months, oldest first."""
    src, _ = source(ol, ["order_month"])
    m = keys_present(src, ["order_month"]).groupBy("order_month").agg(total("sales").alias("sales"))
    return top_k(m, months, F.desc("order_month")).orderBy("order_month")


def top_states(ol: DataFrame | Rollup, k: int = 20) -> DataFrame:
    return top_k(state_summary(ol), k, F.desc("sales"), "state", "region")


def top_customers(ol: DataFrame | Rollup, k: int = 20) -> DataFrame:
    return top_k(customer_summary(ol), k, F.desc("sales"), F.desc("profit"), "customer_id")


def top_customers_total(ol: DataFrame | Rollup, k: int = 10) -> DataFrame:
    """Top customers by total sales (the chart script's variant, no segment key)."""
    keys = ["customer_id", "customer_name"]
    src, m = source(ol, keys)
    g = (keys_present(src, keys).groupBy(*keys)
         .agg(total("sales").alias("total_sales"), total("profit").alias("total_profit"),
              m.orders().alias("orders")))
    return top_k(g, k, F.desc("total_sales"), "customer_id", "customer_name")
