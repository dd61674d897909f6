"""Recency-frequency-monetary scoring of customers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.operators.ranking import rank_buckets_many
from storelens.operators.rollup import Rollup, source
from storelens.operators.summaries import keys_present, top_k
from storelens.schema import RFM_DEFAULT_SEGMENT, RFM_SEGMENTS
from storelens.sources.sinks import stored


def rfm_summary(ol: DataFrame | Rollup, **kw) -> DataFrame:
    """Per customer: recency (days before the frame's latest order), distinct
    orders, sales and profit, three quartile scores and a segment label.

    Scores are exact rank quartiles (ties broken by customer id, then name):
    recency ranks descending days, frequency and monetary ascending.  The
    customer aggregate is written once; one search of
    :mod:`storelens.operators.ranking` over it finds the boundaries of all
    three orderings, and the result reads it again.  No window spans all
    customers.
    """
    keys = ["customer_id", "customer_name"]
    src, m = source(ol, keys)
    latest = src.select(m.last_order()).scalar()
    cust = stored(
        keys_present(src, keys).groupBy(*keys)
            .agg(m.last_order().alias("last_order"),
                 m.orders().alias("frequency"),
                 m.total("sales").alias("monetary_dec"),
                 m.total("profit").alias("profit_dec"))
            .select(*keys, F.datediff(latest, F.col("last_order")).alias("recency_days"),
                    "frequency", "monetary_dec", "profit_dec"), "customers")
    tie = [F.col("customer_id"), F.col("customer_name")]
    r, f, mo = rank_buckets_many(cust, [[-F.col("recency_days")] + tie, [F.col("frequency")] + tie,
                                       [F.col("monetary_dec")] + tie], 4, **kw)
    score = F.col("recency_score") + F.col("frequency_score") + F.col("monetary_score")
    seg = F.when(F.lit(False), F.lit(None))
    for threshold, label in RFM_SEGMENTS:
        seg = seg.when(F.col("rfm_score") >= threshold, F.lit(label))
    seg = seg.otherwise(F.lit(RFM_DEFAULT_SEGMENT))
    return (cust.select(*keys, "recency_days", "frequency",
                        F.col("monetary_dec").cast("double").alias("monetary"),
                        F.col("profit_dec").cast("double").alias("profit"),
                        r.alias("recency_score"), f.alias("frequency_score"), mo.alias("monetary_score"))
            .withColumn("rfm_score", score)
            .withColumn("rfm_segment", seg))


def ranked(rfm: DataFrame) -> DataFrame:
    """The customers in display order: best score first, then largest monetary value."""
    return rfm.orderBy(F.desc("rfm_score"), F.desc("monetary"), "customer_id")


def rfm_segments(rfm: DataFrame) -> DataFrame:
    """Customers and summed monetary value per RFM segment."""
    return (rfm.groupBy("rfm_segment")
            .agg(F.count("customer_id").alias("customers"),
                 # monetary holds exact 4-decimal sums: add them as decimals again
                 F.sum(F.col("monetary").cast("decimal(38,4)")).cast("double").alias("sales"))
            .orderBy("rfm_segment"))


def rfm_watchlist(rfm: DataFrame, k: int = 20) -> DataFrame:
    """Highest-scoring customers (score, then monetary value)."""
    return top_k(rfm, k, F.desc("rfm_score"), F.desc("monetary"), "customer_id").select(
        "customer_name", "recency_days", "frequency", "monetary", "profit", "rfm_segment")
