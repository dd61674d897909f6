"""Derived order-line columns (calendar, margin, bands, recency)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.functions.exprs import discount_band, ratio
from storelens.operators.ranking import KeyHistogram, rank_buckets, rank_buckets_kept
from storelens.schema import BASE_COLUMNS, DERIVED_COLUMNS, SALES_BAND_LABELS


def sales_band(df: DataFrame, histogram: KeyHistogram | None = None, **kw):
    """Quartile label of the sales rank (ties broken by ``row_id``), as a Column.

    Computed over every row of ``df``; null sales get no band and do not count.
    ``histogram``: the stored counts of (sales, row_id) of a stored table, which
    spare the scans of files that they cover.
    """
    n = len(SALES_BAND_LABELS)
    q = (rank_buckets(df, [F.col("sales"), F.col("row_id")], n, **kw) if histogram is None
         else rank_buckets_kept(df, histogram, n))
    labels = F.array(*[F.lit(x) for x in SALES_BAND_LABELS])
    return F.when(q.isNull(), F.lit(None).cast("string")).otherwise(F.element_at(labels, q))


def enrich(base: DataFrame, *, with_sales_band: bool = True, **kw) -> DataFrame:
    """Add ``order_year`` ... ``days_from_latest_order`` to canonical base columns.

    Columns of ``base`` beyond the canonical ones stay, between the base and
    the derived columns; an ``order_year`` that the table was partitioned by is
    used as it is, so that filters on it prune partitions.

    ``days_from_latest_order`` uses the table-wide latest order date as a scalar
    subquery (one tiny aggregate, broadcast to every task); ``sales_band`` needs
    three boundary keys found by :mod:`storelens.operators.ranking`.
    """
    od = F.col("order_date")
    latest = base.select(F.max("order_date")).scalar()
    extra = [c for c in base.columns if c not in BASE_COLUMNS and c not in DERIVED_COLUMNS]
    year = F.col("order_year").cast("int") if "order_year" in base.columns else F.year(od)
    cols = [F.col(f"`{c}`") for c in BASE_COLUMNS + extra] + [
        year.alias("order_year"),
        F.date_format(od, "yyyy-MM").alias("order_month"),
        F.trunc(od, "month").alias("order_month_ts"),
        F.concat(F.year(od).cast("string"), F.lit("Q"), F.quarter(od).cast("string")).alias("order_quarter"),
        F.datediff(F.col("ship_date"), od).alias("shipping_days"),
        F.coalesce(ratio("profit", "sales"), F.lit(0.0)).alias("profit_margin"),
        F.coalesce(F.col("profit") < 0, F.lit(False)).cast("int").alias("is_loss"),
        discount_band("discount").alias("discount_band"),
    ]
    if with_sales_band:
        cols.append(sales_band(base, **kw).alias("sales_band"))
    else:
        cols.append(F.lit(None).cast("string").alias("sales_band"))
    cols.append(F.datediff(latest, od).alias("days_from_latest_order"))
    return base.select(*cols)
