"""Data-quality profile and discount-band risk segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelens.schema import DISCOUNT_BAND_LABELS, QUALITY_COLUMNS

# reference column name -> our column
_QUALITY_SOURCE = {
    "Sales": "sales", "Profit": "profit", "Discount": "discount", "Quantity": "quantity",
    "shipping_days": "shipping_days", "Region": "region", "State": "state",
    "Category": "category", "Sub-Category": "sub_category",
}
_FLOATS = {"sales", "profit", "discount"}


def _as_text(c: Column, is_float: bool) -> Column:
    """Value as the text a float/int/str prints as (decimals print as doubles)."""
    return (c.cast("double") if is_float else c).cast("string")


def data_quality(ol: DataFrame) -> DataFrame:
    """Per profiled column: missing count, distinct non-null count and the first
    non-null value (smallest ``row_id``) as text, or 'N/A'.

    One global pass keeps, per column, the null count and the row with the
    smallest ``row_id`` (typed; only these nine values become text).  Distinct
    values are counted on typed (column, number, text) rows, de-duplicated by a
    hash aggregation before the shuffle, so a value held by a third of the rows
    collapses map-side.
    """
    source = [_QUALITY_SOURCE[name] for name in QUALITY_COLUMNS]
    number = {c for c in source if ol.schema[c].dataType.typeName() != "string"}
    one = ol.agg(*[F.count_if(F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(source)],
                 *[F.min(F.when(F.col(c).isNotNull(), F.struct(F.col("row_id").alias("r"), F.col(c).alias("v"))))
                   .alias(f"s{i}") for i, c in enumerate(source)])
    facts = one.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("at"), F.lit(name).alias("column"), F.col(f"m{i}").alias("missing_values"),
                 _as_text(F.col(f"s{i}.v"), c in _FLOATS).alias("sample"))
        for i, (name, c) in enumerate(zip(QUALITY_COLUMNS, source))])))
    long = ol.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("pos"),
                 (F.col(c) if c in number else F.lit(None)).cast("decimal(18,4)").alias("number"),
                 (F.lit(None) if c in number else F.col(c)).cast("string").alias("text"))
        for i, c in enumerate(source)]))).where("number is not null or text is not null")
    distinct = long.groupBy("pos", "number", "text").agg(F.lit(1).alias("one"))
    unique = distinct.groupBy("pos").agg(F.count(F.lit(1)).alias("n"))
    return (facts.join(F.broadcast(unique), facts["at"] == unique["pos"], "left")  # nine rows
            .select("at", "column", "missing_values", F.coalesce("n", F.lit(0)).cast("long").alias("unique_values"),
                    F.coalesce("sample", F.lit("N/A")).alias("sample_value"))
            .orderBy("at").drop("at"))


def discount_risk_segments(ol: DataFrame) -> DataFrame:
    """Mean sales, mean profit, loss rate and row count for all five discount
    bands, including bands no row falls in (null means, 0 rows).

    One global aggregate with one filtered measure set per band (partial
    aggregation in every task, a single tiny exchange), then one row per band.
    """
    band = F.col("discount_band")
    aggs = []
    for i, label in enumerate(DISCOUNT_BAND_LABELS):
        inb = band == label
        aggs += [
            F.sum(F.when(inb, F.col("sales"))).alias(f"ss{i}"), F.count(F.when(inb, F.col("sales"))).alias(f"sn{i}"),
            F.sum(F.when(inb, F.col("profit"))).alias(f"ps{i}"), F.count(F.when(inb, F.col("profit"))).alias(f"pn{i}"),
            F.sum(F.when(inb, F.col("is_loss"))).alias(f"ls{i}"), F.count(F.when(inb, F.lit(1))).alias(f"ln{i}"),
            F.count(F.when(inb, F.col("row_id"))).alias(f"rn{i}"),
        ]
    one = ol.agg(*aggs)
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(i + 1).alias("band_no"), F.lit(label).alias("discount_band"),
                 F.try_divide(F.col(f"ss{i}").cast("double"), F.col(f"sn{i}")).alias("avg_sales"),
                 F.try_divide(F.col(f"ps{i}").cast("double"), F.col(f"pn{i}")).alias("avg_profit"),
                 F.try_divide(F.col(f"ls{i}").cast("double"), F.col(f"ln{i}")).alias("loss_rate"),
                 F.col(f"rn{i}").alias("rows"))
        for i, label in enumerate(DISCOUNT_BAND_LABELS)]))).orderBy("band_no").drop("band_no")
