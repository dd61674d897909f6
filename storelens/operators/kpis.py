"""Executive KPIs, metric tables and headline facts (one-pass global aggregates)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storelens.functions.exprs import fixed_text, mean, pct_text, ratio, relative_change, round_half_away
from storelens.operators.rollup import Rollup, source
from storelens.operators.summaries import monthly_base


def _rows(df: DataFrame, pairs: list[tuple[str, Column]], name: str = "metric",
          value: str = "value") -> DataFrame:
    """Turn a one-row frame of measures into ``(name, value)`` rows (no union)."""
    return df.select(F.inline(F.array(*[
        F.struct(F.lit(label).alias(name), v.cast("double").alias(value)) for label, v in pairs])))


def customers(ol: DataFrame | Rollup) -> Column:
    """Distinct customers of the whole table, as an aggregate or the merged bitmaps' count."""
    if isinstance(ol, Rollup):
        return ol.customer_count().select("customers").scalar()
    return F.count_distinct("customer_id")


def executive_kpis(ol: DataFrame | Rollup) -> DataFrame:
    """Totals, margin, loss rate, and latest vs previous present month deltas.

    Totals come from one global aggregate; the month deltas from the small
    monthly aggregate (``lag`` on ~10^2 rows), attached as a scalar subquery.
    """
    m = monthly_base(ol)
    w = Window.orderBy("order_month_ts")
    last = (m.select("order_month_ts",
                     F.col("sales_dec").cast("double").alias("s"),
                     F.col("profit_dec").cast("double").alias("p"),
                     F.lag(F.col("sales_dec").cast("double")).over(w).alias("ps"),
                     F.lag(F.col("profit_dec").cast("double")).over(w).alias("pp"))
            .agg(F.max_by(F.struct(relative_change("s", "ps").alias("sd"),
                                   relative_change("p", "pp").alias("pd")),
                          F.col("order_month_ts")).alias("d")))
    deltas = last.select("d").scalar()
    src, of = source(ol, [])
    tot = src.agg(F.coalesce(F.sum("sales"), F.lit(0)).cast("double").alias("total_sales"),
                  F.coalesce(F.sum("profit"), F.lit(0)).cast("double").alias("total_profit"),
                  of.orders().alias("total_orders"),
                  customers(ol).alias("total_customers"),
                  F.coalesce(of.mean("is_loss"), F.lit(0.0)).alias("loss_rate"))
    return tot.select(
        "total_sales", "total_profit", "total_orders", "total_customers",
        F.coalesce(ratio("total_profit", "total_sales"), F.lit(0.0)).alias("profit_margin"),
        "loss_rate",
        F.coalesce(deltas["sd"], F.lit(0.0)).alias("sales_delta"),
        F.coalesce(deltas["pd"], F.lit(0.0)).alias("profit_delta"))


def kpi_cards(ol: DataFrame | Rollup) -> DataFrame:
    """The six headline cards as display texts: (pos, label, value, delta)."""
    k = executive_kpis(ol)
    cards = [("Revenue", fixed_text("total_sales", 2, "$", "M", 1_000_000), pct_text("sales_delta")),
             ("Net Profit", fixed_text("total_profit", 0, "$", "K", 1_000), pct_text("profit_delta")),
             ("Profit Margin", pct_text("profit_margin"), None),
             ("Orders", F.format_string("%,d", "total_orders"), None),
             ("Customers", F.format_string("%,d", "total_customers"), None),
             ("Loss-Making Orders", pct_text("loss_rate"), None)]
    return k.select(F.inline(F.array(*[
        F.struct(F.lit(i + 1).alias("pos"), F.lit(label).alias("label"), value.alias("value"),
                 (F.lit(None) if delta is None else delta).cast("string").alias("delta"))
        for i, (label, value, delta) in enumerate(cards)])))


def report_money(ol: DataFrame | Rollup) -> DataFrame:
    """The report's money lines (two decimals): total sales and total profit as text."""
    return executive_kpis(ol).select(fixed_text("total_sales", 2, "$").alias("total_sales_text"),
                                     fixed_text("total_profit", 2, "$").alias("total_profit_text"))


def _totals(ol: DataFrame | Rollup) -> DataFrame:
    src, of = source(ol, [])
    return src.agg(F.sum("sales").alias("s"), F.sum("profit").alias("p"), of.orders().alias("o"),
                   customers(ol).alias("c"), of.mean("shipping_days").alias("ship"), of.mean("is_loss").alias("loss"),
                   of.mean("discount").alias("disc"))


def kpi_summary(ol: DataFrame | Rollup) -> DataFrame:
    """Batch KPI table (data rows; model metrics are appended by the batch job)."""
    t = _totals(ol)
    return _rows(t, [
        ("Total sales", F.round("s", 2)),
        ("Total profit", F.round("p", 2)),
        ("Profit margin", round_half_away(ratio("p", "s"), 4)),
        ("Orders", F.col("o")),
        ("Customers", F.col("c")),
        ("Average shipping days", round_half_away("ship", 2)),
        ("Loss row rate", round_half_away("loss", 4)),
    ])


def kpi_summary_compact(ol: DataFrame | Rollup) -> DataFrame:
    """KPI table of the chart job: adds average discount, no loss rate."""
    t = _totals(ol)
    return _rows(t, [
        ("Total Sales", F.round("s", 2)),
        ("Total Profit", F.round("p", 2)),
        ("Profit Margin", round_half_away(ratio("p", "s"), 4)),
        ("Average Discount", round_half_away("disc", 4)),
        ("Average Shipping Days", round_half_away("ship", 2)),
        ("Orders", F.col("o")),
        ("Customers", F.col("c")),
    ])


def model_metric_rows(spark, accuracy: float, r2: float, precision: float, recall: float) -> DataFrame:
    """The four model rows of the batch KPI table (values from fitted models)."""
    rows = [("Loss model accuracy", accuracy), ("Profit model R2", r2),
            ("Loss model precision", precision), ("Loss model recall", recall)]
    return spark.createDataFrame([(k, float(round(v, 4))) for k, v in rows], "metric string, value double")


def dataset_snapshot(ol: DataFrame) -> DataFrame:
    return ol.agg(F.count(F.lit(1)).alias("rows"),
                  F.min("order_year").alias("first_year"), F.max("order_year").alias("last_year"),
                  F.sum("sales").cast("double").alias("total_sales"),
                  F.sum("profit").cast("double").alias("total_profit")).select(
        "rows", "first_year", "last_year", "total_sales", "total_profit",
        ratio("total_profit", "total_sales").alias("profit_margin"))


def insight_facts(ol: DataFrame) -> DataFrame:
    """Headline facts with their labels, from one grouping-sets pass.

    Category, region, sub-category and exact-discount groupings plus the grand
    total are computed in a single scan (``groupingSets``); arg-max/arg-min
    pick the smallest label among ties.
    """
    g = ol.groupingSets(
        [["category"], ["region"], ["sub_category"], ["discount"], []],
        "category", "region", "sub_category", "discount",
    ).agg(F.grouping_id().alias("gid"),
          F.coalesce(F.sum("sales"), F.lit(0)).cast("double").alias("sales"),
          F.coalesce(F.sum("profit"), F.lit(0)).cast("double").alias("profit"),
          mean("profit").alias("avg_profit"),
          mean("discount").alias("avg_discount"), mean("shipping_days").alias("avg_ship"),
          mean("is_loss").alias("loss_rate"))
    # grouping_id bits follow the column order: category=8, region=4, sub_category=2, discount=1
    is_cat, is_reg, is_sub, is_disc, is_all = (F.col("gid") == 7, F.col("gid") == 11,
                                               F.col("gid") == 13, F.col("gid") == 14, F.col("gid") == 15)

    def arg(label: Column, value: Column, cond: Column, largest: bool):
        v = F.when(cond & label.isNotNull(), F.struct((-value if largest else value).alias("v"),
                                                      label.alias("l")))
        best = F.min(v)
        return best["l"], (-best["v"] if largest else best["v"])

    cat_l, cat_v = arg(F.col("category"), F.col("sales"), is_cat, True)
    reg_l, reg_v = arg(F.col("region"), F.col("sales"), is_reg, True)
    subp_l, subp_v = arg(F.col("sub_category"), F.col("profit"), is_sub, True)
    subw_l, subw_v = arg(F.col("sub_category"), F.col("profit"), is_sub, False)
    disc_l, disc_v = arg(F.col("discount").cast("double").cast("string"), F.col("avg_profit"),
                         is_disc & F.col("avg_profit").isNotNull(), False)
    total_of = lambda c: F.max(F.when(is_all, F.col(c)))
    one = g.agg(
        total_of("sales").alias("total_sales"), total_of("profit").alias("total_profit"),
        total_of("avg_discount").alias("avg_discount"), total_of("avg_ship").alias("avg_ship"),
        total_of("loss_rate").alias("loss_rate"),
        cat_l.alias("cat_l"), cat_v.alias("cat_v"), reg_l.alias("reg_l"), reg_v.alias("reg_v"),
        subp_l.alias("subp_l"), subp_v.alias("subp_v"), subw_l.alias("subw_l"), subw_v.alias("subw_v"),
        disc_l.alias("disc_l"), disc_v.alias("disc_v"))
    none = F.lit(None).cast("string")
    facts = [
        ("total_sales", none, F.col("total_sales")),
        ("total_profit", none, F.col("total_profit")),
        ("profit_margin", none, ratio("total_profit", "total_sales")),
        ("average_discount", none, F.col("avg_discount")),
        ("average_shipping_days", none, F.col("avg_ship")),
        ("loss_row_rate", none, F.col("loss_rate")),
        ("top_category_by_sales", F.col("cat_l"), F.col("cat_v")),
        ("top_region_by_sales", F.col("reg_l"), F.col("reg_v")),
        ("top_subcategory_by_profit", F.col("subp_l"), F.col("subp_v")),
        ("bottom_subcategory_by_profit", F.col("subw_l"), F.col("subw_v")),
        ("worst_discount_by_avg_profit", F.col("disc_l"), F.col("disc_v")),
    ]
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("fact"), l.alias("label"), v.cast("double").alias("value"))
        for f, l, v in facts])))
