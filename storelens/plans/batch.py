"""Batch job: load once, compute every summary, write the small result tables.

Replaces both report scripts with one entry point; their differences (KPI
table variants, top-20 vs top-10 customers, model variants) are parameters.
Small results (bounded by the number of months, categories, or k) are written
as single CSV files; nothing large is funnelled through one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storelens.operators import forecast, kpis, models, products, quality, summaries
from storelens.plans import params as P
from storelens.plans import sqlviews
from storelens.sources.loader import load_order_lines
from storelens.sources.sinks import write_csv


def run_batch(spark: SparkSession, src: str, out_dir: str, *, train_models: bool = True,
              model_params: dict | None = None) -> dict[str, str]:
    """Write the report tables under ``out_dir``; returns name -> path."""
    ol = load_order_lines(spark, src)
    out: dict[str, DataFrame] = {
        "monthly_sales": summaries.monthly_summary(ol).select("order_month", "sales"),
        "profit_by_category": summaries.profit_by_category(ol),
        "profit_by_subcategory": summaries.profit_by_subcategory(ol),
        "sales_by_region": summaries.sales_by_region(ol),
        "sales_by_year": summaries.sales_by_year(ol),
        "sales_by_category": summaries.sales_by_category(ol),
        "profit_by_discount": summaries.profit_by_discount(ol),
        "monthly_sales_trend": summaries.monthly_sales_trend(ol, P.TREND_MONTHS),
        "profit_by_discount_band": quality.discount_risk_segments(ol),
        "top_customers": summaries.top_customers(ol, P.TOP_CUSTOMERS),
        "top_states": summaries.top_states(ol, P.TOP_STATES),
        "top_customers_total": summaries.top_customers_total(ol, P.TOP_CUSTOMERS_TOTAL),
        "kpi_summary_compact": kpis.kpi_summary_compact(ol),
        "insight_facts": kpis.insight_facts(ol),
        "dataset_snapshot": kpis.dataset_snapshot(ol),
        "anomalies": forecast.anomaly_table(ol),
        "forecast": forecast.forecast_frame(ol, P.FORECAST_PERIODS),
        "product_opportunity": products.product_opportunity(ol),
    }
    kpi = kpis.kpi_summary(ol)
    if train_models:
        mp = model_params or {}
        loss = models.train_loss_classifier(ol, **{**P.LOSS_MODEL, **mp.get("loss", {})})
        profit = models.train_profit_regressor(ol, **{**P.PROFIT_MODEL, **mp.get("profit", {})})
        lm = models.classification_metrics(loss.test_scored).first()
        pm = models.regression_metrics(profit.test_scored).first()
        kpi = kpi.unionByName(kpis.model_metric_rows(spark, lm["accuracy"], pm["r2"], lm["precision"], lm["recall"]))
        out["confusion_matrix"] = models.confusion_matrix(loss.test_scored)
        out["loss_feature_importance"] = models.feature_importance(loss.forest, spark)
        out["profit_feature_importance"] = models.feature_importance(profit.forest, spark)
    out["kpi_summary"] = kpi
    sqlviews.register_sql_store(spark, ol)
    out["sql_table_counts"] = sqlviews.table_counts(spark)

    paths = {}
    for name, df in out.items():
        paths[name] = write_csv(df, f"{out_dir.rstrip('/')}/{name}", single_file=True)
    return paths
