"""Named queries: ``(spark, source_dir) -> DataFrame`` over the whole tables."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.operators import (exact_tree, filters, forecast, kpis, models, monitor, products, quality, rfm, rollup,
                                 summaries)
from storelens.plans import params as P
from storelens.plans import sqlviews
from storelens.session import shared_dir
from storelens.sources import sinks
from storelens.sources.loader import input_mark, load_order_lines
from storelens.sources.reuse import reused

Query = Callable[[SparkSession, str], DataFrame]


def _full(spark: SparkSession, src: str) -> DataFrame:
    """Order lines with the sales band, for the queries that return it."""
    return load_order_lines(spark, src)


def _ol(spark: SparkSession, src: str) -> DataFrame:
    return load_order_lines(spark, src, with_sales_band=False)


def _filtered(spark: SparkSession, src: str) -> DataFrame:
    return filters.apply_filters(_full(spark, src), P.FILTER_YEARS, P.FILTER_REGIONS, P.FILTER_CATEGORIES,
                                 P.FILTER_SEGMENTS, states=P.FILTER_STATES, ship_modes=None)


def _export_roundtrip(spark: SparkSession, src: str) -> DataFrame:
    df = _filtered(spark, src)
    path = sinks.export_filtered(spark, df)
    return sinks.read_csv(spark, path, df.schema)


def _sql(query: str) -> Query:
    def run(spark: SparkSession, src: str) -> DataFrame:
        sqlviews.register_sql_store(spark, _ol(spark, src), rollup=_rollup(spark, src))
        return sqlviews.run_sql(spark, query)
    return run


_ROLLUPS: dict[tuple, rollup.Rollup] = {}


def _rollup(spark: SparkSession, src: str) -> rollup.Rollup:
    """The order-grain rollup of ``src``, built once for unchanged input files."""
    key = (spark.sparkContext.applicationId, id(spark), src)
    if key not in _ROLLUPS:
        path = reused(spark, "rollup", input_mark(spark, src), lambda p: rollup.write(_ol(spark, src), p))
        _ROLLUPS[key] = rollup.read(spark, path)
    return _ROLLUPS[key]


def _kept_forest(spark: SparkSession, src: str, kind: str, params: dict) -> str:
    """Where the forest of these files and parameters is saved, and found by later applications."""
    mark = hashlib.sha256(json.dumps([kind, params, P.TEST_FRACTION, P.SEED], sort_keys=True).encode()).hexdigest()[:16]
    return shared_dir(spark, "storelens", "kept", "forests", f"{input_mark(spark, src)}-{kind}-{mark}")


def _rolled(fn, **kw) -> Query:
    return lambda spark, src: fn(_rollup(spark, src), **kw)


_STORES: dict[tuple, str] = {}


def _written_store(spark: SparkSession, src: str) -> str:
    """The persistent SQL store of ``src``, written once per application (load-once cache)."""
    key = (spark.sparkContext.applicationId, src)
    if key not in _STORES:
        _STORES[key] = sqlviews.write_sql_store(spark, _full(spark, src))
    return _STORES[key]


def _written_sql(query: str) -> Query:
    def run(spark: SparkSession, src: str) -> DataFrame:
        sqlviews.register_sql_store(spark, path=_written_store(spark, src))
        return sqlviews.run_sql(spark, query)
    return run


def _loss(spark: SparkSession, src: str, variant: bool = False) -> models.LossModel:
    p = P.LOSS_MODEL_VARIANT if variant else P.LOSS_MODEL
    return models.train_loss_classifier(_ol(spark, src), fraction=P.TEST_FRACTION, seed=P.SEED,
                                        cache_key=(spark.sparkContext.applicationId, src),
                                        path=_kept_forest(spark, src, "loss", p), **p)


def _profit(spark: SparkSession, src: str) -> models.ProfitModel:
    return models.train_profit_regressor(_ol(spark, src), fraction=P.TEST_FRACTION, seed=P.SEED,
                                         cache_key=(spark.sparkContext.applicationId, src),
                                         path=_kept_forest(spark, src, "profit", P.PROFIT_MODEL), **P.PROFIT_MODEL)


_FRAMES: dict[tuple, DataFrame] = {}


def _once(kind: str, build: Query) -> Query:
    """``build``'s result, written once per application and source and read by every query over it."""
    def run(spark: SparkSession, src: str) -> DataFrame:
        key = (kind, spark.sparkContext.applicationId, id(spark), src)
        if key not in _FRAMES:
            _FRAMES[key] = sinks.stored(build(spark, src), kind)
        return _FRAMES[key]
    return run


def _flagged(classes: tuple | None) -> Query:
    def build(spark: SparkSession, src: str) -> DataFrame:
        ol = _ol(spark, src)
        flag = models.test_flag(ol, fraction=P.TEST_FRACTION, seed=P.SEED, classes=classes)
        return ol.select("row_id", "is_loss", flag.alias("is_test"))
    return build


_split = _once("split", _flagged((0, 1)))
_plain_split = _once("plain-split", _flagged(None))
_rfm = _once("rfm", lambda s, d: rfm.rfm_summary(_rollup(s, d)))


def _on(fn, **kw) -> Query:
    return lambda spark, src: fn(_ol(spark, src), **kw)


QUERIES: dict[str, Query] = {
    # sources, derived columns, filters
    "order_lines": _full,
    "filter_orders": _filtered,
    "export_filtered": _export_roundtrip,
    "filter_options": _on(filters.filter_options),
    # summaries
    "customer_summary": _rolled(summaries.customer_summary),
    "state_summary": _rolled(summaries.state_summary),
    "monthly_summary": _rolled(summaries.monthly_summary),
    "executive_kpis": _rolled(kpis.executive_kpis),
    "region_summary": _rolled(summaries.region_summary),
    "category_summary": _rolled(summaries.category_summary),
    "subcategory_summary": _rolled(summaries.subcategory_summary),
    "sales_by_year": _on(summaries.sales_by_year),
    "sales_by_category": _rolled(summaries.sales_by_category),
    "profit_by_category": _rolled(summaries.profit_by_category),
    "profit_by_subcategory": _rolled(summaries.profit_by_subcategory),
    "profit_by_discount": _on(summaries.profit_by_discount),
    "sales_by_region": _rolled(summaries.sales_by_region),
    "monthly_sales_trend": _rolled(summaries.monthly_sales_trend, months=P.TREND_MONTHS),
    "top_states": _rolled(summaries.top_states, k=P.TOP_STATES),
    "top_customers": _rolled(summaries.top_customers, k=P.TOP_CUSTOMERS),
    "top_customers_total": _rolled(summaries.top_customers_total, k=P.TOP_CUSTOMERS_TOTAL),
    "kpi_summary": _rolled(kpis.kpi_summary),
    "kpi_summary_compact": _rolled(kpis.kpi_summary_compact),
    "kpi_cards": _rolled(kpis.kpi_cards),
    "report_money": _rolled(kpis.report_money),
    "dataset_snapshot": _on(kpis.dataset_snapshot),
    "insight_facts": _on(kpis.insight_facts),
    # customers
    "rfm": lambda s, d: rfm.ranked(_rfm(s, d)),
    "rfm_segments": lambda s, d: rfm.rfm_segments(_rfm(s, d)),
    "rfm_watchlist": lambda s, d: rfm.rfm_watchlist(_rfm(s, d), k=P.WATCHLIST),
    # planning
    "forecast": _rolled(forecast.forecast_frame, periods=P.FORECAST_PERIODS),
    "monthly_anomalies": _rolled(forecast.anomaly_table),
    "alert_feed": lambda s, d: forecast.alert_feed(forecast.anomaly_table(_rollup(s, d)), k=P.ALERTS),
    "product_opportunity": _rolled(products.product_opportunity),
    "top_opportunities": _rolled(products.top_opportunities, k=P.TOP_OPPORTUNITIES),
    "discount_scenario": _rolled(products.discount_scenario, adjustment=P.SCENARIO_ADJUSTMENT),
    "discount_scenarios": _rolled(products.discount_scenarios, adjustments=P.SCENARIO_SWEEP),
    "top_scenario": _rolled(products.top_scenario, adjustment=P.SCENARIO_ADJUSTMENT, k=P.TOP_SCENARIO),
    "discount_risk_segments": _on(quality.discount_risk_segments),
    "data_quality": _on(quality.data_quality),
    # operations monitor
    "recent_orders": _on(monitor.recent_orders, k=P.RECENT),
    "monitor_snapshot": _on(monitor.monitor_snapshot, k=P.RECENT),
    "daily_pulse": _on(monitor.daily_pulse, days=P.PULSE_DAYS),
    # SQL layer
    "sql_orders_export": lambda s, d: sqlviews.orders_table(_full(s, d)),
    "sql_store_written": lambda s, d: sqlviews.read_sql_store(s, _written_store(s, d)),
    "sql_store_monthly_kpis": _written_sql("select * from monthly_kpis"),
    "table_counts": lambda s, d: (sqlviews.register_sql_store(s, _ol(s, d), rollup=_rollup(s, d)), sqlviews.table_counts(s))[1],
    "sql_monthly_kpis": _sql("select * from monthly_kpis"),
    "sql_category_kpis": _sql("select * from category_kpis"),
    "sql_customer_kpis": _sql("select * from customer_kpis"),
    "sql_monthly_trend": _sql(sqlviews.DEFAULT_SQL_QUERIES["Monthly KPI trend"]),
    "sql_top_subcategories": _sql(sqlviews.DEFAULT_SQL_QUERIES["Most profitable sub-categories"]),
    "sql_highest_loss_rate": _sql(sqlviews.DEFAULT_SQL_QUERIES["Highest loss-rate sub-categories"]),
    "sql_best_customers": _sql(sqlviews.DEFAULT_SQL_QUERIES["Best customers by profit"]),
    "sql_region_profit": _sql(sqlviews.EXAMPLE_SQL),
    "sql_trend_preview": lambda s, d: sqlviews.trend_preview(
        _sql(sqlviews.DEFAULT_SQL_QUERIES["Monthly KPI trend"])(s, d)),
    "sql_adhoc": _sql('select "Ship Mode" as ship_mode, count(*) as lines, count(distinct "Order ID") as orders,\n'
                      '       round(sum(Sales), 2) as sales\nfrom orders\ngroup by "Ship Mode"\n'
                      '-- lines per ship mode\n;'),
    # models: evaluation operators on a fixed rule scorer (SQL-checkable) ...
    "split_sizes": lambda s, d: models.split_sizes(_split(s, d)),
    "plain_split_sizes": lambda s, d: _plain_split(s, d).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("is_test").alias("test_rows"),
        F.count_if(~F.col("is_test")).alias("train_rows")),
    "class_weights": lambda s, d: models.class_weights(_split(s, d).where("NOT is_test")),
    "classification_metrics": lambda s, d: models.classification_metrics(models.rule_scored(_ol(s, d))),
    "confusion_matrix": lambda s, d: models.confusion_matrix(models.rule_scored(_ol(s, d))),
    "classification_report": lambda s, d: models.classification_report(models.rule_scored(_ol(s, d))),
    "regression_metrics": lambda s, d: models.regression_metrics(models.rule_scored(_ol(s, d))),
    # ... and on the fitted forests (rows-only checks)
    "feature_matrix": _on(models.feature_matrix),
    "feature_matrix_cells": _on(models.feature_matrix_cells),
    "loss_tree": _on(exact_tree.tree_nodes, label="is_loss", balance=True),
    "loss_tree_importance": _on(exact_tree.tree_importance, label="is_loss", balance=True),
    "loss_tree_scores": _on(exact_tree.tree_scores, label="is_loss", balance=True),
    "profit_tree": _on(exact_tree.tree_nodes, label="profit", steps=exact_tree.EVERY_VALUE),
    "profit_tree_importance": _on(exact_tree.tree_importance, label="profit"),
    "profit_tree_scores": _on(exact_tree.tree_scores, label="profit"),
    "loss_model_metrics": lambda s, d: models.loss_model_metrics(_loss(s, d)),
    "loss_confusion_matrix": lambda s, d: models.confusion_matrix(_loss(s, d).test_scored),
    "loss_variant_report": lambda s, d: models.classification_report(_loss(s, d, variant=True).test_scored),
    "profit_model_metrics": lambda s, d: models.profit_model_metrics(_profit(s, d)),
    "loss_feature_importance": lambda s, d: models.feature_importance(_loss(s, d).forest, s),
    "profit_feature_importance": lambda s, d: models.feature_importance(_profit(s, d).forest, s),
    "regression_preview": lambda s, d: models.regression_preview(_profit(s, d)),
    "score_orders": lambda s, d: models.score_orders(_ol(s, d), _loss(s, d), _profit(s, d)),
}
