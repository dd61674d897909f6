"""Hand-made fixtures for edge cases (bands, growth, forecast, anomalies, ...)."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from storelens.operators import filters, forecast, kpis, models, products, quality, rfm, summaries
from storelens.operators.derive import enrich
from storelens.operators.monitor import recent_orders


def month(y, m, d=10):
    return dt.date(y, m, d)


def test_discount_bands(lines):
    discs = ["-0.01", "-0.005", "0", "0.1", "0.1001", "0.2", "0.4", "0.8", "0.81", None]
    ol = enrich(lines([{"discount": None if d is None else Decimal(d)} for d in discs]))
    got = [r["discount_band"] for r in ol.orderBy("row_id").collect()]
    assert got == [None, "0%", "0%", "1-10%", "11-20%", "11-20%", "21-40%", "41%+", None, None]


def test_zero_sales_margin_and_loss(lines):
    ol = enrich(lines([{"sales": 0, "profit": None}, {"sales": None, "profit": -1}, {"sales": 10, "profit": 5}]))
    got = [(r["profit_margin"], r["is_loss"], r["sales_band"]) for r in ol.orderBy("row_id").collect()]
    assert got == [(0.0, 0, "Low"), (0.0, 1, None), (0.5, 0, "Very High")]


def test_growth_edge_cases(lines):
    sales = [1, 0, 0, -2, 4]
    ol = enrich(lines([{"order_date": month(2024, i + 1), "sales": s} for i, s in enumerate(sales)]))
    got = [r["sales_growth_pct"] for r in summaries.monthly_summary(ol).collect()]
    assert got == [0.0, -1.0, 0.0, 0.0, -3.0]


def test_month_gap_counts_present_months(lines):
    ol = enrich(lines([{"order_date": month(2024, 1), "sales": 10}, {"order_date": month(2024, 3), "sales": 20}]))
    f = forecast.forecast_frame(ol, periods=2).collect()
    assert [r["month_index"] for r in f] == [0, 1, 2, 3]
    assert [r["order_month_ts"] for r in f][2:] == [dt.date(2024, 4, 1), dt.date(2024, 5, 1)]
    assert [r["sales"] for r in f][2:] == [30.0, 40.0]


def test_forecast_needs_two_months(lines):
    ol = enrich(lines([{"order_date": month(2024, 1)}]))
    f = forecast.forecast_frame(ol, periods=3).collect()
    assert [r["type"] for r in f] == ["historical"]


def test_falling_line_clamps_sales_only(lines):
    rows = [{"order_date": month(2024, i + 1), "sales": 30 - 10 * i, "profit": 5 - 10 * i} for i in range(3)]
    f = forecast.forecast_frame(enrich(lines(rows)), periods=2).collect()
    fut = [r for r in f if r["type"] == "forecast"]
    assert [r["sales"] for r in fut] == [0.0, 0.0]
    assert [r["profit"] for r in fut] == [-25.0, -35.0]


def test_flat_months_no_alert(lines):
    ol = enrich(lines([{"order_date": month(2024, i + 1), "sales": 10, "profit": 1} for i in range(4)]))
    a = forecast.anomaly_table(ol).collect()
    assert all(r["sales_zscore"] == 0.0 and not r["alert_flag"] and r["alert_reason"] == "Normal" for r in a)


def test_z_edge_exactly_minus_1_5(lines):
    # four months at -9 and nine at +4: mean 0, population std 6, so z(-9) = -1.5 exactly:
    # flagged (|z| >= 1.5) but not a "Profit dip" (that needs z < -1.5)
    profits = [-9] * 4 + [4] * 9
    ol = enrich(lines([{"order_date": dt.date(2023 + i // 12, i % 12 + 1, 5), "sales": 10, "profit": p}
                       for i, p in enumerate(profits)]))
    rows = {r["order_month"]: r for r in forecast.anomaly_table(ol).collect()}
    r = rows["2023-01"]
    assert r["profit_zscore"] == -1.5 and r["alert_flag"]
    assert r["alert_reason"] == "Demand spike / unusual movement"
    assert rows["2023-06"]["alert_reason"] == "Normal"


def test_empty_filter_lists(lines):
    ol = enrich(lines([{}, {"region": "West"}]))
    assert filters.apply_filters(ol, [2024], [], ["Office"], ["Consumer"]).count() == 0
    assert filters.apply_filters(ol, [2024], ["East", "West"], ["Office"], ["Consumer"], states=[],
                                 ship_modes=None).count() == 2
    assert filters.apply_filters(ol, [2023], ["East", "West"], ["Office"], ["Consumer"]).count() == 0


def test_null_keys_dropped_by_summaries(lines):
    ol = enrich(lines([{"region": None}, {"region": "East"}]))
    assert [r["region"] for r in summaries.region_summary(ol).collect()] == ["East"]


def test_one_band_still_five_rows(lines):
    ol = enrich(lines([{"discount": 0}, {"discount": 0, "profit": -1}]))
    rows = quality.discount_risk_segments(ol).collect()
    assert [r["discount_band"] for r in rows] == ["0%", "1-10%", "11-20%", "21-40%", "41%+"]
    assert rows[0]["rows"] == 2 and rows[0]["loss_rate"] == 0.5
    assert all(r["rows"] == 0 and r["avg_sales"] is None for r in rows[1:])


def test_scenario_clip_and_identity(lines):
    ol = enrich(lines([{"sub_category": "A", "discount": "0.05"}, {"sub_category": "B", "discount": "0.78"}]))
    base = {r["sub_category"]: r for r in products.discount_scenario(ol, 0.0).collect()}
    assert all(r["estimated_profit_impact"] == 0.0 and r["projected_profit"] == r["profit"] for r in base.values())
    up = {r["sub_category"]: r for r in products.discount_scenario(ol, 0.2).collect()}
    down = {r["sub_category"]: r for r in products.discount_scenario(ol, -0.2).collect()}
    assert up["B"]["simulated_discount"] == 0.8 and down["A"]["simulated_discount"] == 0.0
    sweep = products.discount_scenarios(ol, [-0.2, 0.0, 0.2]).count()
    assert sweep == 6


def test_data_quality_sample_and_missing(lines):
    ol = enrich(lines([{"region": None, "sales": "1.5"}, {"region": "West", "sales": "2"}]))
    rows = {r["column"]: r for r in quality.data_quality(ol).collect()}
    assert rows["Region"]["missing_values"] == 1 and rows["Region"]["sample_value"] == "West"
    assert rows["Sales"]["sample_value"] == "1.5" and rows["Sales"]["unique_values"] == 2
    assert rows["Quantity"]["sample_value"] == "1"


def test_rfm_one_customer_and_labels(lines):
    ol = enrich(lines([{"customer_id": "C1"}, {"customer_id": "C2", "order_date": dt.date(2024, 2, 1),
                                                 "order_id": "O2", "sales": 500}]))
    r = {x["customer_id"]: x for x in rfm.rfm_summary(ol).collect()}
    assert r["C2"]["recency_days"] == 0 and r["C2"]["rfm_score"] == 12 and r["C2"]["rfm_segment"] == "Champion"
    assert r["C1"]["rfm_score"] == 3 and r["C1"]["rfm_segment"] == "At Risk"


def test_money_text_half_even(lines):
    ol = enrich(lines([{"sales": "1234.5"}, {"sales": "2.5"}, {"sales": "1235.5"}, {"profit": "-0.4"}]))
    got = [(r["sales_text"], r["profit_text"]) for r in recent_orders(ol, 4).orderBy("sales_text").collect()]
    assert ("$1,234", "$10") in got and ("$2", "$10") in got and ("$1,236", "$10") in got
    assert ("$100", "$-0") in got


def test_executive_kpis_deltas(lines):
    ol = enrich(lines([{"order_date": month(2024, 1), "sales": 100, "profit": 0},
                       {"order_date": month(2024, 2), "sales": 150, "profit": 5, "order_id": "O2"}]))
    k = kpis.executive_kpis(ol).first()
    assert k["sales_delta"] == 0.5 and k["profit_delta"] == 0.0 and k["total_orders"] == 2


def test_confusion_matrix_one_class(spark):
    scored = spark.createDataFrame([(0, 0), (0, 0)], "label int, prediction int")
    cm = models.confusion_matrix(scored).collect()
    assert len(cm) == 2 and cm[1]["Predicted loss"] == 0
    m = models.classification_metrics(scored).first()
    assert m["precision"] == 0.0 and m["recall"] == 0.0 and m["accuracy"] == 1.0


def test_unseen_level_scores_zero_vector(lines):
    ol = enrich(lines([{"category": "A"}, {"category": "B"}]))
    feats = models.with_numeric_features(ol)
    from pyspark.ml import Pipeline
    pm = Pipeline(stages=models.feature_stages()).fit(feats)
    new = models.with_numeric_features(enrich(lines([{"category": "Z"}, {"category": None}])))
    vecs = [r["features"].toArray()[:2].tolist() for r in pm.transform(new).collect()]
    assert vecs == [[0.0, 0.0], [0.0, 0.0]]


def test_exact_split_sizes(lines):
    ol = enrich(lines([{"profit": -1 if i % 4 == 0 else 1} for i in range(103)]))
    split = ol.withColumn("is_test", models.test_flag(ol, fraction=0.2, seed=42, classes=(0, 1)))
    sizes = {r["is_loss"]: (r["rows"], r["test_rows"]) for r in models.split_sizes(split).collect()}
    assert sizes == {0: (77, 16), 1: (26, 5)}  # 21 in all


def test_sql_trend_preview_needs_all_columns(spark, lines):
    from storelens.plans import sqlviews
    ol = enrich(lines([dict(order_date=dt.date(2024, 3, 1)), dict(order_date=dt.date(2024, 1, 5))]))
    sqlviews.register_sql_store(spark, ol)
    prev = sqlviews.trend_preview(sqlviews.run_sql(spark, sqlviews.DEFAULT_SQL_QUERIES["Monthly KPI trend"]))
    assert [r["order_month"] for r in prev.collect()] == ["2024-01", "2024-03"]
    assert sqlviews.trend_preview(sqlviews.run_sql(spark, "select order_month, sales from monthly_kpis")) is None


def test_hold_out_sizes_deal_the_total():
    for counts in ([77, 26], [1, 1], [5, 0], [0, 0], [100, 3], [33, 34, 36]):
        got = models.hold_out_sizes(counts, 0.2)
        assert sum(got) == -(-sum(counts) // 5) and all(0 <= g <= c for g, c in zip(got, counts))


def test_display_texts(spark):
    from storelens.functions.exprs import fixed_text, pct_text
    df = spark.createDataFrame([(2_297_200.86, 0.12345), (-0.001, -0.0001), (1234567.005, 1.0), (None, None)],
                               "x double, p double")
    got = [tuple(r) for r in df.select(fixed_text("x", 2, "$", "M", 1_000_000), fixed_text("x", 0, "$", "K", 1000),
                                       fixed_text("x", 2, "$"), pct_text("p")).collect()]

    def texts(x, p):
        return (f"${x / 1e6:,.2f}M", f"${x / 1e3:,.0f}K", f"${x:,.2f}", f"{p:.1%}")
    assert got[0] == texts(2_297_200.86, 0.12345) and got[1] == texts(-0.001, -0.0001)
    assert got[2][0] == "$1.23M" and got[2][3] == "100.0%" and got[3] == (None,) * 4


EMPTY_OK = "all builders run on a frame without rows"


def test_every_builder_takes_an_empty_frame(spark, lines):
    from storelens.operators import filters, forecast, kpis, monitor, products, quality, rfm, summaries
    from storelens.plans import sqlviews
    ol = enrich(lines([{}]).where("false"))
    frames = [summaries.customer_summary(ol), summaries.state_summary(ol), summaries.monthly_summary(ol),
              summaries.region_summary(ol), summaries.category_summary(ol), summaries.subcategory_summary(ol),
              summaries.sales_by_year(ol), summaries.monthly_sales_trend(ol, 18), summaries.top_states(ol, 5),
              kpis.executive_kpis(ol), kpis.kpi_cards(ol), kpis.report_money(ol), kpis.kpi_summary(ol),
              kpis.kpi_summary_compact(ol), kpis.dataset_snapshot(ol), kpis.insight_facts(ol),
              rfm.rfm_segments(rfm.rfm_summary(ol)), forecast.forecast_frame(ol, 4), forecast.anomaly_table(ol),
              products.product_opportunity(ol), products.discount_scenario(ol), quality.data_quality(ol),
              quality.discount_risk_segments(ol), monitor.recent_orders(ol), monitor.monitor_snapshot(ol),
              monitor.daily_pulse(ol), filters.filter_options(ol), sqlviews.orders_table(ol),
              models.split_sizes(ol.withColumn("is_test", models.test_flag(ol, classes=(0, 1))))]
    rows = [len(f.collect()) for f in frames]
    assert rows[0] == 0 and rows[9] == 1 and EMPTY_OK


def test_models_are_saved_and_loaded(spark, lines, tmp_path):
    import random
    rnd = random.Random(2)
    ol = enrich(lines([{"profit": rnd.choice([-5, 8, 20]), "sales": 10 + i % 50, "discount": rnd.choice(["0", "0.2", "0.5"]),
                        "category": rnd.choice("ABC")} for i in range(200)]), with_sales_band=False)
    kw = dict(num_trees=5, max_depth=3)
    one = models.train_loss_classifier(ol, path=str(tmp_path / "loss"), **kw)
    two = models.train_loss_classifier(ol, path=str(tmp_path / "loss"), **kw)
    assert sorted(one.test_scored.collect()) == sorted(two.test_scored.collect()) and one.test_rows == 40
    profit = models.train_profit_regressor(ol, path=str(tmp_path / "profit"), **kw)
    again = models.train_profit_regressor(ol, path=str(tmp_path / "profit"), **kw)
    assert sorted(profit.test_scored.collect()) == sorted(again.test_scored.collect())
    scored = models.score_orders(ol, two, again)
    assert scored.count() == 200 and "Join" not in scored._jdf.queryExecution().executedPlan().toString()
    top = models.feature_importance(one.forest, spark, k=3).collect()
    assert len(top) == 3 and top[0]["importance"] >= top[2]["importance"]
    assert len(models.feature_importance(one.forest, spark).collect()) <= 12
    assert sum(r["importance"] for r in models.feature_importance(one.forest, spark, k=None).collect()) == \
        __import__("pytest").approx(1.0)


def test_a_tree_asks_each_split_once_and_a_leaf_is_the_one_its_answers_lead_to(lines):
    from storelens.operators.exact_tree import Tree
    tree = Tree({1: ("category", "k", None), 2: ("quantity", None, 3.0), 3: ("region", "E", None),
                 5: ("category", "l", None), 6: ("quantity", None, 5.0)}, None)
    ol = lines([dict(category=c, region=r, quantity=q) for c in ("k", "l", None) for r in ("E", "W", None)
                for q in (1, 3, 4, 6, None)])

    def leaf(r):
        at = 1
        while at in tree.splits:
            f, level, bound = tree.splits[at]
            at = 2 * at + (r[f] == level if level is not None else not (r[f] is not None and r[f] <= bound))
        return at

    got = ol.select("category", "region", "quantity", tree.node().alias("node")).collect()
    assert [r["node"] for r in got] == [leaf(r) for r in got] and len({r["node"] for r in got}) == 6
    text = tree.node()._jc.toString()
    assert [text.count(f"{x} ") for x in ("quantity", "region")] <= [2, 1] and text.count("'E'") <= 1
    assert len(text) < 1500


def test_every_value_of_a_number_is_a_bound_of_the_tree(spark, lines, monkeypatch):
    import itertools

    from storelens.operators import exact_tree
    from storelens.plans.oracle import ORACLE
    from storelens.plans.registry import QUERIES
    ol = enrich(lines([dict(sales=s, profit=9 + s % 3 if s > 2417 else s % 3, quantity=s % 2, category="ab"[s % 2])
                       for s in range(2300, 2500)] + [dict(sales=None, profit=4)]), with_sales_band=False)
    rows = ol.select("sales", "profit").collect()

    def score(bound):
        sides = [[r["profit"] for r in rows if (r["sales"] is not None and r["sales"] <= bound) == low] for low in (True, False)]
        return sum(float(sum(x)) ** 2 / len(x) for x in sides) if min(map(len, sides)) >= 25 else -1

    best = max(range(2300, 2500), key=lambda b: (score(b), -b))
    top = exact_tree.tree_nodes(ol, "profit", depth=1, steps=exact_tree.EVERY_VALUE).collect()
    assert (top[0]["feature"], top[0]["bound"], top[0]["rows"]) == ("sales", best, 201) and best == 2417
    assert [r["rows"] for r in top[1:]] == [118, 83]
    # the registered query takes them so, and its SQL
    monkeypatch.setattr("storelens.plans.registry.load_order_lines", lambda *a, **k: ol)
    assert any(r["bound"] == best for r in QUERIES["profit_tree"](spark, "").collect())
    assert "5000" not in ORACLE["profit_tree"]


def test_running_sums_of_many_parts_are_those_of_one_window(spark):
    from pyspark.sql import Window
    from storelens.operators import exact_tree
    c = spark.range(600).select((F.col("id") % 3 + 1).alias("node"), F.lit("sales").alias("feature"), F.lit(None).cast("string")
                                .alias("level"), (F.col("id") * 7 % 601).cast("double").alias("bound"),
                                (F.col("id") % 5 + 1).alias("rows"), (F.col("id") % 11).cast("decimal(18,4)").alias("label"))
    c = c.unionByName(c.limit(9).withColumn("feature", F.lit("category")).withColumn("level", F.col("bound").cast("string"))
                      .withColumn("bound", F.lit(None).cast("double")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = exact_tree.running_sums(c)
        assert "Window" in got._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(str, got.select("node", "feature", "bound", "level", "part_rows", "part_label").collect()))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    up = Window.partitionBy("node", "feature").orderBy("bound").rowsBetween(Window.unboundedPreceding, 0)
    want = c.select("node", "feature", "bound", "level", *[
        F.when(F.col("bound").isNull(), F.col(x)).otherwise(F.sum(x).over(up)).alias(f"part_{x}") for x in ("rows", "label")])
    assert got == sorted(map(str, want.collect()))
