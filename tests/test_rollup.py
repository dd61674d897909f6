"""The order-grain rollup: same answers as the lines, without distincts over them; reuse of stored tables."""

import os
import random

import pytest
from pyspark.sql import functions as F

from storelens.operators import kpis, products, rfm, rollup, summaries
from storelens.operators.derive import enrich
from storelens.plans import sqlviews
from storelens.plans.registry import QUERIES
from tests.conftest import make_lines

SF = "/root/testdata/sf0.001"


def messy_lines(spark, n=900):
    """Orders over several months, customers, states and products; null keys; one order with a third of all lines."""
    import datetime as dt
    rng = random.Random(9)
    rows = []
    for i in range(n):
        order = rng.choice(["big", f"o{rng.randrange(60)}", f"o{rng.randrange(60)}"])
        rows.append(dict(
            order_id=None if rng.random() < 0.05 else order,
            order_date=None if rng.random() < 0.05 else dt.date(2024, rng.randrange(1, 5), rng.randrange(1, 28)),
            customer_id=rng.choice([None] + [f"c{k}" for k in range(12)]), customer_name=rng.choice(["Ann", "Bob", None]),
            segment=rng.choice(["A", "B", None]), state=rng.choice(["x", "y", None]), region=rng.choice(["E", "W"]),
            category=rng.choice(["k", "l", None]), sub_category=rng.choice(["p", "q", "r", None]),
            sales=None if rng.random() < 0.1 else rng.randrange(1, 900) / 4, profit=rng.randrange(-50, 90) / 8,
            discount=rng.choice([None, "0", "0.2", "0.5"]), quantity=1))
    return enrich(make_lines(spark, rows), with_sales_band=False)


ANSWERS = [summaries.customer_summary, summaries.state_summary, summaries.monthly_summary, summaries.region_summary,
           summaries.category_summary, summaries.subcategory_summary, summaries.sales_by_category,
           summaries.profit_by_category, summaries.profit_by_subcategory, summaries.sales_by_region,
           summaries.monthly_sales_trend, summaries.top_states, summaries.top_customers, summaries.top_customers_total,
           kpis.executive_kpis, kpis.kpi_summary, kpis.kpi_summary_compact, kpis.kpi_cards, kpis.report_money,
           products.product_opportunity, products.discount_scenario]


def same(a, b):
    assert a.dtypes == b.dtypes
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_every_answer_is_that_of_the_lines(spark):
    ol = messy_lines(spark).persist()
    rolled = rollup.build(ol)
    for fn in ANSWERS:
        same(fn(rolled), fn(ol))
    same(rfm.rfm_summary(rolled), rfm.rfm_summary(ol))
    ol.unpersist()


def test_views_over_the_rollup_are_those_of_the_lines(spark):
    ol = messy_lines(spark)
    sqlviews.register_sql_store(spark, ol)
    want = {v: spark.table(v).collect() for v in sqlviews.VIEW_SQL}
    types = {v: spark.table(v).dtypes for v in sqlviews.VIEW_SQL}
    sqlviews.register_sql_store(spark, ol, rollup=rollup.build(ol))
    for v in sqlviews.VIEW_SQL:
        assert spark.table(v).dtypes == types[v], v
        assert sorted(map(repr, spark.table(v).collect())) == sorted(map(repr, want[v])), v


def test_customer_counts_are_exact_at_every_roll_up(spark):
    ol = messy_lines(spark)
    r = rollup.build(ol)
    months = {x["order_month"]: x["customers"] for x in r.customer_count("order_month").collect()}
    want = {x["order_month"]: x["n"] for x in ol.where("customer_id IS NOT NULL").groupBy("order_month").agg(
        F.count_distinct("customer_id").alias("n")).collect()}
    assert months == want
    some = rollup.Rollup(r.customers, r.products, r.months.where("order_month >= '2024-03'"))
    assert some.customer_count().first()["customers"] == ol.where("order_month >= '2024-03'").select(
        F.count_distinct("customer_id")).first()[0]


def test_the_rollup_refuses_what_it_does_not_cover(spark):
    r = rollup.build(messy_lines(spark, 50))
    with pytest.raises(KeyError):
        rollup.source(r, ["state", "category"])
    frame, m = rollup.source(r, ["region"])
    with pytest.raises(KeyError):
        m.orders()


def test_an_empty_table_rolls_up(spark):
    ol = messy_lines(spark, 5).where("false")
    r = rollup.build(ol)
    assert summaries.customer_summary(r).count() == 0
    same(kpis.executive_kpis(r), kpis.executive_kpis(ol))


@pytest.mark.skipif(not os.path.exists(SF), reason="test tables not present")
def test_plans_read_the_rollup_without_distincts(spark):
    for key in ("customer_summary", "state_summary", "monthly_summary", "executive_kpis", "category_summary", "kpi_summary",
                "top_customers_total", "sql_monthly_kpis", "sql_category_kpis", "sql_customer_kpis", "sql_best_customers"):
        df = QUERIES[key](spark, SF)
        assert df.inputFiles() and all("/rollup/" in f for f in df.inputFiles()), key
        p = df._jdf.queryExecution().executedPlan().toString()
        assert "Expand" not in p and "distinct" not in p, key


# ---------------------------------------------------------------- reuse

def test_stored_tables_are_reused_until_the_input_changes(spark, tmp_path, monkeypatch):
    from storelens.sources import loader, reuse
    src = tmp_path / "in"
    src.mkdir()
    head = ("Row ID,Order ID,Order Date,Ship Date,Ship Mode,Customer ID,Customer Name,Segment,State,Region,Category,"
            "Sub-Category,Sales,Quantity,Discount,Profit\n")
    line = "{},O-{},2016-11-08,2016-11-11,First,C-1,Ann,Consumer,Ohio,East,Office,Paper,10,1,0,1\n"
    (src / "a.csv").write_text(head + line.format(1, 1))
    kw = dict(date_format="yyyy-MM-dd")
    reads = []
    real = loader.read_base
    monkeypatch.setattr(loader, "read_base", lambda *a, **k: (reads.append(1), real(*a, **k))[1])

    def again():
        """As another application with the same shared folder."""
        monkeypatch.setattr(loader, "_STORED", {})
        monkeypatch.setattr(loader, "_MARKS", {})
        return loader.stored_base(spark, str(src), **kw).count()

    assert again() == 1 and len(reads) == 1
    assert again() == 1 and len(reads) == 1
    (src / "b.csv").write_text(head + line.format(2, 2))
    assert again() == 2 and len(reads) == 2
    assert again() == 2 and len(reads) == 2
    (src / "a.csv").write_text(head + line.format(1, 1) + line.format(3, 3))
    assert again() == 3 and len(reads) == 3
    a = reuse.fingerprint(spark, [str(src)], "x")
    assert a == reuse.fingerprint(spark, [str(src)], "x") != reuse.fingerprint(spark, [str(src)], "y")


def test_half_written_tables_are_never_read(spark):
    from storelens.sources.reuse import reused

    def fails(path):
        spark.range(3).write.parquet(path)
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        reused(spark, "trial", "m1", fails)
    path = reused(spark, "trial", "m1", lambda p: spark.range(5).write.parquet(p))
    assert spark.read.parquet(path).count() == 5
    assert reused(spark, "trial", "m1", fails) == path


# ---------------------------------------------------------------- newest partitions

@pytest.mark.skipif(not os.path.exists(SF), reason="test tables not present")
def test_newest_rows_scan_the_last_partitions_only(spark):
    from storelens.operators import monitor
    from storelens.sources.loader import load_order_lines
    ol = load_order_lines(spark, SF, with_sales_band=False)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    try:
        for df in (monitor.recent_orders(ol, 12), monitor.monitor_snapshot(ol, 12), monitor.daily_pulse(ol, 14)):
            p = df._jdf.queryExecution().executedPlan().toString()
            assert "PartitionFilters: [order_year#" in p or "cast(order_year" in p or "(order_year#" in p, p
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    last = ol.agg(F.max("order_year")).first()[0]
    assert {f.split("order_year=")[1][:4] for f in monitor.newest(ol, monitor._rows, 12).inputFiles()} == {str(last)} or \
        monitor.newest(ol, monitor._rows, 12).select("order_year").distinct().count() == 1
    everything = ol.count()
    assert monitor.newest(ol, monitor._rows, everything + 1) is ol
    assert monitor.newest(ol, monitor._rows, everything).count() == everything


# ---------------------------------------------------------------- clustered layout

def scanned_rows(df):
    """Rows that the file scan of an executed frame put out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_filters_skip_rows_of_a_clustered_file(spark, tmp_path):
    from storelens.sources.loader import CLUSTERED
    rows = spark.range(400_000).selectExpr(
        *[f"concat('{c}', pmod(xxhash64(id, {i}), {n})) as {c}" for i, (c, n) in enumerate(zip(CLUSTERED, (5, 5, 10, 5, 5)))],
        "id", "1995 + cast(id % 2 as int) as order_year")
    path = str(tmp_path / "t")
    (rows.coalesce(1).sortWithinPartitions("order_year", *CLUSTERED).write.option("parquet.page.row.count.limit", 2000)
     .partitionBy("order_year").parquet(path))
    table = spark.read.parquet(path)
    one = table.where("order_year = 1995")
    counts = [scanned_rows(one.select("id", *CLUSTERED))]
    for c in CLUSTERED[:3]:
        one = one.where(F.col(c) == f"{c}1")
        counts.append(scanned_rows(one.select("id", *CLUSTERED)))
    assert counts[0] == 200_000 and counts[1] < 0.3 * counts[0] and counts[2] < 0.5 * counts[1] and counts[3] <= counts[2]


def test_shuffle_partitions_follow_the_rows_while_tables_are_written(spark, monkeypatch, tmp_path):
    from storelens import session
    was = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    real = rollup._rolled
    monkeypatch.setattr(rollup, "_rolled", lambda ol, *a: (
        seen.append(int(spark.conf.get("spark.sql.shuffle.partitions"))), real(ol, *a))[1])
    monkeypatch.setattr(session, "PARTITION_ROWS", 10)
    ol = messy_lines(spark, 300).persist()
    rollup.write(ol, str(tmp_path / "r"))
    assert seen == [30, 30] and spark.conf.get("spark.sql.shuffle.partitions") == was
    r = rollup.read(spark, str(tmp_path / "r"))
    same(summaries.monthly_summary(r), summaries.monthly_summary(ol))
    with pytest.raises(RuntimeError), session.shuffles_for(spark, 1000):
        raise RuntimeError
    assert spark.conf.get("spark.sql.shuffle.partitions") == was
    ol.unpersist()


# ---------------------------------------------------------------- what is moved

def dealt(df):
    """What the frame's explicit repartitions move, as the optimized plan states it."""
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return [plan[i + 1] for i, x in enumerate(plan) if "RepartitionByExpression" in x]


def test_products_are_added_up_without_dealing_their_measures_by_order(spark):
    ol = messy_lines(spark)
    args = (rollup.PRODUCT_KEYS, rollup.PRODUCT_LEVELS)
    a, b = rollup._rolled(ol, *args, True), rollup._rolled(ol, *args)
    same(a, b)
    assert a.columns == b.columns and a.columns[:4] == rollup.PRODUCT_KEYS
    moved, = dealt(a)
    assert "order_id" in moved and "sales" not in moved and "profit" not in moved
    rolled = rollup.build(ol)
    plan = rolled.products.groupBy().agg(F.sum("orders_product"), F.sum("orders_category")).first()
    assert plan[0] == ol.where("order_id IS NOT NULL").select("order_id", "category", "sub_category").distinct().count()
    assert plan[1] == ol.where("order_id IS NOT NULL").select("order_id", "category").distinct().count()


def test_scans_are_small_while_tables_are_written(spark):
    from storelens import session
    key = "spark.sql.files.maxPartitionBytes"
    was = spark.conf.get(key)
    with session.shuffles_for(spark, 10, "4m"):
        assert spark.conf.get(key) == session.SCAN_BYTES
        assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "4m"
    assert spark.conf.get(key) == was


@pytest.mark.skipif(not os.path.exists(SF), reason="test tables not present")
def test_lines_are_dealt_by_year_before_their_texts_are_built(spark):
    from storelens.sources.star import order_lines_from_star
    def plan_of(df):
        return df._jdf.queryExecution().optimizedPlan().toString()
    df = order_lines_from_star(spark, SF, by_year=True)
    before, after = plan_of(df).split("RebalancePartitions")
    assert "AS row_id" in before and "AS row_id" not in after and "n_name" in before
    plain = order_lines_from_star(spark, SF)
    same(df.drop("order_year"), plain)
    # a part table too large to broadcast meets the lines before the order header does
    shuffled = order_lines_from_star(spark, SF, by_year=True, broadcast_bytes=0)
    joined = plan_of(shuffled).split("RebalancePartitions")[1]
    assert joined.index("(l_orderkey#") < joined.index("(l_partkey#")
    same(shuffled.drop("order_year"), plain)


def test_stored_lines_and_rollup_are_written_as_zstd(spark, tmp_path):
    from storelens.sources.loader import load_order_lines
    lines = load_order_lines(spark, SF)
    found = [f for f in lines.inputFiles() if f.endswith(".parquet")]
    rollup.write(lines, str(tmp_path / "r"))
    found += [f for _, _, names in os.walk(tmp_path / "r") for f in names if f.endswith(".parquet")]
    assert len(found) >= 4 and all(f.endswith(".zstd.parquet") for f in found)
