"""SQL layer: the ``orders`` table, three KPI views and read-only query text.

Views are Spark temporary views; the Analyzer inlines them into each query,
so a query over ``monthly_kpis`` is planned from the order-line scan with
filters and column pruning pushed through.  The store can also be written
once (:func:`write_sql_store`): the ``orders`` table as Parquet partitioned by
``order_year`` under the shared folder, with the views registered over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storelens.functions.exprs import round_half_away
from storelens.operators.rollup import Rollup
from storelens.schema import BASE_COLUMNS, DERIVED_COLUMNS, REFERENCE_NAMES
from storelens.session import SCAN_BYTES, fresh_dir, settings
from storelens.sources.reuse import COMPRESSION

ROUND4 = "signum({x}) * floor(abs({x}) * 10000.0 + 0.5) / 10000.0"
ROUND2 = "signum({x}) * floor(abs({x}) * 100.0 + 0.5) / 100.0"


def _mean(col: str) -> str:
    return f"try_divide(cast(sum({col}) as double), count({col}))"


def orders_table(ol: DataFrame) -> DataFrame:
    """Enriched order lines with the source file's column names; the two order
    dates and ``order_month_ts`` as ``YYYY-MM-DD`` text."""
    cols = []
    for name in ol.columns:
        c = F.col(f"`{name}`")
        if name in ("order_date", "ship_date", "order_month_ts"):
            c = F.date_format(c, "yyyy-MM-dd")
        cols.append(c.alias(REFERENCE_NAMES.get(name, name)))
    return ol.select(*cols)


VIEW_SQL = {
    "monthly_kpis": f"""
        select
            order_month,
            cast(round(sum(Sales), 2) as double) as sales,
            cast(round(sum(Profit), 2) as double) as profit,
            count(distinct `Order ID`) as orders,
            count(distinct `Customer ID`) as customers,
            {ROUND4.format(x=_mean('Discount'))} as avg_discount,
            {ROUND2.format(x=_mean('shipping_days'))} as avg_shipping_days,
            {ROUND4.format(x=_mean('is_loss'))} as loss_rate
        from orders
        group by order_month""",
    "category_kpis": f"""
        select
            Category,
            `Sub-Category` as sub_category,
            cast(round(sum(Sales), 2) as double) as sales,
            cast(round(sum(Profit), 2) as double) as profit,
            count(distinct `Order ID`) as orders,
            {ROUND4.format(x=_mean('Discount'))} as avg_discount,
            {ROUND4.format(x=_mean('is_loss'))} as loss_rate
        from orders
        group by Category, `Sub-Category`""",
    "customer_kpis": f"""
        select
            `Customer ID` as customer_id,
            `Customer Name` as customer_name,
            Segment,
            cast(round(sum(Sales), 2) as double) as sales,
            cast(round(sum(Profit), 2) as double) as profit,
            count(distinct `Order ID`) as orders,
            {ROUND4.format(x=_mean('Discount'))} as avg_discount,
            max(`Order Date`) as last_order_date
        from orders
        group by `Customer ID`, `Customer Name`, Segment""",
}

# The starter queries, verbatim.
DEFAULT_SQL_QUERIES: dict[str, str] = {
    "Monthly KPI trend": (
        "select order_month, sales, profit, orders, customers, avg_discount, loss_rate "
        "from monthly_kpis order by order_month desc limit 18"
    ),
    "Most profitable sub-categories": (
        "select Category, sub_category, sales, profit, orders, avg_discount, loss_rate "
        "from category_kpis order by profit desc limit 15"
    ),
    "Highest loss-rate sub-categories": (
        "select Category, sub_category, sales, profit, avg_discount, loss_rate "
        "from category_kpis where orders >= 20 order by loss_rate desc, sales desc limit 15"
    ),
    "Best customers by profit": (
        "select customer_name, Segment, sales, profit, orders, avg_discount, last_order_date "
        "from customer_kpis order by profit desc limit 15"
    ),
}
EXAMPLE_SQL = (
    "select Region, round(sum(Sales), 2) as sales, round(sum(Profit), 2) as profit\n"
    "from orders\n"
    "group by Region\n"
    "order by profit desc;"
)


def write_sql_store(spark: SparkSession, ol: DataFrame, path: str | None = None) -> str:
    """Write the ``orders`` table once as Parquet partitioned by ``order_year``.

    The path defaults to a new folder under the cluster's shared checkpoint
    directory.  No row is moved: the stored lines lie by year, so a task that
    reads at most ``SCAN_BYTES`` of them meets few years and writes one file for
    each (any other frame: a file a task and year).  A written table also cuts the
    lineage: a lost executor costs a re-read, not a re-run of the star join.
    """
    path = path or fresh_dir(spark, "sql_store")
    with settings(spark, {"spark.sql.files.maxPartitionBytes": SCAN_BYTES}):
        orders_table(ol).write.mode("overwrite").partitionBy("order_year").parquet(path, compression=COMPRESSION)
    return path


def read_sql_store(spark: SparkSession, path: str) -> DataFrame:
    """The written ``orders`` table, columns in store order (a year filter prunes partitions)."""
    table = spark.read.parquet(path)
    base = [REFERENCE_NAMES.get(c, c) for c in BASE_COLUMNS]
    extra = [c for c in table.columns if c not in base and c not in DERIVED_COLUMNS]
    return table.select(*[F.col(f"`{c}`") for c in base + extra + DERIVED_COLUMNS])


def _rolled_mean(c: str) -> Column:
    return F.try_divide(F.sum(f"{c}_sum").cast("double"), F.sum(f"{c}_n"))


def rolled_views(rollup: Rollup) -> dict[str, DataFrame]:
    """The three KPI views from the rollup: same columns and values, no distinct over the lines."""
    money = [F.round(F.sum(c), 2).cast("double").alias(c) for c in ("sales", "profit")]
    discount = round_half_away(_rolled_mean("discount"), 4).alias("avg_discount")
    loss = round_half_away(_rolled_mean("is_loss"), 4).alias("loss_rate")
    months = rollup.customers.groupBy("order_month").agg(
        *money, F.sum("orders_month").alias("orders"), discount,
        round_half_away(_rolled_mean("shipping_days"), 2).alias("avg_shipping_days"), loss)
    heads = rollup.customer_count("order_month").withColumnRenamed("order_month", "month")
    months = months.join(heads, F.col("order_month").eqNullSafe(F.col("month")), "left").select(
        "order_month", "sales", "profit", "orders", F.coalesce("customers", F.lit(0).cast("long")).alias("customers"),
        "avg_discount", "avg_shipping_days", "loss_rate")
    products = rollup.products.groupBy(F.col("category").alias("Category"), "sub_category").agg(
        *money, F.sum("orders_product").alias("orders"), discount, loss)
    customers = rollup.customers.groupBy("customer_id", "customer_name", F.col("segment").alias("Segment")).agg(
        *money, F.sum("orders_customer").alias("orders"), discount,
        F.date_format(F.max("last_order"), "yyyy-MM-dd").alias("last_order_date"))
    return {"monthly_kpis": months, "category_kpis": products, "customer_kpis": customers}


def register_sql_store(spark: SparkSession, ol: DataFrame | None = None, path: str | None = None,
                       rollup: Rollup | None = None) -> None:
    """Publish ``orders`` and the three KPI views in the session catalog.

    ``orders`` is the order-line frame ``ol`` (session store) or the table
    written at ``path`` by :func:`write_sql_store` (persistent store).  With
    the ``rollup`` of the same lines the views read its tables.
    """
    orders = read_sql_store(spark, path) if path is not None else orders_table(ol)
    orders.createOrReplaceTempView("orders")
    views = rolled_views(rollup) if rollup is not None else {n: spark.sql(body) for n, body in VIEW_SQL.items()}
    for name, view in views.items():
        view.createOrReplaceTempView(name)


def run_sql(spark: SparkSession, query: str) -> DataFrame:
    """Run one read-only query over the published table and views.

    The text is wrapped as a sub-query, so Spark's own parser rejects DDL, DML
    and multiple statements; CTEs, ORDER BY/LIMIT and a trailing ``;`` work.
    Double-quoted names (``"Order ID"``) are identifiers.  Decimal results are
    returned as double (the store's numbers are floating point).
    """
    text = query.strip().rstrip(";").rstrip()
    key = "spark.sql.ansi.doubleQuotedIdentifiers"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df = spark.sql(f"select * from (\n{text}\n) q")
    finally:
        spark.conf.set(key, before)
    cols = [F.col(f"`{f.name}`").cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType)
            else F.col(f"`{f.name}`") for f in df.schema.fields]
    return df.select(*cols)


# Columns a SQL result needs for the month trend preview.
TREND_COLUMNS = ("order_month", "sales", "profit")


def trend_preview(result: DataFrame) -> DataFrame | None:
    """Month-ordered ``order_month, sales, profit`` of a SQL result, or None.

    The preview exists only when the result has all three columns; an empty
    result gives an empty preview.
    """
    if not set(TREND_COLUMNS) <= set(result.columns):
        return None
    return result.select(*TREND_COLUMNS).orderBy("order_month")


def table_counts(spark: SparkSession) -> DataFrame:
    """Row counts of the table and the three views (one row)."""
    return run_sql(spark, """
        select (select count(*) from orders) as orders,
               (select count(*) from monthly_kpis) as months,
               (select count(*) from category_kpis) as categories,
               (select count(*) from customer_kpis) as customers""")
