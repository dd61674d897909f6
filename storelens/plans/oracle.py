"""Independent SQL (DuckDB dialect) for every SQL-expressible query.

Each text starts from the driver's raw star tables, builds the same canonical
order lines with plain SQL, and computes the result with ordinary window
functions (``row_number`` over the whole table for the quartiles) instead of
the distributed boundary search the Spark side uses.
"""

from __future__ import annotations

from storelens.operators.exact_tree import BOUNDS, EVERY_VALUE
from storelens.plans import params as P
from storelens.plans import tree_sql
from storelens.schema import DISCOUNT_BAND_LABELS, NUMERIC_FEATURES, SALES_BAND_LABELS


def mean(x: str) -> str:
    return f"(CAST(sum({x}) AS DOUBLE) / NULLIF(count({x}), 0))"


def rnd(x: str, d: int) -> str:
    s = f"{10 ** d}.0"
    return f"(sign({x}) * floor(abs({x}) * {s} + 0.5) / {s})"


def tot(x: str) -> str:
    return f"CAST(coalesce(sum({x}), 0) AS DOUBLE)"


def ratio(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0))"


def money(x: str) -> str:
    r = f"CAST(round_even(CAST({x} AS DECIMAL(38,4)), 0) AS BIGINT)"
    return (f"CASE WHEN {x} IS NULL THEN NULL ELSE '$' || CASE WHEN {x} < 0 AND {r} = 0 THEN '-0' "
            f"ELSE format('{{:,}}', {r}) END END")


def sql_list(values) -> str:
    return ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)


def quartile(rn: str, n: str) -> str:
    return f"(CASE WHEN {n} = 1 THEN 1 ELSE greatest(1, (4 * ({rn} - 1) + {n} - 2) // ({n} - 1)) END)"


_SALES = "CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) AS DECIMAL(18,4))"
_DISC = "CAST(CAST(l.l_discount AS DECIMAL(4,2)) * 8 AS DECIMAL(6,4))"
_BAND = "CASE " + " ".join(
    f"WHEN discount > {lo} AND discount <= {hi} THEN '{lab}'"
    for lo, hi, lab in zip(["-0.01", "0.0", "0.1", "0.2", "0.4"], ["0.0", "0.1", "0.2", "0.4", "0.8"],
                           DISCOUNT_BAND_LABELS)) + " END"
_SBAND = "[" + ", ".join(f"'{x}'" for x in SALES_BAND_LABELS) + "]"

BASE = f"""
src_orders AS (SELECT * FROM orders),
base AS (
  SELECT
    concat_ws('-', l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, CAST(l.l_quantity AS INTEGER),
              CAST(round(l.l_extendedprice * 100) AS BIGINT)) AS row_id,
    CAST(o.o_orderkey AS VARCHAR) AS order_id,
    CAST(o.o_orderdate AS DATE) AS order_date,
    CAST(o.o_orderdate AS DATE) + CAST((l.l_orderkey + l.l_linenumber) % 9 AS INTEGER) AS ship_date,
    o.o_orderpriority AS ship_mode,
    CAST(c.c_custkey AS VARCHAR) AS customer_id,
    c.c_name AS customer_name,
    c.c_mktsegment AS segment,
    n.n_name AS state,
    r.r_name AS region,
    p.p_type AS category,
    p.p_brand AS sub_category,
    {_SALES} AS sales,
    CAST(l.l_quantity AS INTEGER) AS quantity,
    {_DISC} AS discount,
    CAST({_SALES} * (1 - {_DISC}) - CAST(l.l_quantity AS INTEGER) * CAST(p.p_retailprice AS DECIMAL(18,2)) * 0.5
         AS DECIMAL(18,4)) AS profit
  FROM lineitem l
  JOIN src_orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN part p ON l.l_partkey = p.p_partkey
),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY sales, row_id) AS _rn, count(sales) OVER () AS _n FROM base
),
ol AS (
  SELECT row_id, order_id, order_date, ship_date, ship_mode, customer_id, customer_name, segment, state,
    region, category, sub_category, sales, quantity, discount, profit,
    CAST(year(order_date) AS INTEGER) AS order_year,
    strftime(order_date, '%Y-%m') AS order_month,
    CAST(date_trunc('month', order_date) AS DATE) AS order_month_ts,
    CAST(year(order_date) AS VARCHAR) || 'Q' || CAST(quarter(order_date) AS VARCHAR) AS order_quarter,
    CAST(ship_date - order_date AS INTEGER) AS shipping_days,
    coalesce({ratio('profit', 'sales')}, 0.0) AS profit_margin,
    CAST(coalesce(profit < 0, false) AS INTEGER) AS is_loss,
    {_BAND} AS discount_band,
    CASE WHEN sales IS NULL THEN NULL ELSE {_SBAND}[{quartile('_rn', '_n')}] END AS sales_band,
    CAST((SELECT max(order_date) FROM base) - order_date AS INTEGER) AS days_from_latest_order
  FROM ranked
)"""

ORDERS_REF = """,
orders AS (
  SELECT row_id AS "Row ID", order_id AS "Order ID", strftime(order_date, '%Y-%m-%d') AS "Order Date",
    strftime(ship_date, '%Y-%m-%d') AS "Ship Date", ship_mode AS "Ship Mode", customer_id AS "Customer ID",
    customer_name AS "Customer Name", segment AS "Segment", state AS "State", region AS "Region",
    category AS "Category", sub_category AS "Sub-Category", sales AS "Sales", quantity AS "Quantity",
    discount AS "Discount", profit AS "Profit", order_year, order_month,
    strftime(order_month_ts, '%Y-%m-%d') AS order_month_ts, order_quarter, shipping_days, profit_margin,
    is_loss, discount_band, sales_band, days_from_latest_order
  FROM ol
),
monthly_kpis AS (
  SELECT order_month, CAST(round(sum("Sales"), 2) AS DOUBLE) AS sales, CAST(round(sum("Profit"), 2) AS DOUBLE) AS profit,
    count(DISTINCT "Order ID") AS orders, count(DISTINCT "Customer ID") AS customers,
    {d4} AS avg_discount, {s2} AS avg_shipping_days, {l4} AS loss_rate
  FROM orders GROUP BY order_month
),
category_kpis AS (
  SELECT "Category", "Sub-Category" AS sub_category, CAST(round(sum("Sales"), 2) AS DOUBLE) AS sales,
    CAST(round(sum("Profit"), 2) AS DOUBLE) AS profit, count(DISTINCT "Order ID") AS orders,
    {d4} AS avg_discount, {l4} AS loss_rate
  FROM orders GROUP BY "Category", "Sub-Category"
),
customer_kpis AS (
  SELECT "Customer ID" AS customer_id, "Customer Name" AS customer_name, "Segment",
    CAST(round(sum("Sales"), 2) AS DOUBLE) AS sales, CAST(round(sum("Profit"), 2) AS DOUBLE) AS profit,
    count(DISTINCT "Order ID") AS orders, {d4} AS avg_discount, max("Order Date") AS last_order_date
  FROM orders GROUP BY "Customer ID", "Customer Name", "Segment"
)""".format(d4=rnd(mean('"Discount"'), 4), s2=rnd(mean("shipping_days"), 2), l4=rnd(mean("is_loss"), 4))


def q(body: str, sql_store: bool = False) -> str:
    return "WITH " + BASE + (ORDERS_REF if sql_store else "") + "\n" + body


_FILTER = (f"order_year IN ({sql_list(P.FILTER_YEARS)}) AND region IN ({sql_list(P.FILTER_REGIONS)}) "
           f"AND category IN ({sql_list(P.FILTER_CATEGORIES)}) AND segment IN ({sql_list(P.FILTER_SEGMENTS)}) "
           f"AND state IN ({sql_list(P.FILTER_STATES)})")

_MONTHLY = f"""monthly AS (
  SELECT order_month, order_month_ts, {tot('sales')} AS sales, {tot('profit')} AS profit,
         coalesce(sum(sales), 0) AS sales_dec, coalesce(sum(profit), 0) AS profit_dec,
         count(DISTINCT order_id) AS orders
  FROM ol WHERE order_month IS NOT NULL AND order_month_ts IS NOT NULL GROUP BY order_month, order_month_ts
),
monthly_g AS (
  SELECT order_month, order_month_ts, sales, profit, orders, sales_dec, profit_dec,
    coalesce(sales / NULLIF(lag(sales) OVER (ORDER BY order_month_ts), 0) - 1.0, 0.0) AS sales_growth_pct,
    coalesce(profit / NULLIF(lag(profit) OVER (ORDER BY order_month_ts), 0) - 1.0, 0.0) AS profit_growth_pct,
    lag(sales) OVER (ORDER BY order_month_ts) AS prev_sales, lag(profit) OVER (ORDER BY order_month_ts) AS prev_profit
  FROM monthly
)"""

_ANOMALY = f""", means AS (
  SELECT CAST(sum(sales_dec) AS DOUBLE) / count(*) AS sm, CAST(sum(profit_dec) AS DOUBLE) / count(*) AS pm FROM monthly
),
stats AS (
  SELECT any_value(sm) AS sm, any_value(pm) AS pm,
         sqrt(avg((CAST(sales_dec AS DOUBLE) - sm) * (CAST(sales_dec AS DOUBLE) - sm))) AS ss,
         sqrt(avg((CAST(profit_dec AS DOUBLE) - pm) * (CAST(profit_dec AS DOUBLE) - pm))) AS ps
  FROM monthly, means
),
z AS (
  SELECT m.*, (m.sales - s.sm) / (CASE WHEN s.ss = 0 THEN 1.0 ELSE s.ss END) AS sz,
              (m.profit - s.pm) / (CASE WHEN s.ps = 0 THEN 1.0 ELSE s.ps END) AS pz
  FROM monthly_g m, stats s
),
anomalies AS (
  SELECT order_month, order_month_ts, sales, profit, orders, sales_growth_pct, profit_growth_pct,
    {rnd('sz', 6)} AS sales_zscore, {rnd('pz', 6)} AS profit_zscore,
    (abs(sz) >= 1.5 OR abs(pz) >= 1.5) AS alert_flag,
    CASE WHEN NOT (abs(sz) >= 1.5 OR abs(pz) >= 1.5) THEN 'Normal' WHEN pz < -1.5 THEN 'Profit dip'
         ELSE 'Demand spike / unusual movement' END AS alert_reason
  FROM z
)"""

_CUST = f"""cust AS (
  SELECT customer_id, customer_name,
    CAST((SELECT max(order_date) FROM ol) - max(order_date) AS INTEGER) AS recency_days,
    count(DISTINCT order_id) AS frequency, coalesce(sum(sales), 0) AS monetary_dec,
    coalesce(sum(profit), 0) AS profit_dec
  FROM ol WHERE customer_id IS NOT NULL AND customer_name IS NOT NULL GROUP BY customer_id, customer_name
),
rfm_r AS (
  SELECT *,
    row_number() OVER (ORDER BY recency_days DESC, customer_id, customer_name) AS r_rn,
    row_number() OVER (ORDER BY frequency, customer_id, customer_name) AS f_rn,
    row_number() OVER (ORDER BY monetary_dec, customer_id, customer_name) AS m_rn,
    count(*) OVER () AS n
  FROM cust
),
rfm0 AS (
  SELECT customer_id, customer_name, recency_days, frequency, CAST(monetary_dec AS DOUBLE) AS monetary,
    CAST(profit_dec AS DOUBLE) AS profit,
    CAST({quartile('r_rn', 'n')} AS INTEGER) AS recency_score,
    CAST({quartile('f_rn', 'n')} AS INTEGER) AS frequency_score,
    CAST({quartile('m_rn', 'n')} AS INTEGER) AS monetary_score
  FROM rfm_r
),
rfm AS (
  SELECT *, recency_score + frequency_score + monetary_score AS rfm_score,
    CASE WHEN recency_score + frequency_score + monetary_score >= 10 THEN 'Champion'
         WHEN recency_score + frequency_score + monetary_score >= 8 THEN 'Loyal'
         WHEN recency_score + frequency_score + monetary_score >= 6 THEN 'Promising' ELSE 'At Risk' END AS rfm_segment
  FROM rfm0
)"""


def _pct(v: str) -> str:
    return (f"(CASE WHEN {v} IS NULL THEN NULL ELSE (rank() OVER (ORDER BY {v}) "
            f"+ (count(*) OVER (PARTITION BY {v}) - 1) / 2.0) / count({v}) OVER () END)")


_OPP = f"""opp0 AS (
  SELECT category, sub_category, {tot('sales')} AS sales, {tot('profit')} AS profit,
    count(DISTINCT order_id) AS orders, {mean('discount')} AS avg_discount, {mean('is_loss')} AS loss_rate
  FROM ol WHERE category IS NOT NULL AND sub_category IS NOT NULL GROUP BY category, sub_category
),
opp AS (
  SELECT category, sub_category, sales, profit, orders, avg_discount, loss_rate,
    profit / NULLIF(sales, 0) AS profit_margin,
    {_pct('sales')} * 0.35 + {_pct('1.0 - loss_rate')} * 0.25 + {_pct('profit')} * 0.25
      + {_pct('1.0 - avg_discount')} * 0.15 AS opportunity_score
  FROM opp0
)"""


def _scen(adj: float | str, sweep: str = "") -> str:
    return f"""scen0 AS (
  SELECT sub_category, {tot('sales')} AS sales, {tot('profit')} AS profit, {mean('discount')} AS avg_discount
  FROM ol WHERE sub_category IS NOT NULL GROUP BY sub_category
),
scen1 AS (
  SELECT *, CASE WHEN avg_discount IS NULL THEN NULL ELSE least(greatest(avg_discount + {adj}, 0.0), 0.8) END
    AS simulated_discount FROM scen0 {sweep}
),
scen2 AS (SELECT *, simulated_discount - avg_discount AS discount_change FROM scen1),
scen3 AS (SELECT *, sales * discount_change * -0.35 AS estimated_profit_impact FROM scen2),
scen AS (SELECT *, profit + estimated_profit_impact AS projected_profit FROM scen3)"""


_QUALITY_SRC = [("Sales", "CAST(CAST(sales AS DOUBLE) AS VARCHAR)"), ("Profit", "CAST(CAST(profit AS DOUBLE) AS VARCHAR)"),
                ("Discount", "CAST(CAST(discount AS DOUBLE) AS VARCHAR)"), ("Quantity", "CAST(quantity AS VARCHAR)"),
                ("shipping_days", "CAST(shipping_days AS VARCHAR)"), ("Region", "region"), ("State", "state"),
                ("Category", "category"), ("Sub-Category", "sub_category")]

_DQ = "dq_long AS (" + " UNION ALL ".join(
    f"SELECT {i} AS pos, '{name}' AS \"column\", {expr} AS value, row_id FROM ol"
    for i, (name, expr) in enumerate(_QUALITY_SRC)) + ")"

_TOTALS = f"""t AS (
  SELECT sum(sales) AS s, sum(profit) AS p, count(DISTINCT order_id) AS o, count(DISTINCT customer_id) AS c,
    {mean('shipping_days')} AS ship, {mean('is_loss')} AS loss, {mean('discount')} AS disc FROM ol
)"""

_RULE = f"""scored AS (
  SELECT is_loss AS label, CAST(discount > 0.4 AS INTEGER) AS prediction,
         CAST(profit AS DOUBLE) AS actual, CAST(sales AS DOUBLE) * 0.3 AS predicted FROM ol
)"""


# the hold-out of each class: the total size dealt by largest remainder
_SPLIT = f"""cls AS (SELECT is_loss, count(*) AS rows FROM ol GROUP BY is_loss),
cls_t AS (SELECT *, CAST(sum(rows) OVER () AS BIGINT) AS total,
  CAST(ceil(sum(rows) OVER () * {P.TEST_FRACTION}) AS BIGINT) AS t FROM cls),
cls_r AS (SELECT *, rows * t // total AS whole,
  row_number() OVER (ORDER BY rows * t % total DESC, is_loss) AS place FROM cls_t),
sizes AS (SELECT is_loss, rows, whole + CASE WHEN place <= t - CAST(sum(whole) OVER () AS BIGINT) THEN 1 ELSE 0 END
  AS test_rows FROM cls_r)"""

_EXEC = f"""last AS (SELECT * FROM monthly_g ORDER BY order_month_ts DESC LIMIT 1),
        tt AS (SELECT {tot('sales')} AS total_sales, {tot('profit')} AS total_profit,
                      count(DISTINCT order_id) AS total_orders, count(DISTINCT customer_id) AS total_customers,
                      coalesce({mean('is_loss')}, 0.0) AS loss_rate FROM ol),
        ex AS (SELECT total_sales, total_profit, total_orders, total_customers,
          coalesce(total_profit / NULLIF(total_sales, 0), 0.0) AS profit_margin, loss_rate,
          coalesce((SELECT (sales - prev_sales) / NULLIF(prev_sales, 0) FROM last), 0.0) AS sales_delta,
          coalesce((SELECT (profit - prev_profit) / NULLIF(prev_profit, 0) FROM last), 0.0) AS profit_delta
        FROM tt)"""


def amount(x: str, digits: int, scale: int) -> str:
    """Half-even text of x / scale with thousands separators."""
    return f"format('{{:,.{digits}f}}', CAST(round_even(CAST({x} / {scale}.0 AS DECIMAL(38,12)), {digits}) AS DOUBLE))"


def percent(x: str) -> str:
    return f"(format('{{:.1f}}', CAST(round_even(CAST({x} * 100 AS DECIMAL(38,12)), 1) AS DOUBLE)) || '%')"


def _kpi_rows(pairs) -> str:
    return " UNION ALL ".join(f"SELECT {i} AS pos, '{m}' AS metric, CAST({v} AS DOUBLE) AS value FROM t"
                              for i, (m, v) in enumerate(pairs))


def _top_by(label: str, value: str, where: str, largest: bool) -> str:
    order = f"{value} DESC, {label}" if largest else f"{value}, {label}"
    return f"(SELECT {label} FROM g WHERE {where} AND {label} IS NOT NULL ORDER BY {order} LIMIT 1)"


def _val_by(label: str, value: str, where: str, largest: bool) -> str:
    order = f"{value} DESC, {label}" if largest else f"{value}, {label}"
    return f"(SELECT {value} FROM g WHERE {where} AND {label} IS NOT NULL ORDER BY {order} LIMIT 1)"


ORACLE: dict[str, str] = {
    "order_lines": q("SELECT * FROM ol"),
    "filter_orders": q(f"SELECT * FROM ol WHERE {_FILTER}"),
    "export_filtered": q(f"SELECT * FROM ol WHERE {_FILTER}"),
    "filter_options": q(" UNION ALL ".join(
        f"SELECT DISTINCT '{d}' AS dimension, CAST({d} AS VARCHAR) AS value FROM ol WHERE {d} IS NOT NULL"
        for d in ["order_year", "region", "category", "segment", "state", "ship_mode"])),
    "customer_summary": q(f"""SELECT customer_id, customer_name, segment, {tot('sales')} AS sales, {tot('profit')} AS profit,
        count(DISTINCT order_id) AS orders, {mean('discount')} AS avg_discount, max(order_date) AS last_order
        FROM ol WHERE customer_id IS NOT NULL AND customer_name IS NOT NULL AND segment IS NOT NULL
        GROUP BY customer_id, customer_name, segment"""),
    "state_summary": q(f"""SELECT state, region, {tot('sales')} AS sales, {tot('profit')} AS profit,
        count(DISTINCT order_id) AS orders, {mean('discount')} AS avg_discount
        FROM ol WHERE state IS NOT NULL AND region IS NOT NULL GROUP BY state, region"""),
    "monthly_summary": q(", " + _MONTHLY + """
        SELECT order_month, order_month_ts, sales, profit, orders, sales_growth_pct, profit_growth_pct FROM monthly_g"""),
    "executive_kpis": q(", " + _MONTHLY + ", " + _EXEC + " SELECT * FROM ex"),
    "kpi_cards": q(", " + _MONTHLY + ", " + _EXEC + f"""
        SELECT 1 AS pos, 'Revenue' AS label, '$' || {amount('total_sales', 2, 1000000)} || 'M' AS "value",
               {percent('sales_delta')} AS delta FROM ex
        UNION ALL SELECT 2, 'Net Profit', '$' || {amount('total_profit', 0, 1000)} || 'K', {percent('profit_delta')} FROM ex
        UNION ALL SELECT 3, 'Profit Margin', {percent('profit_margin')}, NULL FROM ex
        UNION ALL SELECT 4, 'Orders', format('{{:,}}', total_orders), NULL FROM ex
        UNION ALL SELECT 5, 'Customers', format('{{:,}}', total_customers), NULL FROM ex
        UNION ALL SELECT 6, 'Loss-Making Orders', {percent('loss_rate')}, NULL FROM ex"""),
    "report_money": q(", " + _MONTHLY + ", " + _EXEC + f""" SELECT '$' || {amount('total_sales', 2, 1)} AS total_sales_text,
        '$' || {amount('total_profit', 2, 1)} AS total_profit_text FROM ex"""),
    "region_summary": q(f"""SELECT region, {tot('sales')} AS sales, {tot('profit')} AS profit, {mean('discount')} AS avg_discount
        FROM ol WHERE region IS NOT NULL GROUP BY region"""),
    "category_summary": q(f"""SELECT category, {tot('sales')} AS sales, {tot('profit')} AS profit,
        count(DISTINCT order_id) AS orders FROM ol WHERE category IS NOT NULL GROUP BY category"""),
    "subcategory_summary": q(f"""SELECT sub_category, {tot('sales')} AS sales, {tot('profit')} AS profit,
        {mean('discount')} AS avg_discount FROM ol WHERE sub_category IS NOT NULL GROUP BY sub_category"""),
    "sales_by_year": q(f"SELECT order_year, {tot('sales')} AS sales FROM ol WHERE order_year IS NOT NULL GROUP BY order_year"),
    "sales_by_category": q(f"SELECT category, {tot('sales')} AS sales FROM ol WHERE category IS NOT NULL GROUP BY category"),
    "profit_by_category": q(f"SELECT category, {tot('profit')} AS profit FROM ol WHERE category IS NOT NULL GROUP BY category"),
    "profit_by_subcategory": q(f"""SELECT sub_category, {tot('profit')} AS profit FROM ol
        WHERE sub_category IS NOT NULL GROUP BY sub_category"""),
    "profit_by_discount": q(f"""SELECT CAST(discount AS DOUBLE) AS discount, {mean('profit')} AS avg_profit FROM ol
        WHERE discount IS NOT NULL GROUP BY discount"""),
    "sales_by_region": q(f"SELECT region, {tot('sales')} AS sales FROM ol WHERE region IS NOT NULL GROUP BY region"),
    "monthly_sales_trend": q(f"""SELECT * FROM (SELECT order_month, {tot('sales')} AS sales FROM ol
        WHERE order_month IS NOT NULL GROUP BY order_month ORDER BY order_month DESC LIMIT {P.TREND_MONTHS})"""),
    "top_states": q(f"""SELECT state, region, {tot('sales')} AS sales, {tot('profit')} AS profit,
        count(DISTINCT order_id) AS orders, {mean('discount')} AS avg_discount
        FROM ol WHERE state IS NOT NULL AND region IS NOT NULL GROUP BY state, region
        ORDER BY sales DESC, state, region LIMIT {P.TOP_STATES}"""),
    "top_customers": q(f"""SELECT customer_id, customer_name, segment, {tot('sales')} AS sales, {tot('profit')} AS profit,
        count(DISTINCT order_id) AS orders, {mean('discount')} AS avg_discount, max(order_date) AS last_order
        FROM ol WHERE customer_id IS NOT NULL AND customer_name IS NOT NULL AND segment IS NOT NULL
        GROUP BY customer_id, customer_name, segment ORDER BY sales DESC, profit DESC, customer_id LIMIT {P.TOP_CUSTOMERS}"""),
    "top_customers_total": q(f"""SELECT customer_id, customer_name, {tot('sales')} AS total_sales,
        {tot('profit')} AS total_profit, count(DISTINCT order_id) AS orders
        FROM ol WHERE customer_id IS NOT NULL AND customer_name IS NOT NULL GROUP BY customer_id, customer_name
        ORDER BY total_sales DESC, customer_id, customer_name LIMIT {P.TOP_CUSTOMERS_TOTAL}"""),
    "kpi_summary": q(", " + _TOTALS + " SELECT metric, value FROM (" + _kpi_rows([
        ("Total sales", "round(s, 2)"), ("Total profit", "round(p, 2)"),
        ("Profit margin", rnd(ratio("p", "s"), 4)), ("Orders", "o"), ("Customers", "c"),
        ("Average shipping days", rnd("ship", 2)), ("Loss row rate", rnd("loss", 4))]) + ")"),
    "kpi_summary_compact": q(", " + _TOTALS + " SELECT metric, value FROM (" + _kpi_rows([
        ("Total Sales", "round(s, 2)"), ("Total Profit", "round(p, 2)"),
        ("Profit Margin", rnd(ratio("p", "s"), 4)), ("Average Discount", rnd("disc", 4)),
        ("Average Shipping Days", rnd("ship", 2)), ("Orders", "o"), ("Customers", "c")]) + ")"),
    "dataset_snapshot": q("""SELECT count(*) AS rows, min(order_year) AS first_year, max(order_year) AS last_year,
        CAST(sum(sales) AS DOUBLE) AS total_sales, CAST(sum(profit) AS DOUBLE) AS total_profit,
        CAST(sum(profit) AS DOUBLE) / NULLIF(CAST(sum(sales) AS DOUBLE), 0) AS profit_margin FROM ol"""),
    "insight_facts": q(f""", g AS (
          SELECT 'cat' AS k, category AS label, {tot('sales')} AS sales, {tot('profit')} AS profit, NULL::DOUBLE AS avg_profit FROM ol GROUP BY category
          UNION ALL SELECT 'reg', region, {tot('sales')}, {tot('profit')}, NULL FROM ol GROUP BY region
          UNION ALL SELECT 'sub', sub_category, {tot('sales')}, {tot('profit')}, NULL FROM ol GROUP BY sub_category
          UNION ALL SELECT 'disc', CAST(CAST(discount AS DOUBLE) AS VARCHAR), NULL, NULL, {mean('profit')} FROM ol GROUP BY discount
        ), a AS (SELECT {tot('sales')} AS ts, {tot('profit')} AS tp, {mean('discount')} AS ad,
                        {mean('shipping_days')} AS ash, {mean('is_loss')} AS lr FROM ol)
        SELECT 'total_sales' AS fact, NULL::VARCHAR AS label, ts AS value FROM a
        UNION ALL SELECT 'total_profit', NULL, tp FROM a
        UNION ALL SELECT 'profit_margin', NULL, tp / NULLIF(ts, 0) FROM a
        UNION ALL SELECT 'average_discount', NULL, ad FROM a
        UNION ALL SELECT 'average_shipping_days', NULL, ash FROM a
        UNION ALL SELECT 'loss_row_rate', NULL, lr FROM a
        UNION ALL SELECT 'top_category_by_sales', {_top_by('label', 'sales', "k = 'cat'", True)}, {_val_by('label', 'sales', "k = 'cat'", True)}
        UNION ALL SELECT 'top_region_by_sales', {_top_by('label', 'sales', "k = 'reg'", True)}, {_val_by('label', 'sales', "k = 'reg'", True)}
        UNION ALL SELECT 'top_subcategory_by_profit', {_top_by('label', 'profit', "k = 'sub'", True)}, {_val_by('label', 'profit', "k = 'sub'", True)}
        UNION ALL SELECT 'bottom_subcategory_by_profit', {_top_by('label', 'profit', "k = 'sub'", False)}, {_val_by('label', 'profit', "k = 'sub'", False)}
        UNION ALL SELECT 'worst_discount_by_avg_profit', {_top_by('label', 'avg_profit', "k = 'disc' AND avg_profit IS NOT NULL", False)}, {_val_by('label', 'avg_profit', "k = 'disc' AND avg_profit IS NOT NULL", False)}
        """),
    "rfm": q(", " + _CUST + " SELECT * FROM rfm"),
    "rfm_segments": q(", " + _CUST + """ SELECT rfm_segment, count(customer_id) AS customers,
        CAST(sum(CAST(monetary AS DECIMAL(38,4))) AS DOUBLE) AS sales FROM rfm GROUP BY rfm_segment"""),
    "rfm_watchlist": q(", " + _CUST + f""" SELECT customer_name, recency_days, frequency, monetary, profit, rfm_segment
        FROM rfm ORDER BY rfm_score DESC, monetary DESC, customer_id LIMIT {P.WATCHLIST}"""),
    "forecast": q(", " + _MONTHLY + f""",
        hist AS (SELECT order_month_ts, sales_dec, profit_dec,
                        CAST(row_number() OVER (ORDER BY order_month_ts) - 1 AS BIGINT) AS month_index FROM monthly),
        coef AS (SELECT CAST(count(*) AS DECIMAL(20,0)) AS n, CAST(sum(month_index) AS DECIMAL(20,0)) AS sx,
                        CAST(sum(month_index * month_index) AS DECIMAL(20,0)) AS sxx,
                        sum(CAST(sales_dec AS DECIMAL(38,4))) AS sy,
                        CAST(sum(CAST(month_index AS DECIMAL(20,0)) * CAST(sales_dec AS DECIMAL(38,4))) AS DECIMAL(38,4)) AS sxy,
                        sum(CAST(profit_dec AS DECIMAL(38,4))) AS py,
                        CAST(sum(CAST(month_index AS DECIMAL(20,0)) * CAST(profit_dec AS DECIMAL(38,4))) AS DECIMAL(38,4)) AS pxy,
                        max(order_month_ts) AS last_ts, max(month_index) AS last_idx FROM hist),
        c2 AS (SELECT *, CAST(n * sxx - sx * sx AS DOUBLE) AS den FROM coef),
        c3 AS (SELECT *,
            CAST(CAST(n * sxy - sx * sy AS DECIMAL(38,4)) AS DOUBLE) / den AS ss,
            CAST(CAST(sy * sxx - sx * sxy AS DECIMAL(38,4)) AS DOUBLE) / den AS si,
            CAST(CAST(n * pxy - sx * py AS DECIMAL(38,4)) AS DOUBLE) / den AS ps,
            CAST(CAST(py * sxx - sx * pxy AS DECIMAL(38,4)) AS DOUBLE) / den AS pi FROM c2 WHERE n >= 2)
        SELECT order_month_ts, CAST(sales_dec AS DOUBLE) AS sales, CAST(profit_dec AS DOUBLE) AS profit, month_index,
               'historical' AS type FROM hist
        UNION ALL
        SELECT CAST(last_ts + to_months(CAST(step AS INTEGER)) AS DATE), greatest(0.0, ss * CAST(last_idx + step AS DOUBLE) + si),
               ps * CAST(last_idx + step AS DOUBLE) + pi, CAST(last_idx + step AS BIGINT), 'forecast'
        FROM c3, range(1, {P.FORECAST_PERIODS} + 1) t(step)"""),
    "monthly_anomalies": q(", " + _MONTHLY + _ANOMALY + " SELECT * FROM anomalies"),
    "alert_feed": q(", " + _MONTHLY + _ANOMALY + f""" SELECT order_month, sales, profit, alert_reason FROM anomalies
        WHERE alert_flag ORDER BY order_month_ts DESC LIMIT {P.ALERTS}"""),
    "product_opportunity": q(", " + _OPP + " SELECT * FROM opp"),
    "top_opportunities": q(", " + _OPP + f""" SELECT category, sub_category, sales, profit, loss_rate, opportunity_score
        FROM opp ORDER BY opportunity_score DESC, category, sub_category LIMIT {P.TOP_OPPORTUNITIES}"""),
    "discount_scenario": q(", " + _scen(P.SCENARIO_ADJUSTMENT) + " SELECT * FROM scen"),
    "discount_scenarios": q(", " + _scen("adjustment", "CROSS JOIN (SELECT unnest([" + ", ".join(
        f"CAST('{x}' AS DOUBLE)" for x in P.SCENARIO_SWEEP) + "]) AS adjustment) a") + " SELECT * FROM scen"),
    "top_scenario": q(", " + _scen(P.SCENARIO_ADJUSTMENT) + f""" SELECT sub_category, avg_discount, simulated_discount,
        estimated_profit_impact, projected_profit FROM scen ORDER BY estimated_profit_impact, sub_category
        LIMIT {P.TOP_SCENARIO}"""),
    "discount_risk_segments": q(", bands AS (" + " UNION ALL ".join(
        f"SELECT {i} AS no, '{b}' AS discount_band" for i, b in enumerate(DISCOUNT_BAND_LABELS)) + f""")
        SELECT b.discount_band, {mean('o.sales')} AS avg_sales, {mean('o.profit')} AS avg_profit,
               {mean('o.is_loss')} AS loss_rate, count(o.row_id) AS rows
        FROM bands b LEFT JOIN ol o ON o.discount_band = b.discount_band GROUP BY b.discount_band"""),
    "data_quality": q(", " + _DQ + """,
        d AS (SELECT pos, "column", value, count(*) AS n, min(row_id) AS first_row FROM dq_long GROUP BY pos, "column", value)
        SELECT "column", CAST(coalesce(sum(CASE WHEN value IS NULL THEN n END), 0) AS BIGINT) AS missing_values,
               count(value) AS unique_values,
               coalesce(arg_min(value, first_row) FILTER (WHERE value IS NOT NULL), 'N/A') AS sample_value
        FROM d GROUP BY pos, "column" """),
    "recent_orders": q(f"""SELECT order_date, order_id, customer_name, category, sub_category, region,
        {money('sales')} AS sales_text, {money('profit')} AS profit_text,
        CASE WHEN profit < 0 THEN 'High Risk' ELSE 'Normal' END AS risk_flag
        FROM ol WHERE order_date IS NOT NULL ORDER BY order_date DESC, row_id LIMIT {P.RECENT}"""),
    "monitor_snapshot": q(f""", r AS (SELECT * FROM ol WHERE order_date IS NOT NULL ORDER BY order_date DESC, row_id LIMIT {P.RECENT})
        SELECT count(*) AS recent_orders, count(*) FILTER (WHERE profit < 0) AS negative_profit_orders,
               coalesce({mean('shipping_days')}, 0.0) AS avg_shipping_days, coalesce({mean('discount')}, 0.0) AS avg_discount FROM r"""),
    "daily_pulse": q(f"""SELECT * FROM (SELECT order_date AS order_day, {tot('sales')} AS sales, {tot('profit')} AS profit,
        count(DISTINCT order_id) AS orders FROM ol WHERE order_date IS NOT NULL GROUP BY order_date
        ORDER BY order_day DESC LIMIT {P.PULSE_DAYS})"""),
    # SQL layer
    "sql_orders_export": q("SELECT * FROM orders", sql_store=True),
    "sql_store_written": q("SELECT * FROM orders", sql_store=True),
    "sql_store_monthly_kpis": q("SELECT * FROM monthly_kpis", sql_store=True),
    "table_counts": q("""SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM monthly_kpis) AS months,
        (SELECT count(*) FROM category_kpis) AS categories, (SELECT count(*) FROM customer_kpis) AS customers""",
                      sql_store=True),
    "sql_monthly_kpis": q("SELECT * FROM monthly_kpis", sql_store=True),
    "sql_category_kpis": q("SELECT * FROM category_kpis", sql_store=True),
    "sql_customer_kpis": q("SELECT * FROM customer_kpis", sql_store=True),
    "sql_monthly_trend": q("""select order_month, sales, profit, orders, customers, avg_discount, loss_rate
        from monthly_kpis order by order_month desc limit 18""", sql_store=True),
    "sql_top_subcategories": q("""select "Category", sub_category, sales, profit, orders, avg_discount, loss_rate
        from category_kpis order by profit desc limit 15""", sql_store=True),
    "sql_highest_loss_rate": q("""select "Category", sub_category, sales, profit, avg_discount, loss_rate
        from category_kpis where orders >= 20 order by loss_rate desc, sales desc limit 15""", sql_store=True),
    "sql_best_customers": q("""select customer_name, "Segment", sales, profit, orders, avg_discount, last_order_date
        from customer_kpis order by profit desc limit 15""", sql_store=True),
    "sql_region_profit": q("""select "Region", CAST(round(sum("Sales"), 2) AS DOUBLE) as sales,
        CAST(round(sum("Profit"), 2) AS DOUBLE) as profit from orders group by "Region" order by profit desc""",
                           sql_store=True),
    "sql_trend_preview": q("""select order_month, sales, profit from (select order_month, sales, profit
        from monthly_kpis order by order_month desc limit 18) t order by order_month""", sql_store=True),
    "sql_adhoc": q("""select "Ship Mode" AS ship_mode, count(*) AS lines, count(DISTINCT "Order ID") AS orders,
        CAST(round(sum("Sales"), 2) AS DOUBLE) AS sales from orders group by "Ship Mode" """, sql_store=True),
    # model-evaluation operators on a deterministic rule scorer
    "split_sizes": q(", " + _SPLIT + """ SELECT is_loss, rows, test_rows, rows - test_rows AS train_rows FROM sizes"""),
    "plain_split_sizes": q(f""" SELECT count(*) AS rows, CAST(ceil(count(*) * {P.TEST_FRACTION}) AS BIGINT) AS test_rows,
        count(*) - CAST(ceil(count(*) * {P.TEST_FRACTION}) AS BIGINT) AS train_rows FROM ol"""),
    "class_weights": q(", " + _SPLIT + """, c AS (SELECT is_loss, rows - test_rows AS train_rows FROM sizes)
        SELECT is_loss, train_rows, CAST(sum(train_rows) OVER () AS DOUBLE) / (2.0 * train_rows) AS weight FROM c"""),
    "classification_metrics": q(", " + _RULE + """ SELECT
        CAST(count(*) FILTER (WHERE label = prediction) AS DOUBLE) / NULLIF(count(*), 0) AS accuracy,
        coalesce(CAST(count(*) FILTER (WHERE label = 1 AND prediction = 1) AS DOUBLE) / NULLIF(count(*) FILTER (WHERE prediction = 1), 0), 0.0) AS "precision",
        coalesce(CAST(count(*) FILTER (WHERE label = 1 AND prediction = 1) AS DOUBLE) / NULLIF(count(*) FILTER (WHERE label = 1), 0), 0.0) AS recall,
        count(*) AS test_rows FROM scored"""),
    "confusion_matrix": q(", " + _RULE + """, lab AS (SELECT 0 AS label, 'Actual non-loss' AS actual UNION ALL SELECT 1, 'Actual loss')
        SELECT lab.actual, count(s.label) FILTER (WHERE s.prediction = 0) AS "Predicted non-loss",
               count(s.label) FILTER (WHERE s.prediction = 1) AS "Predicted loss"
        FROM lab LEFT JOIN scored s ON s.label = lab.label GROUP BY lab.label, lab.actual"""),
    "classification_report": q(", " + _RULE + """, lab AS (SELECT 0 AS cls UNION ALL SELECT 1),
        c AS (SELECT lab.cls, count(*) FILTER (WHERE s.label = lab.cls AND s.prediction = lab.cls) AS tp,
                     count(*) FILTER (WHERE s.prediction = lab.cls) AS pp, count(*) FILTER (WHERE s.label = lab.cls) AS support
              FROM lab, scored s GROUP BY lab.cls)
        SELECT CAST(cls AS VARCHAR) AS class, coalesce(CAST(tp AS DOUBLE) / NULLIF(pp, 0), 0.0) AS "precision",
               coalesce(CAST(tp AS DOUBLE) / NULLIF(support, 0), 0.0) AS recall,
               coalesce(2.0 * tp / NULLIF(pp + support, 0), 0.0) AS f1, support FROM c"""),
    "regression_metrics": q(", " + _RULE + f""", m AS (SELECT avg(actual) AS mu FROM scored),
        e AS (SELECT sum(abs(predicted - actual)) / count(*) AS mae,
               1.0 - sum((actual - predicted) * (actual - predicted)) / NULLIF(sum((actual - mu) * (actual - mu)), 0) AS r2,
               count(*) AS test_rows FROM scored, m)
        SELECT {rnd('mae', 6)} AS mae, {rnd('r2', 6)} AS r2, test_rows FROM e"""),
    "feature_matrix_cells": q(", " + tree_sql.matrix_cells(NUMERIC_FEATURES)),
    **{f"{name}_tree{suffix}": q(", " + tree_sql.tree_ctes(
        label, balance, steps=EVERY_VALUE if f"{name}_tree{suffix}" == "profit_tree" else BOUNDS) + "\n" + body)
       for name, label, balance in (("loss", "is_loss", True), ("profit", "profit", False))
       for suffix, body in (("", tree_sql.NODES), ("_importance", tree_sql.IMPORTANCE), ("_scores", tree_sql.SCORES))},
}
