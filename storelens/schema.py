"""Canonical order-line schema and the fixed values the analytics depend on."""

from __future__ import annotations

from pyspark.sql import types as T

SALES_TYPE = T.DecimalType(18, 4)
DISCOUNT_TYPE = T.DecimalType(6, 4)
PROFIT_TYPE = T.DecimalType(18, 4)

# One row = one product line of an order.  Money and discount stay decimal so
# that sums are exact and independent of summation order; they are cast to
# double only in outputs.
ORDER_LINE_SCHEMA = T.StructType([
    T.StructField("row_id", T.StringType(), False),
    T.StructField("order_id", T.StringType(), True),
    T.StructField("order_date", T.DateType(), True),
    T.StructField("ship_date", T.DateType(), True),
    T.StructField("ship_mode", T.StringType(), True),
    T.StructField("customer_id", T.StringType(), True),
    T.StructField("customer_name", T.StringType(), True),
    T.StructField("segment", T.StringType(), True),
    T.StructField("state", T.StringType(), True),
    T.StructField("region", T.StringType(), True),
    T.StructField("category", T.StringType(), True),
    T.StructField("sub_category", T.StringType(), True),
    T.StructField("sales", SALES_TYPE, True),
    T.StructField("quantity", T.IntegerType(), True),
    T.StructField("discount", DISCOUNT_TYPE, True),
    T.StructField("profit", PROFIT_TYPE, True),
])

BASE_COLUMNS = [f.name for f in ORDER_LINE_SCHEMA.fields]

DERIVED_COLUMNS = [
    "order_year", "order_month", "order_month_ts", "order_quarter",
    "shipping_days", "profit_margin", "is_loss", "discount_band",
    "sales_band", "days_from_latest_order",
]

# Column names of the source CSV export (header row) mapped to ours.
CSV_COLUMN_NAMES = {
    "Row ID": "row_id",
    "Order ID": "order_id",
    "Order Date": "order_date",
    "Ship Date": "ship_date",
    "Ship Mode": "ship_mode",
    "Customer ID": "customer_id",
    "Customer Name": "customer_name",
    "Segment": "segment",
    "State": "state",
    "Region": "region",
    "Category": "category",
    "Sub-Category": "sub_category",
    "Sales": "sales",
    "Quantity": "quantity",
    "Discount": "discount",
    "Profit": "profit",
}
REFERENCE_NAMES = {v: k for k, v in CSV_COLUMN_NAMES.items()}

# ---------------------------------------------------------------------------
# Fixed values (must stay exactly as they are for results to agree).
# Discount bands: right-closed intervals (-0.01, 0], (0, 0.1], (0.1, 0.2],
# (0.2, 0.4], (0.4, 0.8]; values outside get no band.
DISCOUNT_BAND_EDGES = ["-0.01", "0.0", "0.1", "0.2", "0.4", "0.8"]
DISCOUNT_BAND_LABELS = ["0%", "1-10%", "11-20%", "21-40%", "41%+"]
# Sales quartile labels, lowest first.
SALES_BAND_LABELS = ["Low", "Medium", "High", "Very High"]
# RFM segment thresholds on the summed 3..12 score, highest first.
RFM_SEGMENTS = [(10, "Champion"), (8, "Loyal"), (6, "Promising")]
RFM_DEFAULT_SEGMENT = "At Risk"
# Product opportunity score weights.
OPPORTUNITY_WEIGHTS = {"sales": 0.35, "retention": 0.25, "profit": 0.25, "discount_discipline": 0.15}
# Anomaly rule: |z| >= 1.5 flags a month; profit z < -1.5 is a profit dip.
ANOMALY_Z = 1.5
ANOMALY_REASONS = ("Profit dip", "Demand spike / unusual movement", "Normal")
# Discount scenario: clip range of the simulated discount and profit elasticity.
SCENARIO_CLIP = (0.0, 0.8)
SCENARIO_ELASTICITY = -0.35
# Decision rule of the scoring tool.
RISK_THRESHOLD = 0.6
DECISIONS = ("Risky order", "Expected negative profit", "Healthy order")
# Model feature contract.
CATEGORICAL_FEATURES = ["category", "sub_category", "region", "segment", "ship_mode"]
NUMERIC_FEATURES = ["discount", "sales", "quantity", "shipping_days"]
# Columns profiled by the data-quality table (reference names, in order).
QUALITY_COLUMNS = ["Sales", "Profit", "Discount", "Quantity", "shipping_days",
                   "Region", "State", "Category", "Sub-Category"]
# Confusion matrix labels.
CONFUSION_ROWS = ["Actual non-loss", "Actual loss"]
CONFUSION_COLS = ["Predicted non-loss", "Predicted loss"]
