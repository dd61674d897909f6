"""Build the canonical order-line table from a TPC-H-shaped star schema.

``lineitem ⋈ orders ⋈ customer ⋈ nation ⋈ region ⋈ part`` (all inner, every
key matches).  Join order is chosen for scale: the order header is joined to
its customer dimension first (orders are ~4x fewer than lines, so the
custkey join moves the small side), then to the line items on the order key.
The part dimension comes last if it is broadcast; else the lines meet it first,
while they hold numbers only.  ``by_year`` deals the joined lines to writers by
year before the row id and the other texts made from numbers are built, and a
small place table meets them after that, so that shuffle moves numbers.

The strategy of every join is decided from counted rows, not from Spark's
compressed-file estimate (which can rate a 600k-row fact table under
``autoBroadcastJoinThreshold`` and broadcast the *fact* side, leaving the probe
to a single split of the header table).  The line items are never broadcast.
A dimension, or the order header, is broadcast only when its counted rows times
the width of its columns are at most ``broadcast_bytes``; a side above that
carries no hint: it is shuffled and joined on the key, and AQE may still turn
the join into a broadcast if a filter leaves little of that side.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.schema import BASE_COLUMNS, DISCOUNT_TYPE, PROFIT_TYPE, SALES_TYPE

TABLES = ("lineitem", "orders", "customer", "nation", "region", "part")

# Largest side sent to every executor: rows times the width of its columns, text columns taken as TEXT_BYTES each.
BROADCAST_BYTES = 64 << 20
TEXT_BYTES = 40


def read_table(spark: SparkSession, src: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{src.rstrip('/')}/{name}.parquet")


def row_bytes(df: DataFrame) -> int:
    """Width of a row, as the rows of a broadcast table take it: 8 bytes a field and 16 a row, more for text."""
    return 16 + sum(8 + (TEXT_BYTES if f.dataType.typeName() == "string" else 0) for f in df.schema.fields)


def _small_side(df: DataFrame, rows: int, bound: int) -> DataFrame:
    """Broadcast ``df`` when it takes at most ``bound`` bytes."""
    return F.broadcast(df) if rows * row_bytes(df) <= bound else df


def order_lines_from_star(spark: SparkSession, src: str, *,
                          broadcast_bytes: int = BROADCAST_BYTES, by_year: bool = False) -> DataFrame:
    """Canonical base columns (see ``schema.ORDER_LINE_SCHEMA``), no derived ones; ``by_year``: and ``order_year``, by
    which the rows are dealt (``REBALANCE``)."""
    raw = {name: read_table(spark, src, name) for name in TABLES}
    li = raw["lineitem"].select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        "l_extendedprice", "l_discount")
    orders = raw["orders"].select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    customer = raw["customer"].select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nation = raw["nation"].select("n_nationkey", "n_name", "n_regionkey")
    region = raw["region"].select("r_regionkey", "r_name")
    part = raw["part"].select("p_partkey", "p_type", "p_brand", "p_retailprice")

    # One job counts the five candidate build sides; Parquet answers a count
    # from the footers (no column is read).  The whole table is counted, an
    # upper bound for any filtered view of it.
    counted = ("orders", "customer", "nation", "region", "part")
    per_table = [raw[name].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("t"), "n")
                 for name in counted]
    union = per_table[0]
    for df in per_table[1:]:
        union = union.unionByName(df)
    rows = {r["t"]: r["n"] for r in union.collect()}

    def small(df: DataFrame, name: str) -> DataFrame:
        return _small_side(df, rows[name], broadcast_bytes)

    geo = nation.join(small(region, "region"), nation.n_regionkey == region.r_regionkey)
    places_last = by_year and rows["nation"] * row_bytes(geo) <= broadcast_bytes
    cust = customer if places_last else customer.join(small(geo, "nation"), customer.c_nationkey == geo.n_nationkey)
    head = orders.join(small(cust, "customer"), orders.o_custkey == cust.c_custkey)
    parts_first = rows["part"] * row_bytes(part) > broadcast_bytes
    lines = li
    for side, name, on in sorted(((head, "orders", li.l_orderkey == head.o_orderkey),
                                  (part, "part", li.l_partkey == part.p_partkey)),
                                 key=lambda x: (x[1] == "part") != parts_first):
        lines = lines.join(small(side, name), on)
    order_date = F.col("o_orderdate").cast("date")
    if by_year:
        lines = lines.withColumn("order_year", F.year(order_date)).hint("rebalance", "order_year")
    if places_last:
        lines = lines.join(F.broadcast(geo), customer.c_nationkey == geo.n_nationkey)

    sales = F.col("l_extendedprice").cast("decimal(18,2)").cast(SALES_TYPE)
    discount = (F.col("l_discount").cast("decimal(4,2)") * F.lit(8)).cast(DISCOUNT_TYPE)
    unit_cost = F.col("p_retailprice").cast("decimal(18,2)")
    row_id = F.concat_ws(
        "-", F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"),
        F.col("l_quantity").cast("int"), F.round(F.col("l_extendedprice") * 100).cast("long"))
    out = lines.select(
        row_id.alias("row_id"),
        F.col("l_orderkey").cast(orders.schema["o_orderkey"].dataType).cast("string").alias("order_id"),
        order_date.alias("order_date"),
        F.date_add(order_date, ((F.col("l_orderkey") + F.col("l_linenumber")) % 9).cast("int")).alias("ship_date"),
        F.col("o_orderpriority").alias("ship_mode"),
        F.col("c_custkey").cast("string").alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        F.col("c_mktsegment").alias("segment"),
        F.col("n_name").alias("state"),
        F.col("r_name").alias("region"),
        F.col("p_type").alias("category"),
        F.col("p_brand").alias("sub_category"),
        sales.alias("sales"),
        F.col("l_quantity").cast("int").alias("quantity"),
        discount.alias("discount"),
        (sales * (F.lit(1) - discount) - F.col("l_quantity").cast("int") * unit_cost * F.lit(Decimal("0.5")))
        .cast(PROFIT_TYPE).alias("profit"),
        *(["order_year"] if by_year else []),
    )
    return out.select(*BASE_COLUMNS, *(["order_year"] if by_year else []))
