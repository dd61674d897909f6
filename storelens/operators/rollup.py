"""An order-grain rollup and the choice of what it answers.

Twenty queries ask for distinct orders, or distinct customers, by some key; on the lines each of them shuffles every
order id again.  Here that work is done once:

* ``customers``: one row per customer, place and month; ``products``: one per category, sub-category and month.  Both
  hold additive measures (exact sums and counts).
* **Distinct orders** are additive too: of the lines of an order under one value of a level's keys, exactly one is
  counted for that level, so the distinct orders of any group of the level are a plain sum.
* **Distinct customers** are bitmaps over dense customer numbers, one set per month.  Bitmaps merge by OR, so counts are
  exact for one month, for any set of months and for the whole table, without an Expand over two distincts.

``source`` hands a summary either the lines or the table that covers its keys.  A summary over filtered lines reads the
lines: an order counted in one row of a level may have others outside the filter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from storelens.functions.exprs import mean
from storelens.session import fresh_dir, shuffles_for
from storelens.sources.reuse import COMPRESSION
from storelens.sources.sinks import stored

CUSTOMER_KEYS = ["customer_id", "customer_name", "segment", "state", "region", "order_month", "order_month_ts"]
PRODUCT_KEYS = ["category", "sub_category", "order_month", "order_month_ts"]
# Measures whose sums are kept, and those with the number of their values, for means.
SUMS = ["sales", "profit"]
MEANS = ["discount", "shipping_days", "is_loss"]
# Levels at which distinct orders are counted: name -> keys.
CUSTOMER_LEVELS = {
    "all": [],
    "month": ["order_month", "order_month_ts"],
    "place": ["state", "region"],
    "customer": ["customer_id", "customer_name", "segment"],
    "named_customer": ["customer_id", "customer_name"],
}
PRODUCT_LEVELS = {"category": ["category"], "product": ["category", "sub_category"]}
MERGED_BYTES = "4m"  # the rows dealt here are narrow: 16 MB of them would sort in 700 MB


def total(c: str) -> Column:
    """Exact sum (0 for an all-null group), still of its own type."""
    return F.coalesce(F.sum(c), F.lit(0))


class Lines:
    """Measures over order lines."""

    total = staticmethod(total)
    mean = staticmethod(mean)

    def orders(self) -> Column:
        return F.count_distinct("order_id")

    def last_order(self) -> Column:
        return F.max("order_date")

    def rows(self) -> Column:
        return F.count(F.lit(1))


@dataclass
class Rolled:
    """The same measures over a rollup table; ``level`` names the column of counted orders."""
    level: str | None

    total = staticmethod(total)

    def mean(self, c: str) -> Column:
        return F.try_divide(F.sum(f"{c}_sum").cast("double"), F.sum(f"{c}_n"))

    def orders(self) -> Column:
        if self.level is None:
            raise KeyError("the rollup does not count distinct orders by these keys")
        return F.coalesce(F.sum(f"orders_{self.level}"), F.lit(0))

    def last_order(self) -> Column:
        return F.max("last_order")

    def rows(self) -> Column:
        return F.coalesce(F.sum("lines"), F.lit(0))


@dataclass
class Rollup:
    """The stored tables; ``months`` holds the customer bitmaps (order_month, bucket, bits)."""
    customers: DataFrame
    products: DataFrame
    months: DataFrame

    def table(self, keys: list[str]) -> tuple[DataFrame, Rolled]:
        for frame, own, levels in ((self.customers, CUSTOMER_KEYS, CUSTOMER_LEVELS),
                                   (self.products, PRODUCT_KEYS, PRODUCT_LEVELS)):
            if set(keys) <= set(own):
                level = next((n for n, k in levels.items() if set(k) == set(keys)), None)
                if level is None and set(keys) == {"order_month"}:
                    level = "month"
                return frame, Rolled(level)
        raise KeyError(f"no rollup covers {keys}")

    def customer_count(self, *keys: str) -> DataFrame:
        """Distinct customers for each value of ``keys`` (of ``order_month``, or of the whole table without keys)."""
        merged = self.months.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        return merged.groupBy(*keys).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("customers"))


def source(ol: DataFrame | Rollup, keys: list[str]):
    """(frame to group, its measures)."""
    return ol.table(keys) if isinstance(ol, Rollup) else (ol, Lines())


def _measures() -> list[Column]:
    return ([F.count(F.lit(1)).alias("lines"), F.max("order_date").alias("last_order")]
            + [F.sum(c).alias(c) for c in SUMS]
            + [x for c in MEANS for x in (F.sum(c).alias(f"{c}_sum"), F.count(c).alias(f"{c}_n"))])


def _merged(levels: dict) -> list[Column]:
    return ([F.sum("lines").alias("lines"), F.max("last_order").alias("last_order")]
            + [F.sum(c).alias(c) for c in SUMS]
            + [x for c in MEANS for x in (F.sum(f"{c}_sum").alias(f"{c}_sum"), F.sum(f"{c}_n").alias(f"{c}_n"))]
            + [F.sum(f"orders_{n}").alias(f"orders_{n}") for n in levels])


def _counted(keys: list[str], levels: dict[str, list[str]]) -> list[Column]:
    """For each level, 1 in one row of each order and value of the level's keys, else 0."""
    out = []
    for name, level in levels.items():
        rest = [k for k in keys if k not in level]
        place = F.row_number().over(Window.partitionBy("order_id", *level).orderBy(*(rest or [F.lit(1)])))
        out.append((place == 1).cast("int").alias(f"orders_{name}"))
    return out


def _rolled(ol: DataFrame, keys: list[str], levels: dict[str, list[str]], apart: bool = False) -> DataFrame:
    """Lines to (order, keys), where one row of each order and level is counted, then to the keys.

    Map-side aggregation comes before every shuffle, so a very large order is a few rows by then; lines without an order
    id count for no order and are not dealt by it.

    ``apart``: the measures are added up by the keys at once, and only the order ids with their keys are dealt by order.
    That moves less where the keys have few values and an order has a line for most of its own (products); a very large
    order's ids then meet in one task, which keeps one row for each value of the keys.
    """
    narrow = [k for k in keys if k != "order_month"]  # the text of order_month_ts
    counted = _counted(narrow, {n: [k for k in level if k in narrow] for n, level in levels.items()})
    none = [F.lit(0).alias(f"orders_{name}") for name in levels]
    if apart:
        parts = (ol.groupBy(*narrow).agg(*_measures()).select("*", *none),
                 ol.where("order_id IS NOT NULL").select("order_id", *narrow).repartition("order_id").distinct()
                 .select(*narrow, *counted))
    else:
        by_order = ol.groupBy("order_id", *narrow).agg(*_measures())
        parts = (by_order.where("order_id IS NULL").select("*", *none),
                 by_order.where("order_id IS NOT NULL").repartition("order_id").select("*", *counted))
    merged = parts[0].unionByName(parts[1], allowMissingColumns=True).groupBy(*narrow).agg(*_merged(levels))
    month = F.date_format("order_month_ts", "yyyy-MM").alias("order_month")
    return merged.select(*[month if k == "order_month" else k for k in keys], *merged.columns[len(narrow):])


def write(ol: DataFrame, path: str) -> None:
    """Writes the three tables under ``path``."""
    spark = ol.sparkSession
    with shuffles_for(spark, ol.count(), MERGED_BYTES):
        _rolled(ol, CUSTOMER_KEYS, CUSTOMER_LEVELS).write.parquet(f"{path}/customers", compression=COMPRESSION)
        _rolled(ol, PRODUCT_KEYS, PRODUCT_LEVELS, True).write.parquet(f"{path}/products", compression=COMPRESSION)
        customers = spark.read.parquet(f"{path}/customers")
        # written once: numbers stay as they are; they are dense within each part of the table
        numbers = stored(customers.where("customer_id IS NOT NULL").select("customer_id").distinct()
                         .withColumn("number", F.monotonically_increasing_id()), "rollup-numbers")
        bits = (customers.select("customer_id", "order_month").join(numbers, "customer_id")
                .groupBy("order_month", F.bitmap_bucket_number("number").alias("bucket"))
                .agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits")))
        bits.write.parquet(f"{path}/months", compression=COMPRESSION)


def read(spark: SparkSession, path: str) -> Rollup:
    return Rollup(*(spark.read.parquet(f"{path}/{name}") for name in ("customers", "products", "months")))


def build(ol: DataFrame) -> Rollup:
    """The rollup of ``ol``, in a new folder under the shared one."""
    path = fresh_dir(ol.sparkSession, "rollup")
    write(ol, path)
    return read(ol.sparkSession, path)
