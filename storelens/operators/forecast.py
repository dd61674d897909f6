"""Linear monthly forecast and z-score anomaly flags over the monthly aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storelens.functions.exprs import growth, round_half_away
from storelens.operators.rollup import Rollup
from storelens.operators.summaries import monthly_base
from storelens.schema import ANOMALY_REASONS, ANOMALY_Z

_D = "decimal(38,4)"
_I = "decimal(20,0)"


def forecast_frame(ol: DataFrame | Rollup, periods: int = 3) -> DataFrame:
    """History plus ``periods`` months of a degree-1 least-squares trend.

    ``x`` is the 0-based position of a present month.  Slope and intercept use
    the closed form over exact decimal moments (sum x, sum x^2, sum y,
    sum x*y), so they do not depend on summation order; one double division
    each.  Forecast sales are clamped at 0, profit is not.  Fewer than two
    months give the history only.
    """
    m = monthly_base(ol)
    w = Window.orderBy("order_month_ts")  # one row per month: tiny
    hist = m.select("order_month_ts", "sales_dec", "profit_dec",
                    (F.row_number().over(w) - 1).cast("long").alias("month_index"))
    x = F.col("month_index").cast(_I)
    coef = hist.agg(
        F.count(F.lit(1)).cast(_I).alias("n"), F.sum(x).cast(_I).alias("sx"),
        F.sum(x * x).cast(_I).alias("sxx"),
        F.sum(F.col("sales_dec").cast(_D)).alias("sy"), F.sum(x * F.col("sales_dec").cast(_D)).cast(_D).alias("sxy"),
        F.sum(F.col("profit_dec").cast(_D)).alias("py"), F.sum(x * F.col("profit_dec").cast(_D)).cast(_D).alias("pxy"),
        F.max("order_month_ts").alias("last_ts"), F.max("month_index").alias("last_idx"))
    den = (F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")).cast("double")

    def line(sy: str, sxy: str):
        slope = (F.col("n") * F.col(sxy) - F.col("sx") * F.col(sy)).cast(_D).cast("double") / den
        icpt = (F.col(sy) * F.col("sxx") - F.col("sx") * F.col(sxy)).cast(_D).cast("double") / den
        return slope, icpt

    s_slope, s_icpt = line("sy", "sxy")
    p_slope, p_icpt = line("py", "pxy")
    future = (coef.where(F.col("n") >= 2)
              .select(F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("step"), "last_ts", "last_idx",
                      s_slope.alias("ss"), s_icpt.alias("si"), p_slope.alias("ps"), p_icpt.alias("pi")) \
              if periods > 0 else coef.where(F.lit(False)).select(
                  F.lit(1).alias("step"), "last_ts", "last_idx", F.lit(0.0).alias("ss"), F.lit(0.0).alias("si"),
                  F.lit(0.0).alias("ps"), F.lit(0.0).alias("pi")))
    idx = (F.col("last_idx") + F.col("step")).cast("long")
    fut = future.select(
        F.add_months("last_ts", F.col("step")).alias("order_month_ts"),
        F.greatest(F.lit(0.0), F.col("ss") * idx.cast("double") + F.col("si")).alias("sales"),
        (F.col("ps") * idx.cast("double") + F.col("pi")).alias("profit"),
        idx.alias("month_index"), F.lit("forecast").alias("type"))
    past = hist.select("order_month_ts", F.col("sales_dec").cast("double").alias("sales"),
                       F.col("profit_dec").cast("double").alias("profit"), "month_index",
                       F.lit("historical").alias("type"))
    return past.unionByName(fut).orderBy("month_index")


def anomaly_table(ol: DataFrame | Rollup, z_digits: int = 6) -> DataFrame:
    """Monthly summary with sales/profit z-scores (population std; 0 std -> 1).

    A month is flagged when either |z| >= 1.5; a profit z below -1.5 reads
    "Profit dip", any other flag "Demand spike / unusual movement".  Means use
    the exact decimal totals; the std is computed in two passes (mean, then
    mean squared deviation), so exact |z| = 1.5 ties are not moved by an ulp.
    All statistics are window functions over the monthly aggregate (one row
    per month), computed once; z-scores are reported rounded to ``z_digits``
    decimals (the flag uses the unrounded value).
    """
    whole = Window.partitionBy(F.lit(1))  # the monthly frame: one row per month
    w = Window.orderBy("order_month_ts")
    m = monthly_base(ol).select(
        "order_month", "order_month_ts", "orders",
        F.col("sales_dec").cast("double").alias("sales"), F.col("profit_dec").cast("double").alias("profit"),
        (F.sum("sales_dec").over(whole).cast("double") / F.count(F.lit(1)).over(whole)).alias("sm"),
        (F.sum("profit_dec").over(whole).cast("double") / F.count(F.lit(1)).over(whole)).alias("pm"))
    m = m.select(
        "*",
        growth("sales", F.lag("sales").over(w)).alias("sales_growth_pct"),
        growth("profit", F.lag("profit").over(w)).alias("profit_growth_pct"),
        F.sqrt(F.avg((F.col("sales") - F.col("sm")) * (F.col("sales") - F.col("sm"))).over(whole)).alias("ss"),
        F.sqrt(F.avg((F.col("profit") - F.col("pm")) * (F.col("profit") - F.col("pm"))).over(whole)).alias("ps"))

    def nz(c):
        return F.when(c == 0, F.lit(1.0)).otherwise(c)

    m = m.select("*", ((F.col("sales") - F.col("sm")) / nz(F.col("ss"))).alias("sz"),
                 ((F.col("profit") - F.col("pm")) / nz(F.col("ps"))).alias("pz"))
    flag = (F.abs(F.col("sz")) >= ANOMALY_Z) | (F.abs(F.col("pz")) >= ANOMALY_Z)
    dip, spike, normal = ANOMALY_REASONS
    reason = F.when(~flag, F.lit(normal)).when(F.col("pz") < -ANOMALY_Z, F.lit(dip)).otherwise(F.lit(spike))
    return (m.select("order_month", "order_month_ts", "sales", "profit", "orders", "sales_growth_pct",
                     "profit_growth_pct", round_half_away("sz", z_digits).alias("sales_zscore"),
                     round_half_away("pz", z_digits).alias("profit_zscore"), flag.alias("alert_flag"),
                     reason.alias("alert_reason"))
            .orderBy(F.desc("order_month_ts")))


def alert_feed(anomalies: DataFrame, k: int = 8) -> DataFrame:
    """Flagged months, newest first."""
    return (anomalies.where(F.col("alert_flag"))
            .orderBy(F.desc("order_month_ts")).limit(k)
            .select("order_month", "sales", "profit", "alert_reason"))
