"""Product opportunity scoring and discount what-if scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.functions.exprs import ratio
from storelens.operators.ranking import pct_ranks
from storelens.operators.rollup import Rollup, source
from storelens.operators.summaries import keys_present, top_k, total
from storelens.schema import OPPORTUNITY_WEIGHTS, SCENARIO_CLIP, SCENARIO_ELASTICITY


def product_opportunity(ol: DataFrame | Rollup) -> DataFrame:
    """Per category/sub-category: totals, loss rate, margin and a blended score.

    score = .35 pct(sales) + .25 pct(1 - loss rate) + .25 pct(profit)
            + .15 pct(1 - mean discount), pct = average-tie percentile rank.
    The percentile ranks are found without a window over all product lines.
    """
    keys = ["category", "sub_category"]
    src, m = source(ol, keys)
    g = (keys_present(src, keys).groupBy(*keys)
         .agg(total("sales").alias("sales"), total("profit").alias("profit"),
              m.orders().alias("orders"), m.mean("discount").alias("avg_discount"),
              m.mean("is_loss").alias("loss_rate")))
    g = pct_ranks(g, {"sales_rank": F.col("sales"), "retention_rank": F.lit(1.0) - F.col("loss_rate"),
                      "profit_rank": F.col("profit"), "discipline_rank": F.lit(1.0) - F.col("avg_discount")})
    w = OPPORTUNITY_WEIGHTS
    score = (F.col("sales_rank") * w["sales"] + F.col("retention_rank") * w["retention"]
             + F.col("profit_rank") * w["profit"] + F.col("discipline_rank") * w["discount_discipline"])
    return (g.select(*keys, "sales", "profit", "orders", "avg_discount", "loss_rate",
                     ratio("profit", "sales").alias("profit_margin"), score.alias("opportunity_score"))
            .orderBy(F.desc("opportunity_score"), *keys))


def top_opportunities(ol: DataFrame | Rollup, k: int = 12) -> DataFrame:
    return top_k(product_opportunity(ol), k, F.desc("opportunity_score"), "category", "sub_category").select(
        "category", "sub_category", "sales", "profit", "loss_rate", "opportunity_score")


def _scenario_columns(adjustment):
    lo, hi = SCENARIO_CLIP
    sim = F.col("avg_discount") + adjustment
    sim = F.when(F.col("avg_discount").isNull(), F.lit(None).cast("double")).otherwise(
        F.least(F.greatest(sim, F.lit(lo)), F.lit(hi)))
    change = F.col("simulated_discount") - F.col("avg_discount")
    impact = F.col("sales") * F.col("discount_change") * F.lit(SCENARIO_ELASTICITY)
    return sim, change, impact


def _subcategory_base(ol: DataFrame | Rollup) -> DataFrame:
    src, m = source(ol, ["sub_category"])
    return (keys_present(src, ["sub_category"]).groupBy("sub_category")
            .agg(total("sales").alias("sales"), total("profit").alias("profit"),
                 m.mean("discount").alias("avg_discount")))


def discount_scenario(ol: DataFrame | Rollup, adjustment: float = 0.05) -> DataFrame:
    """Shift every sub-category's mean discount by ``adjustment`` (clipped to
    [0, 0.8]) and estimate the profit impact as sales * change * -0.35."""
    sim, change, impact = _scenario_columns(F.lit(float(adjustment)))
    return (_subcategory_base(ol)
            .withColumn("simulated_discount", sim)
            .withColumn("discount_change", change)
            .withColumn("estimated_profit_impact", impact)
            .withColumn("projected_profit", F.col("profit") + F.col("estimated_profit_impact"))
            .orderBy("estimated_profit_impact", "sub_category"))


def discount_scenarios(ol: DataFrame | Rollup, adjustments: list[float]) -> DataFrame:
    """The scenario for a whole sweep of adjustments in one job (one aggregate,
    then an ``explode`` of the adjustment list on the small result)."""
    sim, change, impact = _scenario_columns(F.col("adjustment"))
    return (_subcategory_base(ol)
            .withColumn("adjustment", F.explode(F.array(*[F.lit(float(a)) for a in adjustments])))
            .withColumn("simulated_discount", sim)
            .withColumn("discount_change", change)
            .withColumn("estimated_profit_impact", impact)
            .withColumn("projected_profit", F.col("profit") + F.col("estimated_profit_impact"))
            .orderBy("adjustment", "estimated_profit_impact", "sub_category"))


def top_scenario(ol: DataFrame | Rollup, adjustment: float = 0.05, k: int = 15) -> DataFrame:
    return top_k(discount_scenario(ol, adjustment), k, "estimated_profit_impact", "sub_category").select(
        "sub_category", "avg_discount", "simulated_discount", "estimated_profit_impact", "projected_profit")
