"""Dimension filters and the lists of values they can take."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTER_DIMENSIONS = ["order_year", "region", "category", "segment", "state", "ship_mode"]


def _years(years: list[int]) -> Column:
    """order_year IN years (prunes the partitions of a stored table), and the
    same as date ranges, so scans can prune on ``order_date`` statistics."""
    wanted = sorted(set(int(v) for v in years))
    pred = F.lit(False)
    for y in wanted:
        pred = pred | ((F.col("order_date") >= F.lit(dt.date(y, 1, 1)))
                       & (F.col("order_date") < F.lit(dt.date(y + 1, 1, 1))))
    return pred & F.col("order_year").isin(wanted)


def apply_filters(ol: DataFrame, years: list[int], regions: list[str], categories: list[str],
                  segments: list[str], states: list[str] | None = None,
                  ship_modes: list[str] | None = None) -> DataFrame:
    """AND of membership tests.

    The first four lists are mandatory: an empty one selects nothing.  ``states``
    and ``ship_modes`` filter only when non-empty.  Null dimension values never
    match.  Catalyst pushes these predicates below the derived-column projection
    and through the joins to the scans.
    """
    pred = (_years(years) & F.col("region").isin(list(regions))
            & F.col("category").isin(list(categories)) & F.col("segment").isin(list(segments)))
    if states:
        pred = pred & F.col("state").isin(list(states))
    if ship_modes:
        pred = pred & F.col("ship_mode").isin(list(ship_modes))
    return ol.where(pred)


def filter_options(ol: DataFrame) -> DataFrame:
    """Sorted distinct non-null values of every filter dimension, stacked as
    ``(dimension, value)``: one scan, one de-duplicating shuffle."""
    stacked = ol.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("pos"), F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value"))
        for i, d in enumerate(FILTER_DIMENSIONS)])))
    return (stacked.where(F.col("value").isNotNull()).distinct()
            .orderBy("pos", "value").drop("pos"))
