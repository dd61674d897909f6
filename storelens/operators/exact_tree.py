"""Shallow decision trees by exact split search, as grouped aggregates.

One aggregation a level counts rows and adds up the label by (node, feature, value); running sums over these cells (their
number follows the features' values) give both sides of every split.  The cells are dealt by ranges of the value and
written once; a part's running sums begin with those of the parts before it (one row a part), so no window spans a
feature.  Counts and label sums are exact, so the same tree comes out whatever the partitioning, and plain SQL can state
it.

A split asks "is the category this level" or "is the number at most this bound"; a null value answers no.  Every value of
a number is a bound, unless ``steps`` name a coarser grid for it.  The best one
has the largest sum of s^2 / w of its sides (s: weighted label, w: weight), which is the largest variance gain, for a
label of 0 and 1 the largest Gini gain.  Ties go to the first feature, level and bound.  Nodes are numbered from 1;
those who answer "level: no" or "at most: yes" go to 2 i, the others to 2 i + 1.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storelens.functions.exprs import round_half_away
from storelens.schema import CATEGORICAL_FEATURES
from storelens.sources.sinks import stored

DEPTH, MIN_LEAF = 3, 25
# Number features and the step of their bounds (None: every value is one).
BOUNDS = {"discount": None, "sales": 5000, "quantity": None, "shipping_days": None}
EVERY_VALUE = dict.fromkeys(BOUNDS)
SPLIT = "node long, feature string, level string, bound double, rows long, label double, gain double"


@dataclass
class Tree:
    """Splits by node, the weights of the labels 0 and 1 (None: every row weighs 1), and the steps of the bounds."""
    splits: dict[int, tuple[str, str | None, float | None]]
    weights: tuple[float, float] | None
    steps: dict[str, int | None] = field(default_factory=lambda: BOUNDS)

    def node(self) -> Column:
        """The leaf that a row comes to."""
        return self.at_leaf(lambda i: F.lit(i).cast("long"))

    def at_leaf(self, result: Callable[[int], Column], i: int = 1) -> Column:
        """``result`` of the leaf that a row comes to below node i: a row answers one split a level, and the expression
        holds every split once."""
        if i not in self.splits:
            return result(i)
        feature, level, bound = self.splits[i]
        if level is not None:
            right = F.coalesce(F.col(feature) == level, F.lit(False))
        else:
            right = ~F.coalesce(bound_of(feature, self.steps) <= bound, F.lit(False))
        return F.when(right, self.at_leaf(result, 2 * i + 1)).otherwise(self.at_leaf(result, 2 * i))

    def value(self, rows: Column, label: Column) -> Column:
        """Weighted mean of the label from the row count and the label's sum."""
        w, s = self.sides(rows, label)
        return F.try_divide(s, w)

    def sides(self, rows: Column, label: Column) -> tuple[Column, Column]:
        n, y = rows.cast("double"), label.cast("double")
        if self.weights is None:
            return n, y
        none, one = self.weights
        return F.lit(none) * (n - y) + F.lit(one) * y, F.lit(one) * y


def bound_of(feature: str, steps: dict[str, int | None]) -> Column:
    """The number itself, or the lower end of its step."""
    step = steps[feature]
    c = F.col(feature).cast("double")
    return c if step is None else F.floor(c / float(step)).cast("double") * float(step)


def balanced(ol: DataFrame, label: str) -> tuple[float, float]:
    r = ol.agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("y")).first()
    n, y = r["n"], r["y"] or 0
    return (n / (2.0 * (n - y)) if n > y else 1.0, n / (2.0 * y) if y else 1.0)


def cells(ol: DataFrame, tree: Tree, label: str, level: int) -> DataFrame:
    """(node, feature, level, bound, rows, label) of a level's nodes: one aggregation; the feature '' holds the node's
    totals."""
    none_s, none_d = F.lit(None).cast("string"), F.lit(None).cast("double")
    parts = [F.struct(F.lit("").alias("feature"), F.lit("").alias("level"), none_d.alias("bound"))]
    parts += [F.struct(F.lit(c).alias("feature"), F.col(c).alias("level"), none_d.alias("bound"))
              for c in CATEGORICAL_FEATURES]
    parts += [F.struct(F.lit(c).alias("feature"), none_s.alias("level"), bound_of(c, tree.steps).alias("bound"))
              for c in BOUNDS]
    flat = (ol.select(tree.node().alias("node"), F.col(label).alias("y"), *CATEGORICAL_FEATURES, *BOUNDS)
            .where((F.col("node") >= 1 << level) & (F.col("node") < 2 << level))
            .select("node", "y", F.inline(F.array(*parts))))
    return (flat.where("level IS NOT NULL OR bound IS NOT NULL").groupBy("node", "feature", "level", "bound")
            .agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("y"), F.lit(0)).alias("label")))


def running_sums(c: DataFrame) -> DataFrame:
    """The cells with ``part_rows`` and ``part_label``: of a number, those up to its bound; of a category, its own."""
    by = ["node", "feature"]
    c = stored(c.repartitionByRange(*by, "bound").withColumn("part", F.spark_partition_id()), "tree-cells")
    earlier = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = (c.where("bound IS NOT NULL").groupBy(*by, "part").agg(F.sum("rows").alias("rows"), F.sum("label").alias("label"))
              .select(*by, "part", *[F.sum(x).over(earlier).alias(f"before_{x}") for x in ("rows", "label")]))
    up = Window.partitionBy(*by, "part").orderBy("bound").rowsBetween(Window.unboundedPreceding, 0)
    part = [F.when(F.col("bound").isNull(), F.col(x)).otherwise(
        F.sum(x).over(up) + F.coalesce(F.col(f"before_{x}"), F.lit(0))).alias(f"part_{x}") for x in ("rows", "label")]
    return c.join(F.broadcast(before), [*by, "part"], "left").select(*by, "level", "bound", "rows", "label", *part)


def best_splits(ol: DataFrame, tree: Tree, label: str, min_leaf: int, level: int) -> DataFrame:
    """The best split of every node of a level that has one: node, feature, level, bound, rows, label, gain."""
    c = running_sums(cells(ol, tree, label, level))
    whole = c.where("feature = ''").select("node", F.col("rows").alias("all_rows"), F.col("label").alias("all_label"))
    s = c.where("feature <> ''").join(F.broadcast(whole), "node")  # one row a node
    rest = [F.col("all_rows") - F.col("part_rows"), F.col("all_label") - F.col("part_label")]
    (w0, s0), (w1, s1) = tree.sides(F.col("part_rows"), F.col("part_label")), tree.sides(*rest)
    w, t = tree.sides(F.col("all_rows"), F.col("all_label"))
    s = (s.where((F.col("part_rows") >= min_leaf) & (rest[0] >= min_leaf))
         .withColumn("score", s0 * s0 / w0 + s1 * s1 / w1)
         .withColumn("gain", F.col("score") - t * t / w))
    first = Window.partitionBy("node").orderBy(F.desc("score"), "feature", "level", "bound")
    return (s.withColumn("place", F.row_number().over(first)).where("place = 1 AND gain > 0")
            .select("node", "feature", "level", "bound", F.col("all_rows").alias("rows"),
                    F.col("all_label").cast("double").alias("label"), "gain"))


def fit(ol: DataFrame, label: str, *, depth: int = DEPTH, min_leaf: int = MIN_LEAF, balance: bool = False,
        steps: dict[str, int | None] = BOUNDS) -> tuple[Tree, list[tuple]]:
    """(tree, its splits as rows of ``SPLIT``); the driver sees one row a node, at most 2**depth in all."""
    tree, rows = Tree({}, balanced(ol, label) if balance else None, steps), []
    for level in range(depth):
        found = best_splits(ol, tree, label, min_leaf, level).collect()
        for r in found:
            tree.splits[r["node"]] = (r["feature"], r["level"], r["bound"])
            rows.append(tuple(r))
        if not found:
            break
    return tree, sorted(rows)


def tree_nodes(ol: DataFrame, label: str, **kw) -> DataFrame:
    """Every node: its split and gain (leaves: nulls), rows, label sum and value."""
    tree, rows = fit(ol, label, **kw)
    spark = ol.sparkSession
    inner = spark.createDataFrame(rows, SPLIT)
    leaves = (ol.groupBy(tree.node().alias("node"))
              .agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(label), F.lit(0)).cast("double").alias("label")))
    none = F.lit(None)
    leaves = leaves.select("node", none.cast("string").alias("feature"), none.cast("string").alias("level"),
                           none.cast("double").alias("bound"), "rows", "label", none.cast("double").alias("gain"))
    return inner.unionByName(leaves).select(
        "node", "feature", "level", "bound", "rows", round_half_away("label", 4).alias("label"),
        round_half_away(tree.value(F.col("rows"), F.col("label")), 6).alias("value"),
        round_half_away("gain", 4).alias("gain")).orderBy("node")


def tree_importance(ol: DataFrame, label: str, **kw) -> DataFrame:
    """Share of each feature (a level of a category is one) in the gains, largest first."""
    _, rows = fit(ol, label, **kw)
    gains = ol.sparkSession.createDataFrame(rows, SPLIT).groupBy(
        F.concat(F.col("feature"), F.coalesce(F.concat(F.lit("_"), F.col("level")), F.lit(""))).alias("feature")
    ).agg(F.sum(F.col("gain")).alias("gain"))
    total = gains.select(F.sum("gain")).scalar()
    return gains.select("feature", round_half_away(F.col("gain") / total, 6).alias("importance")).orderBy(
        F.desc("importance"), "feature")


def tree_scores(ol: DataFrame, label: str, **kw) -> DataFrame:
    """Every row's leaf and the leaf's value; the leaves' values are literals of the scoring pass."""
    tree, _ = fit(ol, label, **kw)
    leaves = ol.groupBy(tree.node().alias("node")).agg(F.count(F.lit(1)).alias("rows"), F.sum(label).alias("label"))
    values = {r["node"]: r["value"] for r in leaves.select(
        "node", tree.value(F.col("rows"), F.col("label")).alias("value")).collect()}
    value = tree.at_leaf(lambda i: F.lit(values.get(i)).cast("double"))
    return ol.select("row_id", tree.node().alias("node"), F.col(label).cast("double").alias("actual"),
                     round_half_away(value, 6).alias("predicted"))
