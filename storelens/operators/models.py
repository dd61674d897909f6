"""Loss classifier, profit regressor, their evaluation and batch scoring.

The forests grow where the data lives (``operators/forest.py``); evaluation
and scoring are DataFrame jobs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.functions.exprs import round_half_away
from storelens.operators.forest import Forest, train_forest
from storelens.operators.ranking import _key_literal, search
from storelens.schema import (CATEGORICAL_FEATURES, CONFUSION_COLS, CONFUSION_ROWS, DECISIONS,
                              NUMERIC_FEATURES, RISK_THRESHOLD)
from storelens.session import path_exists as spark_path_exists
from storelens.sources.sinks import stored

_OH = "__oh"


def feature_stages() -> list:
    """One-hot categoricals (unseen or null level -> all zeros) + numerics.

    ``StringIndexer(handleInvalid='keep')`` sends unseen/null levels to an extra
    last index; ``OneHotEncoder(dropLast=True)`` drops exactly that slot, so a
    known level gets its own 1 and an unknown one is the zero vector.
    """
    idx = StringIndexer(inputCols=CATEGORICAL_FEATURES, outputCols=[f"{c}__idx" for c in CATEGORICAL_FEATURES],
                        handleInvalid="keep", stringOrderType="alphabetAsc")
    ohe = OneHotEncoder(inputCols=[f"{c}__idx" for c in CATEGORICAL_FEATURES],
                        outputCols=[f"{c}{_OH}" for c in CATEGORICAL_FEATURES], dropLast=True)
    asm = VectorAssembler(inputCols=[f"{c}{_OH}" for c in CATEGORICAL_FEATURES] + [f"{c}__num" for c in NUMERIC_FEATURES],
                          outputCol="features", handleInvalid="keep")
    return [idx, ohe, asm]


def with_numeric_features(df: DataFrame) -> DataFrame:
    return df.select("*", *[F.col(c).cast("double").alias(f"{c}__num") for c in NUMERIC_FEATURES])


# ---------------------------------------------------------------- splitting

def split_key(seed: int) -> list[Column]:
    """Deterministic per-row order for the split: seeded hash, then row id."""
    return [F.xxhash64(F.col("row_id"), F.lit(seed)), F.col("row_id")]


def hold_out_sizes(counts: list[int], fraction: float) -> list[int]:
    """``ceil(fraction * n)`` rows in all, dealt to the classes by largest remainder (ties: first class)."""
    n = sum(counts)
    t = math.ceil(fraction * n)
    sizes = [c * t // n for c in counts] if n else []
    by_rest = sorted(range(len(counts)), key=lambda i: (-(counts[i] * t % n), i)) if n else []
    for i in by_rest[:t - sum(sizes)]:
        sizes[i] += 1
    return sizes


def test_flag(df: DataFrame, *, fraction: float = 0.2, seed: int = 42, classes: tuple | None = None,
              label: str = "is_loss") -> Column:
    """Boolean column: row is in the hold-out set.

    In all ``ceil(fraction * n)`` rows are held out, of each class of ``label``
    its share of them (without ``classes``: of the whole table), those with the
    smallest split key: exact sizes, no shuffle of the data, same rows on every
    run.  One distributed rank search finds the cut keys of all classes.
    """
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(split_key(seed))])
    member = [F.lit(True)] if classes is None else [F.col(label) == c for c in classes]
    keys = df.select(*[F.when(m, key).alias(f"key{i}") for i, m in enumerate(member)])
    sizes, found = search(keys, lambda ns: [[t] if t else [] for t in hold_out_sizes(ns, fraction)])
    key_type = keys.schema["key0"].dataType
    flag = F.lit(False)
    for m, t, f in zip(member, hold_out_sizes(sizes, fraction), found):
        if t:
            flag = flag | (m & (key <= _key_literal(f[t], key_type)))
    return flag


def split_sizes(split: DataFrame, label: str = "is_loss") -> DataFrame:
    return (split.groupBy(label).agg(F.count(F.lit(1)).alias("rows"),
                                     F.count_if(F.col("is_test")).alias("test_rows"),
                                     F.count_if(~F.col("is_test")).alias("train_rows"))
            .orderBy(label))


def class_weights(train: DataFrame, label: str = "is_loss") -> DataFrame:
    """Balanced weights n / (k * n_class) over the training rows (k classes)."""
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("train_rows"))
    tot = train.select(F.count(F.lit(1))).scalar()
    k = counts.select(F.count(F.lit(1))).scalar()
    return counts.select(label, "train_rows",
                         (tot.cast("double") / (k.cast("double") * F.col("train_rows"))).alias("weight")).orderBy(label)


# ---------------------------------------------------------------- metrics

def classification_metrics(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """accuracy, precision and recall of class 1 (0 when undefined), rows."""
    y, p = F.col(label), F.col(prediction)
    tp = F.count_if((y == 1) & (p == 1))
    return scored.agg(
        (F.count_if(y == p).cast("double") / F.count(F.lit(1))).alias("accuracy"),
        F.coalesce(F.try_divide(tp.cast("double"), F.count_if(p == 1)), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(tp.cast("double"), F.count_if(y == 1)), F.lit(0.0)).alias("recall"),
        F.count(F.lit(1)).alias("test_rows"))


def confusion_matrix(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Always 2 x 2: rows actual non-loss / loss, columns predicted."""
    y, p = F.col(label), F.col(prediction)
    one = scored.agg(*[F.count_if((y == a) & (p == b)).alias(f"c{a}{b}") for a in (0, 1) for b in (0, 1)])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("pos"), F.lit(CONFUSION_ROWS[a]).alias("actual"),
                 F.col(f"c{a}0").alias(CONFUSION_COLS[0]), F.col(f"c{a}1").alias(CONFUSION_COLS[1]))
        for a in (0, 1)]))).orderBy("pos").drop("pos")


def classification_report(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Per class: precision, recall, F1 (0 when undefined) and support."""
    y, p = F.col(label), F.col(prediction)
    one = scored.agg(*[e for c in (0, 1) for e in (
        F.count_if((y == c) & (p == c)).alias(f"tp{c}"), F.count_if(p == c).alias(f"pp{c}"),
        F.count_if(y == c).alias(f"s{c}"))])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(str(c)).alias("class"),
                 F.coalesce(F.try_divide(F.col(f"tp{c}").cast("double"), F.col(f"pp{c}")), F.lit(0.0)).alias("precision"),
                 F.coalesce(F.try_divide(F.col(f"tp{c}").cast("double"), F.col(f"s{c}")), F.lit(0.0)).alias("recall"),
                 F.coalesce(F.try_divide(F.lit(2.0) * F.col(f"tp{c}"), F.col(f"pp{c}") + F.col(f"s{c}")),
                            F.lit(0.0)).alias("f1"),
                 F.col(f"s{c}").alias("support"))
        for c in (0, 1)])))


def regression_metrics(scored: DataFrame, actual: str = "actual", predicted: str = "predicted",
                       digits: int = 6) -> DataFrame:
    """MAE and R^2 (reported to ``digits`` decimals) and the row count."""
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    # population variance times count is the total sum of squares: one pass, numerically stable
    e = scored.agg((F.sum(F.abs(p - a)) / F.count(F.lit(1))).alias("mae"),
                   (F.lit(1.0) - F.try_divide(F.sum((a - p) * (a - p)), F.var_pop(a) * F.count(a))).alias("r2"),
                   F.count(F.lit(1)).alias("test_rows"))
    return e.select(round_half_away("mae", digits).alias("mae"), round_half_away("r2", digits).alias("r2"),
                    "test_rows")


def rule_scored(ol: DataFrame) -> DataFrame:
    """A fixed, reproducible scorer (discount > 0.4 -> loss; profit = 0.3 sales)
    to exercise the metric operators without a fitted model."""
    return ol.select(F.col("is_loss").alias("label"),
                     (F.col("discount") > F.lit(0.4)).cast("int").alias("prediction"),
                     F.col("profit").cast("double").alias("actual"),
                     (F.col("sales").cast("double") * F.lit(0.3)).alias("predicted"))


# ---------------------------------------------------------------- models

@dataclass
class LossModel:
    forest: Forest
    split: DataFrame
    test_scored: DataFrame
    train_rows: int
    test_rows: int


@dataclass
class ProfitModel:
    forest: Forest
    split: DataFrame
    test_scored: DataFrame


_FITTED: dict[tuple, object] = {}


def _prepared(ol: DataFrame, kind: str, label: Column, *, fraction: float, seed: int, classes: tuple | None) -> DataFrame:
    """What a model reads of the lines, with the hold-out flag, written once."""
    flag = test_flag(ol, fraction=fraction, seed=seed, classes=classes)
    return stored(ol.select("row_id", *CATEGORICAL_FEATURES, *NUMERIC_FEATURES, label, flag.alias("is_test")), kind,
                  compression="zstd")


def _fitted(path: str | None, spark: SparkSession, train) -> Forest:
    """The forest saved at ``path``, or a new one from ``train()``, saved there."""
    if path is not None and spark_path_exists(spark, f"{path}/done"):
        return Forest.load(spark, path)
    forest = train()
    if path is not None:
        forest.save(spark, path)
        spark.range(1).write.mode("overwrite").parquet(f"{path}/done")
    return forest


def train_loss_classifier(ol: DataFrame, *, num_trees: int = 240, max_depth: int = 12, min_leaf: int = 3,
                          fraction: float = 0.2, seed: int = 42, cache_key: tuple | None = None,
                          path: str | None = None) -> LossModel:
    """Random forest on ``is_loss`` with balanced class weights, stratified hold-out.

    ``path``: folder the fitted forest is saved in, and loaded from if it is there (same data and parameters).
    """
    key = ("loss", cache_key, num_trees, max_depth, min_leaf, fraction, seed)
    if cache_key is not None and key in _FITTED:
        return _FITTED[key]
    split = _prepared(ol, "loss-split", F.col("is_loss"), fraction=fraction, seed=seed, classes=(0, 1))
    train = split.where(~F.col("is_test"))

    def fit() -> Forest:
        rows = class_weights(train.where(F.col("is_loss").isin(0, 1))).collect()
        weight = {r["is_loss"]: float(r["weight"]) for r in rows}
        return train_forest(train, label="is_loss", categorical=CATEGORICAL_FEATURES, numeric=NUMERIC_FEATURES,
                            num_trees=num_trees, max_depth=max_depth, min_leaf=min_leaf, seed=seed,
                            weights=(weight.get(0, 1.0), weight.get(1, 1.0)), tried="sqrt")

    forest = _fitted(path, ol.sparkSession, fit)
    scored = stored(forest.transform(split.where(F.col("is_test"))).select(
        "row_id", F.col("is_loss").alias("label"), (F.col("score") > 0.5).cast("int").alias("prediction"),
        F.col("score").alias("loss_probability")), "loss-scored")
    sizes = split.agg(F.count_if(~F.col("is_test")).alias("tr"), F.count_if(F.col("is_test")).alias("te")).first()
    res = LossModel(forest, split, scored, sizes["tr"], sizes["te"])
    if cache_key is not None:
        _FITTED[key] = res
    return res


def train_profit_regressor(ol: DataFrame, *, num_trees: int = 220, max_depth: int = 14, min_leaf: int = 2,
                           fraction: float = 0.2, seed: int = 42, cache_key: tuple | None = None,
                           path: str | None = None) -> ProfitModel:
    """Random forest on profit (all features per split), plain hold-out; ``path`` as in the classifier."""
    key = ("profit", cache_key, num_trees, max_depth, min_leaf, fraction, seed)
    if cache_key is not None and key in _FITTED:
        return _FITTED[key]
    split = _prepared(ol, "profit-split", F.col("profit").cast("double").alias("profit_label"), fraction=fraction, seed=seed,
                      classes=None)

    def fit() -> Forest:
        return train_forest(split.where(~F.col("is_test")), label="profit_label", categorical=CATEGORICAL_FEATURES,
                            numeric=NUMERIC_FEATURES, num_trees=num_trees, max_depth=max_depth, min_leaf=min_leaf,
                            seed=seed)

    forest = _fitted(path, ol.sparkSession, fit)
    scored = stored(forest.transform(split.where(F.col("is_test"))).select(
        "row_id", F.col("profit_label").alias("actual"), F.col("score").alias("predicted"),
        F.xxhash64(F.col("row_id"), F.lit(seed)).alias("split_hash")), "profit-scored")
    res = ProfitModel(forest, split, scored)
    if cache_key is not None:
        _FITTED[key] = res
    return res


def loss_model_metrics(m: LossModel) -> DataFrame:
    met = classification_metrics(m.test_scored)
    return met.select("accuracy", "precision", "recall", F.lit(m.train_rows).alias("train_rows"),
                      F.col("test_rows"))


def profit_model_metrics(m: ProfitModel) -> DataFrame:
    return regression_metrics(m.test_scored)


def feature_importance(forest: Forest, spark: SparkSession, k: int | None = 12) -> DataFrame:
    """The ``k`` largest importances of the fitted forest (None: all) with readable feature names (bounded by the
    number of features, not by the data)."""
    rows = list(zip(forest.encoder.names, forest.importances()))
    out = spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")
    return out if k is None else out.limit(k)


def regression_preview(m: ProfitModel, k: int = 12) -> DataFrame:
    """``k`` hold-out rows (first by split key): actual, predicted, error (2 dp)."""
    top = m.test_scored.orderBy("split_hash", "row_id").limit(k)
    a = round_half_away("actual", 2)
    p = round_half_away("predicted", 2)
    return top.select(a.alias("actual_profit"), p.alias("predicted_profit")).select(
        "actual_profit", "predicted_profit",
        round_half_away(F.col("predicted_profit") - F.col("actual_profit"), 2).alias("error"))


def score_orders(orders: DataFrame, loss: LossModel, profit: ProfitModel) -> DataFrame:
    """Batch scoring: loss probability, predicted profit and the decision rule
    (p >= 0.6 risky; else negative predicted profit; else healthy).

    Both models are applied in one narrow pass (no join, no shuffle).
    """
    step2 = orders.select("row_id", loss.forest.scores(orders.sparkSession).alias("loss_probability"),
                          profit.forest.scores(orders.sparkSession).alias("predicted_profit"))
    risky, negative, healthy = DECISIONS
    return step2.select(
        "row_id", "loss_probability", "predicted_profit",
        F.when(F.col("loss_probability") >= RISK_THRESHOLD, F.lit(risky))
         .when(F.col("predicted_profit") < 0, F.lit(negative)).otherwise(F.lit(healthy)).alias("decision"))


def feature_matrix(ol: DataFrame) -> DataFrame:
    """The encoded feature vector of every order line (as an array)."""
    feats = with_numeric_features(ol)
    model = Pipeline(stages=feature_stages()).fit(feats)
    return model.transform(feats).select("row_id", vector_to_array("features").alias("features"))


def feature_matrix_cells(ol: DataFrame) -> DataFrame:
    """The feature matrix's cells that are not zero: (row_id, position, value)."""
    cells = feature_matrix(ol).select("row_id", F.posexplode("features").alias("position", "value"))
    return cells.where(F.col("value") != 0)
