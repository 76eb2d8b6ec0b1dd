"""Classifier metrics as aggregates over (label, prediction, score), optionally per model.

`by` names the model column when several models' predictions are in one table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swipesight.functions.ranks import running_totals, value_counts

# Fixed values of the business estimate
SAVED_PER_HIT, COST_PER_MISS, COST_PER_FALSE_ALARM = 1000, 10000, 50


def confusion(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    cell = lambda label, guess: F.expr(f"count_if(label = {label} AND prediction = {guess})")
    return predictions.groupBy(*by).agg(
        cell(1, 1).alias("tp"), cell(0, 1).alias("fp"), cell(0, 0).alias("tn"), cell(1, 0).alias("fn")
    )


def confusion_shares(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts and their shares of each actual class."""
    return confusion(predictions, by).selectExpr(
        *by, "tp", "fp", "tn", "fn",
        "try_divide(CAST(tp AS DOUBLE), tp + fn) AS tp_share", "try_divide(CAST(fn AS DOUBLE), tp + fn) AS fn_share",
        "try_divide(CAST(tn AS DOUBLE), tn + fp) AS tn_share", "try_divide(CAST(fp AS DOUBLE), tn + fp) AS fp_share",
    )


def class_metrics(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall and F1; a metric without a denominator is 0."""
    safe = lambda a, b: f"coalesce(try_divide(CAST({a} AS DOUBLE), {b}), 0D)"
    return confusion(predictions, by).selectExpr(
        *by, "tp", "fp", "tn", "fn",
        f"{safe('tp + tn', 'tp + fp + tn + fn')} AS accuracy",
        f"{safe('tp', 'tp + fp')} AS precision",
        f"{safe('tp', 'tp + fn')} AS recall",
        f"{safe('2 * tp', '2 * tp + fp + fn')} AS f1",
    )


def _scores(predictions: DataFrame, by: Sequence[str], grid: int | None = None) -> DataFrame:
    """Positives and negatives per distinct score with running totals from the lowest score."""
    score = f"round(score * {grid}) / {grid}" if grid else "CAST(score AS DOUBLE)"
    rows = predictions.selectExpr(*by, f"{score} AS score", "label")
    counts = value_counts(
        rows, "score", by, pos="CASE WHEN label = 1 THEN 1 ELSE 0 END", neg="CASE WHEN label = 0 THEN 1 ELSE 0 END"
    )
    return running_totals(counts, "score", ["pos", "neg"], by)


def ranking_metrics(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ROC AUC by rank sums (0.5 with one class only) and step-wise average precision."""
    ranked = _scores(predictions, by).selectExpr(
        *by, "pos_all", "neg_all",
        "pos * (neg_through - neg + neg / 2) AS _below",
        "pos_all - pos_through + pos AS _tp", "neg_all - neg_through + neg AS _fp", "pos",
    )
    return ranked.groupBy(*by).agg(
        F.expr("coalesce(try_divide(sum(_below), CAST(max(pos_all) AS DOUBLE) * max(neg_all)), 0.5D)").alias("roc_auc"),
        F.expr("coalesce(try_divide(sum(pos * _tp / (_tp + _fp)), CAST(max(pos_all) AS DOUBLE)), 0D)").alias("avg_precision"),
    )


def all_metrics(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    counts, ranks = class_metrics(predictions, by), ranking_metrics(predictions, by)
    if by:
        return counts.join(F.broadcast(ranks), list(by), "left")
    return counts.selectExpr("*", "1 AS _one").join(
        F.broadcast(ranks.selectExpr("*", "1 AS _one")), "_one"
    ).drop("_one")


def roc_points(predictions: DataFrame, by: Sequence[str] = (), grid: int | None = None) -> DataFrame:
    """False and true positive rate when everything from a score on is flagged.

    `grid` rounds scores to 1/grid first, for tables with very many distinct scores.
    """
    return _scores(predictions, by, grid).selectExpr(
        *by, "score AS threshold",
        "try_divide(CAST(neg_all - neg_through + neg AS DOUBLE), neg_all) AS fpr",
        "try_divide(CAST(pos_all - pos_through + pos AS DOUBLE), pos_all) AS tpr",
    )


def precision_recall_points(
    predictions: DataFrame, by: Sequence[str] = (), grid: int | None = None
) -> DataFrame:
    tp, fp = "(pos_all - pos_through + pos)", "(neg_all - neg_through + neg)"
    return _scores(predictions, by, grid).selectExpr(
        *by, "score AS threshold",
        f"try_divide(CAST({tp} AS DOUBLE), {tp} + {fp}) AS precision",
        f"try_divide(CAST({tp} AS DOUBLE), pos_all) AS recall",
    )


def business_report(metrics: DataFrame) -> DataFrame:
    """Money saved by hits against the cost of misses and false alarms."""
    return metrics.selectExpr(
        "*",
        f"tp * {SAVED_PER_HIT} AS saved", f"fn * {COST_PER_MISS} AS missed_cost",
        f"fp * {COST_PER_FALSE_ALARM} AS false_alarm_cost",
        f"fn * {COST_PER_MISS} + fp * {COST_PER_FALSE_ALARM} AS total_cost",
        f"tp * {SAVED_PER_HIT} - fn * {COST_PER_MISS} - fp * {COST_PER_FALSE_ALARM} AS net_savings",
    )


def best_models(metrics: DataFrame, n: int | None = None) -> DataFrame:
    """Models by F1, best first."""
    ordered = metrics.orderBy(F.desc_nulls_last("f1"), "model")
    return ordered.limit(n) if n else ordered
