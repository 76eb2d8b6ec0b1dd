"""Models on time alone: fraud by clock time, and customers by the rhythm of their transactions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swipesight.functions.ranks import quantile_columns
from swipesight.functions.semantics import literal_rows, with_row
from swipesight.operators import metrics as me
from swipesight.operators.models import ID, MAX_DEPTH, coefficients, predict, split, training_rows, with_weights
from swipesight.session import settle
from swipesight.operators.temporal import TIMING_COLUMNS, standardise, timing_features

CLOCK_COLUMNS = ["hour", "day_of_week", "sin_hour", "cos_hour", "is_night", "is_weekend"]
F1_GOAL, ACCURACY_GOAL = 0.85, 0.95
CONTAMINATION = 0.1
NODES_PER_TREE = "tree int, node int, feature int, split double, size int"


def clock_table(df: DataFrame) -> DataFrame:
    return df.where("is_fraud IS NOT NULL").selectExpr(
        ID, "CAST(is_fraud AS INT) AS label", "hour(timestamp) AS hour", "weekday(timestamp) AS day_of_week",
        "sin(2 * pi() * hour(timestamp) / 24) AS sin_hour", "cos(2 * pi() * hour(timestamp) / 24) AS cos_hour",
        "CAST(hour(timestamp) BETWEEN 0 AND 5 AS INT) AS is_night",
        "CAST(weekday(timestamp) >= 5 AS INT) AS is_weekend",
    )


def clock_model(df: DataFrame, test_size: float = 0.3, seed: int = 42):
    """Balanced logistic regression on time features: (fitted model, test predictions)."""
    vectors = VectorAssembler(inputCols=CLOCK_COLUMNS, outputCol="features")
    train, test = split(clock_table(df), test_size, seed)
    ready = with_weights(vectors.transform(train).select(ID, "label", "features")).persist()
    model = LogisticRegression(
        maxIter=1000, regParam=1.0 / max(ready.count(), 1), standardization=False, weightCol="weight"
    ).fit(ready)
    return model, predict(model, vectors.transform(test), "clock")


def clock_metrics(df: DataFrame) -> DataFrame:
    _, predictions = clock_model(df)
    return me.all_metrics(predictions).selectExpr("*", f"f1 > {F1_GOAL}D AS goal_met")


def clock_coefficients(df: DataFrame) -> DataFrame:
    model, _ = clock_model(df)
    return coefficients(df.sparkSession, model, CLOCK_COLUMNS)


# --- isolation forest ----------------------------------------------------------------------------


def _usual_depth(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        many = 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n
    return np.where(n > 2, many, np.where(n == 2, 1.0, 0.0))


def _grow(points: np.ndarray, limit: int, rng: np.random.Generator) -> list[tuple]:
    """Nodes (node, feature, split, size) of one random tree; children of i are 2i+1 and 2i+2."""
    nodes, waiting = [], [(0, points, 0)]
    while waiting:
        node, inside, depth = waiting.pop()
        low, high = (inside.min(axis=0), inside.max(axis=0)) if len(inside) else (None, None)
        open_columns = np.flatnonzero(high > low) if len(inside) > 1 else []
        if depth >= limit or not len(open_columns):
            nodes.append((node, -1, 0.0, len(inside)))
            continue
        column = int(rng.choice(open_columns))
        at = float(rng.uniform(low[column], high[column]))
        nodes.append((node, column, at, len(inside)))
        left = inside[:, column] < at
        waiting += [(2 * node + 1, inside[left], depth + 1), (2 * node + 2, inside[~left], depth + 1)]
    return nodes


def isolation_forest(
    df: DataFrame, key: str, columns: list[str], trees: int = 100, sample: int = 256, seed: int = 42
) -> DataFrame:
    """Isolation score of every row: (key, score), higher is more unusual.

    Each tree is grown in a task from its own random `sample` rows. The forest is at most
    trees x 2 x sample nodes whatever the table's size, so it is sent to every task for scoring.
    """
    points = df.select(key, F.array(*[F.col(c).cast("double") for c in columns]).alias("_x"))
    total = max(points.count(), 1)
    limit = int(np.ceil(np.log2(max(min(sample, total), 2))))
    chance = min(1_000_000, int(np.ceil(2e6 * sample / total)))
    drawn = f"filter(sequence(0, {trees - 1}), t -> pmod(xxhash64({key}, t, {seed}), 1000000) < {chance})"
    tagged = points.selectExpr(key, "_x", f"explode({drawn}) AS tree")
    kept = tagged.selectExpr(
        "tree", "_x",
        f"row_number() OVER (PARTITION BY tree ORDER BY xxhash64({key}, tree, {seed}), {key}) AS _at",
    ).where(f"_at <= {sample}").drop("_at")

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        stacked = np.array(pdf["_x"].tolist(), dtype=float)
        stacked = stacked[np.lexsort(stacked.T)]  # same tree whatever order the rows come in
        nodes = _grow(stacked, limit, np.random.default_rng([seed, tree]))
        out = pd.DataFrame(nodes, columns=["node", "feature", "split", "size"])
        out.insert(0, "tree", tree)
        return out

    forest = kept.groupBy("tree").applyInPandas(grow, NODES_PER_TREE).toPandas()
    slots = 2 ** (limit + 1)
    feature = np.full((trees, slots), -1)
    cut, size = np.zeros((trees, slots)), np.zeros((trees, slots))
    feature[forest["tree"], forest["node"]] = forest["feature"]
    cut[forest["tree"], forest["node"]] = forest["split"]
    size[forest["tree"], forest["node"]] = forest["size"]
    grown = np.unique(forest["tree"])
    usual = float(_usual_depth(min(sample, total)))

    @F.pandas_udf(T.DoubleType())
    def score(xs: pd.Series) -> pd.Series:
        rows = np.array(xs.tolist(), dtype=float)
        depths = np.zeros(len(rows))
        for tree in grown:
            node, depth = np.zeros(len(rows), dtype=int), np.zeros(len(rows))
            for _ in range(limit):
                column = feature[tree, node]
                inner = column >= 0
                right = rows[np.arange(len(rows)), np.maximum(column, 0)] >= cut[tree, node]
                node = np.where(inner, 2 * node + 1 + right, node)
                depth += inner
            depths += depth + _usual_depth(size[tree, node])
        return pd.Series(2.0 ** (-depths / len(grown) / usual if usual else -depths))

    return points.select(key, score("_x").alias("score"))


def timing_anomalies(patterns: DataFrame, contamination: float = CONTAMINATION) -> DataFrame:
    """Customers with unusual timing: the most isolated share given by `contamination`."""
    base = settle(timing_features(settle(patterns)))
    scaled = settle(standardise(base, TIMING_COLUMNS))
    scored = settle(isolation_forest(scaled, "customer_id", TIMING_COLUMNS))
    limit = quantile_columns(scored, {"at": ("score", 1 - contamination)})
    flagged = with_row(scored, limit, "_l").selectExpr("customer_id", "score", "score > _l.at AS time_anomaly")
    return flagged.join(base.select("customer_id", "fraud_rate"), "customer_id")


# --- fraud from rhythm ---------------------------------------------------------------------------


def rhythm_vectors(patterns: DataFrame) -> DataFrame:
    """Standardised timing features as a vector per customer."""
    patterns = settle(patterns)
    scaled = standardise(settle(timing_features(patterns)), TIMING_COLUMNS)
    counts = patterns.selectExpr("customer_id", "transaction_count AS gaps")
    joined = scaled.join(counts, "customer_id")
    return VectorAssembler(inputCols=TIMING_COLUMNS, outputCol="features").transform(joined)


def rhythm_accuracy(patterns: DataFrame, folds: int = 5, trees: int = 100, seed: int = 42) -> DataFrame:
    """Cross-validated accuracy of "has any fraud" from timing, customers with three gaps or more."""
    rows = rhythm_vectors(patterns).where("gaps >= 3").selectExpr(
        "customer_id", "CAST(fraud_rate > 0 AS INT) AS label", "features",
        f"CAST(pmod(xxhash64(customer_id, {seed}), {folds}) AS INT) AS fold",
    )
    ready, n = training_rows(with_weights(rows), "customer_id")
    spark = patterns.sparkSession
    if n <= 10 or ready.select("label").distinct().count() < 2:
        return literal_rows(spark, [(None, None, False)], ["mean_accuracy", "std_accuracy", "goal_met"])
    forest = RandomForestClassifier(numTrees=trees, maxDepth=MAX_DEPTH, seed=seed, weightCol="weight")
    validator = CrossValidator(
        estimator=forest, estimatorParamMaps=[{}], numFolds=folds, foldCol="fold", parallelism=2,
        evaluator=MulticlassClassificationEvaluator(metricName="accuracy"),
    )
    fitted = validator.fit(ready)
    mean, std = float(fitted.avgMetrics[0]), float(fitted.stdMetrics[0])
    return literal_rows(spark, [(mean, std, mean > ACCURACY_GOAL)], ["mean_accuracy", "std_accuracy", "goal_met"])


def rhythm_components(patterns: DataFrame) -> DataFrame:
    """First two principal components of the timing features."""
    vectors = rhythm_vectors(patterns).select("customer_id", "fraud_rate", "features")
    model = PCA(k=2, inputCol="features", outputCol="_pca").fit(vectors)
    pair = vector_to_array("_pca")
    return model.transform(vectors).select(
        "customer_id", "fraud_rate", pair[0].alias("pc1"), pair[1].alias("pc2")
    )
