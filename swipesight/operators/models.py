"""Fraud classifiers on MLlib: preparation, training, comparison and inspection."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import (
    OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swipesight.functions.ranks import quantile_columns, running_totals
from swipesight.functions.semantics import booleans_to_int, drop_present, literal_rows, with_row
from swipesight.operators import features as fe
from swipesight.operators import metrics as me
from swipesight.operators.profiling import columns_by_kind, mostly_missing, unpack_last_hour
from swipesight.session import release, settle

ID, LABEL = "transaction_id", "is_fraud"
# Columns that are not features, per preparation
IDENTIFIERS = [
    "customer_id", "card_number", "vendor", "device_fingerprint", "ip_address", "device", "city",
]
MAX_DEPTH = 15
# Training passes over the rows many times, and in every pass each task sends the statistics of all open nodes: few tasks of
# many rows, by fixed numbers, so that the draws of a forest don't depend on the cluster. Above 12 they go by dozens: a thirteenth
# would have a wave of its own in every pass.
TRAINING_TASKS, TRAINING_TASK_ROWS = 12, 400_000


@dataclass(frozen=True)
class Prepared:
    """A model table: id, 0/1 label and feature columns split by kind."""

    table: DataFrame
    numeric: list[str]
    categorical: list[str]
    impute: bool = True


def _finish(df: DataFrame, booleans_are_categories: bool, impute: bool = True) -> Prepared:
    table = df.withColumn("label", F.col(LABEL).cast("int")).drop(LABEL).where("label IS NOT NULL")
    numeric, text = columns_by_kind(table, booleans_are_categories, [ID, "label"])
    return Prepared(table.select(ID, "label", *numeric, *text), numeric, text, impute)


def simple_table(df: DataFrame) -> Prepared:
    """Hour, weekday, the five last-hour members, booleans as 0/1, identifiers dropped."""
    timed = df.selectExpr("*", "hour(timestamp) AS hour", "weekday(timestamp) AS day_of_week")
    flat = drop_present(unpack_last_hour(timed), ["timestamp", "last_hour_activity", *IDENTIFIERS])
    return _finish(booleans_to_int(flat), False)


def quick_table(df: DataFrame) -> Prepared:
    """The shortest preparation: no time parts, three last-hour members, gaps not filled by medians."""
    fields = ["num_transactions", "total_amount", "unique_merchants"]
    flat = drop_present(unpack_last_hour(df, fields), ["timestamp", "last_hour_activity", *IDENTIFIERS])
    return _finish(booleans_to_int(flat), False, impute=False)


def feature_table(df: DataFrame, fit_on: DataFrame | None = None) -> Prepared:
    """Every engineered feature; booleans are categories; mostly missing columns are dropped.

    The ISO week is kept out of the vectors, as its type keeps it out of the numeric columns.
    """
    flat = drop_present(
        fe.all_features(df, fit_on),
        ["timestamp", "last_hour_activity", "transaction_date", "transaction_week", *IDENTIFIERS],
    )
    return _finish(drop_present(flat, mostly_missing(flat)), True)


def basic_table(df: DataFrame) -> Prepared:
    """Basic features; booleans only through their 0/1 copies, without the copy of the label."""
    flat = drop_present(
        fe.basic_features(df), ["timestamp", "last_hour_activity", f"{LABEL}_int", *IDENTIFIERS]
    )
    return _finish(flat, False)


TABLES: dict[str, Callable[[DataFrame], Prepared]] = {
    "simple": simple_table, "quick": quick_table, "features": feature_table, "basic": basic_table,
}


def split(
    df: DataFrame, test_size: float = 0.2, seed: int = 42, key: str = ID
) -> tuple[DataFrame, DataFrame]:
    """Repeatable train and test parts by the hash of the key.

    The hash knows nothing of the label, so class shares agree up to sampling error, and no shuffle
    is made.
    """
    slot = f"pmod(xxhash64({key}, {seed}), 100000)"
    limit = round(test_size * 100000)
    return df.where(f"{slot} >= {limit}"), df.where(f"{slot} < {limit}")


def _class_ranks(df: DataFrame, key: str, label: str, seed: int) -> DataFrame:
    """(label, key, _one_through, _one_all): the rank of each row within its class by the hash of its key.

    Running totals dealt out by range over (class, hash, key): a large class is spread over many tasks, nothing is sorted
    in one. Rows with a null label are left out; keys are taken as unique.
    """
    rows = df.where(f"`{label}` IS NOT NULL").selectExpr(
        f"`{label}`", f"`{key}`", f"struct(xxhash64(`{key}`, {seed}), `{key}`) AS _h", "1 AS _one"
    )
    return running_totals(rows, "_h", ["_one"], by=[label])


def stratified_split(
    df: DataFrame, test_size: float = 0.2, seed: int = 42, key: str = ID, label: str = "label"
) -> tuple[DataFrame, DataFrame]:
    """Train and test parts with exactly round(test_size x n) rows of each class in the test part (halves up).

    The rows are those with the smallest hashes of their key within the class, so the same whatever the partitioning.
    Rows with a null label stay in training.
    """
    ranked = _class_ranks(df, key, label, seed)
    chosen = ranked.where(f"_one_through <= round({test_size!r}D * _one_all)").select(key)
    return df.join(chosen, key, "left_anti"), df.join(chosen, key, "left_semi")


def exact_undersample(df: DataFrame, label: str = "label", seed: int = 42, key: str = ID) -> DataFrame:
    """Every class cut to the size of the smallest, by the smallest hashes of the key: sizes exactly equal."""
    ranked = _class_ranks(df, key, label, seed)
    smallest = ranked.groupBy(label).agg(F.max("_one_all").alias("n")).agg(F.min("n").alias("n"))
    kept = with_row(ranked, smallest, "_s").where("_one_through <= _s.n").select(key)
    return df.join(kept, key, "left_semi")


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights: rows / (2 x rows of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.selectExpr(label, "n", "sum(n) OVER () / (2D * n) AS weight")


def with_weights(df: DataFrame, label: str = "label") -> DataFrame:
    weights = {r[label]: r["weight"] for r in class_weights(df, label).collect()}
    return df.withColumn("weight", F.when(F.col(label) == 1, weights.get(1, 1.0)).otherwise(weights.get(0, 1.0)))


def undersample(df: DataFrame, label: str = "label", seed: int = 42) -> DataFrame:
    """The minority kept whole and a part of the majority of about the same size, picked by hash: the same however partitioned."""
    counts = {r[label]: r["n"] for r in class_weights(df, label).collect()}
    small = min(counts.values())
    limits = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, small / n))])
    slot = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if c != label], F.lit(seed)), F.lit(1 << 30))
    return df.where(slot < limits[F.col(label)] * (1 << 30))


def preprocessing(train: DataFrame, prepared: Prepared) -> list:
    """Pipeline stages to one `features` vector.

    Numeric: exact training medians in gaps, then standard scores. Categorical: 'missing' in gaps,
    then one-hot columns, where a category unseen in training has none set.
    """
    numeric, text = prepared.numeric, prepared.categorical
    fills, stages, parts = {}, [], []
    if numeric:
        if prepared.impute:
            fills = quantile_columns(train, {c: (c, 0.5) for c in numeric}).first().asDict()
        else:
            fills = {c: 0.0 for c in numeric}
    kept = [f"`{c}`" for c in ("label", "weight", ID) if c in train.columns]
    filled = [
        f"coalesce(CAST(`{c}` AS DOUBLE), {float(fills.get(c) or 0.0)!r}D) AS `{c}`" for c in numeric
    ] + [f"coalesce(CAST(`{c}` AS STRING), 'missing') AS `{c}`" for c in text]
    stages.append(SQLTransformer(statement=f"SELECT {', '.join(kept + filled)} FROM __THIS__"))
    if numeric:
        stages += [
            VectorAssembler(inputCols=numeric, outputCol="_numeric"),
            StandardScaler(inputCol="_numeric", outputCol="_scaled", withMean=True, withStd=True),
        ]
        parts.append("_scaled")
    if text:
        stages += [
            StringIndexer(inputCols=text, outputCols=[f"{c}_index" for c in text], handleInvalid="keep"),
            OneHotEncoder(inputCols=[f"{c}_index" for c in text], outputCols=[f"{c}_hot" for c in text]),
        ]
        parts += [f"{c}_hot" for c in text]
    stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
    return stages


def estimators(rows: int, names: Sequence[str] | None = None, size: int = 100, seed: int = 42) -> dict:
    """Classifiers by name; `size` is the number of trees or boosting rounds."""
    made = {
        # penalty 0.5 |w|^2 against the summed loss: 1 / rows against the mean loss
        "logistic_regression": LogisticRegression(
            maxIter=1000, regParam=1.0 / max(rows, 1), standardization=False, weightCol="weight"),
        # each row keeps its node in every tree, else each pass walks all trees from their roots; the same trees either way
        "random_forest": RandomForestClassifier(
            numTrees=size, maxDepth=MAX_DEPTH, seed=seed, weightCol="weight", cacheNodeIds=True, checkpointInterval=-1),
        "gradient_boosting": GBTClassifier(maxIter=size, maxDepth=3, stepSize=0.1, seed=seed),
        "xgb_like": GBTClassifier(maxIter=size, maxDepth=6, stepSize=0.3, seed=seed),
        "lgbm_like": GBTClassifier(maxIter=size, maxDepth=5, maxBins=255, stepSize=0.1, seed=seed),
    }
    return {n: e for n, e in made.items() if names is None or n in names}


def training_rows(ready: DataFrame, key: str | None = ID) -> tuple[DataFrame, int]:
    """The rows kept in memory, dealt into as many parts as training needs (left as they are if there are not more), and their number."""
    held = ready.persist()
    rows, parts = held.count(), held.rdd.getNumPartitions()
    tasks = TRAINING_TASKS * max(1, -(-rows // (TRAINING_TASKS * TRAINING_TASK_ROWS)))
    if parts > tasks or rows > parts * TRAINING_TASK_ROWS:
        dealt = held.repartition(tasks, *([key] if key else held.columns)).sortWithinPartitions(*([key] if key else held.columns)).persist()
        dealt.count()
        held.unpersist()
        held = dealt
    return held, rows


@dataclass
class Trained:
    """Fitted pipelines, test predictions of all models in one table, and one row per model."""

    pipelines: dict[str, PipelineModel] = field(default_factory=dict)
    predictions: DataFrame | None = None
    metrics: DataFrame | None = None


def predict(model, test: DataFrame, name: str) -> DataFrame:
    return model.transform(test).select(
        F.lit(name).alias("model"), F.col(ID).alias("id"), "label",
        F.col("prediction").cast("int").alias("prediction"),
        vector_to_array("probability")[1].alias("score"),
    )


BALANCERS = ("none", "undersample", "smote", "adasyn", "smoteenn")


def balance(prepared_train: DataFrame, method: str, seed: int = 42, kept: DataFrame | None = None) -> DataFrame:
    """Rows (label, weight, features) balanced after preparation, when all columns are numbers.

    `kept`, a persisted frame behind the rows, is let go with its shuffle files where the rows are settled.
    """
    from swipesight.operators import resampling

    if method not in BALANCERS:
        raise ValueError(f"unknown balancing method {method}")
    rows = prepared_train.select(ID, "label", "features")
    if method == "none":
        return with_weights(rows)
    if method == "undersample":
        out = undersample(rows, seed=seed)
    else:
        rows = settle(rows)
        if kept is not None:
            kept.unpersist()
        release(rows.sparkSession)
        out = getattr(resampling, method)(rows, seed=seed)
    return with_weights(out)


def train_models(
    prepared: Prepared,
    names: Sequence[str] | None = None,
    method: str = "none",
    test_size: float = 0.2,
    size: int = 100,
    seed: int = 42,
) -> Trained:
    """Fit each model on the same prepared rows and measure all of them on the same test rows.

    A model that fails is kept as a row with its error and the others go on.
    """
    table = prepared.table.persist()  # read once for each fitted stage otherwise, with all joins behind it
    train, test = split(table, test_size, seed)
    head = Pipeline(stages=preprocessing(train, prepared)).fit(train)
    held_out, _ = training_rows(head.transform(test).select(ID, "label", "features"))
    if table.rdd.getNumPartitions() <= TRAINING_TASKS:
        table.unpersist()  # training rows that are not dealt stand as the joins leave them: draws depend on that order
    ready, rows = training_rows(balance(head.transform(train), method, seed, table))
    table.unpersist()
    out, found, log = Trained(), [], []
    for name, estimator in estimators(rows, names, size, seed).items():
        start = time.monotonic()
        try:
            fitted = estimator.fit(ready)
            seconds = time.monotonic() - start
            found.append(settle(predict(fitted, held_out, name)))  # each task that reads them would get the model else
            out.pipelines[name] = PipelineModel(stages=[*head.stages, fitted])
            log.append((name, seconds, ""))
        except Exception as error:  # noqa: BLE001
            log.append((name, time.monotonic() - start, str(error)[:500]))
    ready.unpersist()
    held_out.unpersist()
    times = literal_rows(prepared.table.sparkSession, log, ["model", "training_seconds", "error"])
    if found:
        union = found[0]
        for part in found[1:]:
            union = union.unionByName(part)
        out.predictions = union
        out.metrics = times.join(F.broadcast(me.all_metrics(union, ["model"])), "model", "left")
    else:
        out.metrics = times
    return out


def best_name(trained: Trained) -> str:
    return me.best_models(trained.metrics, 1).first()["model"]


def feature_names(pipeline: PipelineModel) -> list[str]:
    """Names of the vector's positions: numeric columns, then one per category."""
    names: list[str] = []
    for stage in pipeline.stages:
        if isinstance(stage, VectorAssembler) and stage.getOutputCol() == "_numeric":
            names += stage.getInputCols()
        elif hasattr(stage, "labelsArray"):
            for column, labels in zip(stage.getInputCols(), stage.labelsArray):
                names += [f"{column}_{label}" for label in labels]
    return names


def feature_importance(spark, pipeline: PipelineModel, n: int | None = 15) -> DataFrame:
    """Importances of a tree model by name, largest first; no rows for a model without them."""
    last = pipeline.stages[-1]
    if not hasattr(last, "featureImportances"):
        return spark.range(0).selectExpr("CAST(NULL AS STRING) AS feature", "CAST(NULL AS DOUBLE) AS importance")
    values = [float(v) for v in last.featureImportances.toArray()]
    rows = literal_rows(spark, list(zip(feature_names(pipeline), values)), ["feature", "importance"])
    ordered = rows.orderBy(F.desc("importance"), "feature")
    return ordered.limit(n) if n else ordered


def coefficients(spark, model, names: Sequence[str]) -> DataFrame:
    """Coefficients of a logistic regression by absolute size, and the intercept."""
    rows = list(zip(names, [float(v) for v in model.coefficients.toArray()]))
    rows.append(("(intercept)", float(model.intercept)))
    return literal_rows(spark, rows, ["feature", "coefficient"]).selectExpr(
        "feature", "coefficient", "abs(coefficient) AS importance"
    ).orderBy(F.expr("feature = '(intercept)'"), F.desc("importance"), "feature")


def fraud_models(
    df: DataFrame, table: str = "simple", names: Sequence[str] | None = None, method: str = "none",
    size: int = 100,
) -> Trained:
    """Whole path from transactions to compared models, by preparation name."""
    return train_models(TABLES[table](df), names, method, size=size)


# Model lists of the whole paths, by preparation.
MODEL_LISTS: Mapping[str, Sequence[str]] = {
    "simple": ["logistic_regression", "random_forest", "gradient_boosting", "xgb_like", "lgbm_like"],
    "features": ["logistic_regression", "random_forest", "gradient_boosting", "xgb_like"],
    "basic": ["logistic_regression", "random_forest", "xgb_like"],
    "quick": ["logistic_regression"],
}
REPORT_FIELDS = ["accuracy", "precision", "recall", "f1", "roc_auc", "avg_precision"]


def report(trained: Trained) -> DataFrame:
    """The best model's metrics with the business estimate."""
    return me.business_report(me.best_models(trained.metrics.where("error = ''"), 1))


def report_text(row) -> str:
    """The report row as readable text."""
    lines = [f"Best model: {row['model']}"]
    lines += [f"  {name}: {row[name]:.4f}" for name in REPORT_FIELDS]
    lines += [f"  {name}: {row[name]}" for name in ("tp", "fp", "tn", "fn")]
    lines += [f"  {name}: ${row[name]:,.2f}" for name in
              ("saved", "missed_cost", "false_alarm_cost", "total_cost", "net_savings")]
    return "\n".join(lines)
