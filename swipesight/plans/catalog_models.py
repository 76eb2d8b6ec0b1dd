"""Registered queries: classifier metrics, models, resampling and timing models."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from swipesight.operators import metrics as me
from swipesight.operators import models as mo
from swipesight.operators import temporal as tm
from swipesight.operators import timing_models as ti
from swipesight.plans.catalog_behaviour import _patterns
from swipesight.plans.catalog_customers import on, txn
from swipesight.plans.oracle import with_predictions, with_txn
from swipesight.plans.query import Query, form
from swipesight.sources import fixtures

CELLS = """, cm AS (SELECT count(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
  count(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp, count(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn,
  count(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn FROM pr),
st AS (SELECT score, sum(label) AS pos, count(*) - sum(label) AS neg FROM pr GROUP BY score),
cu AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
  sum(pos) OVER () AS p, sum(neg) OVER () AS n, sum(neg) OVER (ORDER BY score) AS neg_up FROM st)
"""


def _table(name):
    return lambda spark, sf: mo.TABLES[name](fixtures.transactions(spark, sf))


def _ready(spark, sf, keep=False):
    """The simple table, which may be kept as every fitted stage reads it, and its prepared training rows."""
    prepared = _table("simple")(spark, sf)
    table = prepared.table.persist() if keep else prepared.table
    train, _ = mo.split(table)
    return table, Pipeline(stages=mo.preprocessing(train, prepared)).fit(train).transform(train)


def _vectors(spark, sf):
    return _ready(spark, sf)[1].select(
        mo.ID, "label", F.size(vector_to_array("features")).alias("dimensions"))


def _split_sizes(spark, sf):
    train, test = mo.split(_table("simple")(spark, sf).table)
    return train.selectExpr("'train' AS part", "label").union(test.selectExpr("'test' AS part", "label")).groupBy(
        "part", "label").agg(F.count(F.lit(1)).alias("n"))


def _stratified_sizes(spark, sf):
    rows = fixtures.transactions(spark, sf, ["transaction_id", "is_fraud"]).selectExpr("transaction_id", "CAST(is_fraud AS INT) AS label")
    train, test = mo.stratified_split(rows, 0.2, key="transaction_id")
    parts = train.selectExpr("'train' AS part", "label").union(test.selectExpr("'test' AS part", "label"))
    return parts.groupBy("part", "label").agg(F.count(F.lit(1)).alias("n"))


def _balanced(method):
    def run(spark, sf):
        table, ready = _ready(spark, sf, keep=method != "undersample")  # its draw is by the last bits of scaled columns
        rows = mo.balance(ready, method, kept=table)
        return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))
    return run


def _trained(table, names=None, method="none"):
    def run(spark, sf):
        return mo.fraud_models(fixtures.transactions(spark, sf), table, names or mo.MODEL_LISTS[table], method)
    return run


def _metrics(table, names=None, method="none"):
    def run(spark, sf):
        return me.best_models(_trained(table, names, method)(spark, sf).metrics).drop("training_seconds")
    return run


def _importance(spark, sf):
    trained = _trained("simple", ["random_forest"])(spark, sf)
    return mo.feature_importance(spark, trained.pipelines["random_forest"])


def _coefficients(spark, sf):
    pipeline = _trained("quick")(spark, sf).pipelines["logistic_regression"]
    return mo.coefficients(spark, pipeline.stages[-1], mo.feature_names(pipeline))


def _model_curve(spark, sf):
    return me.roc_points(_trained("quick")(spark, sf).predictions, ["model"], grid=1000)


def entries() -> dict[str, Query]:
    q: dict[str, Query] = {}
    load = fixtures.prediction_table
    q["confusion_matrix"] = Query(
        on(load, me.confusion_shares),
        form(with_predictions(CELLS + """SELECT *, tp / (tp + fn) AS tp_share, fn / (tp + fn) AS fn_share,
          tn / (tn + fp) AS tn_share, fp / (tn + fp) AS fp_share FROM cm"""),
             "#tp #fp #tn #fn ~tp_share ~fn_share ~tn_share ~fp_share"))
    q["class_metrics"] = Query(
        on(load, me.class_metrics),
        form(with_predictions(CELLS + """SELECT *, (tp + tn) / (tp + fp + tn + fn) AS accuracy, tp / (tp + fp) AS precision,
          tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM cm"""),
             "#tp #fp #tn #fn ~accuracy ~precision ~recall ~f1"))
    q["ranking_metrics"] = Query(
        on(load, me.ranking_metrics),
        form(with_predictions(CELLS + """SELECT sum(pos * (neg_up - neg + neg / 2)) / (max(p) * max(n)) AS roc_auc,
          sum(pos * tp / (tp + fp)) / max(p) AS avg_precision FROM cu"""), "~roc_auc ~avg_precision"))
    q["roc_points"] = Query(
        on(load, me.roc_points),
        form(with_predictions(CELLS + "SELECT score AS threshold, fp / n AS fpr, tp / p AS tpr FROM cu"),
             "~threshold ~fpr ~tpr"))
    q["precision_recall_points"] = Query(
        on(load, me.precision_recall_points),
        form(with_predictions(CELLS + "SELECT score AS threshold, tp / (tp + fp) AS precision, tp / p AS recall FROM cu"),
             "~threshold ~precision ~recall"))
    q["business_report"] = Query(
        on(load, lambda t: me.business_report(me.confusion(t))),
        form(with_predictions(CELLS + """SELECT *, tp * 1000 AS saved, fn * 10000 AS missed_cost, fp * 50 AS false_alarm_cost,
          fn * 10000 + fp * 50 AS total_cost, tp * 1000 - fn * 10000 - fp * 50 AS net_savings FROM cm"""),
             "#tp #fp #tn #fn #saved #missed_cost #false_alarm_cost #total_cost #net_savings"))
    q["class_weights"] = Query(
        on(load, mo.class_weights),
        form(with_predictions("""SELECT label, count(*) AS n, sum(count(*)) OVER () / (2 * count(*)) AS weight
          FROM pr GROUP BY label"""), "#label #n ~weight"))
    flags = ["is_card_present", "is_outside_home_country", "is_high_risk_vendor", "is_weekend"]
    ints = ", ".join(f"CAST({f} AS INTEGER) AS {f}" for f in flags)
    simple = "transaction_id #label ~amount #is_card_present #is_outside_home_country #is_high_risk_vendor " \
        "#is_weekend #hour #day_of_week vendor_category vendor_type currency country city_size card_type channel"
    q["model_table"] = Query(
        lambda s, sf: _table("simple")(s, sf).table.select(*[c.lstrip("~#") for c in simple.split()]),
        form(with_txn(f"""SELECT transaction_id, CAST(is_fraud AS INTEGER) AS label, amount, {ints},
          hour(timestamp) AS hour, isodow(timestamp) - 1 AS day_of_week, vendor_category, vendor_type, currency,
          country, city_size, card_type, channel FROM txn"""), simple))
    q["train_test_sizes"] = Query(_split_sizes)
    q["stratified_split_sizes"] = Query(_stratified_sizes, form(with_txn("""
      , c AS (SELECT CAST(is_fraud AS INTEGER) AS label, count(*) AS n FROM txn WHERE is_fraud IS NOT NULL GROUP BY 1)
      SELECT 'test' AS part, label, CAST(round(0.2 * n) AS BIGINT) AS n FROM c
      UNION ALL SELECT 'train', label, n - CAST(round(0.2 * n) AS BIGINT) FROM c"""), "part #label #n"))
    q["prepared_vectors"] = Query(_vectors)
    for method in ("undersample", "smote", "adasyn", "smoteenn"):
        q[f"balanced_{method}"] = Query(_balanced(method))
    q["quick_model_metrics"] = Query(_metrics("quick"))
    q["quick_model_coefficients"] = Query(_coefficients)
    q["quick_model_roc"] = Query(_model_curve)
    q["simple_model_metrics"] = Query(_metrics("simple", ["logistic_regression", "random_forest"]))
    for name in ("gradient_boosting", "xgb_like", "lgbm_like"):
        q[f"{name}_metrics"] = Query(_metrics("simple", [name]))
    q["simple_model_report"] = Query(
        lambda s, sf: mo.report(_trained("simple", ["logistic_regression"])(s, sf)).drop("training_seconds"))
    q["smote_model_metrics"] = Query(_metrics("simple", ["logistic_regression"], "smote"))
    q["feature_model_metrics"] = Query(_metrics("features", ["logistic_regression", "random_forest"]))
    q["basic_model_metrics"] = Query(_metrics("basic"))
    q["feature_importance"] = Query(_importance)
    clock = txn("transaction_id", "timestamp", "is_fraud")
    q["clock_model_metrics"] = Query(on(clock, ti.clock_metrics))
    q["clock_model_coefficients"] = Query(on(clock, ti.clock_coefficients))
    q["timing_anomalies"] = Query(on(_patterns, ti.timing_anomalies))
    q["anomaly_fraud_rates"] = Query(
        on(_patterns, lambda t: tm.group_fraud_rates(ti.timing_anomalies(t), "time_anomaly")))
    q["rhythm_accuracy"] = Query(on(_patterns, ti.rhythm_accuracy))
    q["rhythm_components"] = Query(on(_patterns, ti.rhythm_components))
    return q


