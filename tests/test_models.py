"""Models, resampling, anomaly detection, files and streams on small inputs."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from swipesight.operators import models as mo
from swipesight.operators import resampling as rs
from swipesight.operators import timing_models as ti
from swipesight.plans.reports import model_report, save_results
from swipesight.sources import fixtures, io

SMALL = "/root/testdata/sf0.001"


def cloud(spark, n=120, rare=20, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(f"r{i}", int(i < rare), (rng.normal(size=3) + (2 if i < rare else 0)).tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "transaction_id string, label int, x array<double>")
    return rows, df.select("transaction_id", "label", array_to_vector("x").alias("features"))


@pytest.mark.parametrize("block_rows,pivots", [(4096, 1), (7, 5), (16, 12)])
def test_nearest_is_exact(spark, block_rows, pivots):
    rows, _ = cloud(spark)
    df = spark.createDataFrame([(r[0], r[2]) for r in rows], "pid string, x array<double>")
    got = {}
    for r in rs.nearest(df.select(F.col("pid").alias("qid"), "x"), df, 4, block_rows, pivots).collect():
        got.setdefault(r["qid"], {})[r["rank"]] = r["pid"]
    x = np.array([r[2] for r in rows])
    for i, (name, _, _) in enumerate(rows):
        far = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        far[i] = np.inf
        assert [got[name][k] for k in range(1, 5)] == [rows[j][0] for j in np.argsort(far)[:4]]


def test_leaves_leave_out_far_points_and_keep_ties():
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.integers(0, 2, (4000, 12)), rng.normal(size=4000)]).astype(float)
    x[:400] = x[0]  # copies can't be cut apart
    tree = rs._Tree(x, 64)
    leaf = tree.of(x)
    boxes = [(x[leaf == i].min(axis=0), x[leaf == i].max(axis=0)) for i in range(tree.leaves)]
    tree.bound(*(np.array(side) for side in zip(*boxes)))
    limit = np.full(len(x), 0.3)
    rows, found = tree.within(x, limit)
    assert len(rows) < 0.2 * len(x) * tree.leaves  # a pivot's radius leaves out next to nothing here
    reached = set(zip(rows.tolist(), found.tolist()))
    for i in range(0, len(x), 97):
        assert all((i, j) in reached for j in set(leaf[((x - x[i]) ** 2).sum(axis=1) <= 0.09].tolist()))


def test_nearest_of_copies_takes_smaller_ids(spark):
    rows = [(f"r{i:02d}", [float(i // 20), 0.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "pid string, x array<double>")
    got = {}
    for r in rs.nearest(df.select(F.col("pid").alias("qid"), "x"), df, 3, 7, 4).collect():
        got.setdefault(r["qid"], {})[r["rank"]] = r["pid"]
    for i in range(60):
        alike = [f"r{j:02d}" for j in range(i // 20 * 20, i // 20 * 20 + 20) if j != i][:3]
        assert [got[f"r{i:02d}"][k] for k in (1, 2, 3)] == alike


def test_smote_lies_between_rare_neighbours(spark):
    rows, df = cloud(spark)
    made = [r for r in rs.smote(df).collect() if r["transaction_id"].startswith("new-")]
    assert len(made) == 80  # 100 common, 20 rare: four copies each
    rare = {r[0]: np.array(r[2]) for r in rows if r[1]}
    names = list(rare)
    for r in made:
        base = rare[r["transaction_id"].split("-")[1]]
        point = np.array(r["features"].toArray())
        near = sorted(names, key=lambda n: ((rare[n] - base) ** 2).sum())[1:6]
        gaps = []
        for n in near:
            way = rare[n] - base
            share = (point - base) @ way / (way @ way)
            gaps.append(np.abs(base + share * way - point).max() if -1e-9 <= share <= 1 else np.inf)
        assert min(gaps) < 1e-6


def test_adasyn_and_cleaning(spark):
    _, df = cloud(spark)
    counts = {r["label"]: r["count"] for r in rs.adasyn(df).groupBy("label").count().collect()}
    assert counts[0] == 100 and 85 <= counts[1] <= 115
    rows, _ = cloud(spark)
    kept = {r["transaction_id"] for r in rs.edited_neighbours(df).collect()}
    x = np.array([r[2] for r in rows])
    for i, (name, label, _) in enumerate(rows):
        far = ((x - x[i]) ** 2).sum(axis=1)
        far[i] = np.inf
        assert (name in kept) == all(rows[j][1] == label for j in np.argsort(far)[:3])


def test_split_keeps_class_shares(spark):
    df = spark.range(20000).selectExpr("CAST(id AS STRING) AS transaction_id", "CAST(id % 5 = 0 AS INT) AS label")
    train, test = mo.split(df)
    assert train.count() + test.count() == 20000 and train.intersect(test).count() == 0
    for part, share in ((train, 0.8), (test, 0.2)):
        counts = {r["label"]: r["count"] for r in part.groupBy("label").count().collect()}
        assert counts[1] / 4000 == pytest.approx(share, abs=0.02) and counts[0] / 16000 == pytest.approx(share, abs=0.01)


def test_isolation_forest_finds_outliers(spark):
    rng = random.Random(5)
    rows = [(f"c{i}", rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(400)] + [("far", 9.0, -9.0), ("off", -8.0, 8.0)]
    df = spark.createDataFrame(rows, "k string, a double, b double")
    scores = {r["k"]: r["score"] for r in ti.isolation_forest(df, "k", ["a", "b"]).collect()}
    assert sorted(scores, key=scores.get)[-2:] in (["far", "off"], ["off", "far"])
    assert len(scores) == 402 and all(0 < s < 1 for s in scores.values())
    again = {r["k"]: r["score"] for r in ti.isolation_forest(df.repartition(3), "k", ["a", "b"]).collect()}
    assert again == scores


def test_models_are_trained_compared_and_saved(spark, tmp_path):
    df = fixtures.transactions(spark, SMALL)
    trained = mo.fraud_models(df, "simple", ["logistic_regression", "random_forest"], size=10)
    tables = model_report(trained)
    found = {r["model"]: r for r in tables["comparison"].collect()}
    assert set(found) == {"logistic_regression", "random_forest"} and all(r["f1"] > 0.3 for r in found.values())
    names = mo.feature_names(trained.pipelines["random_forest"])
    importance = mo.feature_importance(spark, trained.pipelines["random_forest"], None)
    assert importance.count() == len(names) == len(set(names))
    assert "score" not in names and mo.report_text(tables["business"].first()).startswith("Best model")
    save_results(trained, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out/metrics"), header=True).count() == 2
    assert spark.read.json(str(tmp_path / "out/report")).count() == 1
    model = io.load_model(str(tmp_path / "out/models"), mo.best_name(trained))
    prepared = mo.simple_table(df)
    assert model.transform(prepared.table).where("prediction = 1").count() > 0


def test_a_failing_model_leaves_the_others(spark, monkeypatch):
    df = fixtures.transactions(spark, SMALL)
    made = mo.estimators

    def broken(rows, names=None, size=100, seed=42):
        out = made(rows, ["logistic_regression"], size, seed)
        out["broken"] = made(rows, ["random_forest"], size, seed)["random_forest"].setMaxDepth(30).setMaxBins(2).setFeaturesCol("none")
        return out

    monkeypatch.setattr(mo, "estimators", broken)
    rows = {r["model"]: r for r in mo.fraud_models(df, "quick").metrics.collect()}
    assert rows["broken"]["error"] and rows["broken"]["f1"] is None and rows["logistic_regression"]["f1"] > 0


def test_transactions_round_trip(spark, tmp_path):
    path = str(tmp_path / "transactions")
    fixtures.transactions(spark, SMALL).write.parquet(path)
    df = io.read_transactions(spark, path)
    assert len(df.columns) == 23 and df.count() == 1000
    assert dict(df.dtypes)["timestamp"] == "timestamp"
    with pytest.raises(ValueError):
        io.read_transactions(spark, path, ["nothing"])


def test_interval_stream_matches_batch(spark, tmp_path):
    from swipesight.operators.temporal import interval_counts
    from swipesight.streaming.intervals import interval_stream, read_stream

    path = str(tmp_path / "arriving")
    df = fixtures.transactions(spark, SMALL)
    df.coalesce(1).write.parquet(path)
    late = df.limit(1).withColumn("timestamp", F.lit(datetime(2030, 1, 1) + timedelta(0)))
    late.write.mode("append").parquet(path)
    out = interval_stream(read_stream(spark, path))
    query = out.writeStream.format("memory").queryName("intervals").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    got = {r["interval_start"]: r["transactions"] for r in spark.table("intervals").collect()}
    want = {r["interval_start"]: r["transactions"] for r in interval_counts(df).collect()}
    assert got == want


def test_stratified_split_is_exact_and_independent_of_partitioning(spark):
    from swipesight.operators import models as mo

    rows = [(i, 1 if i % 7 == 0 else (None if i % 31 == 0 else 0)) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, label int")
    train, test = mo.stratified_split(df, 0.2, key="id")
    counts = {r.label: r.n for r in test.groupBy("label").agg(F.count("*").alias("n")).collect()}
    sizes = {lab: sum(1 for _, l in rows if l == lab) for lab in (0, 1)}
    assert counts == {lab: int(n * 0.2 + 0.5) for lab, n in sizes.items()}
    assert train.count() + test.count() == 1000 and train.where("label IS NULL").count() == sum(1 for _, l in rows if l is None)
    _, other = mo.stratified_split(df.repartition(7), 0.2, key="id")
    assert sorted(r.id for r in test.collect()) == sorted(r.id for r in other.collect())
    kept = mo.exact_undersample(df, key="id")
    assert {r.label: r.n for r in kept.groupBy("label").agg(F.count("*").alias("n")).collect()} == {0: sizes[1], 1: sizes[1]}


def test_training_rows_are_dealt_into_few_parts(spark):
    rows = spark.range(3000).selectExpr("CAST(id AS STRING) AS transaction_id", "CAST(id % 2 AS INT) AS label").repartition(100)
    held, n = mo.training_rows(rows)
    assert n == 3000 and held.rdd.getNumPartitions() == mo.TRAINING_TASKS
    assert held.select("transaction_id").distinct().count() == 3000
    small, n = mo.training_rows(rows.limit(50).coalesce(3))
    assert n == 50 and small.rdd.getNumPartitions() <= 3


def test_nearest_goes_in_rounds_of_few_probes_and_stays_exact(spark, monkeypatch):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(600, 6))
    df = spark.createDataFrame([(f"p{i:03d}", v.tolist()) for i, v in enumerate(x)], "pid string, x array<double>")
    settled = []
    monkeypatch.setattr(rs, "settle", lambda frame, keep=rs.settle: settled.append(frame) or keep(frame))
    monkeypatch.setattr(rs, "ROUND_PROBES", 1)
    got = {}
    for r in rs.nearest(df.select(F.col("pid").alias("qid"), "x"), df, 3, 20, 30).collect():
        got.setdefault(r["qid"], {})[r["rank"]] = (r["pid"], r["distance"])
    assert len(settled) > 5  # two steps, then each round: the disk holds one round, not all probes
    for i in range(600):
        far = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        far[i] = np.inf
        want = np.argsort(far)[:3]
        assert [got[f"p{i:03d}"][k][0] for k in (1, 2, 3)] == [f"p{j:03d}" for j in want]
        assert [got[f"p{i:03d}"][k][1] for k in (1, 2, 3)] == pytest.approx(far[want].tolist())


def test_training_reads_the_prepared_table_once(spark):
    """Every fitted stage read the transactions anew, and every metric the model's predictions."""
    reads = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def seen(_):
        reads.add(1)
        return True

    rows = fixtures.transactions(spark, SMALL).repartition(13)  # more parts than tasks: few are read once more, for their order
    counted = rows.where(seen.asNondeterministic()("transaction_id"))
    trained = mo.fraud_models(counted, "quick")
    assert trained.metrics.collect()[0]["error"] == ""
    assert reads.value == rows.count()
    assert "ExistingRDD" in trained.predictions._jdf.queryExecution().toString()  # settled, without the model behind it


def test_forests_keep_nodes_and_tasks_go_by_dozens(spark, monkeypatch):
    assert mo.estimators(10)["random_forest"].getCacheNodeIds()
    monkeypatch.setattr(mo, "TRAINING_TASK_ROWS", 100)
    rows = spark.range(1300).selectExpr("CAST(id AS STRING) AS transaction_id", "CAST(id % 2 AS INT) AS label")
    held, n = mo.training_rows(rows.repartition(3))
    assert n == 1300 and held.rdd.getNumPartitions() == 2 * mo.TRAINING_TASKS
