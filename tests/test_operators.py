"""Operators on small hand-made tables, against brute force or numbers worked out by hand."""

import random
from collections import defaultdict, deque
from datetime import datetime, timedelta

import numpy as np
import pytest

from swipesight.operators import features as fe
from swipesight.operators import graph as gr
from swipesight.operators import hypotheses as hy
from swipesight.operators import metrics as me
from swipesight.operators import profiling as pf
from swipesight.operators import temporal as tm
from swipesight.operators import customers as cu

START = datetime(2024, 1, 1)
COLUMNS = (
    "transaction_id string, customer_id string, timestamp timestamp, amount double, is_fraud boolean, "
    "is_high_risk_vendor boolean, is_outside_home_country boolean, country string"
)


def transactions(spark, rows):
    """rows: (customer, seconds from start, amount, fraud)"""
    made = [
        (str(i), c, START + timedelta(seconds=s), a, f, False, False, "X") for i, (c, s, a, f) in enumerate(rows)
    ]
    return spark.createDataFrame(made, COLUMNS)


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_customer_value_days_and_single_rows(spark):
    day = 86400
    df = transactions(spark, [
        ("a", 0, 10.0, False), ("a", 30 * day - 3600, 20.0, True), ("b", 5, 0.0, False), (None, 5, 1.0, True)])
    got = by(cu.customer_totals(df), "customer_id")
    assert set(got) == {"a", "b"}
    assert got["a"]["activity_days"] == 30 and got["b"]["activity_days"] == 1
    assert got["a"]["fraud_count"] == 1 and got["b"]["avg_high_risk_amount"] == 0.0


def test_limits_without_deviation_never_block(spark):
    df = transactions(spark, [("a", 0, 2000.0, False)] + [("b", 60 * i, 10.0, False) for i in range(11)])
    days = by(hy.limit_days(df), "customer_id")
    assert days["a"]["static_block"] and not days["a"]["dynamic_block"]
    assert days["b"]["static_block"] and days["b"]["daily_count"] == 11
    row = hy.limit_summary(hy.limit_days(df)).first()
    assert row["miss_rate_static"] is None and row["goal_met"] in (True, False)


def test_suspicion_of_a_single_transaction(spark):
    scored = by(hy.suspicion_scores(transactions(spark, [
        ("a", 3600, 5.0, True), ("b", 36000, 5.0, False), ("b", 36300, 5.0, False)])), "transaction_id")
    assert [scored[i]["suspicious_score"] for i in "012"] == [1, 0, 1]
    assert scored["2"]["rule_frequent"] and scored["0"]["rule_night"]
    assert scored["1"]["amount_zscore"] == 0.0 and scored["0"]["amount_zscore"] is None


def test_empty_segments_are_kept(spark):
    travel = cu.travel_table(transactions(spark, [("a", 0, 1.0, False)]))
    got = by(hy.insurance_potential(travel), "ordinal")
    assert [got[i]["customers"] for i in range(4)] == [1, 0, 0, 0]
    assert got[0]["expected_revenue"] == pytest.approx(0.2) and got[3]["expected_revenue"] == 0.0


def test_bots(spark):
    rows = [("steady", 1000 * i, 1.0, False) for i in range(6)]
    rows += [("fast", s, 1.0, True) for s in (0, 1, 59, 60, 100, 101, 130, 131)]
    rows += [("human", s, 1.0, False) for s in (0, 500, 9000, 9100, 50000)]
    rows += [("edge", 0, 1.0, False), ("edge", 0.5, 1.0, False), ("edge", 172801, 1.0, False)]
    got = by(tm.arrival_patterns(transactions(spark, rows)), "customer_id")
    assert set(got) == {"steady", "fast", "human"}
    assert got["steady"]["low_variability"] and got["fast"]["high_frequency"] and not got["human"]["bot_like"]


def test_hourly_series_fills_gaps(spark):
    df = transactions(spark, [("a", 0, 1.0, True), ("a", 3 * 3600, 1.0, False), ("a", 3 * 3600 + 5, 1.0, True)])
    rates = [r["fraud_rate"] for r in tm.hourly_series(df).orderBy("t").collect()]
    assert rates == [1.0, 0.0, 0.0, 0.5]
    acf = by(tm.autocorrelation(tm.hourly_series(df), lags=2), "lag")
    x = np.array(rates) - np.mean(rates)
    for lag in range(3):
        assert acf[lag]["acf"] == pytest.approx((x[: 4 - lag] * x[lag:]).sum() / (x * x).sum())


def brute_clusters(points, eps, least):
    """Density clusters of points by definition."""
    scaled = (points - points.mean(axis=0)) / np.where(points.std(axis=0) == 0, 1, points.std(axis=0))
    near = ((scaled[:, None] - scaled[None]) ** 2).sum(axis=2) <= eps * eps
    core = near.sum(axis=1) >= least
    label = -np.ones(len(points), dtype=int)
    found = 0
    for i in range(len(points)):
        if core[i] and label[i] < 0:
            label[i] = found
            wait = deque([i])
            while wait:
                for j in np.flatnonzero(near[wait.popleft()]):
                    if label[j] < 0:
                        label[j] = found
                        if core[j]:
                            wait.append(j)
            found += 1
    return label, core


def test_time_clusters_match_the_definition(spark):
    rng = random.Random(1)
    minutes = [rng.gauss(120, 10) for _ in range(40)] + [rng.gauss(1200, 15) for _ in range(30)]
    days = [rng.choice([0, 1]) for _ in range(40)] + [rng.choice([5, 6]) for _ in range(30)]
    minutes += [700, 650, 5]
    days += [3, 6, 6]
    rows = [("a", int(d * 86400 + int(m) * 60), 1.0, True) for m, d in zip(minutes, days)]
    got = tm.time_clusters(transactions(spark, rows))
    cells = {(r["minute"], r["weekday"]): r for r in got.collect()}
    points = np.array([(int(m), d) for m, d in zip(minutes, days)], dtype=float)
    label, core = brute_clusters(points, 0.5, 5)
    groups = defaultdict(set)
    for (m, d), want, is_core in zip(points, label, core):
        cell = cells[(int(m), int(d))]
        assert cell["core"] == bool(is_core)
        assert (cell["cluster"] == -1) == (want == -1)
        if is_core:
            groups[want].add(cell["cluster"])
    assert all(len(g) == 1 for g in groups.values()) and len(set(map(tuple, groups.values()))) == len(groups)
    summary = tm.cluster_summary(got).first()
    assert summary["clusters"] == label.max() + 1 and summary["noise"] == int((label == -1).sum())


# --- graph ----------------------------------------------------------------------------------


def uses(spark, devices, ips=()):
    rows = [(c, f"d{k}", None) for k, group in enumerate(devices) for c in group]
    rows += [(c, None, f"i{k}") for k, group in enumerate(ips) for c in group]
    made = [(str(i), c, d, p, i % 3 == 0) for i, (c, d, p) in enumerate(rows)]
    return spark.createDataFrame(
        made, "transaction_id string, customer_id string, device_fingerprint string, ip_address string, is_fraud boolean")


def neighbours(devices, ips=()):
    out = defaultdict(set)
    for group in [*devices, *ips]:
        for a in group:
            out[a] |= set(group) - {a}
    return out


def brute_betweenness(adjacent):
    nodes, total = sorted(adjacent), defaultdict(float)
    for s in nodes:
        paths, far, order = defaultdict(float, {s: 1.0}), {s: 0}, [s]
        for v in order:
            for w in sorted(adjacent[v]):
                if w not in far:
                    far[w] = far[v] + 1
                    order.append(w)
                if far[w] == far[v] + 1:
                    paths[w] += paths[v]
        owed = defaultdict(float)
        for w in reversed(order):
            for v in adjacent[w]:
                if far.get(v) == far[w] - 1:
                    owed[v] += paths[v] / paths[w] * (1 + owed[w])
            if w != s:
                total[w] += owed[w]
    n = len(nodes)
    return {v: total[v] / ((n - 1) * (n - 2)) for v in nodes}


RNG = random.Random(7)
NAMES = [f"c{i:02d}" for i in range(14)]
SHAPES = {
    "path": ([["a", "b"], ["b", "c"], ["c", "d"], ["d", "e"]], []),
    "star": ([["x", "a"], ["x", "b"], ["x", "c"], ["x", "d"]], []),
    "alone": ([["a", "b", "c"], ["z"]], [["a", "b"]]),
    "mixed": ([RNG.sample(NAMES, RNG.choice([2, 3, 6])) for _ in range(7)] + [[n] for n in NAMES],
              [RNG.sample(NAMES, RNG.choice([2, 5])) for _ in range(4)]),
}


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("hub", [1000, 3])
def test_graph_with_and_without_hubs(spark, shape, hub):
    devices, ips = SHAPES[shape]
    df = uses(spark, devices, ips)
    adjacent = neighbours(devices, ips)
    for group in [*devices, *ips]:
        for c in group:
            adjacent[c]
    graph = gr.customer_graph(df, hub)
    degree = {r["customer_id"]: r["degree"] for r in gr.degrees(graph).collect()}
    assert degree == {c: len(near) for c, near in adjacent.items()}
    between = {r["customer_id"]: r["betweenness"] for r in gr.betweenness(graph).collect()}
    assert between == pytest.approx(brute_betweenness(adjacent))
    # the written pairs and the hub rows together are the whole graph
    pairs, members = set(), defaultdict(set)
    for r in gr.customer_links(df, hub).collect():
        if r["hub"]:
            members[r["hub"]].add(r["src"])
        else:
            pairs.add((r["src"], r["dst"]))
            shared = sum({r["src"], r["dst"]} <= set(g) for g in [*devices, *ips])
            assert r["weight"] == shared
    for group in members.values():
        pairs |= {(a, b) for a in group for b in group if a < b}
    assert pairs == {(a, b) for a in adjacent for b in adjacent[a] if a < b}


@pytest.mark.parametrize("shape", SHAPES)
def test_components_and_communities(spark, shape):
    devices, ips = SHAPES[shape]
    df = uses(spark, devices, ips)
    adjacent, want = neighbours(devices, ips), {}
    for c in {c for g in [*devices, *ips] for c in g}:
        seen, wait = {c}, [c]
        while wait:
            for w in adjacent[wait.pop()] - seen:
                seen.add(w)
                wait.append(w)
        want[c] = min(seen)
    members = gr.shared_keys(gr.incidence(df))
    customers = df.select("customer_id").distinct()
    got = {r["customer_id"]: r["component"] for r in gr.connected_components(members, customers).collect()}
    assert got == want
    labels = gr.communities(members, customers)
    named = {r["customer_id"]: r["community"] for r in labels.collect()}
    assert set(named) == set(want) and all(want[c] == want[l] for c, l in named.items())
    # modularity against the sum over pairs
    weight = defaultdict(float)
    for group in [*devices, *ips]:
        for a in group:
            for b in group:
                if a != b:
                    weight[a, b] += 1
    total = sum(weight.values())
    strength = defaultdict(float)
    for (a, _), w in weight.items():
        strength[a] += w
    q = sum(
        (weight[a, b] - strength[a] * strength[b] / total) / total
        for a in want for b in want if named[a] == named[b]
    )
    assert gr.modularity(members, labels).first()[0] == pytest.approx(q)


# --- metrics --------------------------------------------------------------------------------


def test_metrics_on_twelve_predictions(spark):
    labels = [1, 0, 1, 1, 0, 0, 1, 0, 0, 0, 1, 0]
    scores = [0.9, 0.9, 0.8, 0.7, 0.7, 0.7, 0.5, 0.4, 0.4, 0.2, 0.2, 0.1]
    rows = [(str(i), y, int(s >= 0.5), s) for i, (y, s) in enumerate(zip(labels, scores))]
    df = spark.createDataFrame(rows, "id string, label int, prediction int, score double")
    row = me.all_metrics(df).first()
    assert (row["tp"], row["fp"], row["tn"], row["fn"]) == (4, 3, 4, 1)
    pairs = [(a, b) for a, y in zip(scores, labels) if y for b, z in zip(scores, labels) if not z]
    assert row["roc_auc"] == pytest.approx(sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs))
    precision, last = 0.0, 0
    for cut in sorted(set(scores), reverse=True):
        taken = [y for y, s in zip(labels, scores) if s >= cut]
        precision += (sum(taken) - last) / 5 * sum(taken) / len(taken)
        last = sum(taken)
    assert row["avg_precision"] == pytest.approx(precision)
    money = me.business_report(me.confusion(df)).first()
    assert (money["saved"], money["total_cost"], money["net_savings"]) == (4000, 10150, -6150)


def test_metrics_of_one_class_and_constant_scores(spark):
    df = spark.createDataFrame([("a", 0, 0, 0.5), ("b", 0, 0, 0.5)], "id string, label int, prediction int, score double")
    row = me.all_metrics(df).first()
    assert (row["precision"], row["recall"], row["f1"], row["roc_auc"], row["avg_precision"]) == (0, 0, 0, 0.5, 0)


# --- features and profile ---------------------------------------------------------------------


def test_rolling_features_split_hot_customers(spark):
    rng = random.Random(2)
    rows = [(str(i), "a" if i % 3 else f"b{i % 4}", START + timedelta(seconds=rng.randrange(50)), float(i), f"v{i % 5}")
            for i in range(150)]
    df = spark.createDataFrame(rows, "transaction_id string, customer_id string, timestamp timestamp, amount double, vendor string")
    whole = {r["transaction_id"]: r for r in fe.rolling_features(df).collect()}
    cut = {r["transaction_id"]: r for r in fe.rolling_features(df, hot_rows=8).collect()}
    assert whole == cut


def test_missing_and_filled(spark):
    df = spark.createDataFrame([(1.0, None), (None, "x"), (4.0, "y"), (9.0, None)], "a double, b string")
    gaps = {r["column"]: (r["missing"], r["percent"]) for r in pf.missing_values(df).collect()}
    assert gaps == {"a": (1, 25.0), "b": (2, 50.0)}
    assert pf.mostly_missing(df) == [] and pf.mostly_missing(df, 0.4) == ["b"]
    filled = pf.fill_gaps(df, {"b": "missing"}, ["a"])
    assert sorted((r["a"], r["b"]) for r in filled.collect()) == [
        (1.0, "missing"), (4.0, "x"), (4.0, "y"), (9.0, "missing")]
    assert [t for t in pf.column_types(df).select("type").toPandas()["type"]] == ["double", "string"]


def test_histogram_of_equal_values(spark):
    df = spark.createDataFrame([(2.0,)] * 3 + [(None,)], "v double")
    got = {r["bin"]: r["n"] for r in pf.histogram(df, "v", 4).collect()}
    assert got == {1: 3, 2: 0, 3: 0, 4: 0}


def _dense_pagerank(rows, damping=0.85):
    keys = defaultdict(set)
    customers = sorted({c for c, _, _ in rows if c is not None})
    for c, device, ip in rows:
        if c is not None:
            if device is not None:
                keys[("device", device)].add(c)
            if ip is not None:
                keys[("ip", ip)].add(c)
    index = {c: i for i, c in enumerate(customers)}
    n = len(customers)
    w = np.zeros((n, n))
    for members in keys.values():
        for a in members:
            for b in members:
                if a != b:
                    w[index[a], index[b]] += 1
    out = w.sum(1)
    r = np.full(n, 1 / n)
    for _ in range(2000):
        flow = (r[out > 0] / out[out > 0]) @ w[out > 0]
        r = (1 - damping) / n + damping * (flow + r[out == 0].sum() / n)
    return dict(zip(customers, r))


def test_pagerank_equals_dense_power_iteration(spark):
    rng = random.Random(5)
    rows = [(f"c{i}", f"d{rng.randrange(12)}", f"i{rng.randrange(30)}") for i in range(60)]
    rows += [(f"h{i}", "hub-device", None) for i in range(25)] + [("lone", None, None), (None, "d1", "i1")]
    t = spark.createDataFrame(rows, "customer_id string, device_fingerprint string, ip_address string")
    members = gr.shared_keys(gr.incidence(t))
    got = {r.customer_id: r.pagerank for r in gr.pagerank(members, t.select("customer_id").where("customer_id IS NOT NULL")).collect()}
    want = _dense_pagerank(rows)
    assert got.keys() == want.keys()
    assert max(abs(got[c] - want[c]) for c in want) < 1e-10
    assert abs(sum(got.values()) - 1) < 1e-9
    empty = t.limit(0)
    assert gr.pagerank(gr.shared_keys(gr.incidence(empty)), empty.select("customer_id")).count() == 0


def test_drift_monitor_finds_planted_change_and_keeps_empty_days(spark):
    from swipesight.operators.drift import drift

    rng = random.Random(9)
    rows = []
    for day in range(20):
        if day == 12:
            continue  # a day without transactions
        for k in range(200):
            late = day >= 14
            amount = 10.0 if day < 7 and k % 2 else (rng.uniform(50, 100) * (3 if late else 1))
            rows.append((datetime(2024, 3, 1) + timedelta(days=day, minutes=k), amount, rng.random() < (0.5 if late else 0.1)))
    rows += [(None, 5.0, True), (datetime(2024, 3, 2), None, None)]
    tx = spark.createDataFrame(rows, "timestamp timestamp, amount double, is_fraud boolean")
    got = {r.period_start.day - 1: r for r in drift(tx).collect()}
    assert sorted(got) == list(range(20))
    assert got[12].transactions == 0 and got[12].psi is None and got[12].fraud_rate is None and not got[12].change_point
    assert got[1].transactions == 201 and got[3].psi_level == "stable"
    assert got[15].psi_level == "major"
    assert any(got[d].change_point for d in range(14, 17)) and not any(got[d].change_point for d in range(0, 12))


def _partitions(items):
    if not items:
        yield []
        return
    first, rest = items[0], items[1:]
    for part in _partitions(rest):
        for i in range(len(part)):
            yield part[:i] + [[first] + part[i]] + part[i + 1:]
        yield [[first]] + part


def _modularity(w, groups):
    two_m = w.sum()
    k = w.sum(1)
    return sum(w[np.ix_(g, g)].sum() / two_m - (k[g].sum() / two_m) ** 2 for g in groups)


@pytest.mark.parametrize("seed", [1, 2])
def test_louvain_near_brute_force_optimum(spark, seed):
    rng = random.Random(seed)
    rows = []
    for key in range(9):
        for c in rng.sample(range(10), rng.choice([2, 2, 3, 4])):
            rows.append((f"c{c}", f"d{key}", None))
    rows += [(f"c{c}", None, None) for c in range(10)]
    t = spark.createDataFrame(rows, "customer_id string, device_fingerprint string, ip_address string")
    members = gr.shared_keys(gr.incidence(t))
    customers = t.select("customer_id").distinct()
    first = gr.louvain(members, customers)
    got = gr.modularity(members, first).first().modularity
    w = np.zeros((10, 10))
    for key in range(9):
        users = sorted({int(c[1:]) for c, d, _ in rows if d == f"d{key}"})
        for a in users:
            for b in users:
                if a != b:
                    w[a, b] += 1
    best = max(_modularity(w, g) for g in _partitions(list(range(10))))
    assert got >= 0.95 * best - 1e-9
    assert got >= gr.modularity(members, gr.communities(members, customers)).first().modularity - 1e-9
    again = gr.louvain(members, customers)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect()))
