"""Null, bucket and rank rules, and windows over hot keys, on literal rows."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from swipesight.functions import ranks, semantics as se, skew
from swipesight.functions.stats import mann_whitney, welch
from swipesight.operators import customers as cu


def column(df, name):
    return [r[name] for r in df.collect()]


def test_rules_that_cannot_be_evaluated_do_not_fire(spark):
    df = spark.createDataFrame([(1.0, None), (5.0, 2.0)], "a double, b double")
    assert column(df.select((se.is_true(F.col("a") > F.col("b"))).alias("x")), "x") == [False, True]
    assert column(df.select(se.ratio(F.col("a"), F.lit(0)).alias("x")), "x") == [None, None]


def test_cut_edges(spark):
    values = [-1.0, -0.01, 0.0, 0.001, 0.01, 0.0100001, 0.1, 1.0, 1.1]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = column(df.select(se.cut(F.col("v"), [-0.01, 0.001, 0.01, 0.1, 1], list("abcd")).alias("x")), "x")
    assert got == [None, None, "a", "a", "b", "c", "c", "d", None]
    with pytest.raises(ValueError):
        se.cut(F.col("v"), [0, 0, 1], ["a", "b"])


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 1.0, 0.1), (2.0, 4.0, 0.1), (None, 9.0, 0.1)], "a double, b double, c double")
    row = df.agg(se.pair_corr(F.col("a"), F.col("b")).alias("ab"), se.pair_corr(F.col("a"), F.col("c")).alias("ac")).first()
    assert row["ab"] == pytest.approx(1.0) and row["ac"] is None


@pytest.mark.parametrize("n", [1, 2, 7, 500])
def test_quantiles_match_linear_interpolation(spark, n):
    rng = random.Random(n)
    values = [round(rng.expovariate(0.01), 1) for _ in range(n)] + [5.0] * (n // 3)
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {r["p"]: r["q"] for r in ranks.quantiles(df, "v", probabilities).collect()}
    for p in probabilities:
        assert got[p] == pytest.approx(float(np.quantile(values, p)), abs=1e-9)


def test_quantiles_by_group(spark):
    rows = [("a", float(i)) for i in range(100)] + [("b", float(i * i)) for i in range(11)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {(r["g"], r["p"]): r["q"] for r in ranks.quantiles(df, "v", [0.5, 0.75], ["g"]).collect()}
    assert got == {("a", 0.5): 49.5, ("a", 0.75): 74.25, ("b", 0.5): 25.0, ("b", 0.75): 56.5}


@pytest.mark.parametrize("ranges", [None, 1, 7, 200])
def test_running_totals(spark, ranges):
    df = spark.createDataFrame([(i * 7 % 101, i) for i in range(101)], "k int, n int")
    got = {r["k"]: r["n_through"] for r in ranks.running_totals(df, "k", ["n"], ranges=ranges).collect()}
    total = 0
    for k, n in sorted((i * 7 % 101, i) for i in range(101)):
        total += n
        assert got[k] == total


def test_quantile_cut_shares_ties_and_rejects_repeated_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 2, 3, 4, 5, 6, 7, 8, 9]], "v double")
    got = cu.quantile_cut(df, "v", ["low", "high"], "s").groupBy("s").count().collect()
    assert {r["s"]: r["count"] for r in got} == {"low": 5, "high": 5}
    same = spark.createDataFrame([(1.0,)] * 5, "v double")
    with pytest.raises(Exception, match="not unique"):
        cu.quantile_cut(same, "v", ["low", "high"], "s").collect()


@pytest.mark.parametrize("hot_rows", [3, 10, 1_000_000])
def test_windows_are_the_same_for_hot_keys(spark, hot_rows):
    rng = random.Random(4)
    rows = [("hot", rng.randrange(40), i) for i in range(200)] + [("b", i, 1000 + i) for i in range(5)]
    rows += [(None, 1, 2000), (None, 2, 2001)]
    df = spark.createDataFrame(rows, "k string, t int, id int")

    def build(w):
        return {"last": F.lag("id").over(w), "sum4": F.sum("id").over(w.rowsBetween(-3, 0)),
                "n4": F.count("id").over(w.rowsBetween(-3, 0))}

    got = {r["id"]: r for r in skew.ordered_windows(df, "k", ["t", "id"], 3, build, hot_rows).collect()}
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for k, t, i in rows:
        groups[k].append((t, i))
    for k, items in groups.items():
        ids = [i for _, i in sorted(items)]
        for at, i in enumerate(ids):
            recent = ids[max(0, at - 3):at + 1]
            want = (None, None, None) if k is None else (ids[at - 1] if at else None, sum(recent), len(recent))
            assert (got[i]["last"], got[i]["sum4"], got[i]["n4"]) == want


def test_mann_whitney_with_ties(spark):
    a, b = [1.0, 2.0, 2.0, 5.0, 9.0], [2.0, 3.0, 4.0, 4.0, 10.0, 11.0]
    df = spark.createDataFrame([(v, True) for v in a] + [(v, False) for v in b], "v double, m boolean")
    row = mann_whitney(df, "v", "m").first()
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert (row["n1"], row["n2"], row["u"]) == (5, 6, u)
    ties = (3**3 - 3) + (2**3 - 2)
    sd = math.sqrt(30 / 12 * (12 - ties / 110))
    assert row["z"] == pytest.approx((max(u, 30 - u) - 15 - 0.5) / sd)
    assert row["p_value"] == pytest.approx(math.erfc(row["z"] / math.sqrt(2)))


def test_welch(spark):
    # t and freedom by hand: means 3 and 6, variances 2.5 and 14/3
    df = spark.createDataFrame(
        [(float(v), True) for v in [1, 2, 3, 4, 5]] + [(float(v), False) for v in [4, 5, 6, 9]], "v double, m boolean")
    row = welch(df, "v", "m").first()
    e1, e2 = 2.5 / 5, (14 / 3) / 4
    assert row["t"] == pytest.approx(-3 / math.sqrt(e1 + e2))
    assert row["freedom"] == pytest.approx((e1 + e2) ** 2 / (e1**2 / 4 + e2**2 / 3))
    assert 0.05 < row["p_value"] < 0.08  # between the tabulated 0.05 and 0.1 points


def test_student_tail_against_known_points():
    from swipesight.functions.stats import _student_tail

    assert _student_tail(1.0, 1.0) == pytest.approx(0.5, abs=1e-6)
    assert _student_tail(2.228, 10.0) == pytest.approx(0.05, abs=2e-4)
    assert _student_tail(0.0, 5.0) == pytest.approx(1.0, abs=1e-6)


def test_student_tail_of_any_size():
    import math

    from swipesight.functions.stats import _student_tail

    for df, t, p in [(1, 1.0, 0.5), (1, 12.7062047364, 0.05), (2, 4.30265272975, 0.05), (10, 2.22813885196, 0.05), (30, 2.04227245630, 0.05), (120, 1.97993040505, 0.05)]:
        assert abs(_student_tail(t, df) - p) < 1e-8
    for df in (1e7, 1e8, 4e9, 1e10):
        for t in (0.0, 0.5, 1.96, 3.0, 8.0):
            assert abs(_student_tail(t, df) - math.erfc(t / math.sqrt(2))) < 4e-8 * 1e7 / df + 1e-12
    assert abs(_student_tail(1.96, 9.999e5) - _student_tail(1.96, 1.0001e6)) < 1e-8


def test_undersampling_does_not_depend_on_partitioning(spark):
    from swipesight.operators.models import undersample

    rows = spark.range(2000).selectExpr("id", "CAST(id % 10 = 0 AS INT) AS label")
    found = [sorted(r.id for r in undersample(rows.repartition(n)).collect()) for n in (2, 7)]
    assert found[0] == found[1] and 350 < len(found[0]) < 450


def test_exact_mann_whitney_equals_enumeration():
    import itertools

    from swipesight.functions.stats import exact_p, u_distribution

    for n1 in range(1, 9):
        for n2 in range(1, 9):
            counts = [0] * (n1 * n2 + 1)
            for members in itertools.combinations(range(n1 + n2), n1):
                chosen = set(members)
                counts[sum(1 for i in members for j in range(n1 + n2) if j not in chosen and j < i)] += 1
            assert u_distribution(n1, n2) == counts
    assert abs(exact_p(8, 8, 10) - 2 * sum(u_distribution(8, 8)[:11]) / 12870) < 1e-15


def test_exact_mann_whitney_in_spark_and_close_to_normal(spark):
    rows = [(float(v), v % 3 == 0) for v in range(30)]
    df = spark.createDataFrame(rows, "v double, m boolean")
    exact = mann_whitney(df, "v", "m", exact_below=30).first()
    approx = mann_whitney(df, "v", "m").first()
    assert exact.exact and abs(exact.p_value - approx.p_value) < 0.01
    tied = spark.createDataFrame([(1.0, True), (1.0, False), (2.0, True)], "v double, m boolean")
    assert not mann_whitney(tied, "v", "m", exact_below=30).first().exact
